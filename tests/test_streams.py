"""Keyed state of streams against their batch forms: replays, duplicates, late rows, expiry."""

import datetime as dt
import random
import shutil

import pandas as pd
from pyspark.sql import functions as F

from bibspark.sources import epub
from bibspark.streaming import incremental

BOOK = "file_path string, title string, n int"


def run(spark, folder, tmp_path, name="s", known=None):
    books = spark.readStream.schema(BOOK).json(str(folder))
    incremental.append_new(books, str(tmp_path / f"{name}-store"), str(tmp_path / f"{name}-ckpt"), known).awaitTermination()
    return sorted(r["file_path"] for r in spark.read.parquet(str(tmp_path / f"{name}-store")).collect())


def put(folder, name, *paths):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(f'{{"file_path": "{p}", "title": "t", "n": {i}}}\n' for i, p in enumerate(paths)))


def test_import_keeps_state_across_batches_and_starts(spark, tmp_path):
    folder = tmp_path / "in"
    known = spark.createDataFrame([("/old",)], "file_path string")
    put(folder, "1.json", "/a", "/b", "/a", "/old")
    assert run(spark, folder, tmp_path, known=known) == ["/a", "/b"]
    put(folder, "2.json", "/b", "/c", "/old")
    put(folder, "3.json", "/c", "/d")
    assert run(spark, folder, tmp_path, known=known) == ["/a", "/b", "/c", "/d"]
    assert run(spark, folder, tmp_path, known=known) == ["/a", "/b", "/c", "/d"]  # nothing new


def test_replayed_batch_adds_nothing_twice(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "1.json", "/a", "/b")
    assert run(spark, folder, tmp_path) == ["/a", "/b"]
    put(folder, "2.json", "/b", "/c")
    assert run(spark, folder, tmp_path) == ["/a", "/b", "/c"]
    # as if the driver had died after the sink's commit, before the engine's: the last batch runs again
    last = max(int(p.name) for p in (tmp_path / "s-ckpt" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "s-ckpt" / "commits").iterdir():
        if p.name.lstrip(".").startswith(f"{last}"):
            p.unlink()
    assert run(spark, folder, tmp_path) == ["/a", "/b", "/c"]


def test_same_file_under_two_scans(spark, tmp_path):
    """A file that comes again under its old path is no new book."""
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.epub").write_bytes(epub.make("A", "X", "text"))
    go = lambda: incremental.import_stream(spark, str(folder), str(tmp_path / "store"), str(tmp_path / "ckpt")).awaitTermination()
    go()
    shutil.copy(folder / "a.epub", folder / "b.epub")
    (folder / "a.epub").unlink()
    (folder / "a.epub").write_bytes(epub.make("A2", "X", "text"))
    go()
    assert sorted(r["title"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["A", "A"]


def outcomes(df):
    return sorted(map(tuple, df.select("id", F.unix_micros("deleted"), "outcome", F.unix_micros("ended")).collect()))


def test_life_cycle_equals_batch_form(spark, tmp_path):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(str(rng.randrange(25)), k, rng.choice(["delete", "delete", "restore", "purge"]), start + dt.timedelta(seconds=rng.randrange(60 * 86_400), microseconds=rng.randrange(3) * 500)) for k in range(400)]
    rows += [("tie", 900, "delete", start), ("tie", 901, "restore", start), ("edge", 902, "delete", start), ("edge", 903, "restore", start + dt.timedelta(days=10))]
    rows.sort(key=lambda r: r[3])
    schema = "id string, seq long, kind string, ts timestamp"
    folder = str(tmp_path / "in")
    for k in range(4):  # four batches in order of time, each shuffled
        own = rows[k * 101 : (k + 1) * 101] if k < 3 else rows[303:]
        rng.shuffle(own)
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(folder)
        found = incremental.bin_outcomes_stream(spark.readStream.schema(schema).parquet(folder), 10)
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    everything = spark.createDataFrame(rows, schema)
    want = outcomes(incremental.bin_outcomes(everything, 10))
    got = outcomes(spark.read.parquet(str(tmp_path / "out")))
    # the last event itself waits for the watermark to pass it
    end = max(r[3] for r in rows)
    last = [x for x in want if x[3] >= int(end.timestamp()) * 1_000_000]
    assert [x for x in want if x not in last] == [x for x in got if x not in last] and set(got) <= set(want)
    assert {x[2] for x in got} == {"restored", "purged", "replaced", "expired"}


def test_known_and_null_paths_in_the_batch_that_brings_them(spark, tmp_path):
    """Known paths and new ones meet in the first batch; a later start without a catalogue still knows them."""
    folder = tmp_path / "in"
    known = spark.createDataFrame([(f"/k{i}",) for i in range(300)] + [("/k1",)], "file_path string")
    put(folder, "1.json", *(f"/k{i}" for i in range(0, 300, 2)), *(f"/n{i}" for i in range(50)))
    with (folder / "0.json").open("w") as f:
        f.write('{"title": "no path"}\n{"title": "no path either"}\n')

    def go(known):
        books = spark.readStream.schema(BOOK).json(str(folder))
        incremental.append_new(books, str(tmp_path / "store"), str(tmp_path / "ckpt"), known).awaitTermination()
        return sorted(r["file_path"] or "" for r in spark.read.parquet(str(tmp_path / "store")).collect())

    want = sorted(["", *(f"/n{i}" for i in range(50))])
    assert go(known) == want
    put(folder, "2.json", "/k3", "/k4", "/n1", "/new")
    assert go(None) == sorted([*want, "/new"])


def test_one_timer_for_all_waiting_events():
    """Timers do not grow with a file's events: one a batch, and one for what is still to come."""

    class Held:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            return iter(self.rows) if isinstance(self.rows, list) else self.rows

        def exists(self):
            return bool(self.rows)

        def appendList(self, rows):
            self.rows, self.calls = self.rows + rows, self.calls + 1

        def appendValue(self, row):
            self.appendList([row])

        def put(self, rows):
            self.rows = list(rows)

        def update(self, row):
            self.rows = row

        def clear(self):
            self.rows = []

    class Handle:
        timers = set()

        def registerTimer(self, at):
            self.timers.add(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 500

    state, handle = incremental._Bin(1), Handle()
    state.handle, state.waiting, state.bin = handle, Held(), Held()
    events = pd.DataFrame({"us": [i * 10_000 for i in range(100)], "seq": range(100), "kind": ["delete"] * 100})
    list(state.handleInputRows(("a",), iter([events]), None))
    assert handle.timers == {1} and state.waiting.calls == 1
    handle.timers = set()
    (out,) = state.handleExpiredTimer(("a",), Now(), None)
    assert len(out) == 49 and len(state.waiting.rows) == 50 and state.bin.rows == (490_000,)
    assert handle.timers == {501, 86_400_491}


def test_import_keeps_paths_without_python(spark, tmp_path):
    (tmp_path / "in").mkdir()
    plan = incremental.first_seen(spark.readStream.schema(BOOK).json(str(tmp_path / "in")), "file_path", str(tmp_path / "ckpt"))._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "Python" not in plan and "Pandas" not in plan, plan
