"""The index log and the lookup source, against plain forms and a server of the test's own."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from bibspark.operators import enrich
from bibspark.sources import files, index_log, lookup

ROW = "seq long, op string, id string, original_path string, recycle_path string, file_name string, file_size long, deleted_at string, metadata map<string,string>"


def events(spark, *rows):
    return spark.createDataFrame([(seq, op, i, f"/{i}", None if op == "drop" else f"/bin/{i}", f"{i}.epub", size, "2024-01-01T00:00:00", {"title": i}) for seq, op, i, size in rows], ROW)


def standing(spark, path):
    return sorted((r["id"], r["file_size"], (r["metadata"] or {}).get("title")) for r in index_log.load(spark, path).collect())


def test_log_write_read_compact(spark, tmp_path):
    path = str(tmp_path / "index")
    assert standing(spark, path) == []
    index_log.append(events(spark, (1, "put", "a", 10), (2, "put", "b", 20), (3, "put", "c", 30)), path)
    index_log.append(events(spark, (5, "put", "a", 11), (4, "put", "a", 99), (6, "drop", "b", 0)), path)
    index_log.append(events(spark, (5, "put", "a", 11)), path)  # written twice
    want = [("a", 11, "a"), ("c", 30, "c")]
    assert standing(spark, path) == want
    index_log.compact(spark, path)
    assert standing(spark, path) == want and index_log.version(spark, path) == 1
    # the base is the plain JSON index
    plain = files.index_from_json(spark.read.text(f"{path}/v=1/base"))
    assert sorted(r["id"] for r in plain.collect()) == ["a", "c"]
    index_log.append(events(spark, (7, "drop", "c", 0), (8, "put", "b", 21)), path)
    index_log.compact(spark, path)
    assert standing(spark, path) == [("a", 11, "a"), ("b", 21, "b")]
    assert [p.name for p in (tmp_path / "index").iterdir()] == ["v=2"]


def test_compaction_that_dies_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    index_log.append(events(spark, (1, "put", "a", 10)), path)
    half = tmp_path / "index" / "v=1" / "base"
    half.mkdir(parents=True)
    (half / "part-0.txt").write_text('{"z": {}}\n')
    assert standing(spark, path) == [("a", 10, "a")]
    assert index_log.version(spark, path) == 0


class Handler(BaseHTTPRequestHandler):
    seen: Counter = Counter()

    def do_GET(self):
        Handler.seen[self.path] += 1
        key = self.path.rsplit("/", 1)[1].removesuffix(".json")
        if key == "flaky" and Handler.seen[self.path] < 3 or key == "broken":
            self.send_error(503)
        elif key == "none":
            self.send_error(404)
        else:
            body = json.dumps({"title": f"T {key}", "publishers": ["P"]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    Handler.seen.clear()
    own = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_address[1]}"
    own.shutdown()


def test_lookup(spark, tmp_path, server):
    keys = spark.createDataFrame([("a b",), ("a b",), ("flaky",), ("broken",), ("none",), (None,), ("x",)], "isbn string")
    found = lookup.fetch(keys, "isbn", server + "/isbn/{key}.json", str(tmp_path / "keys"), requests_at_once=3, pause=0.01)
    rows = {r["key"]: r for r in found.collect()}
    assert set(rows) == {"a b", "flaky", "broken", "none", "x"}
    assert json.loads(rows["a b"]["body"])["title"] == "T a%20b" and rows["flaky"]["status"] == 200
    assert rows["none"]["status"] == 404 and rows["none"]["body"] is None
    assert rows["broken"]["status"] is None and "503" in rows["broken"]["error"]
    assert Handler.seen["/isbn/flaky.json"] == 3 and Handler.seen["/isbn/broken.json"] == 3 and Handler.seen["/isbn/none.json"] == 1
    assert found.rdd.getNumPartitions() <= 3


def test_lookup_without_a_server(spark, tmp_path):
    keys = spark.createDataFrame([("x",)], "isbn string")
    (row,) = lookup.fetch(keys, "isbn", "http://127.0.0.1:1/{key}", str(tmp_path / "keys"), tries=2, pause=0.01, timeout=1).collect()
    assert row["status"] is None and row["error"]


def test_answers_feed_the_parsers(spark, tmp_path, server):
    found = lookup.fetch(spark.createDataFrame([("9780306406157",)], "isbn string"), "isbn", server + "/isbn/{key}.json", str(tmp_path / "keys"))
    record = enrich.parse_isbn_record(found.filter(F.col("status") == 200)).first()
    assert (record["key"], record["title"], record["publisher"]) == ("9780306406157", "T 9780306406157", "P")


def test_files_come_to_python_as_rows(spark):
    """No batch of thousands of files is held at once; missing contents and changes are as ever."""
    from pyspark.util import PythonEvalType

    from bibspark.sources import epub, files

    assert files.parse_content.evalType == PythonEvalType.SQL_BATCHED_UDF
    good = epub.make("A", "X", "text", tags=("one",))
    rows = spark.createDataFrame([("/a.epub", good, {"title": "B"}), ("/b.epub", good, None), ("/c.epub", None, {"title": "B"}), ("/d.epub", b"broken", {})], "path string, content binary, changes map<string,string>")
    saved = files.save_epub_rows(rows)
    assert "ArrowEval" not in saved._jdf.queryExecution().executedPlan().toString()
    found = {r["file_path"]: (r["title"], r["author"], r["tags"], r["cover_path"]) for r in files.parse(saved.selectExpr("path", "saved AS content", "1L AS length")).collect()}
    assert found == {"/a.epub": ("B", "X", ["one"], "cover.jpg"), "/b.epub": ("A", "X", ["one"], "cover.jpg"), "/c.epub": ("c", "", [], None), "/d.epub": ("d", "", [], None)}
