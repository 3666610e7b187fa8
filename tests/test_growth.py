"""Steps that grew faster than the catalogue."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from bibspark.functions import kernels
from bibspark.operators import detect, quotient, recommend

from .test_goldens import frame


def test_isbns_of_one_book_only_make_no_nodes_of_their_own(spark):
    n = 3000
    own = detect.prepared(frame(spark, [(i, "三体", "刘慈欣", f"{9780000000000 + i}" if i % 3 else "", 7, 100 + i, "epub") for i in range(n)]).withColumn("isbn_normalized", F.col("isbn"))).cache()
    assert own.select("isbn_normalized").distinct().count() > 1000
    assert own.select("node").distinct().count() == 2
    members = own.select(F.lit("b").alias("bucket"), "ord", "node")
    assert detect._scored(own, members).count() == 3  # before: a pair for each two books with an ISBN
    assert own.count() == n


def test_kinds_of_isbns_give_what_every_isbn_gives(spark):
    rng = random.Random(5)
    titles, authors = ["活着", "《活着》(珍藏版)", "War and Peace", "War & Peace", "?", "!"], ["余华", "余华 著", "路遥", "路遥远", "Leo Tolstoy", "Alexei Tolstoy", ""]
    shared = ["9787020089543", "9780306406157"]
    rows = [
        (i, rng.choice(titles), rng.choice(authors), rng.choice(["", *shared, *[str(9780000000000 + 37 * i)] * 3]), rng.choice([0, 5, 7, rng.getrandbits(62)]), rng.choice([0, 85, 100, rng.randint(1, 999)]), rng.choice(["epub", "pdf", ""]))
        for i in range(300)
    ]
    kinds = detect.prepared(frame(spark, rows).withColumn("isbn_normalized", F.col("isbn"))).cache()
    every = kinds.drop("isbn_key").withColumn("node", quotient.node_of()).cache()
    assert kinds.select("node").distinct().count() < every.select("node").distinct().count() * 0.7
    sizes = []
    for kind in ("title_author_simhash", "title_with_author_check", "simhash_content"):
        found = []
        for books in (kinds, every):
            members, similar = detect.run_stage(kind, books, detect.MatchConfig())
            found.append(({tuple(r) for r in members.collect()}, dict(similar.collect())))
        assert found[0][0] == found[1][0]
        sizes.append(len(found[0][0]))
        assert found[0][1] == pytest.approx(found[1][1], abs=1e-9)
    assert sum(sizes) > 50


def test_scores_equal_to_nine_digits_are_ties(spark):
    rows = spark.createDataFrame([("g", 0, 0.1 + 0.2 + 0.3), ("g", 1, 0.1 + 0.2 + 0.3 + 2e-16), ("g", 2, 0.7)], "group_id string, member_pos int, score double")
    assert {r["member_pos"]: r["rank"] for r in recommend.ranked(rows).collect()} == {2: 1, 0: 2, 1: 3}


def test_memory_of_title_kernels_is_small_whatever_the_titles():
    rng = random.Random(2)
    titles = [" ".join("".join(rng.choice("abcdefghiklmnorstu") for _ in range(6)) for _ in range(8)) for _ in range(8000)]
    tracemalloc.start()
    for a, b in zip(titles, titles[1:]):
        kernels.title(a, b)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 40e6
