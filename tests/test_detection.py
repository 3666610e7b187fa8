"""Detection on what used to be paired book by book: hot buckets, long chains, bounds of the candidate index."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspark.functions import kernels
from bibspark.operators import candidates, cluster, detect, quotient

from .test_goldens import frame


def test_chain_of_ten_thousand_in_one_sweep(spark):
    n = 10_000
    members = spark.range(n).select(F.lit("b").alias("bucket"), F.col("id").alias("ord"))
    edges = spark.range(n - 1).select(F.lit("b").alias("bucket"), F.col("id").alias("j"), (F.col("id") + 1).alias("i"))
    assert cluster.reachable(members, edges).count() == n
    assert cluster.reachable(members, edges.filter("j <> 4000")).count() == 4001
    found = {r["ord"]: r["seed"] for r in cluster.stars(edges.select("j", "i")).collect()}
    assert found == {i: i - i % 2 for i in range(n)}


def test_acceptance_over_nodes_equals_naive_loop(spark):
    rng = random.Random(11)
    members, arcs, edges, want = [], [], [], {}
    for g in range(80):
        n, kinds = rng.randint(1, 30), rng.randint(1, 5)
        node = [rng.randrange(kinds) for _ in range(n)]
        match = {(a, b) for a in range(kinds) for b in range(kinds) if rng.random() < 0.25}
        single = {(j, i) for j in range(n) for i in range(j + 1, n) if rng.random() < 0.03}
        kept = [0]
        for i in range(1, n):
            if any((node[j], node[i]) in match or (j, i) in single for j in kept):
                kept.append(i)
        want[str(g)] = kept
        members += [(str(g), 5000 * i, str(node[i])) for i in range(n)]  # apart, so that runs are thinned and not
        arcs += [(str(g), str(a), str(b)) for a, b in match]
        edges += [(str(g), 5000 * j, 5000 * i) for j, i in single]
    got = defaultdict(list)
    frames = spark.createDataFrame(members, "bucket string, ord long, node string"), spark.createDataFrame(arcs, "bucket string, src string, dst string"), spark.createDataFrame(edges, "bucket string, j long, i long")
    for r in cluster.accepted(*frames).collect():
        got[r["bucket"]].append(r["ord"] // 5000)
    assert {k: sorted(v) for k, v in got.items()} == want
    near = [(b, o // 5000, x) for b, o, x in members], arcs, [(b, j // 5000, i // 5000) for b, j, i in edges]
    again = cluster.accepted(*(spark.createDataFrame(rows, f.schema) for rows, f in zip(near, frames, strict=True)))
    got = defaultdict(list)
    for r in again.collect():
        got[r["bucket"]].append(r["ord"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_sums_equal_pairs(spark):
    rng = random.Random(3)
    titles, authors = ["活着", "《活着》(珍藏版)", "War and Peace", "War & Peace", "人生"], ["余华", "余华 著", "余秋雨", "Leo Tolstoy", "Alexei Tolstoy", ""]
    rows = [
        (i, rng.choice(titles), rng.choice(authors), rng.choice(["", "", "9787020089543", "9780306406157"]), rng.choice([0, 5, 7, -3, rng.getrandbits(62)]), rng.choice([0, 85, 100, 120, rng.randint(1, 999)]), rng.choice(["epub", "PDF", "pdf", ""]))
        for i in range(400)
    ]
    books = frame(spark, rows).withColumn("node", quotient.node_of()).cache()
    members = books.select((F.col("ord") % 3).cast("string").alias("bucket"), "ord", "node").cache()
    scored = detect._scored(books, members)
    pairs, sums = ({r["bucket"]: r["similarity"] for r in quotient.mean_similarity(scored, members, books, few).collect()} for few in (1 << 40, 0))
    assert len(pairs) == 3 and sums == pytest.approx(pairs, abs=1e-12)
    assert quotient.mean_similarity(scored, members.limit(0), books).count() == 0


def test_hundred_thousand_books_of_one_title(spark):
    n = 100_000
    books = spark.range(n).select(
        F.col("id").alias("ord"), F.lit("三体").alias("title"), F.lit("刘慈欣").alias("author"), F.lit("刘慈欣").alias("author_clean"), F.lit("刘慈欣").alias("author_form"), F.lit("").alias("isbn_normalized"),
        F.lit(0).cast("long").alias("simhash"), (F.col("id") % 1000 + 1).alias("file_size"), F.when(F.col("id") % 2 == 0, "epub").otherwise("pdf").alias("file_format"), F.lit("t").alias("title_key"), F.lit("ta").alias("title_author_key"),
    )
    groups, members = detect.detect(books)
    (group,) = groups.collect()
    assert (group["match_type"], group["n_books"], members.count()) == ("title_author_simhash", n, n)
    # sizes 1 to 1000 a hundred times each, all of one size in one format
    size = np.arange(1, 1001)
    share = np.minimum.outer(size, size) / np.maximum.outer(size, size)
    score = np.where((size[:, None] + size) % 2, np.minimum(share + 0.15, 1.0), share)
    mean = (score.sum() * 100 * 100 - 1000 * 100) / (n * (n - 1))
    w = {k: v for k, v in zip(("author", "title", "size"), (0.69 + 0.1375 * 0.6, 0.1425 + 0.1375 * 0.25, 0.03 + 0.1375 * 0.15), strict=True)}
    assert group["similarity"] == pytest.approx(w["author"] + w["title"] + w["size"] * mean, abs=1e-9)


def test_stages_that_need_no_equal_authors_fire(spark):
    rows = [
        (0, "War and Peace", "Leo Tolstoy", "", 0, 100, "epub"),
        (1, "War & Peace", "Tolstoy, Leo Tolstoy", "", 0, 110, "epub"),
        (2, "平凡的世界", "刘慈欣", "", 77, 100, "epub"),
        (3, "平凡的世界上", "刘慈欣 著", "", 77, 100, "epub"),
    ]
    groups, members = detect.detect(frame(spark, rows))
    kinds = {r["match_type"]: sorted(m["ord"] for m in members.filter(F.col("group_id") == r["group_id"]).collect()) for r in groups.collect()}
    assert kinds.get("simhash_content") == [2, 3]
    first, _ = detect.detect(frame(spark, rows), upto="isbn_exact")
    assert first.count() == 0


def test_titles_that_score_share_a_rare_entry(spark):
    rng = random.Random(8)
    words = ["the", "The", "war", "peace", "Pride", "prejudice", "of", "a", "b", "c", "Éva", "great", "greater", "gates", "by", "é", "III", "活着", "着", "活", "三体", "x"]
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(400)} | {"a p b c", "a b q c", "活x着", "活着", "ab", "ba", "ABC", "abc", "é", "É"})
    held = defaultdict(set)
    for r in candidates.title_index(spark.createDataFrame([(t,) for t in titles], "title string")).collect():
        held[r["title"]].add(r["entry"])
    close = left_out = 0
    for i, a in enumerate(titles):
        for b in titles[i + 1 :]:
            shared = bool(held[a] & held[b])
            left_out += not shared
            if max(kernels.title(a, b), kernels.title(b, a)) >= 0.40:
                close += 1
                assert shared, (a, b, kernels.title(a, b))
    assert close > 1000 and left_out > 1000


def test_authors_that_score_are_paired(spark):
    rng = random.Random(9)
    chars = "余华路遥远刘慈欣王小明"
    names = {"".join(rng.choice(chars) for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"Лев", "Лев Толстой", "Толстой", "Leo Tolstoy", "L. Tolstoy", "余x华", "Ｙ u", "é"}
    names = sorted(names)
    rows = [(i, "书", n, "", 0, 1, "epub") for i, n in enumerate(names)]
    met = {(r["x"], r["y"]): (r["x_y"], r["y_x"]) for r in candidates.author_pairs(frame(spark, rows)).collect()}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            scores = kernels.author(a, b), kernels.author(b, a)
            assert ((a, b) in met) == (max(scores) >= 0.55), (a, b, scores)
            assert met.get((a, b), scores) == scores


def test_blocks_of_titles_keep_close_pairs_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BLOCK", 64)  # several blocks an author
    rng = random.Random(21)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    prose = [" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(240)]
    near = [t.replace(t.split()[k % 9], rng.choice(words), 1) + " " * (k % 3) for k, t in enumerate(prose[:60])]
    odd = ["活着", "《活着》(珍藏版)", "三体", "三体 典藏版", "In. In. In.", " In. In.", "a b c", "c b a", "T", "t", "The", "Ｔhe", " ", "é", "War & Peace", "War and Peace"]
    titles = [*prose, *near, *odd]
    rows = [(i, t, rng.choice(["Jane Austen", "J. Austen"]), "9787020089543" if i % 3 == 0 else "", i, 1, "epub") for i, t in enumerate(titles)]
    found = {(r["a_ord"], r["b_ord"]): r["author_ab"] for r in candidates.fuzzy_pairs(frame(spark, rows)).collect()}
    fresh = {(r["a_ord"], r["b_ord"]): r["author_ab"] for r in candidates.fuzzy_pairs(frame(spark, rows), fresh=spark.range(5, 400, 7).withColumnRenamed("id", "ord")).collect()}
    close = met = 0
    for i, a in enumerate(titles):
        for j in range(i + 1, len(titles)):
            b = titles[j]
            author = kernels.author(rows[i][2], rows[j][2])
            if author < 0.55 or i % 3 == 0 and j % 3 == 0:
                assert (i, j) not in found
                continue
            met += 1
            if a and b and max(kernels.title(a, b), kernels.title(b, a)) >= 0.40:
                close += 1
                assert found[i, j] == author, (a, b)
    assert fresh == {k: v for k, v in found.items() if any(x % 7 == 5 for x in k)}
    assert close > 20 and len(found) < close + met / 20, (close, len(found), met)


def test_names_settle_equal_content_before_titles_are_paired(spark):
    """Buckets whose names keep the mean under the threshold have no title scored; those whose names do not are judged as ever."""
    names = ["Jane Austen", "Leo Tolstoy", "余华", "鲁迅", "Victor Hugo"]
    rows = [(i, f"Title number {i}", names[i % 5], "", 7, 100, "epub") for i in range(40)]
    rows += [(100 + i, f"Other {'book' if i % 2 else 'tale'} {i}", "Jane Austen", "9780306406157" if i == 3 else "", 9, 100, "epub") for i in range(6)]
    books = detect.prepared(frame(spark, rows))
    members = books.select(F.col("simhash").cast("string").alias("bucket"), "ord", "node")
    assert [r["bucket"] for r in quotient.may_reach(members, books, 0.80).collect()] == ["9"]
    pairs = quotient.node_pairs(quotient.bucket_nodes(members), quotient.nodes_of(books))
    mean = {r["bucket"]: r["similarity"] for r in quotient.mean_similarity(quotient.backward(quotient.forward(pairs)), members, books).collect()}
    assert mean["7"] < 0.80
    assert detect.run_stage("simhash_content", books, detect.MatchConfig())[0].filter("bucket = '7'").count() == 0
