"""The pipeline against a composition of brute-force stages, and awkward inputs for every operator and stage."""

from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bibspark.llm import decontaminate, langid, lines, mixing, oracles, pii, quality, secrets, simhash, suffix, tokens

from . import fixtures
from .test_contracts import GAP, brute_components, brute_fingerprint, brute_leaks, brute_lines, leak_items, lower

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_quality(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"]))
    kept = {r[0] for r in con.execute(f"SELECT doc_id, kept FROM ({oracles.quality_sql()})").fetchall() if r[1]}
    return [r for r in rows if r[0] in kept]


def brute_drop_lines(rows):
    order, near = brute_lines(rows, 1)
    first = {w: min(places) for w, places in order.items()}
    stays = {w for w in order if not any(v != w and first[v] < first[w] and near(w, v) for v in order)}
    out = []
    for r in rows:
        left = []
        for k, line in enumerate(r[1].split("\n")):
            w = tuple(lower(line).split())
            if not w or w in stays and first[w] == (False, r[0], r[1], k):
                left.append(line)
        text = "\n".join(left)
        if text == r[1] or GAP.search(text):
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def brute_one_of_each(rows):
    ids = [r[0] for r in rows]
    best = brute_components(ids, [brute_fingerprint(r[1]) for r in rows])
    return [r for r, b in zip(rows, best, strict=True) if r[0] == b]


def brute_cut(rows, items):
    hits = {x[0]: x for x in brute_leaks(rows, items)}
    return {r[0]: (r[1] if not hits[r[0]][5] else None) for r in rows if hits[r[0]][2] < hits[r[0]][1] or not hits[r[0]][1]}


def test_pipeline(spark, tmp_path):
    seen, rows = set(), []
    for r in fixtures.documents(seed=9, n=70):
        if r[0] is not None and r[0] not in seen and r[1] is not None:
            seen.add(r[0])
            rows.append(r[:5])
    items = leak_items([r for r in rows if len(r[1].split()) > 60])[3:5]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, d = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    want = [brute_quality(rows)]
    want.append(brute_drop_lines(want[0]))
    want.append(brute_one_of_each(want[1]))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, d)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(tuple, docs.collect())) == sorted(want[k]), k
    assert len(rows) > len(want[0]) > len(want[2])
    cut = corpus_pipeline.STAGES[3][1](spark, docs, d)
    texts = brute_cut(want[2], items)
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got.keys() == texts.keys() and None in texts.values()
    assert all(t is None and got[i] != dict((r[0], r[1]) for r in want[2])[i] or got[i] == t for i, t in texts.items())
    mixed = corpus_pipeline.run(spark, d)
    assert mixed.columns[-2:] == ["shard", "pass"] and {r["doc_id"] for r in mixed.collect()} <= got.keys()
    counts = mixing.mixed_counts(cut).collect()
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter({r["doc_id"]: r["copies"] for r in counts})


def operators(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    return {
        "secrets": secrets.scan_secrets, "tokens": lambda x: tokens.limits_report(tokens.length_histogram(x)), "simhash": simhash.near_duplicates, "pii": lambda x: pii.pseudonymize(x, "k"), "mixing": mixing.mixed_counts, "mix": mixing.mix,
        "language": langid.identify, "suffix": suffix.dedup_substrings, "lines": lines.dedup_lines, "leaks": lambda x: decontaminate.find_leaks(x, bench), "no benchmark": lambda x: decontaminate.find_leaks(x, bench.limit(0)),
        "quality": quality.quality, "quality stage": quality.quality_filter, "line stage": lines.drop_lines, "near stage": simhash.one_of_each, "leak stage": lambda x: decontaminate.drop_leaked(x, bench),
    }


@pytest.mark.parametrize("name", ["secrets", "tokens", "simhash", "pii", "mixing", "mix", "language", "suffix", "lines", "leaks", "no benchmark", "quality", "quality stage", "line stage", "near stage", "leak stage"])
def test_empty_and_null_tables(spark, name):
    run = operators(spark)[name]
    empty = spark.createDataFrame([], fixtures.SCHEMA)
    assert run(empty).count() == 0
    nulls = spark.createDataFrame([(None,) * 10, (None,) * 10, (1, None, None, None, None, None, None, None, None, None)], fixtures.SCHEMA)
    got = run(nulls).collect()
    assert len(got) == {"tokens": 1, "mix": 0, "quality stage": 0, "near stage": 1}.get(name, 3), got


def test_token_histogram(spark):
    rows = fixtures.documents(seed=3, n=40)
    encode = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN).encode_ordinary
    sizes = [len(encode(r[1])) if r[1] else 0 for r in rows]
    report = tokens.limits_report(tokens.length_histogram(fixtures.frame(spark, rows)))
    got = {r["n_tokens"]: r for r in report.collect()}
    assert {n: r["n_docs"] for n, r in got.items()} == Counter(sizes)
    for n, r in got.items():
        above = [s for s in sizes if s >= n]
        assert (r["docs_ge"], r["tokens_ge"], r["docs_total"], r["tokens_total"]) == (len(above), sum(above), len(sizes), sum(sizes))
        assert r["truncated_total"] == sum(min(s, n) for s in sizes) and r["docs_cut"] == sum(s > n for s in sizes)
        assert r["quantile"] == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    limits = spark.createDataFrame([(x,) for x in (0, 1, 17, 100, 10**6)], "context_limit long")
    assert {tuple(r) for r in tokens.truncated_totals(report, limits).collect()} == {(x, sum(s > x for s in sizes), sum(min(s, x) for s in sizes)) for x in (0, 1, 17, 100, 10**6)}
    ordered = sorted(sizes)
    for share, n in map(tuple, tokens.quantiles(report, [0.1, 0.5, 0.99]).collect()):
        assert n == next(x for x in ordered if sum(s <= x for s in sizes) >= share * len(sizes))


PRIVATE = "Mail jo.doe+x@mail3.example.com, card 4111 1111 1111 1111 or 4871316720949013, no card 4871316720949014, ip 192.168.10.7 not 300.1.1.1, born 1985-02-28 not 1985-02-30, on 12/31/1999 and 31.12.1999, call +1 (523) 555-1055 or 523-555-1055, ssn 123-45-6789 not 000-12-3456, DE89 3704 0044 0532 0130 00 end"


def test_pii(spark):
    tool = pii.Pseudonymizer("k")
    fresh, spans = tool.rewrite(PRIVATE)
    assert Counter(k for _, _, k, _ in spans) == {"email": 1, "card": 2, "ip": 1, "date": 3, "phone": 2, "ssn": 1, "iban": 1}
    again, found = tool.rewrite(fresh)
    assert [k for _, _, k, _ in found] == [k for _, _, k, _ in spans]  # pseudonyms are valid values of the same kinds
    assert pii.Pseudonymizer("k", back=True).rewrite(fresh)[0] == PRIVATE
    for s, e, kind, new in spans:
        old = PRIVATE[s:e]
        assert len(old) == len(new) or kind == "ip"
        assert new != old and old not in fresh
    assert "4871316720949014" in fresh and "300.1.1.1" in fresh and "1985-02-30" in fresh and "000-12-3456" in fresh
    assert tool.rewrite("a" * 200_000) == ("a" * 200_000, [])  # linear in long runs
    df = spark.createDataFrame([(1, PRIVATE), (2, None), (3, ""), (4, "again jo.doe+x@mail3.example.com"), (5, "plain")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymize(df, "k").collect()}
    assert got[1]["text"] == fresh and got[2]["text"] is None and got[3]["text"] == "" and got[5]["text"] == "plain" and got[5]["pii_spans"] == ""
    assert fresh[5:].startswith(got[4]["text"].removeprefix("again "))  # equal values stay linked
    assert pii.pseudonymize(df, "other").filter("doc_id = 1").first()["text"] != fresh
    back = pii.pseudonymize(pii.pseudonymize(df, "k"), "k", back=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] for r in df.collect()}


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 97, 1000):
        image = [pii._feistel(b"k", "t", n, x, False) for x in range(n)]
        assert sorted(image) == list(range(n)) and [pii._feistel(b"k", "t", n, y, True) for y in image] == list(range(n))


def test_long_single_text(spark):
    rows = [(1, "abc def ghi jkl. " * 60_000, "en", "a", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert secrets.scan_secrets(docs).count() == 1
    assert simhash.near_duplicates(docs).first()["component_id"] == 1
    r = suffix.dedup_substrings(docs).first()
    assert r["n_removed"] == r["n_bytes"] == len(rows[0][1])
    assert quality.quality(docs).first()["n_repeat_words"] == 240_000


NAMES = ["secrets", "tokens", "simhash", "pii", "mixing", "mix", "language", "suffix", "lines", "leaks", "quality", "quality stage", "line stage", "near stage", "leak stage"]
ODD = ["a b", "__row", "__text", "pass", "key", "row", "own", "stays", "a`b", "a.b", "__source", "best_id", "lang_of"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_column_names(spark, name):
    """Extra columns of any name neither break an operator nor change its rows."""
    rows = [r[:5] for r in fixtures.documents(seed=5, n=8)[:20]]
    plain = spark.createDataFrame(rows, COLUMNS)
    odd = plain.select("*", *(F.lit(1).alias(c) for c in ODD))
    run = operators(spark)[name]
    want, got = run(plain), run(odd)
    assert set(want.columns) <= set(got.columns)
    pick = lambda df: Counter(map(str, df.select(*want.columns).collect()))
    assert pick(got) == pick(want)
    if "stage" in name:
        assert got.columns == odd.columns


@pytest.mark.parametrize("name", NAMES)
def test_one_very_long_text(spark, name):
    """A million characters in one row: white space, one letter, or numbers that look like personal data."""
    for text in (" " * 1_000_000, "\n" * 300_000, "eyJabcd" * 40_000, "1985-02-28 " * 32_000):
        docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, "a b c d e f g h i j k l", "en", "a", 23)], COLUMNS)
        assert operators(spark)[name](docs).count() >= 0


def test_long_white_space_has_the_same_tokens():
    encode = tokens.encoder(tokens.VOCABULARY, tokens.PATTERN).encode_ordinary
    for gap in (" " * 70_000, "\n" * 66_000, " \n" * 40_000, "\u3000" * 70_000):
        for text in (gap, "a" + gap, gap + "b", f"a b{gap}c d{gap}e", f"{gap}, x"):
            assert tokens.encoded_length(text) == len(encode(text))


def test_large_hypergeometric_draws():
    import numpy as np

    draw = np.random.default_rng(1)
    for good, bad, sample in ((3 * 10**8, 15 * 10**8, 9 * 10**8), (10**10, 7, 10**9), (5, 10**10, 10**9), (10**9, 10**9, 2 * 10**9)):
        got = [mixing.hypergeometric(draw, good, bad, sample) for _ in range(20)]
        mean = sample * good / (good + bad)
        sd = (mean * bad / (good + bad) * (good + bad - sample) / (good + bad - 1)) ** 0.5
        assert all(max(0, sample - bad) <= x <= min(good, sample) and abs(x - mean) <= 6 * sd + 1 for x in got)
    q = np.array([3 * 10**8] * 6)
    out = np.stack([n for _, _, n in mixing.split_tree(q, 0, 8, 8, int(q.sum()), 5)], axis=1)
    assert (out.sum(axis=1) == q).all() and np.ptp(out.sum(axis=0)) <= 1


def test_shards_show_the_tree(spark):
    docs = fixtures.frame(spark, fixtures.documents(seed=4, n=40)).select("doc_id", "text", "source")
    shown = Counter()
    for r in mixing.mixed_counts(docs).collect():
        own = r["shards"].split(",") if r["shards"] else []
        assert len(own) == r["copies"]
        shown.update((r["doc_id"], *map(int, x.split(":"))) for x in own)
    assert shown == Counter((r["doc_id"], r["shard"], r["pass"]) for r in mixing.mix(docs).collect())
