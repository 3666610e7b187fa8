"""Whole jobs of single operators, each against brute force or known values."""

import random

import pytest

from bibspark.llm import lines, pii, queries, shingles, simhash

from .test_contracts import brute_fingerprint


def brute_groups(rows):
    """Least id of each row's component of 5-word Jaccard similarity 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (t.lower().split() for _, t in rows)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return set(least.values())


def edited(seed=4):
    """Texts with edited copies from almost equal to clearly below the bound, and a passage that all have."""
    rng, texts = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(12)]
    for _ in range(25):
        base = passage + [word() for _ in range(rng.choice([20, 80, 200]))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                own[rng.randrange(12, len(own))] = word()
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small,chunk", [(8, 4096), (2, 20)])
def test_near_copies(spark, small, chunk):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_groups(rows)
    assert {r["doc_id"] for r in shingles.groups(docs, small, chunk).collect()} == want
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == want


def test_near_copies_differ_in_many_bits():
    a = edited()
    bits = [(brute_fingerprint(x) ^ brute_fingerprint(y)).bit_count() for i, (_, x) in enumerate(a) for _, y in a[:i] if len(brute_groups([(0, x), (1, y)])) == 1]
    assert sum(b > 3 for b in bits) > len(bits) / 4  # what a bound of 3 bits leaves


PRIVATE = [
    ("iban", "AT61 1904 3002 3457 3201", " USD"), ("iban", "ES91 2100 0418 4502 0005 1332", " BIC"), ("iban", "AT611904300234573201", " 2024"),
    ("iban", "BE68 5390 0754 7034", " EUR"), ("iban", "DE89 3704 0044 0532 0130 00", " AT61 0000"), ("card", "3782 822463 10005", ","), ("card", "3782-822463-10005", ""),
    ("card", "3056 930902 5904", "."), ("phone", "+1 (023) 555-0142", " x"), ("phone", "123-555-0142", ""),
]


@pytest.mark.parametrize("kind,value,rest", PRIVATE)
def test_no_valid_value_stays(kind, value, rest):
    text = f"pay {value}{rest}"
    fresh, spans = pii.Pseudonymizer("k").rewrite(text)
    assert [(text[s:e], k) for s, e, k, _ in spans] == [(value, kind)]
    assert value not in fresh and fresh.endswith(rest) and len(fresh) == len(text)
    assert pii.Pseudonymizer("k", back=True).rewrite(fresh)[0] == text


def test_ibans_side_by_side():
    text = "AT61 1904 3002 3457 3201 BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00 USD, no AT61 1904 3002 3457 3202"
    fresh, spans = pii.Pseudonymizer("k").rewrite(text)
    assert len(spans) == 3 and fresh.endswith("AT61 1904 3002 3457 3202") and pii.Pseudonymizer("k", back=True).rewrite(fresh)[0] == text


def test_lines_of_any_length_and_script(spark, tmp_path):
    rows = [(1, "Chapter one\nThe first of six words\n\u4eca\u5929\u5929\u6c14\u5f88\u597d\nkept\n\n"), (2, "chapter  one\nThe first of seven words\n\u4eca\u65e5\u5929\u6c14\u5f88\u597d\nown\n\n"), (3, "kept\nChapter two\n\u4eca\u5929\u5929\u6c14\u5f88\u597d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["text"] for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "own\n\n", 3: "Chapter two"}
    assert lines.line_units("Ab \u4eca\u5929c") == [b"ab", "\u4eca".encode(), "\u5929".encode(), b"c"]
