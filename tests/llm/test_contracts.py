"""Operators with a stated result, against plain brute force."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
import xxhash

from bibspark.llm import decontaminate, induced, langid, lines, mixing, quality, secrets, simhash, suffix

from . import fixtures

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    return fixtures.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return fixtures.frame(spark, rows).cache()


def counted(found):
    return Counter(tuple(r) for r in found)


def brute_secrets(t):
    t, spans = t or "", []
    for kind, pattern, group, least in (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ):
        spans += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in pattern.finditer(t) if len(m.group(group)) >= least]
    spans.sort()
    n = Counter(s[3] for s in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def test_secrets(docs, rows):
    got = secrets.scan_secrets(docs).collect()
    assert counted(tuple(r)[:5] for r in got) == Counter((r[0], *brute_secrets(r[1])) for r in rows)
    assert sum(r["n_assign"] for r in got) >= 4 and sum(r["n_access"] for r in got) >= 1 and sum(r["n_hex"] for r in got) >= 2


def test_trigram_queries_are_necessary():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigrams_of(secrets.trigram_query("AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    index = secrets.TrigramIndex(secrets.DEFAULT_RULES)
    import pyarrow as pa

    keys = {
        "private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "a" * 36, "slack": "xoxb-" + "1" * 12, "google": "AIza" + "b" * 35,
        "stripe": "sk_live_" + "c" * 20, "jwt": "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9,
    }
    for kind, own in keys.items():
        found = index.scan(pa.array(["nothing", f"é {own} é"]))
        assert not found[0] and [index.rules[k].kind for _, k, _ in found[1] if k >= 3] == [kind]


def brute_fingerprint(t):
    w = GAP.findall(lower(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, least=min):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [best.get(root(i)) for i in range(len(ids))]


def test_simhash(docs, rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = Counter(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_components([r[0] for r in rows], fps), strict=True))
    got = simhash.near_duplicates(docs)
    assert counted(got.drop("root").collect()) == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == got.select("root").distinct().count()
    assert {r["component_id"] for r in got.collect()} == {r["doc_id"] for r in kept.collect()}


@pytest.mark.parametrize("chunk", [4096, 7])
def test_simhash_links_of_dense_and_sparse_fingerprints(spark, chunk):
    import random

    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for seed in list(fps)[:12]:
        for _ in range(25):
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(nodes, chunk=chunk).collect()]
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    want = brute_components(fps, fps)
    least = {}
    for f in fps:
        least[root(f)] = min(least.get(root(f), f), f)
    assert [least[root(f)] for f in fps] == want


def test_manhattan_is_a_lower_bound():
    import random

    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        want = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
        x, y = (simhash.segment_counts(np.array([v], np.uint64)) for v in (a, b))
        assert int(simhash.manhattan(x, y)[0]) == want <= (a ^ b).bit_count()


def test_mixing(docs, rows):
    got = mixing.mixed_counts(docs).collect()
    assert counted(got) == counted(mixing.mixed_counts(docs.repartition(3)).collect())
    size = [len(GAP.findall(r[1] or "")) for r in rows]
    total, per = sum(size), Counter()
    for r, n in zip(rows, size, strict=True):
        per[r[3]] += n
    order = sorted((s for s in per if s is not None), key=lambda s: s) + ([None] if None in per else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest, w = total - sum(3 * per[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * per[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * per[s]}
        if not over:
            break
        capped |= over
    source = {}
    for r in rows:
        source.setdefault((r[0], len(GAP.findall(r[1] or ""))), set()).add(r[3])
    taken = Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        assert any(abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) and r["source_size"] == per[s] for s in source[r["doc_id"], r["size"]])
        taken[r["source_size"]] += r["taken"]
    for s in order:
        biggest = max(n for r, n in zip(rows, size, strict=True) if r[3] == s)
        assert abs(taken[per[s]] - sum(target[t] for t in order if per[t] == per[s])) <= biggest
    assert Counter(r["size"] for r in got) == Counter(size)


def test_mix_emits_what_is_counted(docs):
    want = Counter()
    for r in mixing.mixed_counts(docs).collect():
        want[r["doc_id"]] += r["copies"]
    got = mixing.mix(docs)
    assert got.columns == [c for c in docs.columns if c != "shard"] + ["shard", "pass"]
    assert Counter(r["doc_id"] for r in got.collect()) == +want


def test_split_tree_meets_quotas():
    import numpy as np

    q = np.array([100, 0, 3, 5000, 17])
    whole = mixing.split_tree(q, 0, 7, 7, 5120, 5)
    out = np.stack([n for _, _, n in whole], axis=1)
    assert [lo for lo, _, _ in whole] == list(range(7)) and (out.sum(axis=1) == q).all() and np.ptp(out.sum(axis=0)) <= 1
    parts = [x for lo, hi, n in mixing.split_tree(q, 0, 7, 7, 5120, 5, leaf=3) for x in mixing.split_tree(n, lo, hi, 7, 5120, 5)]
    assert all((a[2] == b[2]).all() for a, b in zip(whole, parts, strict=True))


def test_mix_over_many_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 10)
    got = mixing.mix(docs).collect()
    assert len({r["shard"] for r in got}) > 64
    want = Counter()
    for r in mixing.mixed_counts(docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in got) == +want


def test_quality_counts(docs, rows):
    def brute(t):
        t = t or ""
        w = GAP.findall(t)
        own = [x for x in t.split("\n") if GAP.search(x)]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)

    got = quality.quality(docs).collect()
    assert counted(tuple(r)[:7] for r in got) == Counter((r[0], *brute(r[1])) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got) and any(r["kept"] for r in got)
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.quality_filter(docs).count() == sum(r["kept"] for r in got)


@pytest.mark.parametrize("length,options", [(200, {}), (200, {"many": 1}), (200, {"queued": 100}), (100, {}), (400, {}), (600, {}), (20, {"many": 2})])
def test_suffix(docs, rows, length, options):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))

    def brute(d):
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(c for c, h in zip(d, hit, strict=True) if not h)
        return len(d), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()

    want = Counter((r[0], *brute(d)) for r, d in zip(rows, data, strict=True))
    assert sum(n for x in want for n in [x[2]]) > 1000
    assert counted(tuple(r)[:5] for r in suffix.dedup_substrings(docs, length=length, **options).collect()) == want


def test_induced_sorting():
    """Order and common prefixes, with queues that spill and without, taken in steps of any width."""
    import random

    import numpy as np

    rng = random.Random(1)

    def common(a, b, most):
        k = 0
        while k < min(most, len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    for _ in range(400):
        s = bytes(rng.randint(0, rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))) * rng.choice([1, 1, 3])
        length = rng.choice([1, 3, 8, 20])
        got = [x for p, c in induced.suffix_order(np.frombuffer(s, np.uint8), length, rng.choice([3, 1000]), step=rng.choice([1, 2, 5, 1000])) for x in zip(p.tolist(), c.tolist(), strict=True)]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert got == list(zip(order, [0, *(common(s[a:], s[b:], length) for a, b in zip(order, order[1:]))], strict=False))[: len(s)]


def test_queues_spill_with_production_settings():
    import numpy as np

    text = np.random.default_rng(1).integers(97, 101, suffix.SHARD_BYTES).astype(np.uint8)
    scratch = induced.Scratch(induced.QUEUED)
    try:
        order = np.concatenate([p for p, _ in induced.suffix_order(text, 0, induced.QUEUED, scratch)])
        assert scratch.folder and scratch.count >= 3  # runs on disk, in a shard of the usual size
    finally:
        scratch.close()
    assert np.array_equal(np.sort(order), np.arange(len(text)))
    raw = text.tobytes()
    assert all(raw[a : a + 64] <= raw[b : b + 64] for a, b in zip(order[:-1:97].tolist(), order[1::97].tolist(), strict=True))


def test_anchors_of_one_repeated_byte():
    import time

    import numpy as np

    began = time.time()
    text, *_, lo, hi = suffix.anchors(np.full(1_000_000, 97, np.uint8), np.array([0, 1_000_000]))
    assert (hi - lo + 1).sum() == 1_000_000 - suffix.LENGTH + 1 and time.time() - began < 10


WORD9 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_leaks(rows, items):
    windows = {}
    for name, t in items:
        w = WORD9.findall(lower(t))
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if name is None else str(name))
    sizes = {len(k) for k in windows}
    for r in rows:
        w, hit, names = WORD9.findall(lower(r[1])), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    names |= own
                    hit.update(range(i, i + n))
        yield r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def leak_items(rows):
    own = [r[1].split() for r in rows if r[1] and 60 < len(r[1].split()) < 400]
    items = [(i, "Xyz " + " ".join(w[10 : 10 + n])) for i, (w, n) in enumerate(zip(own, [9, 10, 11, 25, 40, 12, 14], strict=False))]
    return [*items, (100, " ".join(own[3][5:8])), (101, None), (102, "..."), (None, " ".join(own[4][1:14])), (103, " ".join(own[3][5:8])), (104, "a b"), (9, "the the the the the the the the the the the")]


@pytest.mark.parametrize("block_words", [400_000, 30])
def test_leaks(spark, docs, rows, block_words):
    items = leak_items(rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(docs, benchmark, block_words=block_words).collect()
    assert counted(tuple(r)[:6] for r in got) == Counter(brute_leaks(rows, items))
    assert sum(r["contaminated"] for r in got) >= 4
    clean = decontaminate.drop_leaked(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r["n_hit"] or r["n_hit"] < r["n_words"] for r in got)  # a document that is all passage goes
    assert not any(x[5] for x in brute_leaks([tuple(r) for r in clean.collect()], items[:4]))
    by = {r["doc_id"]: r for r in got}
    assert all(r["text"] == t for r in clean.collect() for i, t, *_ in rows if i == r["doc_id"] and i is not None and i < 60 and not by[i]["contaminated"])


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_cases(spark, docs, rows):
    by = {}
    for r, g in zip(sorted(rows, key=str), sorted(langid.identify(docs).collect(), key=str), strict=True):
        by[r[0]] = g
    for r in langid.identify(docs).collect():
        assert r["lang_pred"] in ("en", "fr", "de", "und")
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_mixture_of_two_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    languages, table = langid.fit(d)
    by = {lang: "".join(r["text"] for r in d.filter(f"lang = '{lang}'").limit(3).collect())[:3000] for lang in ("en", "fr")}
    import numpy as np

    counts, _ = langid.trigrams(by["en"] + by["fr"][:1500])
    at = np.flatnonzero(counts)
    chosen, share, _ = langid.mixture(counts[at].astype(float), table[at])
    assert [languages[i] for i in chosen] == ["en", "fr"] and 0.55 < share[0] < 0.8


def brute_lines(rows, least=5):
    distinct = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda x: x[:2])
    order = {}
    for none, i, t in distinct:
        for k, line in enumerate(t.split("\n")):
            w = tuple(lower(line).split())
            if len(w) >= least:
                order.setdefault(w, []).append((none, i, t, k))

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 10:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    return order, near


def test_lines(docs, rows):
    order, near = brute_lines(rows)
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    # whatever stays of eligible lines: no two documents keep equal or near lines, and every line is represented
    kept = Counter()
    once = {(r["doc_id"], r["text"], r["n_lines"]) for r in got}
    for _, t, _ in once:
        for line in (t or "").split("\n"):
            w = tuple(lower(line).split())
            if len(w) >= 5:
                kept[w] += 1
    assert kept and max(kept.values()) == 1
    left = list(kept)
    gone = [w for w in order if w not in kept]
    assert gone and all(any(near(w, v) for v in order if v != w) for w in gone)
    assert not any(near(a, b) for i, a in enumerate(left) for b in left[:i])
    assert {w for w in left} | set(gone) == set(order)
    for r in got:
        assert (r["text"] is None) == (r["n_lines"] == 0)


def test_drop_lines(docs):
    got, by = lines.drop_lines(docs), Counter(r["doc_id"] for r in docs.collect())
    assert got.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["text"] is not None)
    assert not Counter(r["doc_id"] for r in got.collect()) - by


def test_line_variants():
    assert lines.within_one_word([b"a", b"b"], [b"a"]) and lines.within_one_word([b"a"], [b"b", b"a"]) and lines.within_one_word([b"a", b"b"], [b"a", b"c"])
    assert not lines.within_one_word([b"a", b"b"], [b"b", b"a"]) and not lines.within_one_word([b"a", b"b", b"c"], [b"a"])
