"""Conversation tries, token alignment and web archives against brute force; the mended mixing and suffix operators."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibspark.llm import alignment, mixing, queries, suffix, trie, warc

from . import fixtures


# ---------------------------------------------------------------- op11
def brute_trie(sequences):
    """Rows of op11 from {conv: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = own + sum(saved[k] for k in children[p])
    out = Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(sequences[c]) == len(p)))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def conversations(seed, n=70, longest=40):
    rng, rows = random.Random(seed), []
    for c in range(n):
        if c % 11 == 4:
            continue
        for t in range(rng.choice([1, 2, 3, 8, longest]) if c % 7 else 12):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rng.choice(["user", "tool", None]) if t % 5 == 4 else "user", rng.choice(["a", "é", "", None, "long text"]) if t % 3 else "hello", "x"))
    return rows + rows[:3]


KINDS = "conv_id long, turn long, role string, text string, name string"


def ordered_turns(rows):
    own = defaultdict(list)
    for c, t, role, text, _ in rows:
        own[c].append((t is not None, t or 0, role or "", text or ""))
    return own


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_rebuilt_conversations(spark, tmp_path, seed):
    rows = [r for r in conversations(seed) if r[0] % 5 or r[0] < 60]  # some bases are absent
    ties = {r[0] for r in rows if rows.count(r) > 1}
    own = {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in ordered_turns(rows).items()}
    for c in ties:  # repeated rows stand side by side, in whatever order
        own[c] = [x[2:] for x in sorted(ordered_turns(rows)[c])]
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    spark.createDataFrame(rows, KINDS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_trie(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == brute_trie(rebuilt)


def test_trie_of_plain_conversations_and_odd_cases(spark):
    rows = [(5, 1, "u", "a"), (7, 1, "u", "a"), (7, 2, "u", "b"), (9, None, None, None), (None, 1, "u", "lost")]
    df = spark.createDataFrame(rows, "`conv.id` long, turn long, role string, text string").withColumn("depth", F.lit(1))
    nodes, ends = trie.conversation_trie(df, "conv.id")
    found = Counter((r["conv"], r["depth"], r["parent_conv"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"]) for r in nodes.collect())
    assert found == Counter([(5, 0, None, 3, 2, 2, 1), (5, 1, 5, 2, 1, 1, 1), (7, 2, 5, 1, 0, 1, 0), (9, 1, 5, 1, 0, 1, 0)])
    assert sorted(r["conv"] for r in ends.collect()) == [5, 7, 9]
    nodes, ends = trie.conversation_trie(df.limit(0), "conv.id")
    assert nodes.count() == 0 and ends.count() == 0


def test_long_conversation_and_hot_turn(spark):
    """Two conversations of 700 turns that part at turn 650, and 3000 that share their first turn."""
    a = [(1, t, "u", f"t{t}") for t in range(700)]
    b = [(2, t, "u", f"t{t}" if t < 650 else f"x{t}") for t in range(700)]
    hot = [(c, 0, "u", "t0") for c in range(10, 3010)]
    nodes, ends = trie.conversation_trie(spark.createDataFrame(a + b + hot, "conv_id long, turn long, role string, text string"))
    at = {(r["conv"], r["depth"]): r for r in nodes.collect()}
    assert len(at) == 1 + 650 + 2 * 50
    assert at[1, 0]["n_convs"] == 3002 and at[1, 1]["n_convs"] == 3002 and at[1, 650]["n_leaves"] == 2 and at[1, 1]["n_leaves"] == 2 and at[2, 700]["parent_conv"] == 2
    sizes = [len(f"t{t}") for t in range(650)]
    assert at[1, 0]["saved"] == 3001 * sizes[0] + sum(sizes[1:]) and at[1, 651]["saved"] == 0
    digest = {r["name"]: r["ends_sha256"] for r in trie.ends_digest(ends).collect()}
    assert digest[at[1, 1]["name"]] == hashlib.sha256(",".join(map(str, range(10, 3010))).encode()).hexdigest()


# ---------------------------------------------------------------- op12
def naive_encodings(text):
    import sentencepiece
    from tokenizers import Tokenizer

    t = naive_encodings.a = getattr(naive_encodings, "a", None) or Tokenizer.from_file(alignment.BYTE_BPE)
    t.encode_special_tokens = True
    m = naive_encodings.b = getattr(naive_encodings, "b", None) or sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode()) for i in m.encode(text) for p in [m.id_to_piece(i)]]
    said = (" " + text).encode()
    return (a, b) if text and b"".join(x for _, x in a) == said == b"".join(x for _, x in b) else ([], [])


def brute_alignment(rows):
    docs, holds = [], Counter()
    for doc_id, text in rows:
        sides = []
        for side in naive_encodings(text or ""):
            at, own = 0, []
            for i, raw in side:
                own.append((i, at, at + len(raw)))
                at += len(raw)
            sides.append(own)
        a, b = sides
        found = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 400 else sweep(a, b)
        holds.update(set(found))
        docs.append((doc_id, a, b, found))
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = Counter()
    for doc_id, a, b, found in docs:
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts, start, shared = [], 0, 0
        for end in cuts:
            own = [[i for i, _, e in side if start < e <= end] for side in (a, b)] if len(a) < 400 else None
            if own:
                parts.append("|".join(",".join(map(str, x)) for x in own))
                shared += len(own[0]) * len(own[1])
            start = end
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "" if not cuts else None
        out[doc_id, len(a), len(b), len(cuts), len(found), sum(holds[p] == best[p[0]] for p in found), sum(holds[p] for p in found), digest] += 1
    return out


def sweep(a, b):
    out, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def test_alignment(spark):
    rows = [(r[0], r[1]) for r in fixtures.documents(3, 40)]
    rows += [(1, "a <|endoftext|> b"), (2, "a▁b"), (3, "日本語のテキスト 😀😀"), (4, "\u0000x"), (5, "  two  spaces "), (6, "ﬁ Ａ"), (7, "aaaaaaaaaaaaaaaaaaaaaaaaa")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pairs int").repartition(4)
    want = brute_alignment(rows)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for options in ({}, {"broadcast_pairs": 0}):
        got = alignment.alignment_report(df, **options).collect()
        known = {w[:7] for w in want if w[7] is None}  # long texts: groups are not spelled out here
        assert Counter((*r[:7], None if tuple(r[:7]) in known else r[7]) for r in (tuple(r[n] for n in names) for r in got)) == want
    assert {tuple(r) for r in alignment.align(df.filter("doc_id < 8"), slab_bytes=7).drop("pairs", "times").collect()} == {tuple(r) for r in alignment.align(df.filter("doc_id < 8")).drop("pairs", "times").collect()}
    assert alignment.alignment_report(df.limit(0)).count() == 0


def test_links_spell_the_overlaps(spark):
    df = spark.createDataFrame([(1, "unbelievable tokens, überall"), (2, None), (3, "")], "doc_id long, text string")
    a, b = naive_encodings("unbelievable tokens, überall")
    got = {(r["a_at"], r["b_at"], r["a_id"], r["b_id"], r["shared_bytes"]) for r in alignment.links(df).collect()}
    want, at = set(), 0
    for i, (x, raw) in enumerate(a):
        low = 0
        for j, (y, other) in enumerate(b):
            n = min(at + len(raw), low + len(other)) - max(at, low)
            if n > 0:
                want.add((i, j, x, y, n))
            low += len(other)
        at += len(raw)
    assert got == want


def test_sparse_product_equals_dense():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n, k, m = rng.integers(1, 9, 3)
        dense = [rng.random((n, k)) < 0.4, rng.random((m, k)) < 0.4]
        a, b = (alignment.Rows(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], int(k)) for d in dense)
        want = dense[0].astype(int) @ dense[1].astype(int).T
        i, j, v = alignment.product(a, alignment.transposed(b))
        got = np.zeros_like(want)
        got[i, j] = v
        assert (got == want).all() and (v > 0).all()
        assert (alignment.row_sizes(a, alignment.transposed(b)) == want.sum(1)).all()


def test_byte_vocabulary_spells_every_token_by_itself():
    """Ranks stand for merges: each token's own bytes, where they are text, are encoded as by the merges."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(alignment.BYTE_BPE)
    encode, words = alignment.byte_encoder(alignment.BYTE_BPE)
    for i in range(0, 50_256, 7):
        raw = words.flat[words.start[i] : words.start[i] + words.size[i]].tobytes()
        try:
            own = raw.decode()
        except UnicodeDecodeError:
            continue
        assert list(encode(own)) == t.encode(own, add_special_tokens=False).ids


def test_long_gaps_are_encoded_alike():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(alignment.BYTE_BPE)
    encode, _ = alignment.byte_encoder(alignment.BYTE_BPE)
    for text in ("a" + " " * 70_000 + "b", " " * 70_000, "x\n" + "\t" * 66_000 + " y z"):
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids


# ---------------------------------------------------------------- op13
def pages(rng):
    long = "<p>é" + "x" * 120 + "</p>"
    rows = [(i, f"http://h/{i}", rng.choice([long, long + "2", "short", "", None, "a\r\n\r\nb" * 30, f"<b>{i}</b>" * 40])) for i in range(60)]
    rows += [(100, None, long), (101, "http://h/\r\nX: y", "z" * 99), (102, "u", "z" * 100), (103, "u", "z" * 100), (None, "n", "z" * 100), (None, "n", "only nameless " * 10), (None, "m", "only nameless " * 10)]
    return rows + rows[:2] + [rows[-5]]


def brute_records(rows):
    full = [(i, u, (h or "").encode()) for i, u, h in rows]
    first = {}
    for i, _, p in full:
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    out = Counter()
    for i, u, p in full:
        other = first.get(p) if len(p) >= 100 and first.get(p) != i else None
        out[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if other is not None else "response", other, (u or "").replace("\r", "%0D").replace("\n", "%0A")] += 1
    return out


@pytest.mark.parametrize("broadcast", [0, 1 << 18])
def test_archives(spark, tmp_path, broadcast, monkeypatch):
    rows = pages(random.Random(2))
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    monkeypatch.setattr(warc.write_archives, "__defaults__", (*warc.write_archives.__defaults__[:-2], 2000, broadcast))
    got = warc.round_trip(df, f"{tmp_path}/w").collect()
    assert Counter(tuple(r) for r in got) == brute_records(rows)
    # the index names every byte of the archives, and any part of it can be read
    index = spark.read.parquet(f"{tmp_path}/w/index")
    sizes = {r["archive"]: r["size"] for r in warc.archive_files(spark, f"{tmp_path}/w").collect()}
    assert {r["archive"]: r["n"] for r in index.groupBy("archive").agg(F.sum("length").alias("n")).collect()} == sizes and len(sizes) > 3
    some = index.filter("page_id % 3 = 0")
    assert warc.read_records(some, f"{tmp_path}/w", 500, 0).count() == some.count()
    spans = warc.ranges(index).collect()
    assert len(spans) == len(sizes) and all((r["start"], r["stop"]) == (0, sizes[r["archive"]]) for r in spans)
    for r in warc.ranges(some, 500, 10).collect():
        inside = r["records"]
        assert r["start"] == inside[0]["offset"] and r["stop"] == inside[-1]["offset"] + inside[-1]["length"]


def test_archive_is_plain_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "héllo" * 30), (2, "http://b/", "héllo" * 30)], "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/w")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w" / "archives").rglob("part-*")))
    kinds = []
    while raw:  # by the lengths that the records themselves state
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        kinds.append((fields["WARC-Type"], fields["WARC-Target-URI"], len(rest[:size].partition(b"\r\n\r\n")[2])))
        assert rest[size : size + 4] == b"\r\n\r\n"
        raw = rest[size + 4 :]
    assert sorted(kinds) == [("response", "http://a/", 180), ("revisit", "http://b/", 0)]


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df, f"{tmp_path}/w").count() == 0


# ---------------------------------------------------------------- op5, op7
@pytest.mark.parametrize("seed", [1, 2])
def test_fill_passes_over_what_does_not_fit(spark, seed):
    """One document of 50,000 words among 2,500 of 20: what is left is less than any document that could still be taken."""
    rows = [(0, "w " * 50_000, "a")] + [(i, f"x{i} " * 20, "a") for i in range(1, 2501)] + [(9000 + i, "y " * 20, "b") for i in range(2500)]
    got = mixing.mixed_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 4), seed=seed).collect()
    for size in (100_000, 50_000):
        own = [r for r in got if r["source_size"] == size]
        spare = min((r["size"] for r in own if r["taken"] == 0), default=20)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= spare, size
    own = [r for r in got if r["source_size"] == 100_000]
    assert own[0]["target"] == pytest.approx(30_000) and abs(sum(r["taken"] for r in own) - 30_000) <= 20


def letters(n, seed):
    return "".join(map(chr, 97 + np.random.default_rng(seed).integers(0, 26, n)))


def test_suffix_dedup_of_texts_beyond_eight_megabytes(spark):
    passage = letters(1000, 1)
    rows = [(1, letters(10_000_000, 2) + passage + "end"), (2, "zz" + passage), (3, letters(20_000_000, 3) + passage)]
    got = {r["doc_id"]: r["spans"] for r in suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "spans").collect()}
    assert got == {1: "10000000:10001000", 2: "2:1002", 3: "20000000:20001000"}


def test_suffix_dedup_of_long_windows(spark):
    text = letters(45_000, 7)
    rows = [(1, "q" + text), (2, "zz" + text), (3, text[:39_999])]
    got = {r["doc_id"]: r["spans"] for r in suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), length=40_000).select("doc_id", "spans").collect()}
    assert got == {1: "1:45001", 2: "2:45002", 3: ""}


# ---------------------------------------------------------------- op4
def test_one_number_in_any_notation_has_one_pseudonym():
    from bibspark.llm import pii

    own, back = pii.Pseudonymizer("k"), pii.Pseudonymizer("k", back=True)
    forms = ["+1 202-555-0142", "202-555-0142", "+12025550142", "(202) 555-0142", "2025550142", "+1 (202) 555 0142", "+1.202.555.0142"]
    moved = [pseudonym(own, f"call {f} now") for f in forms]
    digits = {"".join(c for c in m if c.isdigit())[-10:] for m in moved}
    assert len(digits) == 1 and digits != {"2025550142"}
    assert [pseudonym(back, m) for m in moved] == [f"call {f} now" for f in forms]


def pseudonym(own, text):
    out, at = [], 0
    for start, end, _, fresh in own.spans(text):
        out += [text[at:start], fresh]
        at = end
    return "".join([*out, text[at:]])
