"""Known values, and order-dependent passes against naive loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bibspark.functions import fingerprint, isbn, kernels, similarity, text
from bibspark.operators import bin as bins
from bibspark.operators import candidates, cluster, convert, detect, quotient, recommend, report, verify
from bibspark.plans import fixture
from bibspark.sources import epub, files


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def test_isbn(spark):
    given = ["978-7-02-008954-3", "7-02-008954-3", "ISBN 9787020089543", "invalid-isbn", "", "9787530209559", "ISBN-13: 9787020089543", "X123456789", None]
    want = ["9787020089543"] * 3 + [""] * 6
    df = column(spark, given)
    assert [r[0] for r in df.select(isbn.normalize_isbn(F.col("v"))).collect()] == want
    again = column(spark, want).select(isbn.normalize_isbn(F.col("v"))).collect()
    assert [r[0] for r in again] == want


def test_normal_forms(spark):
    given = ["L'Étranger", "活着", "《活着》(珍藏版)", "三体 典藏版", "The Art of War", "Straße œuvre", "Ｆｕｌｌ　width", "", "一个人的战争", None]
    df = column(spark, given)
    native = df.select(text.normalize_title(F.col("v")), text.normalize_general(F.col("v"))).collect()
    assert [tuple(r) for r in native] == [(kernels.title_form(v or ""), kernels.general(v or "")) for v in given]
    assert [r[0] for r in native][:4] == ["etranger", "活 着", "活 着", "三 体"]
    names = ["余华 著", "钱钟书", "余华", "路遥,王", "Jane Austen", "A和B", "主编写", "", None]
    got = [r[0] for r in column(spark, names).select(text.normalize_author(F.col("v"))).collect()]
    assert got == [kernels.author_form(v or "") for v in names] and got[:4] == ["余华", "钱钟", "余华", "路遥"]


def test_human_size_and_pdf_fields(spark):
    got = [r[0] for r in column(spark, [0, 1023, 1280, 1792, 1024**3 * 5], "long").select(text.human_size(F.col("v"))).collect()]
    assert got == ["0.0 B", "1023.0 B", "1.2 KB", "1.8 KB", "5.0 GB"]
    raw = ["/Name", "D:2020", "/d:2021 ", "é".encode().decode("latin-1"), "é", "书"]
    assert [r[0] for r in column(spark, raw).select(text.clean_pdf_field(F.col("v"))).collect()] == ["Name", "2020", "2021", "é", "é", "书"] == [files.clean_pdf_text(x) for x in raw]


def scalar_simhash(content):
    import hashlib

    from bibspark import constants as K

    low = content.lower()
    tokens = [w for w in re.findall("[a-z]+", low) if len(w) > 1 and w not in K.SIMHASH_STOPWORDS]
    run = "".join(c for c in low if "一" <= c <= "鿿")
    tokens += [run[i : i + n] for n in (2, 3) for i in range(len(run) - n + 1) if not set(run[i : i + n]) & set(K.SIMHASH_STOP_CHARS)]
    h = [int(hashlib.sha1(t.encode()).hexdigest()[:16], 16) for t in tokens]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    texts = ["福贵是一个农民，他的一生充满了苦难。", "福贵是一个农民，他的一生充满了苦难和坚强。", "The quick brown fox", "", "123", "a the", "活"]
    df = column(spark, texts)
    got = {r["i"]: r["simhash"] % (1 << 64) for r in fingerprint.simhashes(df, "i", "v").collect()}
    assert [got.get(i, 0) for i in range(len(texts))] == [scalar_simhash(t) for t in texts]


def test_kernels():
    assert kernels.author("余华", "余秋雨") == pytest.approx(0.396667, abs=1e-6)
    assert kernels.author("路遥", "路遥远") == pytest.approx(0.776667, abs=1e-6)
    assert kernels.author("", "x") == 0.2 and kernels.author("余华", "余华 著") == 1.0
    assert kernels.title("活着", "兄弟") == 0.0
    assert kernels.ratio("abcd", "bcde") == 0.75


BOOK = "ord long, title string, author string, isbn string, simhash long, file_size long, file_format string"


def frame(spark, rows):
    df = spark.createDataFrame(rows, BOOK)
    return df.withColumns(
        {
            "isbn_normalized": isbn.normalize_isbn(F.col("isbn")),
            "author_clean": text.clean_text(F.col("author")),
            "author_form": text.normalize_author(F.col("author")),
            "title_key": fingerprint.title_key(F.col("title")),
            "author_key": fingerprint.author_key(F.col("author")),
            "file_path": F.concat(F.lit("/"), F.col("ord").cast("string")),
        }
    ).withColumn("title_author_key", fingerprint.title_author_key(F.col("title_key"), F.col("author_key")))


def pair(spark, a, b):
    rows = [(0, *a), (1, *b)]
    books, members = noded(spark, rows)
    met = quotient._book_pairs(verify.verified(detect._scored(books, members)), members, books)
    return met.select(F.col("verdict.is_same_book").alias("same"), similarity.pair_overall("a_", "b_", F.col("author_ab"), F.col("title_ab")).alias("overall")).first()


def noded(spark, rows):
    """Books with their nodes, all in one bucket."""
    books = frame(spark, rows).withColumn("node", quotient.node_of())
    return books, books.select(F.lit("x").alias("bucket"), "ord", "node")


@pytest.mark.parametrize(
    ("title_a", "author_a", "title_b", "author_b", "overall", "same"),
    [
        ("活着", "余华", "活着", "余华", 1.0, True),
        ("活着", "余华", "活着", "王小明", 0.2275, False),
        ("活着", "余华", "活着", "余秋雨", 0.45, False),
        ("活着", "余华", "兄弟", "余华", 0.35, False),
        ("人生", "路遥", "人生", "路遥远", None, False),
        ("活着", "余华", "活着", "余华 著", None, True),
        ("狂人日记", "鲁迅", "狂人日记", "周树人", None, True),
    ],
)
def test_pair_scores(spark, title_a, author_a, title_b, author_b, overall, same):
    got = pair(spark, (title_a, author_a, "", 0, 100, "epub"), (title_b, author_b, "", 0, 100, "epub"))
    assert got["same"] is same
    if overall is not None:
        assert got["overall"] == pytest.approx(overall, abs=1e-9)


# ---------------------------------------------------------------- naive detection
def naive_overall(a, b):
    both = bool(a["n"] and b["n"])
    s = {"isbn": float(both and a["n"] == b["n"]), "author": kernels.author(a["author"], b["author"]), "title": kernels.title(a["title"], b["title"])}
    hashes = a["simhash"] != 0 and b["simhash"] != 0
    s["simhash"] = 1 - (a["simhash"] ^ b["simhash"]).bit_count() / 64 if hashes else 0.0
    low, high = sorted((a["size"], b["size"]))
    s["size"] = 0.5 if low == 0 else min(low / high + 0.15, 1.0) if a["fmt"] != b["fmt"] else low / high
    w = {"isbn": 0.15, "author": 0.60, "title": 0.12, "simhash": 0.10, "size": 0.03}
    if not both:
        for k, share in (("simhash", 0.25), ("title", 0.15), ("author", 0.60)):
            w[k] += w["isbn"] * share
        w["isbn"] = 0.0
    if not hashes:
        extra = w["simhash"]
        for k, share in (("title", 0.25), ("author", 0.60), ("size", 0.15)):
            w[k] += extra * share
        w["simhash"] = 0.0
    x = sum(s[k] * w[k] for k in w) / sum(w.values())
    if not a["author"] or not b["author"]:
        x = min(x, 0.25)
    if s["isbn"] < 0.5:
        x = min(x, next((cap for limit, cap in ((0.35, 0.25), (0.55, 0.45), (0.70, 0.65)) if s["author"] < limit), 1.0))
    return min(x, 0.35) if s["title"] < 0.4 else x


def naive_same(a, b):
    from bibspark import constants as K

    if a["n"] and a["n"] == b["n"]:
        return True
    sim, title = kernels.author(a["author"], b["author"]), kernels.title(a["title"], b["title"])
    ca, cb, fa, fb = kernels.clean(a["author"]), kernels.clean(b["author"]), kernels.author_form(a["author"]), kernels.author_form(b["author"])
    if ca == cb or any(ca in p and cb in p for p in K.PSEUDONYMS):
        sim = max(sim, 1.0)
    ia, ib = sorted((kernels.ideographs(fa), kernels.ideographs(fb)), key=len)
    pairs = {frozenset(p) for p in K.SUSPICIOUS_PAIRS}
    if fa != fb and (frozenset((ca, cb)) in pairs or frozenset((fa, fb)) in pairs or (len(ia) == 2 and len(ib) == 3 and ia in ib)):
        sim *= 0.35
    na, nb = len(kernels.ideographs(a["author"])), len(kernels.ideographs(b["author"]))
    aok = sim >= 0.85 or sim >= 0.65 and (na == nb >= 2 or na >= 3 and nb >= 3)
    tok = title >= 0.60
    o = 0.0 if a["n"] and b["n"] else 0.60 * sim + 0.40 * title
    if sim < 0.40 or not aok and sim < 0.55:
        return False
    if o >= 0.80 and aok and tok or o >= 0.75 and aok or o >= 0.85 and tok and sim >= 0.65:
        return True
    return o >= 0.72 and aok


def naive_detect(books):
    out, done = [], set()

    def left():
        return [b for b in books if b["ord"] not in done]

    def buckets(rows, key):
        found = {}
        for b in rows:
            if b[key]:
                found.setdefault(b[key], []).append(b)
        return found.values()

    def greedy(rows, match):
        kept = rows[:1]
        for b in rows[1:]:
            if any(match(v, b) for v in kept):
                kept.append(b)
        return kept

    def similar(use_hash, need):
        def match(v, b):
            a, t = kernels.author(b["author"], v["author"]), kernels.title(b["title"], v["title"])
            ok = not (use_hash and b["simhash"] and v["simhash"]) or 1 - (b["simhash"] ^ v["simhash"]).bit_count() / 64 >= 0.80 * 0.8
            return not (need and a < 0.55) and (ok and naive_overall(b, v) >= 0.65 or t >= 0.85 and a >= 0.65)

        return match

    def mean(rows):
        own = [naive_overall(rows[i], rows[j]) for i in range(len(rows)) for j in range(i + 1, len(rows))]
        return sum(own) / len(own) if own else 0.0

    def emit(kind, rows, sim):
        out.append((kind, tuple(b["ord"] for b in rows), round(sim, 6)))
        done.update(b["ord"] for b in rows)

    for rows in buckets(books, "n"):
        if len(rows) > 1:
            emit("isbn_exact", rows, 1.0)
    for kind, key, need, floor in (("title_author_simhash", "tak", False, 0.0), ("title_with_author_check", "tk", True, 0.70)):
        for rows in list(buckets(left(), key)):
            rows = greedy(rows, naive_same)
            if len(rows) > 1 and len(rows := greedy(rows, similar(True, need))) > 1 and mean(rows) >= floor:
                emit(kind, rows, mean(rows))
    for rows in list(buckets(left(), "simhash")):
        if len(rows) > 1 and (m := mean(rows)) >= 0.80 and len(kept := greedy(rows, similar(False, True))) > 1:
            emit("simhash_content", kept, m)
    rest, taken = left(), set()
    for i, seed in enumerate(rest):
        if seed["ord"] in taken:
            continue
        star = [seed] + [b for b in rest[i + 1 :] if b["ord"] not in taken and naive_same(seed, b) and naive_overall(seed, b) >= 0.55]
        taken.update(b["ord"] for b in star)
        if len(star) > 1 and len(kept := greedy(star, similar(True, True))) > 1 and mean(kept) >= 0.70:
            emit("fuzzy_match", kept, mean(kept))
    return out


def test_detect_equals_naive(spark):
    rng = random.Random(5)
    titles = ["活着", "《活着》(珍藏版)", "三体", "三体 典藏版", "平凡的世界", "War and Peace", "War & Peace", "Pride and Prejudice", "Prejudice", "人生", "Великое"]
    authors = ["余华", "余华 著", "余秋雨", "鲁迅", "周树人", "路遥", "路遥远", "Jane Austen", "J. Austen", "Austen Jane", "Leo Tolstoy", "Alexei Tolstoy", "", "Толстой", "Éva Kiss", "Eva Kiss"]
    isbns = ["", "", "", "9787020089543", "7-02-008954-3", "9780306406157"]
    hashes = [0, 5, 7, -3, 1 << 40]
    rows = [(i, rng.choice(titles), rng.choice(authors), rng.choice(isbns) if rng.random() < 0.4 else "", rng.choice(hashes), rng.choice([0, 100, 120, 900]), rng.choice(["epub", "pdf"])) for i in range(90)]
    books = frame(spark, rows)
    plain = [
        {"ord": r["ord"], "title": r["title"], "author": r["author"], "n": r["isbn_normalized"], "simhash": r["simhash"] % (1 << 64), "size": r["file_size"], "fmt": r["file_format"], "tk": r["title_key"], "tak": r["title_author_key"]}
        for r in books.orderBy("ord").collect()
    ]
    want = naive_detect(plain)
    groups, members = detect.detect(books)
    by = {}
    for r in members.collect():
        by.setdefault(r["group_id"], []).append((r["member_pos"], r["ord"]))
    info = {r["group_id"]: r for r in groups.collect()}
    got = sorted((int(g.rpartition("_")[2]), info[g]["match_type"], tuple(o for _, o in sorted(m)), round(info[g]["similarity"], 6)) for g, m in by.items())
    assert [x[1:3] for x in got] == [x[:2] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)
    assert [x[0] for x in got] == list(range(len(want)))
    assert {x[0] for x in want} >= {"isbn_exact", "title_author_simhash", "fuzzy_match"}


def test_greedy_passes_equal_naive_loops(spark):
    rng = random.Random(2)
    edges, members, want_reach, want_star, star_edges = [], [], {}, {}, []
    for g in range(60):
        n = rng.randint(1, 9)
        match = {(j, i) for j in range(n) for i in range(j + 1, n) if rng.random() < 0.3}
        kept = [0]
        for i in range(1, n):
            if any((j, i) in match for j in kept):
                kept.append(i)
        want_reach[str(g)] = set(kept)
        members += [(str(g), i) for i in range(n)]
        edges += [(str(g), j, i) for j, i in match]
        star_edges += [(g * 10 + j, g * 10 + i) for j, i in match]
        owner = {}
        for i in range(n):
            if i not in owner:
                owner[i] = i
                owner |= {k: i for k in range(i + 1, n) if k not in owner and (i, k) in match}
        touched = {x for e in match for x in e}
        want_star |= {g * 10 + i: g * 10 + s for i, s in owner.items() if i in touched}
    got = {}
    for r in cluster.reachable(spark.createDataFrame(members, "bucket string, ord long"), spark.createDataFrame(edges, "bucket string, j long, i long")).collect():
        got.setdefault(r["bucket"], set()).add(r["ord"])
    assert got == want_reach
    assert {r["ord"]: r["seed"] for r in cluster.stars(spark.createDataFrame(star_edges, "j long, i long")).collect()} == want_star


def test_fuzzy_blocks_miss_nothing(spark):
    rng = random.Random(4)
    parts = ["余华", "路遥", "刘", "Jane", "Austen", "J.", "Leo", "Tolstoy", "Лев", "Éva", "Kiss", "王小明", "O'Neil", "ß", "é"]
    names = sorted({" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(150)})
    rows = [(i, "同", n, "", 0, 1, "epub") for i, n in enumerate(names)]
    found = {tuple(sorted((r["a_ord"], r["b_ord"]))) for r in candidates.fuzzy_pairs(frame(spark, rows)).select("a_ord", "b_ord").collect()}
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if max(kernels.author(names[i], names[j]), kernels.author(names[j], names[i])) >= 0.55:
                assert (i, j) in found, (names[i], names[j])


def test_recommendation_and_statistics(spark):
    kind = "group_id string, member_pos int, ord long, title string, author string, publisher string, publish_date string, isbn string, language string, description string, file_path string, file_format string, file_size long, simhash long, text_preview string, cover_path string, tags array<string>, metadata_completeness double"
    rows = [
        ("g", 0, 0, "活着", "余华", "p", "2012", "978", "zh", "d", "/a/活着 余华.epub", "epub", 300, 1, "x" * 200, "c", ["t"], 1.0),
        ("g", 1, 1, "活着", "余华", "", "", "", "zh", "", "/a/copy.pdf", "pdf", 900, 0, "", None, [], 3 / 7),
        ("g", 2, 2, "活着", "余华", "", "", "", "", "", "/a/b.mobi", "mobi", 0, 0, "", None, [], 2 / 7),
    ]
    own = recommend.ranked(recommend.scored(spark.createDataFrame(rows, kind)))
    got = own.orderBy("rank").collect()
    assert [r["ord"] for r in got] == [0, 1, 2]
    assert got[0]["score"] == pytest.approx(0.35 + 0.25 + 0.20 * 0.5 + 0.15 * 0.75 + 0.05 * 0.8)
    assert got[1]["filename_score"] == pytest.approx(0.35)
    why = {r["ord"]: r["removal_reasons"] for r in recommend.removal_reasons(own).collect()}
    assert why == {1: ["元数据较少", "格式较不通用 (PDF)", "体积过大", "缺少封面"], 2: ["元数据较少", "格式较不通用 (MOBI)", "可能是压缩版/删减版", "缺少封面"]}
    m = own.withColumn("match_type", F.lit("isbn_exact"))
    s = report.overview(detect.statistics(m.select("ord", "file_size", "file_format"), m.select("group_id", "match_type", "ord"))).first()
    assert (s["total_groups"], s["total_books"], s["removable"], s["total_size"], s["saved_size"], s["saved_percent"]) == (1, 3, 2, 1200, 300, 25.0)


def test_epub_round_trip(tmp_path, spark):
    raw = epub.make("Old", "A & B", "Some <text> here", isbn="9787020089543", tags=("x", "y", "x"), language="en")
    fresh = epub.write_metadata(raw, {"title": "New", "publisher": "P", "isbn": "isbn:ISBN:123", "author": ""})
    got = epub.read_metadata(fresh)
    assert (got["title"], got["author"], got["publisher"], got["isbn"], got["tags"], got["cover_path"]) == ("New", "A & B", "P", "ISBN:123", ["x", "y"], "cover.jpg")
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(fresh)) as a, zipfile.ZipFile(io.BytesIO(raw)) as b:
        assert a.namelist() == b.namelist() and a.infolist()[0].filename == "mimetype" and a.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert a.read("OEBPS/c1.xhtml") == b.read("OEBPS/c1.xhtml")
    assert epub.write_metadata(b"no zip", {}) is None and epub.read_metadata(b"no zip")["title"] == ""
    assert epub.read_text(raw) == "Some &lt;text&gt; here"
    path = tmp_path / "sub" / "book.epub"
    path.parent.mkdir()
    path.write_bytes(raw)
    assert epub.save_metadata(str(path), {"title": "Third"}) and [p.name for p in path.parent.iterdir()] == ["book.epub"]
    (tmp_path / "x.PDF").write_bytes(b"%PDF")
    (tmp_path / "y.doc").write_bytes(b"")
    rows = {r["title"]: r for r in files.parse(files.scan(spark, [str(tmp_path)])).collect()}
    assert set(rows) == {"Third", "x"} and rows["Third"]["file_format"] == "epub" and rows["x"]["file_format"] == "pdf"
    assert files.scan(spark, [str(tmp_path)], recursive=False).count() == 1
    assert files.scan(spark, [str(tmp_path / "none")]).count() == 0
    assert files.scan(spark, [str(tmp_path), str(tmp_path / "sub")]).count() == 3  # overlapping roots


def test_streaming_import(tmp_path, spark):
    from bibspark.streaming import incremental

    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.epub").write_bytes(epub.make(name.upper(), "X", "text"))
    for _ in range(2):
        incremental.import_stream(spark, str(folder), store, str(tmp_path / "ckpt")).awaitTermination()
        (folder / "c.epub").write_bytes(epub.make("C", "X", "text"))
    assert sorted(r["title"] for r in spark.read.parquet(store).collect()) == ["A", "B", "C"]


def test_bin(spark):
    e = spark.createDataFrame([("1", "2024-01-01T00:00:00"), ("2", "2024-03-01T00:00:00"), ("3", "no date"), ("4", None)], "id string, deleted_at string")
    stay, gone = bins.cleanup(e, F.lit("2024-03-02").cast("timestamp"), 30)
    assert {r["id"] for r in gone.collect()} == {"1"} and stay.count() == 3
    assert bins.cleanup(e, F.lit("2024-03-02").cast("timestamp"), 0)[1].count() == 0


def test_conversion_states(spark):
    t = spark.createDataFrame([("/a/b.epub", "PDF", True), ("/a/b.epub", "doc", True), ("/a/b.pdf", "mobi", False)], "input_path string, output_format string, input_exists boolean")
    got = convert.planned(t).collect()
    assert [(r["status"], r["output_path"]) for r in got] == [("pending", "/a/b.pdf"), ("error", "/a/b.doc"), ("error", "/a/b.mobi")]
    assert {r["error"] for r in convert.planned(t, tool_present=False).collect()} == {"converter not found"}


def test_sql_functions(spark):
    similarity.register(spark)
    r = spark.sql("select author_sim('余华', '余华 著') a, seq_ratio('abcd', 'bcde') s, nfkc('ＡＢ') n, fold_text('Éß') f").first()
    assert tuple(r) == (1.0, 0.75, "AB", "E")


def test_verdict_reasons(spark):
    rows = [(0, "活着", "余华", "", 0, 1, "epub"), (1, "活着", "王小明", "", 0, 1, "epub")]
    books, members = noded(spark, rows)
    met = quotient.node_pairs(quotient.bucket_nodes(members), quotient.nodes_of(books))
    v = verify.verified(met.withColumns({"author_ab": F.lit(0.0), "title_ab": F.lit(1.0)})).first()["verdict"]
    assert not v["is_same_book"] and v["severity"] == "low" and v["reasons"] == ["❌ 作者名完全不同，疑似不同书", "作者差异大，匹配度仅 0%", "书名匹配度 100%"]


def test_fixture_has_all_columns(spark):
    assert fixture.books(spark, "/root/testdata/sf0.001").count() == 200


def test_conversion_run_and_progress(tmp_path, spark):
    from bibspark.operators import progress

    (tmp_path / "a.epub").write_text("x")
    t = spark.createDataFrame([(str(tmp_path / "a.epub"), "txt", True), (str(tmp_path / "none.epub"), "txt", True), ("/b.pdf", "doc", True)], "input_path string, output_format string, input_exists boolean")
    done, seen = progress.observed(convert.run(convert.planned(t), command="cp"), "jobs", failed=F.count_if(F.col("status") == "error"))
    assert [r["status"] for r in done.collect()].count("completed") == 1
    assert (tmp_path / "a.txt").read_text() == "x" and seen.get == {"rows": 3, "failed": 2}
