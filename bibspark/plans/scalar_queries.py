"""Queries over scalar functions: text, keys, fingerprints, similarities, verifier rules. Each with its DuckDB statement where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import fingerprint, isbn, similarity, text
from ..operators import cluster, verify
from . import fixture
from .catalogue import BOOKS, Catalogue

catalogue = Catalogue()
query = catalogue.query
c = F.col
PUNCT, Q = text.PUNCTUATION, text.quoted


# ---------------------------------------------------------------- text
def _of_books(**columns):
    return lambda spark, d: fixture.books(spark, d).select("ord", *(make().alias(n) for n, make in columns.items()))


query("txt01_clean_text", f"{BOOKS} SELECT ord, {text.sql_squeeze('title')} AS cleaned FROM books")(_of_books(cleaned=lambda: text.clean_text(c("title"))))
query("txt02_remove_punctuation", f"{BOOKS} SELECT ord, {text.sql_remove_punctuation('title')} AS bare FROM books")(_of_books(bare=lambda: text.remove_punctuation(c("title"))))
query("txt03_normalize_general", f"{BOOKS} SELECT ord, {text.sql_normalize_general('lead_text')} AS form FROM books")(_of_books(form=lambda: text.normalize_general(c("lead_text"))))
query("txt04_normalize_for_author", f"{BOOKS} SELECT ord, {text.sql_normalize_general('author', True)} AS form FROM books")(_of_books(form=lambda: text.normalize_general(c("author"), True)))
query("txt05_normalize_title", f"{BOOKS} SELECT ord, {text.sql_normalize_title('title')} AS form FROM books")(_of_books(form=lambda: text.normalize_title(c("title"))))
query("txt06_normalize_author", f"{BOOKS} SELECT ord, {text.sql_normalize_author('author')} AS form FROM books")(_of_books(form=lambda: text.normalize_author(c("author"))))
query("txt07_normalize_isbn", f"{BOOKS} SELECT ord, {isbn.sql_normalize_isbn('isbn')} AS isbn13 FROM books")(_of_books(isbn13=lambda: isbn.normalize_isbn(c("isbn"))))
query("txt08_isbn_convert_validate", f"{BOOKS}, x AS (SELECT ord, {isbn.sql_isbn10_to_isbn13('isbn')} AS isbn13, concat('978', isbn) AS raw FROM books) SELECT ord, isbn13, {isbn.sql_is_isbn13('isbn13')} AS good, {isbn.sql_is_isbn13('raw')} AS raw_good FROM x")(
    lambda spark, d: fixture.books(spark, d).select("ord", isbn.isbn10_to_isbn13(c("isbn")).alias("isbn13"), F.concat(F.lit("978"), "isbn").alias("raw")).select("ord", "isbn13", isbn.is_isbn13(c("isbn13")).alias("good"), isbn.is_isbn13(c("raw")).alias("raw_good"))
)
SIZE_SQL = "CASE WHEN {0} < 1024 THEN concat(printf('%.1f', CAST({0} AS DOUBLE)), ' B') WHEN {0} < 1048576 THEN concat(printf('%.1f', {0} / 1024.0), ' KB') ELSE concat(printf('%.1f', {0} / 1048576.0), ' MB') END"
query("txt09_human_size", f"{BOOKS} SELECT ord, {SIZE_SQL.format('(file_size * 97)')} AS size_text FROM books")(_of_books(size_text=lambda: text.human_size(c("file_size") * 97)))


@query("txt10_html_escape", "SELECT page_id, replace(replace(replace(replace(substr(html, 1, 300), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def txt10(spark: SparkSession, d: str) -> DataFrame:
    return fixture.read(spark, d, "pages").select("page_id", text.html_escape(F.substring("html", 1, 300)).alias("escaped"))


NAME_SQL = "split_part(file_path, '/', -1)"
query("txt11_path_parts", rf"{BOOKS} SELECT ord, {NAME_SQL} AS name, lower(regexp_extract({NAME_SQL}, '^.+(\.[^.]+)$', 1)) AS suffix, regexp_extract({NAME_SQL}, '^(.+)\.[^.]+$', 1) AS stem FROM books")(
    _of_books(name=lambda: text.file_name(c("file_path")), suffix=lambda: text.suffix(c("file_path")), stem=lambda: text.stem(c("file_path")))
)
_CREDIT = "concat('[', language, '] ', author, ' /  ', publisher)"
query("txt12_online_author", rf"{BOOKS} SELECT ord, regexp_replace(regexp_replace({_CREDIT}, '[\[\]]', '', 'g'), '\s*/\s*', ', ', 'g') AS credit FROM books")(_of_books(credit=lambda: text.online_author(F.expr(_CREDIT))))
_LABELS = "concat('作者: ', author, chr(10), '出版社： ', publisher, chr(10), 'ISBN:', isbn)"
query("txt13_label_field", rf"{BOOKS} SELECT ord, trim(regexp_extract({_LABELS}, '出版社\s*[:：]\s*([^\n]+)', 1)) AS publisher, trim(regexp_extract({_LABELS}, 'ISBN\s*[:：]\s*([^\n]+)', 1)) AS isbn FROM books")(
    _of_books(publisher=lambda: text.label_field(F.expr(_LABELS), "出版社"), isbn=lambda: text.label_field(F.expr(_LABELS), "ISBN"))
)
_META = "concat(author, ' / ', title, ' / ', publisher, ' 出版社 / ', CAST(1990 + mod(ord, 30) AS STRING), '-', CAST(1 + mod(ord, 12) AS STRING))"


@query(
    "txt14_meta_text",
    rf"""{BOOKS}, p AS (SELECT ord, list_filter(list_transform(string_split({_META}, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM books)
    SELECT ord, coalesce(list_filter(parts, lambda x: NOT regexp_matches(x, '^[0-9]{{4}}') AND NOT regexp_matches(x, '出版社|出版|Publish'))[1], '') AS author,
      coalesce(list_filter(parts, lambda x: NOT regexp_matches(x, '^[0-9]{{4}}') AND regexp_matches(x, '出版社|出版|Publish'))[-1], '') AS publisher,
      coalesce(list_filter(parts, lambda x: regexp_matches(x, '^[0-9]{{4}}'))[-1], '') AS publish_date FROM p""",
)
def txt14(spark: SparkSession, d: str) -> DataFrame:
    author, publisher, date = text.meta_parts(F.expr(_META))
    return fixture.books(spark, d).select("ord", author.alias("author"), publisher.alias("publisher"), date.alias("publish_date"))


# ---------------------------------------------------------------- fingerprints
KEY_SQL = f"md5({text.sql_normalize_title('title')}) AS title_key, md5({text.sql_normalize_author('author')}) AS author_key"
query("fp01_03_keys", f"{BOOKS}, k AS (SELECT ord, {KEY_SQL} FROM books) SELECT *, md5(concat(title_key, '|', author_key)) AS title_author_key FROM k")(
    lambda spark, d: fixture.books(spark, d).select("ord", fingerprint.title_key(c("title")).alias("title_key"), fingerprint.author_key(c("author")).alias("author_key")).withColumn("title_author_key", fingerprint.title_author_key(c("title_key"), c("author_key")))
)
SIZE_HASH_SQL = f"CASE WHEN file_path <> '' THEN md5(concat(CAST(file_size AS VARCHAR), '|', lower({NAME_SQL}))) ELSE '' END"
query("fp04_size_hash", f"{BOOKS} SELECT ord, {SIZE_HASH_SQL} AS size_hash FROM books")(_of_books(size_hash=lambda: fingerprint.size_hash(c("file_size"), c("file_path"))))

#: The test tables hold no ideographs in texts, so the Latin half of the tokenizer is the whole of it there.
TOKENS_SQL = f"list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 1 AND NOT list_contains({text.sql_list(K.SIMHASH_STOPWORDS)}, w))"
COUNTS_SQL = f"WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM documents), n AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL)"
HASH_SQL = "CAST(concat('0x', substr(sha1(token), 1, 16)) AS UBIGINT)"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return fixture.read(spark, d, "documents")


@query("fp05_06_token_weights", f"{COUNTS_SQL} SELECT doc_id, token, n, round(n / sum(n) OVER (PARTITION BY doc_id), 9) AS weight FROM n")
def fp05(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    counts = fingerprint.token_counts(docs(spark, d), "doc_id", "text")
    return counts.withColumn("weight", F.round(c("n") / F.sum("n").over(Window.partitionBy("doc_id")), 9))


@query("fp07_token_hash", "WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents) SELECT token, substr(sha1(token), 1, 16) AS hash FROM t")
def fp07(spark: SparkSession, d: str) -> DataFrame:
    words = docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("token")).distinct()
    return words.select("token", fingerprint.hex16(fingerprint.token_hash(c("token"))).alias("hash"))


BITS_SQL = " + ".join(f"CASE WHEN 2 * sum(CASE WHEN (h >> {i}) & 1 = 1 THEN n ELSE 0 END) > sum(n) THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64))
SIMHASH_SQL = f"{COUNTS_SQL}, h AS (SELECT doc_id, n, {HASH_SQL} AS h FROM n), s AS (SELECT doc_id, {BITS_SQL} AS simhash FROM h GROUP BY doc_id)"


@query("fp08_simhash", f"{SIMHASH_SQL} SELECT doc_id, lpad(lower(hex(simhash)), 16, '0') AS simhash FROM s")
def fp08(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.simhashes(docs(spark, d), "doc_id", "text").select("doc_id", fingerprint.hex16(c("simhash")).alias("simhash"))


@query("fp09_10_hamming", f"{SIMHASH_SQL} SELECT a.doc_id, bit_count(xor(a.simhash, b.simhash)) :: INT AS distance, CASE WHEN a.simhash = 0 OR b.simhash = 0 THEN 0.0 ELSE 1 - bit_count(xor(a.simhash, b.simhash)) / 64.0 END :: DOUBLE AS similarity FROM s a JOIN s b ON b.doc_id = a.doc_id + 1")
def fp09(spark: SparkSession, d: str) -> DataFrame:
    own = fingerprint.simhashes(docs(spark, d), "doc_id", "text")
    other = own.select((c("doc_id") - 1).alias("doc_id"), c("simhash").alias("b"))
    return own.join(other, "doc_id").select("doc_id", fingerprint.hamming(c("simhash"), c("b")).alias("distance"), fingerprint.simhash_similarity(c("simhash"), c("b")).alias("similarity"))


query("fp11_preview", f"{BOOKS} SELECT ord, substr(lead_text, 1, 200) AS preview FROM books")(_of_books(preview=lambda: F.substring("lead_text", 1, 200)))
_FILLED = " + ".join(f"CASE WHEN trim(coalesce({f}, '')) <> '' THEN 1 ELSE 0 END" for f in fingerprint.COMPLETENESS)
query("fp13_completeness", f"{BOOKS} SELECT ord, round(({_FILLED}) / 7.0, 6) AS completeness FROM books")(_of_books(completeness=lambda: F.round(fingerprint.completeness(), 6)))
query("fp12_14_batch_fingerprints", f"{BOOKS}, k AS (SELECT ord, {isbn.sql_normalize_isbn('isbn')} AS isbn_normalized, {KEY_SQL}, {SIZE_HASH_SQL} AS size_hash, round(({_FILLED}) / 7.0, 6) AS metadata_completeness FROM books) SELECT *, md5(concat(title_key, '|', author_key)) AS title_author_key FROM k")(
    lambda spark, d: fingerprint.with_fingerprints(fixture.books(spark, d)).select("ord", "isbn_normalized", "title_key", "author_key", "size_hash", F.round("metadata_completeness", 6).alias("metadata_completeness"), "title_author_key")
)


# ---------------------------------------------------------------- similarities of neighbours in the catalogue
def pairs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    own = fixture.books(spark, d)
    a = own.select("ord", *(c(x).alias(f"a_{x}") for x in columns))
    return a.join(own.select((c("ord") - 1).alias("ord"), *(c(x).alias(f"b_{x}") for x in columns)), "ord")


def pair_sql(*columns: str, where: str = "books") -> str:
    return "p AS (SELECT a.ord, " + ", ".join(f"a.{x} AS a_{x}, b.{x} AS b_{x}" for x in columns) + f" FROM {where} a JOIN {where} b ON b.ord = a.ord + 1)"


def sql_jaccard(a: str, b: str) -> str:
    both = f"length(list_intersect({a}, {b}))"
    return f"CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE {both} / CAST(length(list_distinct(list_concat({a}, {b}))) AS DOUBLE) END"


@query("sim01_jaccard", f"{BOOKS}, {pair_sql('title')}, w AS (SELECT ord, list_distinct(string_split(lower(a_title), ' ')) AS x, list_distinct(string_split(lower(b_title), ' ')) AS y FROM p) SELECT ord, round(({sql_jaccard('x', 'y')})::DOUBLE, 6) AS similarity FROM w")
def sim01(spark: SparkSession, d: str) -> DataFrame:
    words = lambda x: F.array_distinct(F.split(F.lower(x), " "))
    return pairs(spark, d, "title").select("ord", F.round(similarity.jaccard(words("a_title"), words("b_title")), 6).alias("similarity"))


def sql_grams(x: str, n: int) -> str:
    bare = f"replace({x}, ' ', '')"
    return f"list_distinct(list_transform(range(1, greatest(length({bare}) - {n} + 1, 1) + 1), lambda i: substr({bare}, i, {n})))"


def sql_ngram(a: str, b: str, n: int) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE {sql_jaccard(sql_grams(a, n), sql_grams(b, n))} END"


@query("sim02_ngram", f"{BOOKS}, {pair_sql('title')} SELECT ord, round(({sql_ngram('a_title', 'b_title', 2)})::DOUBLE, 6) AS two, round(({sql_ngram('a_title', 'b_title', 3)})::DOUBLE, 6) AS three FROM p")
def sim02(spark: SparkSession, d: str) -> DataFrame:
    gram = lambda n: F.round(similarity.ngram(c("a_title"), c("b_title"), n), 6)
    return pairs(spark, d, "title").select("ord", gram(2).alias("two"), gram(3).alias("three"))


def _kernel(name: str, column: str, udf) -> None:
    query(name)(lambda spark, d: pairs(spark, d, column).select("ord", F.round(udf(c(f"a_{column}"), c(f"b_{column}")), 6).alias("similarity")))


_kernel("sim03_sequence_ratio", "title", similarity.seq_ratio)
_kernel("sim04_combined", "title", similarity.combined)
_kernel("sim05_author", "author", similarity.author)
_kernel("sim08_title", "title", similarity.title)


@query("sim06_chinese_author")
def sim06(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d, "author").filter("a_author rlike '[\\\\x{4e00}-\\\\x{9fff}]' and b_author rlike '[\\\\x{4e00}-\\\\x{9fff}]'")
    return own.select("ord", F.round(similarity.cjk_author(c("a_author"), c("b_author")), 6).alias("similarity"))


@query("sim07_western_author")
def sim07(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d, "author").filter("a_author rlike '[A-Za-z]' and b_author rlike '[A-Za-z]'")
    return own.select("ord", F.round(similarity.western_author(c("a_author"), c("b_author")), 6).alias("similarity"))


_SIZE_SCORE = "CASE WHEN a_file_size = 0 OR b_file_size = 0 THEN 0.5 WHEN a_file_format <> '' AND b_file_format <> '' AND lower(a_file_format) <> lower(b_file_format) THEN least(least(a_file_size, b_file_size) / greatest(a_file_size, b_file_size)::DOUBLE + 0.15, 1.0) ELSE least(a_file_size, b_file_size) / greatest(a_file_size, b_file_size)::DOUBLE END"


@query("sim09_10_isbn_size_scores", f"{BOOKS}, {pair_sql('isbn', 'file_size', 'file_format')} SELECT ord, CASE WHEN a_isbn <> '' AND a_isbn = b_isbn THEN 1.0 ELSE 0.0 END::DOUBLE AS isbn_score, round(({_SIZE_SCORE})::DOUBLE, 6) AS size_score FROM p")
def sim09(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d, "isbn", "file_size", "file_format")
    size = similarity.size_score(c("a_file_size"), c("b_file_size"), c("a_file_format"), c("b_file_format"))
    return own.select("ord", similarity.isbn_score(c("a_isbn"), c("b_isbn")).alias("isbn_score"), F.round(size, 6).alias("size_score"))


#: Scores given as functions of the place, so that every branch of weights and caps is met.
_GIVEN = "mod(ord * 7, 101) / 100.0 AS author, mod(ord * 13, 101) / 100.0 AS title, CASE WHEN mod(ord, 3) = 0 THEN 1.0 ELSE 0.0 END AS isbn, mod(ord * 17, 101) / 100.0 AS simhash, mod(ord * 19, 101) / 100.0 AS size, mod(ord, 4) < 2 AS isbns, mod(ord, 5) <> 1 AS hashes, mod(ord, 11) <> 0 AS authors"


@query(
    "sim11_overall",
    f"""WITH g0 AS (SELECT doc_id AS ord FROM documents), g1 AS (SELECT ord, {_GIVEN} FROM g0),
    g AS (SELECT ord, isbns, hashes, authors, author::DOUBLE AS author, title::DOUBLE AS title, isbn::DOUBLE AS isbn, simhash::DOUBLE AS simhash, size::DOUBLE AS size FROM g1),
    w AS (SELECT *, CASE WHEN isbns THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS wi, 0.60::DOUBLE + CASE WHEN isbns THEN 0::DOUBLE ELSE 0.15::DOUBLE * 0.60::DOUBLE END AS wa,
      0.12::DOUBLE + CASE WHEN isbns THEN 0::DOUBLE ELSE 0.15::DOUBLE * 0.15::DOUBLE END AS wt, 0.10::DOUBLE + CASE WHEN isbns THEN 0::DOUBLE ELSE 0.15::DOUBLE * 0.25::DOUBLE END AS wh, 0.03::DOUBLE AS ws FROM g),
    x AS (SELECT *, CASE WHEN hashes THEN 0::DOUBLE ELSE wh END AS e FROM w),
    y AS (SELECT *, wa + e * 0.60 AS va, wt + e * 0.25 AS vt, ws + e * 0.15 AS vs, wh - e AS vh FROM x),
    z AS (SELECT *, (isbn * wi + author * va + title * vt + simhash * vh + size * vs) / (wi + va + vt + vh + vs) AS s0 FROM y),
    u AS (SELECT *, CASE WHEN authors THEN s0 ELSE least(s0, 0.25) END AS s1 FROM z),
    v AS (SELECT *, CASE WHEN isbn >= 0.5 THEN s1 WHEN author < 0.35 THEN least(s1, 0.25) WHEN author < 0.55 THEN least(s1, 0.45) WHEN author < 0.70 THEN least(s1, 0.65) ELSE s1 END AS s2 FROM u)
    SELECT ord, round(CASE WHEN title < 0.4 THEN least(s2, 0.35) ELSE s2 END, 10) AS overall FROM v""",
)
def sim11(spark: SparkSession, d: str) -> DataFrame:
    given = docs(spark, d).select(c("doc_id").alias("ord")).selectExpr("ord", *[x.strip() for x in _split(_GIVEN)])
    scores = {k: c(k).cast("double") for k in K.OVERALL_WEIGHTS}
    return given.select("ord", F.round(similarity.overall(scores, c("isbns"), c("hashes"), c("authors")), 10).alias("overall"))


def _split(columns: str) -> list[str]:
    """Select list -> items; commas inside parentheses do not count."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


# ---------------------------------------------------------------- verifier rules
_PERSONS = {name: i for i, names in enumerate(K.PSEUDONYMS) for name in names}
_PERSON = lambda x: "CASE " + " ".join(f"WHEN {x} = {Q(n)} THEN {i}" for n, i in _PERSONS.items()) + " END"


@query("ver02_pseudonyms", f"{BOOKS}, {pair_sql('author')} SELECT ord, {text.sql_squeeze('a_author')} = {text.sql_squeeze('b_author')} OR coalesce({_PERSON(text.sql_squeeze('a_author'))} = {_PERSON(text.sql_squeeze('b_author'))}, false) AS known FROM p")
def ver02(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d, "author").select("ord", verify.pseudonym_match(text.clean_text(c("a_author")), text.clean_text(c("b_author"))).alias("known"))


_LISTED = text.sql_list(sorted({f"{x}|{y}" for x, y in K.SUSPICIOUS_PAIRS} | {f"{y}|{x}" for x, y in K.SUSPICIOUS_PAIRS}))
_IDEO = lambda x: rf"regexp_replace({x}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')"
_INSIDE = lambda s, t: f"(length({s}) = 2 AND length({t}) = 3 AND contains({t}, {s}))"


@query(
    "ver03_suspicious_pairs",
    f"""{BOOKS}, {pair_sql('author')}, f AS (SELECT ord, {text.sql_squeeze('a_author')} AS ra, {text.sql_squeeze('b_author')} AS rb, {text.sql_normalize_author('a_author')} AS fa, {text.sql_normalize_author('b_author')} AS fb FROM p),
    i AS (SELECT *, {_IDEO('fa')} AS ia, {_IDEO('fb')} AS ib FROM f)
    SELECT ord, fa <> fb AND (list_contains({_LISTED}, concat(ra, '|', rb)) OR list_contains({_LISTED}, concat(fa, '|', fb)) OR {_INSIDE('ia', 'ib')} OR {_INSIDE('ib', 'ia')}) AS suspicious FROM i""",
)
def ver03(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d, "author").select("ord", *(f(c(f"{s}_author")).alias(f"{s}{n}") for s in "ab" for n, f in (("r", text.clean_text), ("f", text.normalize_author))))
    return own.select("ord", verify.suspicious_pair(c("ar"), c("br"), c("af"), c("bf")).alias("suspicious"))


_SIMS = "round(mod(ord * 7, 101) / 100.0, 2) AS author_sim, round(mod(ord * 13, 101) / 100.0, 2) AS title_sim"


@query(
    "ver04_07_decision",
    f"""{BOOKS}, {pair_sql('author', 'isbn')}, g AS (SELECT *, {_SIMS.replace('100.0', '100.0::DOUBLE')} FROM p),
    n AS (SELECT *, length({_IDEO('a_author')}) AS na, length({_IDEO('b_author')}) AS nb FROM g),
    o AS (SELECT *, author_sim >= 0.85 OR author_sim >= 0.65 AND (na = nb AND na >= 2 OR na >= 3 AND nb >= 3) AS author_fits, title_sim >= 0.60 AS title_fits,
      CASE WHEN a_isbn <> '' AND b_isbn <> '' THEN CASE WHEN a_isbn = b_isbn THEN 1.0 ELSE 0.0 END::DOUBLE ELSE 0.60::DOUBLE * author_sim + 0.40::DOUBLE * title_sim END AS total FROM n)
    SELECT ord, author_fits, title_fits, round(total, 6) AS total, CASE WHEN author_sim < 0.40 THEN false WHEN NOT author_fits AND author_sim < 0.55 THEN false WHEN total >= 0.80 AND author_fits AND title_fits THEN true
      WHEN total >= 0.75 AND author_fits THEN true WHEN total >= 0.85 AND title_fits AND author_sim >= 0.65 THEN true WHEN total < 0.65 THEN false WHEN NOT author_fits THEN false ELSE total >= 0.72 END AS same FROM o""",
)
def ver04(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d, "author", "isbn").selectExpr("*", *[x.replace("100.0", "double(100.0)") for x in _split(_SIMS)])
    a, t = c("author_sim"), c("title_sim")
    own = own.withColumns({"author_fits": verify.author_ok(a, c("a_author"), c("b_author")), "title_fits": verify.title_ok(t), "total": verify.overall(a, t, c("a_isbn"), c("b_isbn"))})
    return own.select("ord", "author_fits", "title_fits", F.round("total", 6).alias("total"), verify.decision(a, c("title_fits"), c("author_fits"), c("total")).alias("same"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    own = fingerprint.with_fingerprints(fixture.books(spark, d))
    names = ["title", "author", "author_clean", "author_form", "isbn_normalized"]
    a = own.select("ord", *(c(x).alias(f"a_{x}") for x in names))
    met = a.join(own.select((c("ord") - 1).alias("ord"), *(c(x).alias(f"b_{x}") for x in names)), "ord")
    met = met.withColumns({"author_ab": similarity.author(c("a_author"), c("b_author")), "title_ab": similarity.title(c("a_title"), c("b_title"))})
    return verify.verified(met)


@query("ver01_verify_pairs")
def ver01(spark: SparkSession, d: str) -> DataFrame:
    own = verdicts(spark, d).select("ord", "verdict.*")
    return own.withColumns({x: F.round(x, 6) for x in ("author_confidence", "title_confidence", "overall_confidence")}).withColumn("reasons", F.array_join("reasons", "; "))


@query("ver08_filter_candidates")
def ver08(spark: SparkSession, d: str) -> DataFrame:
    """Candidates verified against the first book of their list only; a list is a book with its later editions."""
    own = fingerprint.with_fingerprints(fixture.editions(spark, d)).withColumn("list", c("ord") % 1_000_000_000)
    names = ["ord", "title", "author", "author_clean", "author_form", "isbn_normalized"]
    seed = own.groupBy("list").agg(F.min_by(F.struct(*names), "ord").alias("s")).select("list", *(c(f"s.{x}").alias(f"a_{x}") for x in names))
    met = own.select("list", *(c(x).alias(f"b_{x}") for x in names)).join(seed, "list").filter("b_ord > a_ord")
    met = met.withColumns({"author_ab": similarity.author(c("a_author"), c("b_author")), "title_ab": similarity.title(c("a_title"), c("b_title"))})
    # cut, as a filter on the verdict would take all of its rules with it
    same = cluster.cut(verify.verified(met).select(c("a_ord").alias("seed_ord"), c("b_ord").alias("ord"), c("verdict.is_same_book").alias("same")))
    return same.filter("same").drop("same")


_GAP = "abs(a_file_size - b_file_size) / greatest(a_file_size, b_file_size)::DOUBLE"


@query("ver09_size_compatible", f"{BOOKS}, {pair_sql('file_size', 'file_format')} SELECT ord, a_file_size = 0 OR b_file_size = 0 OR {_GAP} < 0.3 OR a_file_format <> b_file_format OR {_GAP} < 0.05 AS compatible FROM p")
def ver09(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d, "file_size", "file_format")
    return own.select("ord", verify.size_compatible(c("a_file_size"), c("b_file_size"), c("a_file_format"), c("b_file_format")).alias("compatible"))
