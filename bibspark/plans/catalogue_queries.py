"""Queries over groups and the catalogue: detection, ranking, reports, edits, bin, lookup, conversion, sources, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import fingerprint, isbn, text
from ..operators import bin as bins
from ..operators import cluster, convert, detect, edit, enrich, increments, recommend, report
from ..sources import epub, files, index_log
from ..streaming import incremental
from . import fixture
from .catalogue import BOOKS, Catalogue
from .scalar_queries import NAME_SQL, SIZE_SQL, docs

catalogue = Catalogue()
query = catalogue.query
c = F.col
Q = text.quoted


def books(spark: SparkSession, d: str) -> DataFrame:
    return fixture.books(spark, d)


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new folder in the place that the cluster shares."""
    cluster.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{stem}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- detection
ISBN_SQL = f"{BOOKS}, n AS (SELECT *, {isbn.sql_normalize_isbn('isbn')} AS isbn_normalized FROM books), k AS (SELECT isbn_normalized AS bucket FROM n WHERE isbn_normalized <> '' GROUP BY 1 HAVING count(*) >= 2)"
#: Members of ISBN groups with all that ranking needs; groups are numbered by their first books.
MEMBERS_SQL = f"""{ISBN_SQL}, f AS (SELECT isbn_normalized AS bucket, min(ord) AS first FROM n SEMI JOIN k ON isbn_normalized = k.bucket GROUP BY 1),
    g AS (SELECT bucket, concat('group_isbn_', CAST(row_number() OVER (ORDER BY first) - 1 AS VARCHAR)) AS group_id FROM f),
    m AS (SELECT g.group_id, n.*, row_number() OVER (PARTITION BY g.group_id ORDER BY ord) - 1 AS member_pos,
      ({' + '.join(f"CASE WHEN trim(coalesce({x}, '')) <> '' THEN 1 ELSE 0 END" for x in fingerprint.COMPLETENESS)}) / 7.0::DOUBLE AS metadata_completeness,
      substr(lead_text, 1, 200) AS text_preview, list_filter(string_split(tag_text, ','), lambda t: t <> '') AS tags,
      CASE WHEN length(list_filter(regexp_extract_all(lower(lead_text), '[a-z]+'), lambda w: length(w) > 1 AND NOT list_contains({text.sql_list(K.SIMHASH_STOPWORDS)}, w))) > 0 THEN 1 ELSE 0 END AS simhash FROM n JOIN g ON n.isbn_normalized = g.bucket)"""


def isbn_books(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).withColumn("isbn_normalized", isbn.normalize_isbn(c("isbn")))


def fingerprinted_isbn_books(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(books of ISBN groups with fingerprints, their (bucket, ord)): only what is in a group is fingerprinted."""
    own = isbn_books(spark, d)
    found = detect.cut(detect.isbn_groups(own))
    return fingerprint.with_fingerprints(own.join(found.select("ord"), "ord", "left_semi")), found


def isbn_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of the ISBN groups with fingerprint columns."""
    own, found = fingerprinted_isbn_books(spark, d)
    own = own.withColumn("tags", edit.tags_of(c("tag_text")))
    first = found.groupBy("bucket").agg(F.min("ord").alias("first")).withColumns({"stage": F.lit(0), "prefix": F.lit("group_isbn_")})
    ids = detect.numbered(first).select("bucket", "group_id")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("ord")) - 1
    return found.join(ids, "bucket").join(own, "ord").withColumn("member_pos", place)


@query("ded01_isbn_groups", f"{ISBN_SQL} SELECT isbn_normalized AS bucket, count(*) AS n_books, min(ord) AS first_ord, sum(file_size)::BIGINT AS total_size, (sum(file_size) - max(file_size))::BIGINT AS saved_size FROM n SEMI JOIN k ON isbn_normalized = k.bucket GROUP BY 1")
def ded01(spark: SparkSession, d: str) -> DataFrame:
    own = isbn_books(spark, d).filter("isbn_normalized <> ''")
    sums = own.groupBy(c("isbn_normalized").alias("bucket")).agg(F.count(F.lit(1)).alias("n_books"), F.min("ord").alias("first_ord"), F.sum("file_size").alias("total_size"), (F.sum("file_size") - F.max("file_size")).alias("saved_size"))
    return sums.filter("n_books >= 2")


@query("ded02_residue", f"{ISBN_SQL} SELECT ord, file_path FROM n ANTI JOIN k ON isbn_normalized = k.bucket")
def ded02(spark: SparkSession, d: str) -> DataFrame:
    own = isbn_books(spark, d)
    return own.join(detect.isbn_groups(own), "ord", "left_anti").select("ord", "file_path")


def _detected(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Groups and members of a detection run over the whole catalogue."""
    return detect.detect(fingerprint.with_fingerprints(books(spark, d)))


@query("ded00_detect_groups")
def ded00(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d)[0].withColumn("similarity", F.round("similarity", 6))


@query("ded00_detect_members")
def ded00_members(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d)[1]


@query("ded00_increment")
def ded00_increment(spark: SparkSession, d: str) -> DataFrame:
    """Groups after a fifth of the catalogue has been added to the rest; the same as those of one run over all."""
    own = detect.cut(fingerprint.with_fingerprints(books(spark, d)).select(*detect.NEEDED))
    state = increments.extended(increments.begun(own.filter("mod(ord, 5) <> 0")), own.filter("mod(ord, 5) = 0"))
    return state.groups()[0].withColumn("similarity", F.round("similarity", 6))


def _stage(match_type: str, catalogue=books):
    """Groups of one stage; the stages after it are not run."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        groups, members = detect.detect(fingerprint.with_fingerprints(catalogue(spark, d)), upto=match_type)
        return members.filter(c("match_type") == match_type).join(groups.select("group_id", F.round("similarity", 6).alias("similarity")), "group_id")

    return run


query("ded03_06_07_title_author")(_stage("title_author_simhash"))
query("ded04_title_with_author")(_stage("title_with_author_check", fixture.editions))
query("ded05_content")(_stage("simhash_content", fixture.editions))
query("ded10_fuzzy")(_stage("fuzzy_match"))


@query("ded08_09_pair_and_group_similarity")
def ded09(spark: SparkSession, d: str) -> DataFrame:
    """Mean pair similarity inside the ISBN groups."""
    own, found = fingerprinted_isbn_books(spark, d)
    return detect.group_similarity(own, found).select("bucket", F.round("similarity", 6).alias("similarity"))


_MAP_TEXT = "array_join(transform(map_entries({0}), e -> concat(e.key, '=', cast(e.value as string))), ',')"


@query(
    "ded11_statistics",
    f"""{MEMBERS_SQL}, p AS (SELECT group_id, count(*) AS n, sum(file_size) AS size, max(file_size) AS largest FROM m GROUP BY 1), t AS (SELECT file_format, count(*) AS n FROM m GROUP BY 1)
    SELECT count(*) AS total_groups, coalesce(sum(n), 0)::BIGINT AS total_books, coalesce(sum(n - 1), 0)::BIGINT AS removable, coalesce(sum(size), 0)::BIGINT AS total_size, coalesce(sum(size - largest), 0)::BIGINT AS saved_size,
      (SELECT string_agg(concat(file_format, '=', CAST(n AS VARCHAR)), ',' ORDER BY file_format) FROM t) AS formats, concat('isbn_exact=', CAST(count(*) AS VARCHAR)) AS match_types FROM p""",
)
def ded11(spark: SparkSession, d: str) -> DataFrame:
    own = isbn_members(spark, d).withColumn("match_type", F.lit("isbn_exact"))
    stats = detect.statistics(own.select("ord", "file_size", "file_format"), own.select("group_id", "match_type", "ord"))
    return stats.withColumns({"formats": F.expr(_MAP_TEXT.format("format_counts")), "match_types": F.expr(_MAP_TEXT.format("match_type_counts"))}).drop("format_counts", "match_type_counts")


# ---------------------------------------------------------------- ranking
_FORMAT_SQL = "CASE lower(file_format) " + " ".join(f"WHEN {Q(k)} THEN {v}" for k, v in K.FORMAT_SCORES.items()) + f" ELSE {K.OTHER_FORMAT_SCORE} END::DOUBLE"
_BAD_SQL = " + ".join(f"CASE WHEN contains(lower(name), {Q(w)}) THEN 0.15 ELSE 0 END" for w in K.BAD_NAME_WORDS)
SCORED_SQL = f"""{MEMBERS_SQL}, a AS (SELECT *, {NAME_SQL} AS name, min(CASE WHEN file_size > 0 THEN file_size END) OVER w AS low, max(CASE WHEN file_size > 0 THEN file_size END) OVER w AS high, avg(CASE WHEN file_size > 0 THEN file_size END) OVER w AS mean FROM m WINDOW w AS (PARTITION BY group_id)),
    s AS (SELECT *, metadata_completeness AS metadata_score, {_FORMAT_SQL} AS format_score,
      CASE WHEN low IS NULL THEN 0.5 WHEN file_size = 0 THEN 0.3 WHEN high = low THEN 1.0 WHEN file_size <= mean THEN 0.5 + (file_size - low) / (mean - low) * 0.5 ELSE 0.5 + (high - file_size) / (high - mean) * 0.5 END::DOUBLE AS size_score,
      (0.5 + CASE WHEN cover_path <> '' THEN 0.15 ELSE 0 END + CASE WHEN length(tags) > 0 THEN 0.1 ELSE 0 END)::DOUBLE AS quality_score,
      greatest(0, least(1, 0.5 - ({_BAD_SQL}) - CASE WHEN contains(name, '[') AND contains(name, ']') THEN 0.1 ELSE 0 END - CASE WHEN contains(name, '(') AND contains(name, ')') THEN 0.05 ELSE 0 END
        + CASE WHEN title <> '' AND contains(name, title) THEN 0.2 ELSE 0 END + CASE WHEN author <> '' AND contains(name, author) THEN 0.1 ELSE 0 END))::DOUBLE AS filename_score FROM a),
    r0 AS (SELECT *, 0.35 * metadata_score + 0.25 * format_score + 0.20 * size_score + 0.15 * quality_score + 0.05 * filename_score AS score FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(score, 9) DESC, member_pos) AS rank FROM r0)"""
_SCORES = ("metadata_score", "format_score", "size_score", "quality_score", "filename_score", "score")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("rec01_06_scores", f"{SCORED_SQL} SELECT group_id, ord, " + ", ".join(f"round({x}, 6) AS {x}" for x in _SCORES) + " FROM r")
def rec01(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(recommend.scored(isbn_members(spark, d)).select("group_id", "ord", *_SCORES), *_SCORES)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Ranked ISBN groups. Scores are compared to nine digits, as the two engines add in different orders."""
    return recommend.ranked(recommend.scored(isbn_members(spark, d)).withColumn("score", F.round("score", 9)))


@query("rec07_keep", f"{SCORED_SQL} SELECT group_id, ord AS keep_ord, round(score, 6) AS score FROM r WHERE rank = 1")
def rec07(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).filter("rank = 1").select("group_id", c("ord").alias("keep_ord"), F.round("score", 6).alias("score"))


@query("rec08_rank", f"{SCORED_SQL} SELECT group_id, ord, rank FROM r")
def rec08(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("group_id", "ord", "rank")


_KEEP_SQL = f"""list_filter([CASE WHEN format_score >= 0.9 THEN concat('格式通用 (', upper(file_format), ')') END, CASE WHEN metadata_score >= 0.8 THEN {Q(K.KEEP_METADATA)} END, CASE WHEN size_score >= 0.8 THEN {Q(K.KEEP_SIZE)} END,
    CASE WHEN cover_path <> '' THEN {Q(K.KEEP_COVER)} END, CASE WHEN length(text_preview) > 300 THEN {Q(K.KEEP_TEXT)} END], lambda x: x IS NOT NULL)"""


@query("rec09_keep_reasons", f"{SCORED_SQL} SELECT group_id, ord, array_to_string({_KEEP_SQL}, '; ') AS reasons FROM r")
def rec09(spark: SparkSession, d: str) -> DataFrame:
    return recommend.scored(isbn_members(spark, d)).select("group_id", "ord", F.array_join(recommend.keep_reasons(), "; ").alias("reasons"))


_DROP_SQL = f"""list_filter([CASE WHEN r.metadata_completeness < k.metadata_completeness THEN {Q(K.DROP_METADATA)} END, CASE WHEN r.format_score < k.format_score THEN concat('格式较不通用 (', upper(r.file_format), ')') END,
    CASE WHEN r.file_size > k.file_size * 1.5 THEN {Q(K.DROP_LARGE)} END, CASE WHEN r.file_size < k.file_size * 0.5 THEN {Q(K.DROP_SMALL)} END, CASE WHEN r.cover_path = '' AND k.cover_path <> '' THEN {Q(K.DROP_COVER)} END], lambda x: x IS NOT NULL)"""


@query("rec10_removal_reasons", f"{SCORED_SQL} SELECT r.group_id, r.ord, k.ord AS keep_ord, array_to_string({_DROP_SQL}, '; ') AS reasons FROM r JOIN r k ON k.group_id = r.group_id AND k.rank = 1 WHERE r.rank > 1")
def rec10(spark: SparkSession, d: str) -> DataFrame:
    return recommend.removal_reasons(_ranked(spark, d)).select("group_id", "ord", "keep_ord", F.array_join("removal_reasons", "; ").alias("reasons"))


@query("rec11_auto_dedup", f"{SCORED_SQL} SELECT r.group_id, r.ord, r.file_path, k.file_path AS kept_path, r.file_size FROM r JOIN r k ON k.group_id = r.group_id AND k.rank = 1 WHERE r.rank > 1")
def rec11(spark: SparkSession, d: str) -> DataFrame:
    return recommend.removal_plan(_ranked(spark, d))


# ---------------------------------------------------------------- reports
@query("rpt01_overview", f"{MEMBERS_SQL}, p AS (SELECT group_id, count(*) AS n, sum(file_size) AS size, max(file_size) AS largest FROM m GROUP BY 1) SELECT count(*) AS total_groups, sum(n)::BIGINT AS total_books, sum(n - 1)::BIGINT AS removable, sum(size)::BIGINT AS total_size, sum(size - largest)::BIGINT AS saved_size, round(CASE WHEN sum(size) > 0 THEN sum(size - largest) * 100.0 / sum(size) ELSE 0 END, 6)::DOUBLE AS saved_percent FROM p")
def rpt01(spark: SparkSession, d: str) -> DataFrame:
    own = isbn_members(spark, d).withColumn("match_type", F.lit("isbn_exact"))
    return _rounded(report.overview(detect.statistics(own.select("ord", "file_size", "file_format"), own.select("group_id", "match_type", "ord"))), "saved_percent")


@query("rpt02_format_distribution", f"{BOOKS}, n AS (SELECT file_format, count(*) AS n FROM books GROUP BY 1) SELECT file_format, file_format AS label, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM n")
def rpt02(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.distribution(books(spark, d), "file_format"), "percent")


_TYPES = "split_part('isbn_exact|title_author_simhash|title_with_author_check|simhash_content|fuzzy_match', '|', 1 + CAST(mod(doc_id, 5) AS INT))"
_LABEL_SQL = "CASE match_type " + " ".join(f"WHEN {Q(k)} THEN {Q(v)}" for k, v in K.MATCH_LABELS.items()) + " ELSE match_type END"


@query("rpt03_match_type_distribution", f"WITH t AS (SELECT {_TYPES} AS match_type FROM documents), n AS (SELECT match_type, count(*) AS n FROM t GROUP BY 1) SELECT match_type, {_LABEL_SQL} AS label, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM n")
def rpt03(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.match_distribution(docs(spark, d).select(F.expr(_TYPES).alias("match_type"))), "percent")


@query(
    "rpt04_group_details",
    f"{SCORED_SQL} SELECT group_id, 'isbn_exact' AS match_type, 1.0::DOUBLE AS similarity, count(*) AS n_books, min_by(title, member_pos) AS first_title, sum(file_size)::BIGINT AS size, (sum(file_size) - max(file_size))::BIGINT AS saved_size, sum(CASE WHEN rank > 1 THEN file_size ELSE 0 END)::BIGINT AS actual_saved_size FROM r GROUP BY 1",
)
def rpt04(spark: SparkSession, d: str) -> DataFrame:
    own = isbn_members(spark, d)
    groups = own.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_books")).select("group_id", F.lit("isbn_exact").alias("match_type"), F.lit(1.0).alias("similarity"), "n_books")
    return report.group_details(groups, own)


@query("rpt05_compare_view", f"{SCORED_SQL} SELECT group_id, rank, ord, title, author, round(score, 6) AS score, round(metadata_score, 6) AS metadata_score, array_to_string({_KEEP_SQL}, '; ') AS keep_reasons, {SIZE_SQL.format('file_size')} AS size_text, substr(text_preview, 1, 300) AS preview FROM r")
def rpt05(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report.compare_view(_ranked(spark, d)), "score", "metadata_score").withColumn("keep_reasons", F.array_join("keep_reasons", "; "))


@query("rpt06_catalogue_filter", f"{BOOKS} SELECT ord, title, author FROM books WHERE upper(file_format) = 'EPUB' AND contains(lower(concat_ws(' ', title, author, isbn, publisher)), 'au')")
def rpt06(spark: SparkSession, d: str) -> DataFrame:
    return report.catalogue_filter(books(spark, d), "epub", "AU").select("ord", "title", "author")


@query("rpt07_sort", f"{BOOKS} SELECT ord, file_size FROM books ORDER BY file_size DESC, ord")
def rpt07(spark: SparkSession, d: str) -> DataFrame:
    return report.sorted_catalogue(books(spark, d), "file_size", descending=True).select("ord", "file_size")


@query("rpt08_catalogue_view", f"{BOOKS} SELECT ord, title, author, publisher, isbn, language, upper(file_format) AS format_label, {SIZE_SQL.format('file_size')} AS size_text, file_path FROM books")
def rpt08(spark: SparkSession, d: str) -> DataFrame:
    return report.catalogue_view(books(spark, d))


# ---------------------------------------------------------------- bin, on the event table as a delete log
ENTRIES_SQL = """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id, concat('/lib/', event_type, '/', CAST(event_id AS VARCHAR), '.epub') AS file_path, CAST(floor(coalesce(value, 0) * 1000) AS BIGINT) AS file_size, ts FROM events)"""
NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def deletions(spark: SparkSession, d: str) -> DataFrame:
    ev = fixture.read(spark, d, "events")
    return ev.select(
        c("event_id").cast("string").alias("entry_id"),
        F.concat(F.lit("/lib/"), "event_type", F.lit("/"), c("event_id").cast("string"), F.lit(".epub")).alias("file_path"),
        F.floor(F.coalesce("value", F.lit(0.0)) * 1000).cast("long").alias("file_size"),
        c("ts").cast("timestamp").alias("deleted"),
        F.create_map(F.lit("title"), c("event_type"), F.lit("author"), c("user_id").cast("string")).alias("metadata"),
    )


def entries(spark: SparkSession, d: str) -> DataFrame:
    return bins.delete(deletions(spark, d))


_DELETED_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


@query("bin01_delete", f"{ENTRIES_SQL} SELECT id, file_path AS original_path, concat('/bin/files/', strftime(ts, '%Y%m%d_%H%M%S'), '_', substr(id, 1, 8), '_', {NAME_SQL}) AS recycle_path, {NAME_SQL} AS file_name, file_size, {_DELETED_SQL} AS deleted_at FROM e")
def bin01(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).drop("metadata")


@query(
    "bin02_restore",
    f"""{ENTRIES_SQL}, w AS (SELECT id, concat('/lib/', CAST(CAST(id AS BIGINT) // 20 AS VARCHAR), '.epub') AS p, CAST(id AS BIGINT) // 20 AS q FROM e WHERE CAST(id AS BIGINT) % 10 = 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY id) - CASE WHEN q % 2 = 0 THEN 0 ELSE 1 END AS turn FROM w)
    SELECT id, CASE WHEN turn = 0 THEN p ELSE concat('/lib/', CAST(q AS VARCHAR), '_restored', CAST(CASE WHEN q % 3 = 0 THEN turn + 1 ELSE turn END AS VARCHAR), '.epub') END AS restored_path FROM t""",
)
def bin02(spark: SparkSession, d: str) -> DataFrame:
    """Two entries to a path; every second path exists, of every third path also the first restored name."""
    own = entries(spark, d).withColumn("q", F.floor(c("id").cast("long") / 20)).withColumn("original_path", F.concat(F.lit("/lib/"), c("q").cast("string"), F.lit(".epub")))
    there = own.select("q").distinct()
    path = lambda end: F.concat(F.lit("/lib/"), c("q").cast("string"), F.lit(end)).alias("file_path")
    existing = there.filter("q % 2 = 0").select(path(".epub")).unionByName(there.filter("q % 3 = 0").select(path("_restored1.epub")))
    return bins.restore(own, own.filter(c("id").cast("long") % 10 == 0).select("id"), existing)


@query("bin03_purge", f"{ENTRIES_SQL} SELECT id FROM e WHERE CAST(id AS BIGINT) % 4 <> 0")
def bin03(spark: SparkSession, d: str) -> DataFrame:
    own = entries(spark, d)
    return bins.purge(own, own.filter(c("id").cast("long") % 4 == 0).select("id")).select("id")


@query("bin04_newest_first", f"{ENTRIES_SQL} SELECT id, {_DELETED_SQL} AS deleted_at FROM e ORDER BY deleted_at DESC, id")
def bin04(spark: SparkSession, d: str) -> DataFrame:
    return bins.newest_first(entries(spark, d)).select("id", "deleted_at")


@query("bin05_06_totals", f"{ENTRIES_SQL} SELECT count(*) AS n_entries, sum(file_size)::BIGINT AS total_size FROM e")
def bin05(spark: SparkSession, d: str) -> DataFrame:
    return bins.totals(entries(spark, d))


@query("bin07_ttl_cleanup", f"{ENTRIES_SQL}, m AS (SELECT max(ts) AS now FROM e) SELECT id FROM e, m WHERE ts < now - INTERVAL 10 DAY")
def bin07(spark: SparkSession, d: str) -> DataFrame:
    own = entries(spark, d)
    now = deletions(spark, d).agg(F.max("deleted").alias("now"))
    return own.join(F.broadcast(now)).filter(bins.expired(c("deleted_at"), c("now"), 10)).select("id")  # one row


@query("bin08_catalogue_sync", f"{BOOKS} SELECT ord FROM books WHERE mod(ord, 3) <> 0")
def bin08(spark: SparkSession, d: str) -> DataFrame:
    own = books(spark, d)
    gone = own.filter("mod(ord, 3) = 0").select(c("ord").cast("string").alias("entry_id"), "file_path", "file_size", F.lit("2024-01-01").cast("timestamp").alias("deleted"), F.create_map(F.lit("group_id"), F.lit("g")).alias("metadata"))
    return bins.without_removed(own, bins.delete(gone)).select("ord")


@query("rpt09_bin_listing", f"{ENTRIES_SQL} SELECT e.id, {NAME_SQL} AS file_name, {SIZE_SQL.format('file_size')} AS size_text, strftime(e.ts, '%Y-%m-%d %H:%M:%S') AS deleted_text, v.event_type AS title, CAST(v.user_id AS VARCHAR) AS author, strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%f') AS deleted_at FROM e JOIN events v ON CAST(v.event_id AS VARCHAR) = e.id")
def rpt09(spark: SparkSession, d: str) -> DataFrame:
    return report.bin_listing(entries(spark, d))


# ---------------------------------------------------------------- edits
@query("edt01_batch_update", f"{BOOKS} SELECT ord, title, CASE WHEN mod(ord, 5) = 0 THEN 'House' ELSE publisher END AS publisher, language FROM books")
def edt01(spark: SparkSession, d: str) -> DataFrame:
    return edit.apply_batch(books(spark, d), {"publisher": "House", "language": "", "colour": "red"}, c("ord") % 5 == 0).select("ord", "title", "publisher", "language")


@query("edt02_single_update", f"{BOOKS} SELECT ord, CASE WHEN file_path = '/lib/src0/0.epub' THEN 'New' ELSE title END AS title FROM books")
def edt02(spark: SparkSession, d: str) -> DataFrame:
    return edit.apply_single(books(spark, d), "/lib/src0/0.epub", {"title": "New"}).select("ord", "title")


def _merge(overwrite: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        labels = fixture.read(spark, d, "labels").groupBy(c("doc_id").alias("ord")).agg(F.max("quality").alias("q"))
        source = labels.select("ord", F.concat(F.lit("q"), c("q").cast("string")).alias("publisher"), F.when(c("q") == 1, "kept").otherwise("").alias("description"))
        return edit.merge_from_source(books(spark, d), source, overwrite=overwrite).select("ord", "publisher", "description")

    return run


_LABELS_SQL = f"{BOOKS}, s AS (SELECT doc_id AS ord, concat('q', CAST(max(quality) AS VARCHAR)) AS p, CASE WHEN max(quality) = 1 THEN 'kept' ELSE '' END AS t FROM labels GROUP BY 1)"
query("edt03_merge_fill", f"{_LABELS_SQL} SELECT ord, CASE WHEN publisher = '' THEN coalesce(p, '') ELSE publisher END AS publisher, coalesce(t, '') AS description FROM books LEFT JOIN s USING (ord)")(_merge(False))
query("edt03_merge_overwrite", f"{_LABELS_SQL} SELECT ord, coalesce(p, publisher) AS publisher, coalesce(t, '') AS description FROM books LEFT JOIN s USING (ord)")(_merge(True))


@query("edt04_form_tags", f"{BOOKS} SELECT ord, array_to_string(list_filter(list_transform(string_split(concat(language, ' , ,', publisher, ','), ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags FROM books")
def edt04(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("ord", F.array_join(edit.tags_of(F.concat("language", F.lit(" , ,"), "publisher", F.lit(","))), "|").alias("tags"))


# ---------------------------------------------------------------- lookup, on responses made from the catalogue
def _responses(spark: SparkSession, d: str) -> DataFrame:
    """One search response per book: a full document and an empty one."""
    own = books(spark, d)
    doc = F.struct(
        c("title"), F.filter(F.array("author", F.lit("Anon")), lambda x: x != "").alias("author_name"), F.array("publisher").alias("publisher"), F.array("language").alias("language"),
        F.lit(1990).alias("first_publish_year"), F.when(c("isbn") != "", F.array("isbn")).alias("isbn"), F.array(F.concat(F.lit("OL"), c("ord").cast("string"))).alias("edition_key"),
    )
    return own.select("ord", F.to_json(F.struct(F.array(doc).alias("docs"))).alias("body"))


_AUTHORS_SQL = "CASE WHEN author = '' THEN 'Anon' ELSE concat(author, ', Anon') END"


@query("net03_parse_search", f"{BOOKS} SELECT ord, 0 AS pos, title, {_AUTHORS_SQL} AS author, publisher, '1990' AS publish_date, isbn, language, concat('cover:OL', CAST(ord AS VARCHAR)) AS cover_url FROM books")
def net03(spark: SparkSession, d: str) -> DataFrame:
    return enrich.parse_search_docs(_responses(spark, d))


@query("net04_parse_isbn_record", f"{BOOKS} SELECT ord, title, CASE WHEN mod(ord, 2) = 0 THEN concat(author, ', Anon') ELSE concat('Anon, ', author) END AS author, publisher, '2001' AS publish_date FROM books WHERE author <> ''")
def net04(spark: SparkSession, d: str) -> DataFrame:
    own = books(spark, d).filter("author <> ''")
    even = F.struct("title", F.array(F.struct(c("author").alias("name")), F.struct(F.lit("Anon").alias("name"))).alias("authors"), F.array(F.struct(c("publisher").alias("name"))).alias("publishers"), F.lit("2001").alias("publish_date"))
    odd = F.struct("title", F.array(F.lit("Anon"), "author").alias("authors"), F.array("publisher").alias("publishers"), F.lit("2001").alias("publish_date"))
    return enrich.parse_isbn_record(own.select("ord", F.when(c("ord") % 2 == 0, F.to_json(even)).otherwise(F.to_json(odd)).alias("body")))


@query("net05_parse_suggestions", f"{BOOKS} SELECT ord, 0 AS pos, title, author, '1999' AS publish_date, '' AS cover_url FROM books WHERE title <> ''")
def net05(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("title", c("author").alias("author_name"), F.lit("1999").alias("year"))
    body = F.concat(F.lit("["), F.to_json(item), F.lit(', 7, {"title": ""}]'))
    return enrich.parse_suggestions(books(spark, d).select("ord", body.alias("body")))


_PAGE = """concat('<html><div class="subject-item"><a title="', replace(title, '"', ''), '">', title, '</a><div class="pub">', author, ' / ', publisher, '出版社 / 2001-2</div><span class="rating_nums">8.', cast(mod(ord, 10) as string), '</span><img src="c.jpg"></div></html>')"""


@query("net06_parse_search_page", f"{BOOKS} SELECT ord, replace(title, '\"', '') AS title, author, concat(publisher, '出版社') AS publisher, '2001-2' AS publish_date, '' AS isbn, '' AS language, '' AS description, concat('8.', CAST(mod(ord, 10) AS VARCHAR)) AS rating, 'c.jpg' AS cover_url FROM books WHERE title <> ''")
def net06(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("ord", F.explode(enrich.search_pages(F.expr(_PAGE))).alias("r")).select("ord", "r.*")


@query(
    "net07_parse_detail_page",
    rf"""{BOOKS} SELECT ord, title, trim(concat(language, ' ', author)) AS author, CASE WHEN publisher = '' THEN trim(concat('ISBN: ', isbn)) ELSE publisher END AS publisher, '' AS publish_date, isbn,
    substr(trim(regexp_replace(lead_text, '\s+', ' ', 'g')), 1, 300) AS description, '' AS language, '' AS rating, '' AS cover_url FROM books""",
)
def net07(spark: SparkSession, d: str) -> DataFrame:
    page = F.expr("concat('<h1>', title, '</h1><div id=\"info\"><span>作者</span>: [', language, '] ', author, '<br/><span>出版社:</span> ', publisher, '<br/>ISBN: ', isbn, '</div><div class=\"intro\">', lead_text, '</div>')")
    return books(spark, d).select("ord", enrich.detail_pages(page).alias("r")).select("ord", "r.*")


@query("net01_search_union", f"{BOOKS}, u AS (SELECT 0 AS source_rank, ord AS pos, title FROM books WHERE mod(ord, 2) = 0 UNION ALL SELECT 1, ord, title FROM books WHERE mod(ord, 3) = 0) SELECT pos, title, source_rank FROM u ORDER BY source_rank, pos LIMIT 20")
def net01(spark: SparkSession, d: str) -> DataFrame:
    own = books(spark, d).select(c("ord").alias("pos"), "title")
    return enrich.search([own.filter("mod(pos, 2) = 0"), own.filter("mod(pos, 3) = 0")], 10)


@query("net02_isbn_fallback", f"{BOOKS} SELECT ord, CASE WHEN mod(ord, 2) = 0 THEN title WHEN mod(ord, 3) = 0 THEN author END AS record FROM books")
def net02(spark: SparkSession, d: str) -> DataFrame:
    own = books(spark, d)
    return enrich.first_found(own.select("ord"), [own.filter("mod(ord, 2) = 0").select("ord", c("title").alias("record")), own.filter("mod(ord, 3) = 0").select("ord", c("author").alias("record"))], key="ord")


@query("net08_query_isbn", rf"{BOOKS} SELECT ord, regexp_replace(concat(substr(isbn, 1, 3), '- ', substr(isbn, 4)), '[-\s]', '', 'g') AS isbn FROM books")
def net08(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("ord", isbn.query_isbn(F.concat(F.substring("isbn", 1, 3), F.lit("- "), F.expr("substr(isbn, 4)"))).alias("isbn"))


# ---------------------------------------------------------------- conversion
_TARGETS_SQL = " UNION ALL ".join(f"SELECT {Q(s)} AS s, {Q(t)} AS t" for s, ts in K.CONVERSIONS.items() for t in ts)


@query("cnv01_targets", f"{BOOKS}, v AS ({_TARGETS_SQL}) SELECT DISTINCT t AS target_format FROM books JOIN v ON lower(file_format) = s ORDER BY 1")
def cnv01(spark: SparkSession, d: str) -> DataFrame:
    return convert.targets(books(spark, d))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return convert.planned(books(spark, d).select("ord", c("file_path").alias("input_path"), F.expr("split_part('mobi|PDF|txt|doc', '|', 1 + CAST(mod(ord, 4) AS INT))").alias("output_format"), (c("ord") % 9 != 0).alias("input_exists")))


_PLAN_SQL = rf"""{BOOKS}, v AS ({_TARGETS_SQL}), t AS (SELECT ord, file_path AS input_path, split_part('mobi|PDF|txt|doc', '|', 1 + CAST(mod(ord, 4) AS INT)) AS output_format, mod(ord, 9) <> 0 AS input_exists, file_format FROM books),
    p AS (SELECT ord, input_path, output_format, input_exists, concat(regexp_extract(input_path, '^(.*)\.[^.]+$', 1), '.', lower(output_format)) AS output_path,
      CASE WHEN NOT input_exists THEN 'input not found' WHEN NOT EXISTS (SELECT 1 FROM v WHERE s = file_format AND t = lower(output_format)) THEN 'conversion not supported' ELSE '' END AS error FROM t)"""


@query("cnv02_03_plan", f"{_PLAN_SQL} SELECT *, CASE WHEN error = '' THEN 'pending' ELSE 'error' END AS status FROM p")
def cnv02(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d)


@query("cnv04_summary", f"{_PLAN_SQL} SELECT count(*) FILTER (error = '') AS n_ok, count(*) FILTER (error <> '') AS n_failed FROM p")
def cnv04(spark: SparkSession, d: str) -> DataFrame:
    return convert.summary(_tasks(spark, d))


# ---------------------------------------------------------------- sources and sinks
@query("src02_union_of_roots", f"{BOOKS} SELECT ord, file_path FROM books WHERE mod(ord, 2) = 0 UNION ALL SELECT ord, file_path FROM books WHERE mod(ord, 3) = 0")
def src02(spark: SparkSession, d: str) -> DataFrame:
    own = books(spark, d).select("ord", "file_path")
    return own.filter("mod(ord, 2) = 0").unionByName(own.filter("mod(ord, 3) = 0"))


@query("src03_supported_files", rf"{BOOKS}, u AS (SELECT ord, CASE WHEN mod(ord, 7) = 0 THEN '/lib/.epub' ELSE replace(file_path, 'epub', 'EPUB') END AS p FROM books), s AS (SELECT *, lower(regexp_extract(split_part(p, '/', -1), '^.+(\.[^.]+)$', 1)) AS x FROM u) SELECT ord, ltrim(x, '.') AS file_format, list_contains(['.epub', '.mobi', '.pdf'], x) AS supported FROM s")
def src03(spark: SparkSession, d: str) -> DataFrame:
    own = books(spark, d).withColumn("p", F.when(c("ord") % 7 == 0, "/lib/.epub").otherwise(F.replace("file_path", F.lit("epub"), F.lit("EPUB"))))
    return own.select("ord", files.file_format(c("p")).alias("file_format"), files.supported(c("p")).alias("supported"))


def _book_files(spark: SparkSession, d: str) -> DataFrame:
    """Book files in memory, as a scan would give them; every fifth is broken."""

    @F.udf(T.BinaryType(), useArrow=False)
    def make(title, author, lead, number):
        return b"broken" if number % 5 == 0 else epub.make(title, author, lead, isbn=f"978{number}", tags=("one", "two", "one"), language="en")

    name = F.concat(F.lit("/lib/"), c("ord").cast("string"), F.lit(".epub"))
    return books(spark, d).select("ord", "title", "author", "lead_text", name.alias("path"), make("title", "author", "lead_text", "ord").alias("content")).withColumn("length", F.length("content").cast("long"))


_STEM = "CAST(ord AS VARCHAR)"
_ESCAPED = "replace(replace(replace(lead_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    "src01_04_05_06_parse_epub",
    rf"""{BOOKS}, e AS (SELECT *, mod(ord, 5) <> 0 AS good FROM books) SELECT concat('/lib/', {_STEM}, '.epub') AS file_path, CASE WHEN good AND title <> '' THEN title ELSE {_STEM} END AS title, CASE WHEN good THEN author ELSE '' END AS author,
    CASE WHEN good THEN 'en' ELSE '' END AS language, CASE WHEN good THEN concat('ISBN:978', {_STEM}) ELSE '' END AS isbn, CASE WHEN good THEN 'one,two' ELSE '' END AS tags, CASE WHEN good THEN 'cover.jpg' END AS cover_path,
    CASE WHEN good THEN least(length(trim(regexp_replace({_ESCAPED}, '\s+', ' ', 'g'))), 1000) ELSE 0 END AS n_text, 'epub' AS file_format FROM e""",
)
def src05(spark: SparkSession, d: str) -> DataFrame:
    return files.parse(_book_files(spark, d)).select("file_path", "title", "author", "language", "isbn", F.array_join("tags", ",").alias("tags"), "cover_path", F.length("lead_text").alias("n_text"), "file_format")


@query("src04_title_fallback", rf"{BOOKS} SELECT file_path, regexp_extract(split_part(file_path, '/', -1), '^(.+)\.[^.]+$', 1) AS title, file_format FROM books WHERE file_format IN ('txt', 'azw3')")
def src04(spark: SparkSession, d: str) -> DataFrame:
    own = books(spark, d).filter("file_format in ('txt', 'azw3')").select(c("file_path").alias("path"), c("file_size").alias("length"), F.lit(b"").alias("content"))
    return files.parse(own).select("file_path", "title", "file_format")


@query("src07_13_mobi", rf"{BOOKS} SELECT concat('/lib/', {_STEM}, '.mobi') AS file_path, coalesce(nullif(trim(substr(regexp_replace(author, '[^\x00-\x7F]', '', 'g'), 1, 31)), ''), {_STEM}) AS title, '' AS lead_text FROM books")
def src07(spark: SparkSession, d: str) -> DataFrame:
    head = F.encode(F.rpad(F.substring(F.regexp_replace("author", "[^\\x00-\\x7F]", ""), 1, 31), 32, "\u0000"), "UTF-8")
    return files.parse(books(spark, d).select(F.concat(F.lit("/lib/"), c("ord").cast("string"), F.lit(".mobi")).alias("path"), c("file_size").alias("length"), head.alias("content"))).select("file_path", "title", "lead_text")


@query("src08_12_pdf", f"{BOOKS} SELECT concat('/lib/', {_STEM}, '.pdf') AS file_path, {_STEM} AS title, '' AS lead_text FROM books")
def src08(spark: SparkSession, d: str) -> DataFrame:
    return files.parse(books(spark, d).select(F.concat(F.lit("/lib/"), c("ord").cast("string"), F.lit(".pdf")).alias("path"), c("file_size").alias("length"), F.lit(b"%PDF").alias("content"))).select("file_path", "title", "lead_text")


@query("src09_pdf_field", rf"{BOOKS} SELECT ord, trim(regexp_replace(regexp_replace(concat('/D:', CAST(ord AS VARCHAR), ' ', file_format, ' '), '^/', ''), '^[Dd]:', '')) AS field FROM books")
def src09(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d).select("ord", text.clean_pdf_field(F.concat(F.lit("/D:"), c("ord").cast("string"), F.lit(" "), "file_format", F.lit(" "))).alias("field"))


@query("src10_11_strip_tags", r"SELECT page_id, substr(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 1000) AS lead_text FROM pages")
def src10(spark: SparkSession, d: str) -> DataFrame:
    return fixture.read(spark, d, "pages").select("page_id", F.substring(text.strip_tags(c("html")), 1, 1000).alias("lead_text"))


@query("src14_import_new", f"{BOOKS} SELECT file_path FROM books WHERE mod(ord, 2) = 0 OR mod(ord, 3) = 0")
def src14(spark: SparkSession, d: str) -> DataFrame:
    own = books(spark, d).select("file_path", "title", "ord")
    return files.import_new(own.filter("mod(ord, 2) = 0"), own.filter("mod(ord, 3) = 0")).select("file_path")


@query("src15_index_from_json", f"{ENTRIES_SQL} SELECT id, file_path AS original_path, '' AS recycle_path, '' AS file_name, file_size, '' AS deleted_at FROM e")
def src15(spark: SparkSession, d: str) -> DataFrame:
    own = entries(spark, d).withColumn("shard", c("id").cast("long") % 16)
    index = own.groupBy("shard").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.struct("original_path", "file_size"))))).alias("value"))
    return files.index_from_json(index).drop("metadata")


@query("src16_books_from_json", f"{BOOKS} SELECT title, author, '' AS publisher, file_path, file_size, false AS is_duplicate, 0.0::DOUBLE AS metadata_completeness FROM books")
def src16(spark: SparkSession, d: str) -> DataFrame:
    rows = books(spark, d).select(F.to_json(F.struct("title", "author", "file_path", "file_size", F.lit("x").alias("other"))).alias("value"))
    return files.books_from_json(rows).select("title", "author", "publisher", "file_path", "file_size", "is_duplicate", "metadata_completeness")


@query("snk01_02_save_epub", f"{BOOKS} SELECT concat('/lib/', {_STEM}, '.epub') AS file_path, trim(concat('New ', title)) AS title, author, 'ISBN:123' AS isbn FROM books WHERE mod(ord, 5) <> 0")
def snk01(spark: SparkSession, d: str) -> DataFrame:
    """Write a new title into each container and read it back."""
    own = _book_files(spark, d).withColumn("changes", F.create_map(F.lit("title"), F.concat(F.lit("New "), "title"), F.lit("isbn"), F.lit("ISBN:ISBN:123")))
    saved = files.save_epub_rows(own).filter("saved is not null").select("ord", "path", c("saved").alias("content")).withColumn("length", F.length("content").cast("long"))
    return files.parse(saved).select("file_path", "title", "author", "isbn")


@query("snk03_index_persist", f"{ENTRIES_SQL} SELECT id, file_size FROM e")
def snk03(spark: SparkSession, d: str) -> DataFrame:
    """Write the index and read it again."""
    path = shared_folder(spark, "index")
    files.write_index(entries(spark, d), path)
    return spark.read.parquet(path).select("id", "file_size")


@query("snk03_src15_index_log", f"{ENTRIES_SQL} SELECT id, CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN file_size + 1 ELSE file_size END AS file_size FROM e WHERE CAST(id AS BIGINT) % 5 <> 0")
def snk03_log(spark: SparkSession, d: str) -> DataFrame:
    """All entries are put, every seventh is put anew, every fifth dropped; the log is compacted in between. Its folder is removed when it has been read."""
    path, number = shared_folder(spark, "index-log"), c("id").cast("long")
    own = detect.cut(entries(spark, d))
    event = lambda df, op, seq: df.withColumns({"op": F.lit(op), "seq": number + seq})
    index_log.append(event(own, index_log.PUT, 0), path)
    index_log.append(event(own.filter(number % 7 == 0).withColumn("file_size", c("file_size") + 1), index_log.PUT, 1), path)
    index_log.compact(spark, path)
    index_log.append(event(own.filter(number % 5 == 0), index_log.DROP, 2), path)
    found = detect.cut(index_log.load(spark, path).select("id", "file_size"))
    index_log.remove(spark, path)
    return found


@query("snk04_to_json", f"{BOOKS} SELECT ord, json_object('title', title, 'file_size', file_size, 'cover_path', NULL)::VARCHAR AS value FROM books")
def snk04(spark: SparkSession, d: str) -> DataFrame:
    own = books(spark, d)
    return own.select("ord", F.to_json(F.struct("title", "file_size", F.lit(None).cast("string").alias("cover_path")), {"ignoreNullFields": "false"}).alias("value"))


@query("str01_deletions_per_window", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", count(*) AS n, round(sum(value), 6) AS bytes FROM events GROUP BY ALL")
def str01(spark: SparkSession, d: str) -> DataFrame:
    own = incremental.deletions_per_window(fixture.read(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")))
    return own.select(c("start").cast("timestamp_ntz").alias("start"), c("end").cast("timestamp_ntz").alias("end"), "n", F.round("bytes", 6).alias("bytes"))


# ---------------------------------------------------------------- streams with keyed state
def streamed(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table's files as a stream, some files to a batch. The pattern makes a table of one file and one of a folder alike."""
    return spark.readStream.schema(fixture.read(spark, d, table).schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/{table}.parque[t]")


def _drained(spark: SparkSession, start) -> DataFrame:
    """What a stream has written once it has met all of its input; ``start`` gets a place for its table and one for its checkpoint."""
    folder = shared_folder(spark, "stream")
    start(f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/table")


@query("src14_import_stream", f"{BOOKS} SELECT file_path, title FROM books WHERE mod(ord, 3) <> 0")
def src14_stream(spark: SparkSession, d: str) -> DataFrame:
    """All books come as a stream, every other one twice; a third of them is known."""
    known = books(spark, d).filter("mod(ord, 3) = 0")
    found = spark.sql(fixture.BOOKS_SQL.replace("FROM documents", "FROM {documents}"), documents=streamed(spark, d, "documents")).select("file_path", "title", "ord")
    twice = found.withColumn("copy", F.explode(F.when(c("ord") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return _drained(spark, lambda table, at: incremental.append_new(twice, table, at, known)).select("file_path", "title")


#: What each kind of event does to a user's file in the life cycle below.
_KIND = "CASE event_type WHEN 'click' THEN 'restore' WHEN 'purchase' THEN 'purge' ELSE 'delete' END"
_DAYS = 2
_OUTCOME_SQL = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, {_KIND} AS kind, ts FROM events), m AS (SELECT date_trunc('millisecond', max(ts)) AS now FROM e),
    n AS (SELECT *, lead(ts) OVER w AS next, lead(kind) OVER w AS then_kind FROM e WINDOW w AS (PARTITION BY id ORDER BY ts, seq)),
    o AS (SELECT id, seq, ts, ts + INTERVAL {_DAYS} DAY AS lim, next, then_kind FROM n WHERE kind = 'delete'),
    r AS (SELECT id, ts AS deleted, CASE WHEN next <= lim THEN CASE then_kind WHEN 'restore' THEN 'restored' WHEN 'purge' THEN 'purged' ELSE 'replaced' END ELSE 'expired' END AS outcome, CASE WHEN next <= lim THEN next ELSE lim END AS ended FROM o)
    SELECT id, deleted, outcome, ended FROM r, m WHERE ended < now AND deleted < now"""


def _bin_events(df: DataFrame) -> DataFrame:
    return df.selectExpr("CAST(user_id AS STRING) AS id", "event_id AS seq", f"{_KIND} AS kind", "CAST(ts AS TIMESTAMP) AS ts")


@query("bin09_outcomes_stream", _OUTCOME_SQL)
def bin09_stream(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each deletion: restored, purged, replaced or expired, by event time and timers."""
    found = incremental.bin_outcomes_stream(_bin_events(streamed(spark, d, "events")), _DAYS)
    start = lambda table, at: found.writeStream.format("parquet").option("path", table).option("checkpointLocation", at).trigger(availableNow=True).start()
    return _drained(spark, start).select("id", c("deleted").cast("timestamp_ntz").alias("deleted"), "outcome", c("ended").cast("timestamp_ntz").alias("ended"))


@query("bin09_outcomes", _OUTCOME_SQL.replace("ended < now AND deleted < now", "(outcome <> 'expired' OR ended < (SELECT max(ts) FROM e))"))
def bin09(spark: SparkSession, d: str) -> DataFrame:
    """The same of the whole table at once."""
    found = incremental.bin_outcomes(_bin_events(fixture.read(spark, d, "events")), _DAYS)
    return found.select("id", c("deleted").cast("timestamp_ntz").alias("deleted"), "outcome", c("ended").cast("timestamp_ntz").alias("ended"))
