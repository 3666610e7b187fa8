"""Quality rules with adaptive thresholds, native DataFrame operations only.

Counts per document feed mergeable quantile sketches per language and source; thresholds are read
off the sketches and joined back. The sketch is a logarithmic-linear histogram of integers: exact
below 512 and with 256 bins per power of two above, so two sketches merge by adding counts, in any
order, with the same result on every run. A threshold is a fence FENCE spreads beyond a quartile of
the group's own sketch: quartiles stay put as long as less than a quarter of a group is junk. The
fence of a group of n documents is mixed with its language's, n to PRIOR, and that with the whole
corpus's, so that small groups lean on the wider sketches by degrees. There are no fixed cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, checkpointed, column, free_names, row_key

SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATS = 5, 10, 20

#: Adaptive features: name, value in thousandths as an integer expression (SQL for both engines), which side is bad.
#: Repeated words are left to the base rule: most documents have none, and those that have some are no outliers.
FEATURES: tuple[tuple[str, str, str], ...] = (
    ("symbols", "n_symbols * 1000 div n_words", "high"),
    ("dup_lines", "n_dup_lines * 1000 div n_words", "high"),
    ("long_words", "word_chars * 1000 div n_words", "high"),
    ("short_words", "word_chars * 1000 div n_words", "low"),
)
#: Spreads (upper quartile less lower quartile, one thousandth at least) from a quartile to its fence.
FENCE = 10
#: Documents' worth of the wider sketch's fence in that of a narrower one. Leading binary digits that a sketch keeps of a value.
PRIOR, DIGITS = 50, 9


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def counts(docs: DataFrame, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """``keep`` and the base counts of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. Null counts as empty.

    Repeated 5-word windows are found inside the row: hashes of the windows are sorted with their places, equal neighbours mark
    repeats, and one fold adds up the words that they cover. Only documents in which two windows agree are sorted at all.
    """
    names = [f"k{i}" for i in range(len(keep))]
    text = F.coalesce(F.col(text_col), F.lit(""))

    def barrier(df: DataFrame, cols: dict[str, Column], keep_cols: list[str]) -> DataFrame:
        """Compute columns once: an optimizer never merges projections across a generator."""
        made = F.struct(*(c.alias(n) for n, c in cols.items()))
        return df.select(*keep_cols, F.explode(F.array(made)).alias("x")).select(*keep_cols, "x.*")

    first = docs.select(*(F.col(k).alias(n) if isinstance(k, str) else k.alias(n) for k, n in zip(keep, names, strict=True)), text.alias("t"))
    base = barrier(
        first,
        {
            "w": _words(F.col("t")),
            "word_chars": F.length(F.translate("t", SPACES, "")),
            "n_symbols": F.length("t") - F.length(F.translate("t", SYMBOLS, "")),
            "l": F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
        },
        names,
    )
    starts = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(1), F.size("w") - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    hashed = barrier(
        base,
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.col("word_chars").cast("long"),
            "n_symbols": F.col("n_symbols").cast("long"),
            "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
            "h": F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, WINDOW))),
        },
        names,
    )
    plain = [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    placed = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    ordered = barrier(hashed, {"s": placed}, plain)
    equal = lambda x, other: F.coalesce(F.get(F.col("s"), other)["h"] == x["h"], F.lit(False))
    twice = F.array_sort(F.transform(F.filter("s", lambda x, i: equal(x, i - 1) | equal(x, i + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        twice,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    out = ordered.select(*plain, F.when(F.size("s") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"))
    return out


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))


def sketch_bin(value: Column) -> Column:
    """Lower end of the value's bin: the value with all but its DIGITS leading binary digits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(features: DataFrame) -> DataFrame:
    """(level, lang, source, feature, bin, n): mergeable sketches per (language, source), language and corpus, of documents that pass the base rules."""
    own = F.array(*(F.struct(F.lit(name).alias("feature"), sketch_bin(F.expr(value.replace("div n_words", "div greatest(n_words, 1)"))).alias("bin")) for name, value in _measures()))
    fine = features.filter(~base_failed()).select("lang", "source", F.explode(own).alias("x")).groupBy("lang", "source", "x.feature", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    fine = checkpointed(fine)
    by_lang = fine.groupBy("lang", "feature", "bin").agg(F.sum("n").alias("n"))
    whole = by_lang.groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return (
        fine.select(F.lit(2).alias("level"), "lang", "source", "feature", "bin", "n")
        .unionByName(by_lang.select(F.lit(1).alias("level"), "lang", none.alias("source"), "feature", "bin", "n"))
        .unionByName(whole.select(F.lit(0).alias("level"), none.alias("lang"), none.alias("source"), "feature", "bin", "n"))
    )


def _measures() -> list[tuple[str, str]]:
    """One sketch per distinct expression."""
    seen: dict[str, str] = {}
    for name, value, _ in FEATURES:
        seen.setdefault(value, name)
    return [(name, value) for value, name in seen.items()]


def thresholds(sketch: DataFrame) -> DataFrame:
    """(level, lang, source, n, q1_<measure>, q3_<measure>...): quartiles of every sketch. A sketch has a bounded number of bins, whatever it has counted."""
    key = ["level", "lang", "source", "feature"]
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_n = Window.partitionBy(*key)
    ranked = sketch.select(*key, "bin", F.sum("n").over(upto).alias("c"), F.sum("n").over(all_n).alias("total"))
    picks = [F.max("total").alias("n")]
    for name, _ in _measures():
        for q in (1, 3):
            picks.append(F.min(F.when((F.col("feature") == name) & (4 * F.col("c") >= q * F.col("total")), F.col("bin"))).alias(f"q{q}_{name}"))
    return ranked.groupBy("level", "lang", "source").agg(*picks)


def _fences(levels: DataFrame) -> DataFrame:
    """(lang, source, f_<feature>...) of every language and source: its own fence mixed with its language's, that one with the corpus's."""
    shared = dict((value, name) for name, value in _measures())
    own = []
    for name, value, side in FEATURES:
        q1, q3 = F.col(f"q1_{shared[value]}"), F.col(f"q3_{shared[value]}")
        spread = FENCE * F.greatest(q3 - q1, F.lit(1))
        own.append((q3 + spread if side == "high" else F.greatest(q1 - spread, F.lit(0))).alias(f"f_{name}"))
    raw = checkpointed(levels.select("level", "lang", "source", "n", *own))
    names = [f"f_{name}" for name, *_ in FEATURES]
    whole = raw.filter("level = 0").first() or dict.fromkeys(names)  # one row
    mixed = lambda f, g: F.call_function("div", F.col("n") * F.col(f) + PRIOR * g, F.col("n") + PRIOR)
    lang = raw.filter("level = 1").select(F.col("lang").alias("of"), *(mixed(f, F.lit(whole[f]).cast("long")).alias(f"w{f}") for f in names))
    met = raw.filter("level = 2").join(lang, F.col("lang").eqNullSafe(F.col("of")))
    return met.select("lang", "source", *(mixed(f, F.col(f"w{f}")).alias(f) for f in names))


def verdicts(features: DataFrame) -> DataFrame:
    """``features`` (cheap to read again; with lang and source) plus base_failed and kept."""
    fences = _fences(thresholds(sketches(features)))
    fences = fences.select(F.col("lang").alias("lang_of"), F.col("source").alias("source_of"), *(f"f_{name}" for name, *_ in FEATURES))
    met = features.join(fences, features.lang.eqNullSafe(F.col("lang_of")) & features.source.eqNullSafe(F.col("source_of")), "left")
    bad = F.lit(False)
    for name, value, side in FEATURES:
        v = F.expr(value.replace("div n_words", "div greatest(n_words, 1)"))
        bad = bad | F.coalesce(v > F.col(f"f_{name}") if side == "high" else v < F.col(f"f_{name}"), F.lit(False))
    return met.select(*features.columns, base_failed().alias("base_failed"), (~base_failed() & ~bad).alias("kept"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, base counts, base_failed, kept.

    Null, empty and wordless texts have no words and fail. Null languages and sources form groups of their own. A corpus in which no document
    passes the base rules has no sketch, and base_failed alone decides; an empty table gives no rows. Values that tie with a fence are kept.
    Texts of any length are counted whole. Repeated rows are judged alike; other columns are ignored, whatever their names.
    """
    features = checkpointed(_features(docs, id_col, text_col, lang_col, source_col))
    return verdicts(features).drop("lang", "source", "row_key")


def _features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    made = counts(docs, [*map(column, (id_col, lang_col, source_col)), row_key(id_col, text_col)], text_col)
    return made.withColumnsRenamed({"k0": id_col, "k1": "lang", "k2": "source", "k3": "row_key"})


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns, repeated rows as often as they come) that quality() keeps."""
    features = checkpointed(_features(docs, "doc_id", "text", "lang", "source"))
    key_at, *at = free_names(docs, "key", "id_of", "lang_of", "source_of")
    kept = verdicts(features).filter("kept").select(F.col("row_key").alias(key_at), *(F.col(c).alias(n) for c, n in zip(("doc_id", "lang", "source"), at, strict=True)))
    same = row_key("doc_id", "text") == F.col(key_at)
    for c, n in zip(("doc_id", "lang", "source"), at, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return docs.join(kept, same, "left_semi")
