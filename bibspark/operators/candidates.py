"""Candidate pairs of the fuzzy stage, from bounds that its acceptance implies: an author score of 0.55 and a title score of 0.40.

Authors are paired first, each name once, by keys that such names share: an equal form, the last name, two ideographs in the same order, two
neighbouring characters. Titles of paired authors then meet block by block, and only pairs that can reach 0.40 leave a task (see sieve.py). At so
low a bound an inverted index of entries keeps three fifths of all pairs (title_index(), for titles of many authors at once).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, similarity, text
from . import sieve, verify
from .cluster import cut, spread

LEAST_AUTHOR, LEAST_TITLE = 0.55, 0.40
#: Weights of the title score: ratio, character pairs, character triples, words (fixed values; see kernels.combined).
RATIO, PAIRS, TRIPLES, WORDS = 0.30, 0.25, 0.30, 0.15
#: Titles of an author in a block, about.
BLOCK = 1 << 13


def author_keys(authors: DataFrame) -> DataFrame:
    """(author, latin, key) of ``authors`` (author, author_form, clean, general): authors that score LEAST_AUTHOR in either order share a key, unless neither a form nor a key of theirs can say so.

    Latin names need the same last word (0.50 at most without it). Two names in ideographs need two of them in the same order: with one
    match at most the score stays under 0.25 + 0.2 · 2/5 + 0.2. A name without Latin words needs two neighbouring characters in common with the other one:
    without these ratio and words give 0.45 at most.
    """
    clean = F.col("clean")
    run = F.regexp_replace(clean, "[^\\x{4e00}-\\x{9fff}]", "")
    words = F.filter(F.split(F.regexp_replace(F.lower(clean), "[^a-z]+", " "), " "), lambda w: F.length(w) > 1)
    bare = F.lower(F.replace(clean, F.lit(" "), F.lit("")))
    chars = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(bare) - 1, F.lit(1))), lambda i: F.substr(bare, i, F.lit(2))))
    size, none = F.length(run), F.array().cast("array<string>")
    first = lambda i: F.transform(F.sequence(i + 1, size), lambda j: F.concat(F.substr(run, i, F.lit(1)), F.substr(run, j, F.lit(1))))
    ordered = F.when(size > 1, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size - 1), first)))).when(size == 1, F.array(run)).otherwise(none)
    tag = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    keys = F.concat(
        F.array(F.concat(F.lit("n:"), F.col("author_form")), F.concat(F.lit("g:"), F.col("general"))),
        tag("p:", ordered),
        F.when(F.size(words) > 0, F.array(F.concat(F.lit("l:"), F.element_at(words, -1)))).otherwise(none),
        tag("x:", chars),
    )
    return authors.select("author", (F.size(words) > 0).alias("latin"), F.explode(F.array_distinct(keys)).alias("key"))


def author_pairs(books: DataFrame) -> DataFrame:
    """(x, y, x_y, y_x): distinct authors x <= y that score LEAST_AUTHOR in either order, with both scores; each author with itself."""
    authors = books.filter(F.coalesce(F.col("author"), F.lit("")) != "").groupBy("author").agg(F.first("author_form").alias("author_form"))
    authors = cut(authors.withColumns({"clean": text.clean_text(F.col("author")), "general": text.normalize_general(F.col("author"))}))
    keys = cut(author_keys(authors))
    plain = keys.filter(~F.col("key").startswith("x:")).select("author", "key")
    met = plain.select(F.col("author").alias("x"), "key").join(plain.select(F.col("author").alias("y"), "key"), "key").filter("x < y").select("x", "y")
    # neighbouring characters count where a name has no Latin word; Latin names are not paired by them
    near = keys.filter(F.col("key").startswith("x:"))
    other = near.filter("not latin").select(F.col("author").alias("x"), "key").join(near.select(F.col("author").alias("y"), "key"), "key").filter("x <> y")
    met = met.unionByName(other.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).distinct()
    scored = met.withColumns({"x_y": similarity.author(F.col("x"), F.col("y")), "y_x": similarity.author(F.col("y"), F.col("x"))})
    own = authors.select(F.col("author").alias("x"), F.col("author").alias("y"), F.lit(1.0).alias("x_y"), F.lit(1.0).alias("y_x"))
    return cut(scored.filter((F.col("x_y") >= LEAST_AUTHOR) | (F.col("y_x") >= LEAST_AUTHOR)).unionByName(own))


def may_match(pairs: DataFrame, books: DataFrame) -> DataFrame:
    """Author ``pairs`` whose books the verifier can match where there is no ISBN."""
    names = books.groupBy("author").agg(*(F.first(c).alias(c) for c in ("author_clean", "author_form")))
    for s, side in (("x", "a_"), ("y", "b_")):
        pairs = pairs.join(names.select(F.col("author").alias(s), *(F.col(c).alias(side + c) for c in names.columns)), s)
    pairs = cut(verify.may_match(pairs.withColumns({"a_isbn_normalized": F.lit(""), "b_isbn_normalized": F.lit("")}), "x_y", "y_x"))
    return pairs.filter("may_match").select("x", "y", "x_y", "y_x")


# ---------------------------------------------------------------- titles
def entries(title: str) -> list[str]:
    """Index entries of a title: its character pairs (spaces left out, lower case) and its words."""
    bare = kernels.clean(title).replace(" ", "")
    pairs = [bare[i : i + 2].lower() for i in range(max(len(bare) - 1, 1))] if bare else []
    return list(dict.fromkeys([*pairs, *(f"t:{w}" for w in kernels.general(kernels.clean(title)).split())]))


def most(title: str, shared: set[str]) -> float:
    """The most that a title can score against another one, in Latin letters, with which it shares no entries but ``shared``.

    Shares of pairs, triples and words are those of the title's own that can be made of shared entries. The ratio's matching blocks
    add up to M letters: runs of shared pairs (o places of the title have one), and single letters, between which one of both titles has a letter
    that does not match. So both have 3M - o - 1 letters at least; spaces can all match.
    """
    clean = kernels.clean(title)
    bare = clean.replace(" ", "")
    at = [bare[i : i + 2].lower() in shared for i in range(max(len(bare) - 1, 1))]
    pairs, triples = kernels.grams(clean, 2), kernels.grams(clean, 3)
    two = sum(p.lower() in shared for p in pairs) / len(pairs)
    three = sum(all(t[i : i + 2].lower() in shared for i in range(max(len(t) - 1, 1))) for t in triples) / len(triples)
    words = set(kernels.general(clean).split())
    said = sum(f"t:{w}" in shared for w in words) / len(words) if words else 1.0
    letters, spaces = len(bare), len(clean) - len(bare)
    other = (letters + sum(at) + 1) / 2  # letters of the other title for which the ratio is the largest
    ratio = min((2 * other + 2 * spaces) / (letters + other + 2 * spaces), 1.0)
    return RATIO * ratio + PAIRS * two + TRIPLES * three + WORDS * said


def rare_entries(title: str, ordered: list[str]) -> list[str]:
    """Of a title's entries, ordered from the rarest on, those without which it cannot score LEAST_TITLE; and its forms, as equal forms decide alone.

    Titles in ideographs keep all entries: single ideographs count there. Without a common pair they need equal sets of ideographs.
    """
    clean = kernels.clean(title)
    own = kernels.ideographs(clean)
    forms = [f"{kind}:{form}" for kind, form in (("f", kernels.title_form(title)), ("g", kernels.general(clean)), ("s", "".join(sorted(set(own))))) if form]
    if most(title, set()) >= LEAST_TITLE - 1e-6:  # letters between many spaces, no word: single letters can be enough
        forms += [f"c:{x}" for x in dict.fromkeys(clean.replace(" ", "").lower())]
    if own:
        return [*ordered, *forms]
    low, high = 0, len(ordered)  # the largest tail of frequent entries that is safe; what can be scored grows with it
    while low < high:
        middle = (low + high) // 2
        if most(title, set(ordered[middle:])) < LEAST_TITLE - 1e-6:
            high = middle
        else:
            low = middle + 1
    return [*ordered[:low], *forms]


def title_index(titles: DataFrame) -> DataFrame:
    """(title, entry) of distinct titles: what each is looked up by. Frequencies are counted over all of them."""

    @F.pandas_udf("array<string>")
    def split(column: pd.Series) -> pd.Series:
        return column.map(entries)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [rare_entries(t, [e["entry"] for e in own]) for t, own in zip(batch["title"], batch["own"], strict=True)]
            yield pd.DataFrame({"title": batch["title"], "entry": found})

    held = cut(titles.filter("title <> ''").select("title", F.explode(split("title")).alias("entry")))
    counts = held.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))
    ordered = held.join(counts, "entry").groupBy("title").agg(F.array_sort(F.collect_list(F.struct("n", "entry"))).alias("own"))
    return ordered.mapInPandas(kept, "title string, entry array<string>").select("title", F.explode("entry").alias("entry"))


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, v): titles of a task, those of side 0 against those of side 1, or, where there are none, against each other. Rows come by task."""

    def pairs(own: pd.DataFrame) -> pd.DataFrame:
        first, second = own[own["side"] == 0], own[own["side"] == 1]
        if own["alone"].iloc[0]:
            i, j = sieve.close(first, first, LEAST_TITLE)
            i, j, second = i[i < j], j[i < j], first
        else:
            i, j = sieve.close(first, second, LEAST_TITLE)
        return pd.DataFrame({"u": first["id"].to_numpy()[i], "v": second["id"].to_numpy()[j], "pair": own["pair"].iloc[0]})

    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held) == 0:
            continue
        last = held["task"].iloc[-1]  # the next batch may have more of it
        for _, own in held[held["task"] != last].groupby("task", sort=False):
            yield pairs(own)
        held = held[held["task"] == last]
    if held is not None and len(held):
        yield pairs(held)


def title_pairs(titles: DataFrame, authors: DataFrame) -> DataFrame:
    """(u, v, pair): ids of ``titles`` (id, author, title, free, new) whose authors are an x and y of ``authors`` (pair, x, y), u's x and v's y, among which are
    all that score LEAST_TITLE; one of both is free, one new. An author's titles are dealt into blocks, and each two blocks meet in a task of their own."""

    @F.pandas_udf("clean string, words string, form string")
    def formed(column: pd.Series) -> pd.DataFrame:
        return sieve.formed(column)

    kind = titles.groupBy("author", "free", "new").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    made = spread(titles).withColumn("made", formed("title")).select("id", "author", "title", "free", "new", "made.*")
    titles = cut(made.join(kind.drop("size"), ["author", "free", "new"]).withColumn("block", F.pmod(F.xxhash64("title"), "blocks").cast("int")))
    kind = cut(kind.withColumn("kind", F.col("free").cast("int") * 2 + F.col("new").cast("int")))
    x, y = (kind.select(F.col("author").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("free", "new", "kind", "blocks", "size"))) for s in "xy")
    tasks = authors.select("pair", "x", "y").join(x, "x").join(y, "y").filter("(x_free or y_free) and (x_new or y_new) and (x <> y or x_kind <= y_kind)")
    tasks = tasks.withColumn("x_block", F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1))).withColumn("y_block", F.explode(F.sequence(F.lit(0), F.col("y_blocks") - 1)))
    same = (F.col("x") == F.col("y")) & (F.col("x_kind") == F.col("y_kind"))
    tasks = tasks.filter(~same | (F.col("x_block") <= F.col("y_block"))).withColumn("alone", same & (F.col("x_block") == F.col("y_block")))
    tasks = cut(tasks.filter("not alone or x_size > 1").withColumn("task", F.monotonically_increasing_id()))

    def side(s: str, number: int) -> DataFrame:
        keys = [F.col(s).alias("author"), *(F.col(f"{s}_{c}").alias(c) for c in ("free", "new", "block"))]
        own = tasks if number == 0 else tasks.filter("not alone")
        return own.select("task", "pair", "alone", *keys).join(titles, ["author", "free", "new", "block"]).select("task", "pair", "alone", F.lit(number).alias("side"), "id", "clean", "words", "form")

    rows = side("x", 0).unionByName(side("y", 1))
    return spread(rows, "task").sortWithinPartitions("task").mapInPandas(_met, "u long, v long, pair string")


def fuzzy_pairs(books: DataFrame, equal_isbns: bool = False, fresh: DataFrame | None = None) -> DataFrame:
    """(a_ord, b_ord, author_ab): pairs of books, the earlier one as a, among which are all that score LEAST_AUTHOR and LEAST_TITLE, whose authors
    the verifier can match and whose ISBNs do not contradict each other; with ``equal_isbns`` those of equal ISBNs too, whatever their authors. Where ``fresh`` (ord) is given, only pairs
    with one of these books."""
    pairs = cut(may_match(author_pairs(books), books).withColumn("pair", F.md5(F.concat(F.length("x").cast("string"), F.lit(":"), "x", "y"))))
    new = F.lit(True)
    own = books
    if fresh is not None:
        own, new = books.join(fresh.select("ord", F.lit(True).alias("__new")), "ord", "left"), F.col("__new").isNotNull()
    own = cut(own.filter("title <> '' and author <> ''").select("ord", "author", "title", (F.col("isbn_normalized") == "").alias("free"), new.alias("new")))
    # titles are compared once, whatever the number of an author's books that have them
    titles = cut(own.groupBy("author", "title").agg(F.max("free").alias("free"), F.max("new").alias("new"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()))
    met = title_pairs(titles.drop("n"), pairs)
    self = titles.filter("n > 1").join(pairs.filter("x = y").select(F.col("x").alias("author"), "pair"), "author")
    met = met.unionByName(self.select(F.col("id").alias("u"), F.col("id").alias("v"), "pair"))
    held = cut(own.join(titles.select("author", "title", "id"), ["author", "title"]).select("id", "ord", "free", "new"))
    for s in "uv":
        met = met.join(held.select(F.col("id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("ord", "free", "new"))), s)
    # books with an ISBN meet only those without one
    met = met.filter("(u_free or v_free) and (u_new or v_new) and (u <> v or u_ord < v_ord)").join(pairs.select("pair", "x_y", "y_x"), "pair")
    score: Column = F.when(F.col("u_ord") < F.col("v_ord"), F.col("x_y")).otherwise(F.col("y_x"))
    found = met.select(F.least("u_ord", "v_ord").alias("a_ord"), F.greatest("u_ord", "v_ord").alias("b_ord"), score.alias("author_ab")).filter(F.col("author_ab") >= LEAST_AUTHOR)
    if equal_isbns:
        own = books.filter("isbn_normalized <> ''").select("isbn_normalized", "ord", "author")  # few, as equal ISBNs are the first stage's
        same = own.select("isbn_normalized", *(F.col(c).alias(f"a_{c}") for c in ("ord", "author"))).join(own.select("isbn_normalized", *(F.col(c).alias(f"b_{c}") for c in ("ord", "author"))), "isbn_normalized")
        found = found.unionByName(same.filter("a_ord < b_ord").select("a_ord", "b_ord", similarity.author(F.col("a_author"), F.col("b_author")).alias("author_ab")))
    return found
