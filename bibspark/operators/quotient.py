"""The quotient of a catalogue by what the matching rules look at first: books of equal title, author and ISBN are one node.

Of an ISBN the rules ask only whether the other book has the same one, so ISBNs that a single book has count as one kind (SOLE): after the first
stage nearly all are such, and the nodes of a title do not grow with its books.

Inside a bucket nodes are paired instead of books, and each pair of nodes is scored once. Titles and authors settle most pairs of nodes for
all of their books; only where content hash and size can still turn the answer are books paired. Means over all pairs of a large
pair of nodes come from sorted sums: of size ratios by prefix sums, of hash distances by counts of bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.fingerprint import simhash_similarity
from . import verify
from .cluster import cut, spread

OWN = ["title", "author", "author_clean", "author_form", "isbn_normalized"]
#: Pairs of books up to which a pair of nodes is summed pair by pair; sorted sums give the same beyond.
FEW_PAIRS = 1 << 12
#: Rounding of a score: answers nearer to a threshold than this are left to the pairs of books.
DOUBT = 1e-9
#: Rounding of a mean's summand that is told apart from no cap.
ROUNDING = 1e-12
#: In place of an ISBN that no other book has; it equals none, not even itself.
SOLE = "*"
#: Share of sizes from which on different formats make up the difference (fixed value of the size score).
FORMAT_BONUS = 0.15


def node_of(isbn: str = "isbn_normalized") -> Column:
    """Name of a book's node."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "author", isbn)]
    return F.md5(F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p))))


def noded(books: DataFrame) -> DataFrame:
    """``books`` with isbn_key (the ISBN, or SOLE where no other of them has it) and node. Holds for any part of ``books`` as well."""
    has = F.coalesce(F.col("isbn_normalized"), F.lit("")) != ""
    shared = books.filter(has).groupBy(F.col("isbn_normalized").alias("__key")).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n").withColumn("__shared", F.lit(True))
    keyed = books.withColumn("__key", F.when(has, F.col("isbn_normalized")).otherwise(F.concat(F.lit("-"), F.col("ord").cast("string"))))  # books without one go to no single task
    key = F.when(~has, "").when(F.col("__shared"), F.col("isbn_normalized")).otherwise(SOLE)
    own = keyed.join(shared, "__key", "left").withColumn("isbn_key", key).drop("__key", "__shared")
    return own.withColumn("node", node_of("isbn_key"))


def nodes_of(books: DataFrame) -> DataFrame:
    """(node, OWN...) of books that have a column ``node``; where they have ``isbn_key`` too, that stands for the ISBN."""
    own = books.withColumn("isbn_normalized", F.col("isbn_key")) if "isbn_key" in books.columns else books
    return own.groupBy("node").agg(*(F.first(c).alias(c) for c in OWN))


def bucket_nodes(members: DataFrame) -> DataFrame:
    """(bucket, node, n, first, last) of ``members`` (bucket, ord, node)."""
    return members.groupBy("bucket", "node").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"), F.max("ord").alias("last"))


def node_pairs(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of nodes of a bucket, the one with the earlier first book as a; a node with itself where it has several books. With counts and OWN."""
    a, b = (held.select("bucket", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "first", "last"))) for s in "ab")
    met = a.join(b, "bucket").filter("a_first < b_first or (a_node = b_node and a_n > 1)")
    for s in "ab":
        met = met.join(nodes.select(F.col("node").alias(f"{s}_node"), *(F.col(c).alias(f"{s}_{c}") for c in OWN)), f"{s}_node")
        met = met.withColumn(f"{s}_isbn_normalized", F.when(F.col(f"{s}_isbn_normalized") == SOLE, f"{SOLE}{s}").otherwise(F.col(f"{s}_isbn_normalized")))
    return met


def _unless_equal(kernel, a: str, b: str) -> Column:
    """``kernel`` of two names; equal ones, which score 1, travel to Python as nulls."""
    same = (F.col(a) == F.col(b)) & (F.col(a) != "")
    return F.when(same, 1.0).otherwise(kernel(F.when(~same, F.col(a)), F.when(~same, F.col(b))))


def _added(pairs: DataFrame, kinds: tuple[str, ...], way: str) -> DataFrame:
    x, y = way
    kernels = {"author": similarity.author, "title": similarity.title}
    return pairs.withColumns({f"{k}_{way}": _unless_equal(kernels[k], f"{x}_{k}", f"{y}_{k}") for k in kinds})


def forward(pairs: DataFrame) -> DataFrame:
    """Adds author_ab, title_ab: scores of a before b."""
    return _added(pairs, ("author", "title"), "ab")


def backward(pairs: DataFrame) -> DataFrame:
    """Adds author_ba, title_ba: scores of b before a; the ratio behind them is not symmetric."""
    return _added(pairs, ("author", "title"), "ba")


def authors_scored(pairs: DataFrame) -> DataFrame:
    """Adds author_ab, author_ba."""
    return _added(_added(pairs, ("author",), "ab"), ("author",), "ba")


def titles_scored(pairs: DataFrame) -> DataFrame:
    """Adds title_ab, title_ba."""
    return _added(_added(pairs, ("title",), "ab"), ("title",), "ba")


def verified_arcs(scored: DataFrame) -> DataFrame:
    """(bucket, src, dst): nodes whose books the verifier matches with later ones; it looks at the earlier book first."""
    both = scored.select("bucket", "a_node", "b_node", *(f"{s}_{c}" for s in "ab" for c in ("author", "author_clean", "author_form", "isbn_normalized")), "author_ab", "title_ab", "author_ba", "title_ba")
    both = verify.verified(both).withColumn("ab", F.col("verdict.is_same_book")).drop("verdict")
    both = verify.verified(both, "b_", "a_", "author_ba", "title_ba").select("bucket", "a_node", "b_node", "ab", F.col("verdict.is_same_book").alias("ba"))
    both = cut(both)  # else the filters would take all rules with them, each written out wherever it is used
    there = both.filter("ab").select("bucket", F.col("a_node").alias("src"), F.col("b_node").alias("dst"))
    return there.unionByName(both.filter("ba and a_node <> b_node").select("bucket", F.col("b_node").alias("src"), F.col("a_node").alias("dst")))


# ---------------------------------------------------------------- rules over content and size
def _flags() -> tuple[Column, Column, Column]:
    """(score of the ISBNs, both have one, both have an author) of a pair of nodes."""
    isbns = (F.col("a_isbn_normalized") != "") & (F.col("b_isbn_normalized") != "")
    return similarity.isbn_score(F.col("a_isbn_normalized"), F.col("b_isbn_normalized")), isbns, (F.col("a_author") != "") & (F.col("b_author") != "")


def with_parts(pairs: DataFrame, author: Column, title: Column) -> DataFrame:
    """Adds what the overall similarity of books of two nodes is made of: base1, content1, size1 (both books have a content hash), base0, size0
    (not both): base + content score · content + size score · size, at most ``cap``."""
    isbn, isbns, authors = _flags()

    def weight(name: str, hashes: bool) -> Column:
        found = [(w[name] / sum(w.values())) for w in (similarity.weights(True, hashes), similarity.weights(False, hashes))]
        return F.when(isbns, found[0]).otherwise(found[1])

    base = lambda hashes: isbn * weight("isbn", hashes) + author * weight("author", hashes) + title * weight("title", hashes)
    return pairs.withColumns(
        {"base1": base(True), "base0": base(False), "content1": weight("simhash", True), "size1": weight("size", True), "size0": weight("size", False), "cap": similarity.cap(isbn, author, title, authors)}
    )


def bounds(same_content: bool = False) -> tuple[Column, Column]:
    """(least, most) uncapped overall similarity that any two books of a pair of nodes with_parts() can have."""
    c = F.col
    if same_content:
        return c("base1") + c("content1"), c("base1") + c("content1") + c("size1")
    return F.least("base1", "base0"), F.greatest(c("base1") + c("content1") + c("size1"), c("base0") + c("size0"))


def may_reach(members: DataFrame, books: DataFrame, least: float) -> DataFrame:
    """Buckets of ``members`` (bucket, ord, node), books of one content hash each, whose mean similarity can reach ``least`` as far as authors and ISBNs say: with equal
    titles and sizes. Each two names are scored once for all buckets."""
    nodes = nodes_of(books).select("node", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("isbn_normalized", F.lit("")).alias("isbn_normalized"))
    kinds = cut(members.join(nodes, "node").groupBy("bucket", "author", "isbn_normalized").agg(F.count(F.lit(1)).alias("n")))
    a, b = (kinds.select("bucket", F.struct("author", "isbn_normalized").alias(f"{s}_kind"), *(F.col(c).alias(f"{s}_{c}") for c in ("author", "isbn_normalized", "n"))) for s in "ab")
    met = a.join(b, "bucket").filter("a_kind < b_kind or (a_kind = b_kind and a_n > 1)")
    met = met.withColumn("size", F.when(F.col("a_kind") == F.col("b_kind"), F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n")))
    for s in "ab":
        met = met.withColumn(f"{s}_isbn_normalized", F.when(F.col(f"{s}_isbn_normalized") == SOLE, f"{SOLE}{s}").otherwise(F.col(f"{s}_isbn_normalized")))
    names = spread(met.select("a_author", "b_author").distinct())
    names = cut(names.withColumn("author", F.greatest(similarity.author(F.col("a_author"), F.col("b_author")), similarity.author(F.col("b_author"), F.col("a_author")))))
    met = with_parts(met.join(names, ["a_author", "b_author"]), F.col("author"), F.lit(1.0))
    most = met.groupBy("bucket").agg((F.sum(F.col("size") * F.least(bounds(True)[1], F.col("cap"))) / F.sum("size")).alias("most"))
    return most.filter(F.col("most") >= least - DOUBT).select("bucket")


def _book_pairs(pairs: DataFrame, members: DataFrame, books: DataFrame) -> DataFrame:
    """Pairs of books of ``pairs`` of nodes, a_ord and b_ord with what differs between books of a node; ``members`` is (bucket, ord, node)."""
    own = members.join(books.select("ord", "simhash", "file_size", "file_format"), "ord")
    for s in "ab":
        pairs = pairs.join(own.select("bucket", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "ord", "simhash", "file_size", "file_format"))), ["bucket", f"{s}_node"])
    return pairs.filter("a_ord <> b_ord and (a_node <> b_node or a_ord < b_ord)")


def similar(scored: DataFrame, members: DataFrame, books: DataFrame, least_content: float, use_content: bool, need_author: bool, same_content: bool = False) -> tuple[DataFrame, DataFrame]:
    """(arcs, edges) of the rule for a later book against an accepted one: similar content (where ``use_content``) and an overall similarity of 0.65, or
    a title of 0.85 and an author of 0.65; where ``need_author``, an author of 0.55 besides. Arcs (bucket, src, dst) hold for all books of two nodes,
    edges (bucket, j, i) for two books."""
    arcs, open_ = [], []
    for src, dst, scores in (("a", "b", "ba"), ("b", "a", "ab")):
        author, title = F.col(f"author_{scores}"), F.col(f"title_{scores}")
        low, high = (F.least(x, F.col("cap")) for x in bounds(same_content))
        allowed = (author >= 0.55) if need_author else F.lit(True)
        plain = (title >= 0.85) & (author >= 0.65)
        always = allowed & (plain if use_content else plain | (low >= 0.65 + DOUBT))
        maybe = allowed & (high >= 0.65 - DOUBT)
        own = with_parts(scored if src == "a" else scored.filter("a_node <> b_node"), author, title)
        own = own.withColumns({"__always": always, "__maybe": ~always & maybe})
        arcs.append(own.filter("__always").select("bucket", F.col(f"{src}_node").alias("src"), F.col(f"{dst}_node").alias("dst")))
        open_.append(own.filter("__maybe").select(*scored.columns, F.lit(scores).alias("way")))
    met = _book_pairs(open_[0].unionByName(open_[1]), members, books)
    # of a node with itself either way is the same; otherwise the later book is b in the one way and a in the other
    met = met.filter("a_node = b_node or (way = 'ba' and a_ord < b_ord) or (way = 'ab' and b_ord < a_ord)")
    whole = similarity.pair_overall("a_", "b_", *(F.when(F.col("way") == "ba", F.col(f"{s}_ba")).otherwise(F.col(f"{s}_ab")) for s in ("author", "title")))
    fits = F.lit(True)
    if use_content:
        both = (F.col("a_simhash") != 0) & (F.col("b_simhash") != 0)
        fits = ~both | (simhash_similarity(F.col("a_simhash"), F.col("b_simhash")) >= least_content)
    edges = met.filter(fits & (whole >= 0.65)).select("bucket", F.least("a_ord", "b_ord").alias("j"), F.greatest("a_ord", "b_ord").alias("i"))
    return arcs[0].unionByName(arcs[1]), edges


# ---------------------------------------------------------------- means over all pairs
def _size_sums(rows: DataFrame) -> DataFrame:
    """(set, q, size_sum): the size scores of all unordered pairs of a set, q = 0 over all its books, q = 1 over those with a content hash.
    ``rows`` is (set, file_size, file_format, hashed).

    Equal sizes are counted first. The shares of sizes of all pairs come from prefix sums in order of size; what different formats add
    (FORMAT_BONUS, or what the share lacks to 1) is the sum over all pairs less that over pairs of one format, each from the sums over
    sizes from 1 - FORMAT_BONUS of a book's on.
    """
    scopes = rows.select("set", F.explode(F.when(F.col("hashed"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("q"), "file_size", F.lower(F.coalesce("file_format", F.lit(""))).alias("format"))
    by_format = scopes.groupBy("set", "q", "format", "file_size").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def added(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Per size and key: sums over pairs whose larger size it is (equal sizes: each pair once)."""
        spec = f"PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY ln(file_size) RANGE BETWEEN"
        near, upto = f"{spec} {-math.log(1 - FORMAT_BONUS)!r}D PRECEDING AND CURRENT ROW", f"{spec} UNBOUNDED PRECEDING AND CURRENT ROW"
        df = df.withColumn("s", F.col("n") * F.col("file_size"))
        df = df.withColumns({f"{x}_{name}": F.expr(f"sum({x}) OVER ({frame})") for x in "ns" for name, frame in (("all", upto), ("near", near))})
        n, size = F.col("n"), F.col("file_size")
        same = n * (n - 1) / 2
        share = n * (F.col("s_all") - F.col("s")) / size + same
        lack = n * ((F.col("n_near") - n) - (F.col("s_near") - F.col("s")) / size)
        bonus = lack + FORMAT_BONUS * n * (F.col("n_all") - F.col("n_near"))
        return df.groupBy(*[k for k in keys if k != "format"]).agg(F.sum(share).alias(f"{name}_share"), F.sum(bonus).alias(f"{name}_bonus"))

    sized, known = by_format.filter("file_size > 0"), by_format.filter("file_size > 0 and format <> ''")
    every = added(sized.groupBy("set", "q", "file_size").agg(F.sum("n").alias("n")), ["set", "q"], "every")
    mixed = added(known.groupBy("set", "q", "file_size").agg(F.sum("n").alias("n")), ["set", "q"], "mixed")
    equal = added(known.select("set", "q", "format", "file_size", "n"), ["set", "q", "format"], "equal")
    count = by_format.groupBy("set", "q").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("file_size") == 0, F.col("n")).otherwise(0.0)).alias("zero"))
    met = count.join(every, ["set", "q"], "left").join(mixed, ["set", "q"], "left").join(equal, ["set", "q"], "left")
    got = lambda c: F.coalesce(c, F.lit(0.0))
    unknown = F.col("zero") * (F.col("n") - F.col("zero")) + F.col("zero") * (F.col("zero") - 1) / 2  # a size of 0 scores 0.5 with any other
    return met.select("set", "q", (got("every_share") + got("mixed_bonus") - got("equal_bonus") + 0.5 * unknown).alias("size_sum"))


def _hash_sums(rows: DataFrame) -> DataFrame:
    """(set, hashed, apart): books with a content hash, and the sum of Hamming distances over all their pairs, from counts of set bits."""
    bits = [F.sum(F.getbit("simhash", F.lit(i)).cast("long")).alias(f"b{i}") for i in range(64)]
    sums = rows.filter("hashed").groupBy("set").agg(F.count(F.lit(1)).alias("hashed"), *bits)
    apart = sum((F.col(f"b{i}") * (F.col("hashed") - F.col(f"b{i}")) for i in range(64)), F.lit(0).cast("long"))
    return sums.select("set", "hashed", apart.alias("apart"))


def _set_sums(sets: DataFrame) -> DataFrame:
    """(set, pairs, hashed_pairs, content_sum, size_sum, hashed_size_sum) over all unordered pairs of books of a set; ``sets`` is (set, simhash, file_size, file_format)."""
    rows = cut(sets.withColumn("hashed", F.col("simhash") != 0))
    sizes = _size_sums(rows).groupBy("set").agg(*(F.coalesce(F.sum(F.when(F.col("q") == q, F.col("size_sum"))), F.lit(0.0)).alias(n) for q, n in ((0, "size_sum"), (1, "hashed_size_sum"))))
    pairs = lambda n: n * (n - 1) / 2
    counted = rows.groupBy("set").agg(F.count(F.lit(1)).alias("n"))
    met = counted.join(_hash_sums(rows), "set", "left").join(sizes, "set")
    hashed = F.coalesce("hashed", F.lit(0))
    return met.select(
        "set", pairs(F.col("n")).alias("pairs"), pairs(hashed).alias("hashed_pairs"), (pairs(hashed) - F.coalesce("apart", F.lit(0)) / 64.0).alias("content_sum"), "size_sum", "hashed_size_sum"
    )


def mean_similarity(scored: DataFrame, members: DataFrame, books: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """(bucket, similarity): mean overall similarity over all pairs of the bucket's members (bucket, ord, node), earlier book first.

    ``scored`` has the pairs of their nodes (others do no harm) with author_ab, title_ab and, where both orders occur, author_ba, title_ba.
    A pair of nodes with more than ``few`` pairs of books is summed without pairing them where no cap cuts in between and the order
    does not matter; the result is the same.
    """
    held = cut(bucket_nodes(members))
    own = scored.drop(*(f"{s}_{c}" for s in "ab" for c in ("n", "first", "last")))
    for s in "ab":
        own = own.join(held.select("bucket", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "first", "last"))), ["bucket", f"{s}_node"])
    one = F.col("a_node") == F.col("b_node")
    own = own.withColumn("size", F.when(one, F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n"))).filter("size > 0")
    backwards = (F.col("b_last") < F.col("a_first")) & ~one
    either = one | (F.col("a_last") < F.col("b_first")) | backwards | (F.col("author_ab") == F.col("author_ba")) & (F.col("title_ab") == F.col("title_ba"))
    own = own.withColumns({"author": F.when(backwards, F.col("author_ba")).otherwise(F.col("author_ab")), "title": F.when(backwards, F.col("title_ba")).otherwise(F.col("title_ab"))})
    own = with_parts(own, F.col("author"), F.col("title"))
    low, high = bounds()
    flat, free = low >= F.col("cap") - ROUNDING, high <= F.col("cap") + ROUNDING
    large = cut(own.withColumns({"flat": flat, "summed": either & (F.col("size") > few) & (flat | free)}))

    direct = _book_pairs(large.filter("not summed"), members, books)
    order = F.col("a_ord") < F.col("b_ord")
    scores = (F.when(order | (F.col("a_node") == F.col("b_node")), F.col(f"{s}_ab")).otherwise(F.col(f"{s}_ba")) for s in ("author", "title"))
    sums = direct.groupBy("bucket").agg(F.sum(similarity.pair_overall("a_", "b_", *scores)).alias("total"))
    summed = large.filter("summed")
    if not summed.isEmpty():
        sums = sums.unionByName(_large_sums(summed, members, books)).groupBy("bucket").agg(F.sum("total").alias("total"))
    count = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return sums.join(count, "bucket").select("bucket", (F.col("total") / (F.col("n") * (F.col("n") - 1) / 2)).alias("similarity"))


def _large_sums(pairs: DataFrame, members: DataFrame, books: DataFrame) -> DataFrame:
    """(bucket, total) over the pairs of books of large pairs of nodes: overall similarity is a sum of content and size scores, weighted by whether both
    books have a content hash, so that sums of these scores are enough. Those between two nodes are those of both together less those inside each."""
    flat = pairs.filter("flat").groupBy("bucket").agg(F.sum(F.col("size") * F.col("cap")).alias("total"))
    free = cut(pairs.filter("not flat").select("bucket", "a_node", "b_node", "base1", "base0", "content1", "size1", "size0"))
    own = members.join(books.select("ord", "simhash", "file_size", "file_format"), "ord")
    name = lambda a, b: F.concat_ws("|", "bucket", a, b)
    singles = free.select("bucket", F.explode(F.array("a_node", "b_node")).alias("node")).distinct().withColumn("set", name("node", "node"))
    both = free.filter("a_node <> b_node").select("bucket", F.explode(F.array("a_node", "b_node")).alias("node"), name("a_node", "b_node").alias("set"))
    sets = singles.unionByName(both).join(own, ["bucket", "node"]).select("set", "simhash", "file_size", "file_format")
    sums = cut(_set_sums(sets))
    met, fields = free, ("pairs", "hashed_pairs", "content_sum", "size_sum", "hashed_size_sum")
    for s, key in (("u", name("a_node", "b_node")), ("a", name("a_node", "a_node")), ("b", name("b_node", "b_node"))):
        met = met.withColumn("set", key).join(sums.select("set", *(F.col(f).alias(f"{s}_{f}") for f in fields)), "set").drop("set")
    one = F.col("a_node") == F.col("b_node")
    own_sum = {f: F.when(one, F.col(f"u_{f}")).otherwise(F.col(f"u_{f}") - F.col(f"a_{f}") - F.col(f"b_{f}")) for f in fields}
    met = met.select("bucket", "base1", "base0", "content1", "size1", "size0", *(v.alias(k) for k, v in own_sum.items()))
    total = (
        F.col("base1") * F.col("hashed_pairs")
        + F.col("content1") * F.col("content_sum")
        + F.col("size1") * F.col("hashed_size_sum")
        + F.col("base0") * (F.col("pairs") - F.col("hashed_pairs"))
        + F.col("size0") * (F.col("size_sum") - F.col("hashed_size_sum"))
    )
    return flat.unionByName(met.groupBy("bucket").agg(F.sum(total).alias("total")))
