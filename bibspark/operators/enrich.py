"""External lookup: responses come in as data, parsing and combining are queries. Fetching is the caller's business."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

RESULT = ["title", "author", "publisher", "publish_date", "isbn", "language", "description", "cover_url", "rating"]
FIELDS = T.StructType([T.StructField(c, T.StringType()) for c in RESULT])


def search(sources: list[DataFrame], most: int = 10) -> DataFrame:
    """Results of all sources, in their order, ``most`` per source at most; missing fields are null. Each has a column pos."""
    out = None
    for rank, df in enumerate(sources):
        own = df.withColumn("source_rank", F.lit(rank))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out.orderBy("source_rank", "pos").limit(most * len(sources))


def first_found(keys: DataFrame, sources: list[DataFrame], key: str = "isbn") -> DataFrame:
    """For each key the record (struct ``record``) of the first source that has one, else null. Sources are (key, record)."""
    out = keys
    for i, df in enumerate(sources):
        out = out.join(df.select(key, F.col("record").alias(f"__r{i}")), key, "left")
    return out.select(*keys.columns, F.coalesce(*(f"__r{i}" for i in range(len(sources)))).alias("record"))


_DOC = "title string, author_name array<string>, publisher array<string>, language array<string>, first_publish_year string, isbn array<string>, edition_key array<string>"


def _listed(values: Column) -> Column:
    return F.coalesce(F.array_join(values, ", "), F.lit(""))


def parse_search_docs(responses: DataFrame, json_col: str = "body", most: int = 10) -> DataFrame:
    """One row per document of a search response ``{"docs": [...]}``: pos, title, author, publisher, publish_date, isbn, language, cover_url."""
    docs = F.from_json(json_col, f"docs array<struct<{_DOC.replace(' string', ':string').replace(' array', ':array')}>>")["docs"]
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    rows = responses.select(*[c for c in responses.columns if c != json_col], F.posexplode(F.slice(F.coalesce(docs, F.array().cast(f"array<struct<{_DOC.replace(' string', ':string').replace(' array', ':array')}>>")), 1, most)).alias("pos", "d"))
    edition = first(F.col("d.edition_key"))
    return rows.select(
        *[c for c in responses.columns if c != json_col],
        "pos",
        F.coalesce("d.title", F.lit("")).alias("title"),
        _listed(F.col("d.author_name")).alias("author"),
        _listed(F.col("d.publisher")).alias("publisher"),
        F.coalesce("d.first_publish_year", F.lit("")).alias("publish_date"),
        first(F.col("d.isbn")).alias("isbn"),
        _listed(F.col("d.language")).alias("language"),
        F.when(edition != "", F.concat(F.lit("cover:"), edition)).otherwise("").alias("cover_url"),
    )


def parse_isbn_record(responses: DataFrame, json_col: str = "body") -> DataFrame:
    """One row per record: authors are objects with a name or plain strings, the first publisher likewise."""
    v = F.try_parse_json(json_col)
    rows = responses.withColumn("__v", v)
    get = lambda path: F.coalesce(F.try_variant_get("__v", path, "string"), F.lit(""))
    name = lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    listed = lambda path: F.coalesce(F.try_variant_get("__v", path, "array<variant>"), F.array().cast("array<variant>"))
    authors = F.array_join(F.array_compact(F.transform(listed("$.authors"), name)), ", ")
    publisher = F.coalesce(F.try_element_at(F.array_compact(F.transform(F.slice(listed("$.publishers"), 1, 1), name)), F.lit(1)), F.lit(""))
    return rows.select(*[c for c in responses.columns if c != json_col], get("$.title").alias("title"), authors.alias("author"), publisher.alias("publisher"), get("$.publish_date").alias("publish_date"))


def parse_suggestions(responses: DataFrame, json_col: str = "body", most: int = 10) -> DataFrame:
    """One row per suggestion of a JSON list: the first ``most`` items, without those that are no object or have no title."""
    items = F.coalesce(F.try_variant_get(F.try_parse_json(json_col), "$", "array<variant>"), F.array().cast("array<variant>"))
    rows = responses.select(*[c for c in responses.columns if c != json_col], F.posexplode(F.slice(items, 1, most)).alias("pos", "d"))
    get = lambda name: F.coalesce(F.try_variant_get("d", f"$.{name}", "string"), F.lit(""))
    out = rows.select(*[c for c in responses.columns if c != json_col], "pos", get("title").alias("title"), get("author_name").alias("author"), get("year").alias("publish_date"), get("pic").alias("cover_url"))
    return out.filter("title <> ''")


# ---------------------------------------------------------------- HTML
class _Page(HTMLParser):
    """Flat list of (tag, classes, attributes, text) in document order; a tag's text is all text below it."""

    VOID = {"br", "img", "input", "meta", "link", "hr"}

    def __init__(self) -> None:
        super().__init__()
        self.nodes: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = {k: v or "" for k, v in attrs}
        node = {"tag": tag, "class": own.get("class", "").split(), "attrs": own, "text": [], "up": [id(x) for x in self.open]}
        self.nodes.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        for node in self.open:
            node["text"].append(data)


def _parsed(html: str) -> list[dict]:
    page = _Page()
    page.feed(html)
    for node in page.nodes:
        node["text"] = re.sub(r"\s+", " ", "".join(node["text"])).strip()
    return page.nodes


def _meta(line: str) -> dict[str, str]:
    out = {"author": "", "publisher": "", "publish_date": ""}
    for part in filter(None, map(str.strip, line.split("/"))):
        if re.match(r"\d{4}", part):
            out["publish_date"] = part
        elif re.search("出版社|出版|Publish", part):
            out["publisher"] = part
        elif not out["author"]:
            out["author"] = part
    return out


def search_page(html: str, most: int = 10) -> list[dict[str, str]]:
    """Results of a search page: items with a title link, a meta line, a rating and a cover; else JSON objects with a title in scripts."""
    nodes, found = _parsed(html or ""), []
    for item in (n for n in nodes if {"subject-item", "result", "item-root"} & set(n["class"])):
        below = [n for n in nodes if id(item) in n["up"]]
        link = next((n for n in below if n["tag"] == "a" and n["text"]), None)
        if link is None:
            continue
        pick = lambda *names, below=below: next((n for n in below if set(names) & set(n["class"])), None)
        meta, rating, image = pick("pub", "subject-cast", "meta"), pick("rating_nums"), next((n for n in below if n["tag"] == "img"), None)
        own = {"title": link["attrs"].get("title") or link["text"], **_meta(meta["text"] if meta else "")}
        found.append(own | {"rating": rating["text"] if rating else "", "cover_url": image["attrs"].get("src", "") if image else ""})
    if not found:
        for script in re.findall(r"<script[^>]*>(.*?)</script>", html or "", re.S):
            for raw in re.findall(r'\{[^{}]*"title"\s*:\s*"[^"]+"[^{}]*\}', script):
                try:
                    own = json.loads(raw)
                except ValueError:
                    continue
                found.append({"title": str(own["title"]), **_meta(str(own.get("abstract", ""))), "rating": "", "cover_url": str(own.get("cover_url", ""))})
    return [r for r in found if r["title"]][:most]


def detail_page(html: str) -> dict[str, str]:
    """Labelled fields of a detail page; the description is cut to 300 characters."""
    nodes = _parsed(html or "")
    info = next((n for n in nodes if n["attrs"].get("id") == "info"), None)
    lines = "" if info is None else re.sub(r"<br\s*/?>", "\n", re.search(r'id="info"[^>]*>(.*?)</div>', html, re.S)[1] if re.search(r'id="info"[^>]*>(.*?)</div>', html, re.S) else "")
    plain = re.sub(r"<[^>]+>", "", lines)
    field = lambda label: (m[1].strip() if (m := re.search(rf"{label}\s*[:：]\s*([^\n]+)", plain)) else "")
    title = next((n["text"] for n in nodes if n["tag"] == "h1"), "")
    intro = next((n["text"] for n in nodes if "intro" in n["class"]), "")
    author = re.sub(r"\s*/\s*", ", ", re.sub(r"[\[\]]", "", field("作者")))
    return {"title": title, "author": author, "publisher": field("出版社"), "publish_date": field("出版年"), "isbn": field("ISBN"), "description": intro[:300]}


@F.pandas_udf(T.ArrayType(FIELDS))
def search_pages(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [{c: r.get(c, "") for c in RESULT} for r in search_page(h)])


@F.pandas_udf(FIELDS)
def detail_pages(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([{c: r.get(c, "") for c in RESULT} for r in map(detail_page, html)], columns=RESULT)


def author_of(raw: Column) -> Column:
    return text.online_author(raw)
