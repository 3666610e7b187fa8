"""EPUB container: read metadata, cover and leading text; write metadata back. Pure functions over bytes."""

from __future__ import annotations

import io
import os
import re
import shutil
import tempfile
import zipfile
from xml.etree import ElementTree

CONTAINER = "META-INF/container.xml"
DC = "http://purl.org/dc/elements/1.1/"
OPF = "http://www.idpf.org/2007/opf"
FIRST = {"title": "title", "creator": "author", "publisher": "publisher", "date": "publish_date", "language": "language", "description": "description"}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def package_path(book: zipfile.ZipFile) -> str | None:
    """Path of the package document: what the container names, else any .opf."""
    try:
        for node in ElementTree.fromstring(book.read(CONTAINER)).iter():
            if local(node.tag) == "rootfile" and node.get("full-path"):
                return node.get("full-path")
    except (KeyError, ElementTree.ParseError):
        pass
    return next((n for n in book.namelist() if n.endswith(".opf")), None)


def read_metadata(content: bytes) -> dict[str, object]:
    """Fields of the package document; what cannot be read stays empty."""
    out: dict[str, object] = {v: "" for v in FIRST.values()} | {"isbn": "", "tags": [], "cover_path": None}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            root = ElementTree.fromstring(book.read(package_path(book) or ""))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError):
        return out
    hrefs, cover_id = {}, None
    for node in root.iter():
        name, text = local(node.tag), (node.text or "").strip()
        if name in FIRST and text and not out[FIRST[name]]:
            out[FIRST[name]] = text
        elif name == "identifier" and "isbn" in text.lower() and not out["isbn"]:
            out["isbn"] = text
        elif name == "subject" and text and text not in out["tags"]:
            out["tags"].append(text)
        elif name == "item":
            hrefs[node.get("id")] = node.get("href")
            if "cover-image" in (node.get("properties") or "") and out["cover_path"] is None:
                out["cover_path"] = node.get("href")
        elif name == "meta" and node.get("name") == "cover":
            cover_id = node.get("content")
    if out["cover_path"] is None:
        out["cover_path"] = hrefs.get(cover_id)
    return out


def read_text(content: bytes, most: int = 1000) -> str:
    """Leading text in spine order, tags stripped, white space collapsed."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            path = package_path(book)
            root, base = ElementTree.fromstring(book.read(path or "")), os.path.dirname(path)
            items = {n.get("id"): n.get("href") for n in root.iter() if local(n.tag) == "item"}
            out = ""
            for node in root.iter():
                href = items.get(node.get("idref")) if local(node.tag) == "itemref" else None
                if not href or not href.lower().endswith((".xhtml", ".html", ".htm")):
                    continue
                try:
                    raw = book.read(os.path.normpath(os.path.join(base, href))).decode("utf-8", "ignore")
                except KeyError:
                    continue
                out += " " + re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", raw)).strip()
                if len(out.strip()) >= most:
                    break
            return out.strip()[:most]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError):
        return ""


def update_package(document: str, changes: dict[str, str]) -> str:
    """Package document with non-empty values set: the first element of the name is replaced, else one is added; tags are not written."""
    for prefix, space in (("dc", DC), ("", OPF)):
        ElementTree.register_namespace(prefix, space)
    root = ElementTree.fromstring(document)
    metadata = next((n for n in root if local(n.tag) == "metadata"), None)
    if metadata is None:
        return document
    for name, field in FIRST.items():
        value = changes.get(field)
        if value:
            node = next((n for n in metadata if local(n.tag) == name), None)
            if node is None:
                node = ElementTree.SubElement(metadata, f"{{{DC}}}{name}")
            node.text = value
    if isbn := re.sub(r"^(?i:isbn:)+", "", changes.get("isbn") or ""):
        node = next((n for n in metadata if local(n.tag) == "identifier" and "isbn" in (n.text or "").lower()), None)
        if node is None:
            node = ElementTree.SubElement(metadata, f"{{{DC}}}identifier")
        node.text = f"ISBN:{isbn}"
    return ElementTree.tostring(root, encoding="unicode", xml_declaration=True)


def write_metadata(content: bytes, changes: dict[str, str]) -> bytes | None:
    """The container with an updated package document: mimetype first and stored, all other entries in order with their attributes. None if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            path = package_path(book)
            fresh = update_package(book.read(path or "").decode("utf-8"), changes).encode()
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as target:
                for entry in sorted(book.infolist(), key=lambda e: e.filename != "mimetype"):
                    kind = zipfile.ZIP_STORED if entry.filename == "mimetype" else entry.compress_type
                    copy = zipfile.ZipInfo(entry.filename, entry.date_time)
                    copy.compress_type, copy.external_attr, copy.comment, copy.extra, copy.create_system = kind, entry.external_attr, entry.comment, entry.extra, entry.create_system
                    target.writestr(copy, fresh if entry.filename == path else book.read(entry))
            return out.getvalue()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, UnicodeDecodeError):
        return None


def save_metadata(path: str, changes: dict[str, str]) -> bool:
    """Rewrite a local file: a temporary file beside it, a .bak of the old one while it is replaced. False if it is no readable EPUB."""
    if not path.lower().endswith(".epub"):
        return False
    try:
        with open(path, "rb") as f:
            fresh = write_metadata(f.read(), changes)
        if fresh is None:
            return False
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as f:
            f.write(fresh)
        shutil.copy2(path, path + ".bak")
        os.replace(f.name, path)
        os.remove(path + ".bak")
        return True
    except OSError:
        return False


def make(title: str, author: str, text: str, isbn: str = "", tags: tuple[str, ...] = (), **more: str) -> bytes:
    """A small EPUB, for tests and examples."""
    from xml.sax.saxutils import escape

    fields = {"title": title, "creator": author, **more}
    dc = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in fields.items() if v) + "".join(f"<dc:subject>{escape(t)}</dc:subject>" for t in tags)
    dc += f"<dc:identifier>ISBN:{escape(isbn)}</dc:identifier>" if isbn else ""
    package = (
        f'<?xml version="1.0"?><package xmlns="{OPF}" version="3.0"><metadata xmlns:dc="{DC}">{dc}<meta name="cover" content="img"/></metadata>'
        '<manifest><item id="c1" href="c1.xhtml"/><item id="img" href="cover.jpg"/></manifest><spine><itemref idref="c1"/></spine></package>'
    )
    files = {"mimetype": "application/epub+zip", CONTAINER: '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>', "OEBPS/content.opf": package, "OEBPS/c1.xhtml": f"<html><body><p>{escape(text)}</p></body></html>"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, body in files.items():
            entry = zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0))
            entry.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            book.writestr(entry, body)
    return out.getvalue()
