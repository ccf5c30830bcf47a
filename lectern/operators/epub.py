"""Books as EPUB files: rendering of nodes, packaging, and reading a package back."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS, ENCLOSING = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"), ("li", "table", "nav", "aside")
NODE = "array<struct<seq:long,role:string,level:int,text:string,chapter:long>>"
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def clean(text: str) -> str:
    """Text for XML 1.0: forbidden characters dropped, the rest escaped."""
    return html.escape(_BAD.sub("", text), quote=True)


def render(nodes: list, title: str) -> str:
    """One chapter as XHTML: runs of list items become lists, empty paragraphs are dropped."""
    body, open_list = [], False
    for n in nodes:
        if (n["role"] == "LIST_ITEM") != open_list:
            body.append("</ul>" if open_list else "<ul>")
            open_list = not open_list
        text = clean(n["text"] or "").strip()
        if not text:
            continue
        tag = {"HEADING": f"h{min(6, max(1, n['level'] or 1))}", "LIST_ITEM": "li"}.get(n["role"], "p")
        kind = {"QUOTE": "quote", "CAPTION": "caption", "FOOTNOTE": "note-unlinked"}.get(n["role"])
        body.append(f'<{tag}{f" class={chr(34)}{kind}{chr(34)}" if kind else ""} id="n{n["seq"]}">{text}</{tag}>')
    if open_list:
        body.append("</ul>")
    return f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{clean(title)}</title></head><body>{"".join(body)}</body></html>'


def package(doc_id: int, nodes: list) -> bytes:
    """A deterministic EPUB3 file: stored mimetype first, then container, chapters, navigation and package document."""
    by_chapter: dict[int, list] = {}
    for n in sorted(nodes, key=lambda x: x["seq"]):
        by_chapter.setdefault(n["chapter"], []).append(n)
    titles = {c: next((n["text"] for n in ns if n["role"] == "HEADING"), "Front Matter") for c, ns in by_chapter.items()}
    files = {f"text/chapter{c:04d}.xhtml": render(ns, titles[c]) for c, ns in sorted(by_chapter.items())}
    entries = "".join(f'<li><a href="{f}">{clean(titles[c])}</a></li>' for f, c in zip(files, sorted(by_chapter), strict=True))
    files["nav.xhtml"] = f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>{entries}</ol></nav></body></html>'
    items = "".join(f'<item id="i{k}" href="{f}" media-type="application/xhtml+xml"{" properties=" + chr(34) + "nav" + chr(34) if f == "nav.xhtml" else ""}/>' for k, f in enumerate(files))
    spine = "".join(f'<itemref idref="i{k}"/>' for k, f in enumerate(files) if f != "nav.xhtml")
    files["content.opf"] = f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:doc:{doc_id}</dc:identifier><dc:title>{clean(str(next(iter(titles.values()), doc_id)))}</dc:title><dc:language>und</dc:language></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        stamp = (2000, 1, 1, 0, 0, 0)
        z.writestr(zipfile.ZipInfo("mimetype", stamp), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr(zipfile.ZipInfo("META-INF/container.xml", stamp), _CONTAINER, zipfile.ZIP_DEFLATED)
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(f"OEBPS/{name}", stamp), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def packages(nodes: DataFrame) -> DataFrame:
    """doc_id and EPUB bytes of each book. nodes: doc_id, seq, role, level, text, chapter."""
    books = nodes.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "role", F.col("level").cast("int").alias("level"), "text", F.col("chapter").cast("long").alias("chapter"))).alias("nodes"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "epub": [package(d, list(ns)) for d, ns in zip(pdf["doc_id"], pdf["nodes"], strict=True)]})

    return books.mapInPandas(pack, "doc_id long, epub binary")


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _spine(z: zipfile.ZipFile) -> Iterator[str]:
    """The names of an EPUB's chapters in reading order, by way of its container and package files."""
    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.attrib["full-path"] for e in container.iter() if _local(e) == "rootfile")
    package = ElementTree.fromstring(z.read(opf))
    items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if _local(e) == "item"}
    for e in package.iter():
        if _local(e) == "itemref":
            yield posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(items[e.attrib["idref"]].partition("#")[0])))


def _blocks(element: ElementTree.Element, enclosed: bool = False) -> Iterator[tuple[str, str]]:
    """(tag, text) of headings, paragraphs and list items that no list item, table, nav or aside encloses."""
    name = _local(element)
    if name in BLOCKS and not enclosed:
        yield name, " ".join("".join(element.itertext()).split())
    for child in element:
        yield from _blocks(child, enclosed or name in ENCLOSING)


def read_back(books: DataFrame) -> DataFrame:
    """Nodes of EPUB files in spine order: doc_id, seq, tag, text, error. books: doc_id, epub.

    Any container and package layout is followed. A file that is no EPUB, or breaks off, gives the nodes up to there and
    one row with the error; a null file gives an error row.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, raw in zip(pdf["doc_id"], pdf["epub"], strict=True):
                seq = 0
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        for name in _spine(z):
                            for tag, text in _blocks(ElementTree.fromstring(_plain_entities(z.read(name)))):
                                out.append((doc_id, seq, tag, text, None))
                                seq += 1
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, RuntimeError, UnicodeDecodeError) as error:
                    out.append((doc_id, seq, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["doc_id", "seq", "tag", "text", "error"])

    return books.mapInPandas(unpack, "doc_id long, seq long, tag string, text string, error string")


def _plain_entities(raw: bytes) -> bytes:
    """A chapter with its named entities as characters, as XML knows five of them only."""
    return re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)([A-Za-z][A-Za-z0-9]*);", lambda m: html.unescape(m[0]), raw.decode("utf-8-sig")).encode()
