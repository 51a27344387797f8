"""What documents come from: files of text, HTML and Markdown; page markers; bookmarks; the tables as they are kept."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions.ids import digest_id, stored_name
from evidara.session import ship

# What is read as it is, as HTML, or not without a converter.
TEXT = {".txt", ".md", ".markdown", ".rst", ".text", ".log", ".csv", ".json", ".yaml", ".yml"}
HTML = {".html", ".htm", ".xhtml"}
CONVERTED = {".pdf", ".docx", ".pptx", ".xlsx", ".odt", ".epub", ".rtf"}
IMAGES = {".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp"}
SUPPORTED = TEXT | HTML | CONVERTED | IMAGES


class _Markdown(HTMLParser):
    """HTML as Markdown: headings, paragraphs, lists, code, tables' cells; scripts and styles left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.pre = False
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "noscript", "template"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "ul", "ol", "blockquote"):
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "tr":
            self.out.append("\n|")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif re.fullmatch("h[1-6]|p", tag):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_markdown(text: str) -> str:
    """The Markdown of an HTML page."""
    p = _Markdown()
    p.feed(text)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(p.out))).strip() + "\n"


def suffix_of(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, name, suffix, size, text, error): every supported file of a folder.

    Files are read whole, a file a row; what needs a converter that is not there has an error instead of a text.
    Bytes that are no UTF-8 are replaced.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("suffix", suffix_of("path")).where(F.col("suffix").isin(sorted(SUPPORTED)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from evidara.functions.ids import base58

        for b in it:
            rows = []
            for path, suffix, content in zip(*(b.column(c).to_pylist() for c in ("path", "suffix", "content"))):
                raw = content or b""
                text = error = None
                if suffix in CONVERTED | IMAGES:
                    error = "no converter for " + suffix
                else:
                    text = raw.decode("utf-8", "replace")
                    text = html_markdown(text) if suffix in HTML else text
                rows.append((base58(hashlib.md5(raw).digest()), stored_name(path.rsplit("/", 1)[-1]), suffix, len(raw), text, error))
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["document_id", "name", "suffix", "size", "text", "error"])

    return files.select("path", "suffix", "content").mapInArrow(run, "document_id string, name string, suffix string, size long, text string, error string")


def converted(pages: DataFrame) -> DataFrame:
    """(document_id, markdown): the HTML of pages(document_id, html) as Markdown."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([b.column(0), pa.array([None if h is None else html_markdown(h) for h in b.column(1).to_pylist()], pa.string())], names=["document_id", "markdown"])

    kind = pages.schema["document_id"].dataType.simpleString()
    return pages.select("document_id", "html").mapInArrow(run, f"document_id {kind}, markdown string")


def refused(documents: DataFrame, skip_ocr: str = "skip_ocr_pages") -> DataFrame:
    """Documents that the policy on scanned pages does not let in: all pages unread, or some unread and not to be skipped."""
    pages, unread = F.coalesce("pages", F.lit(0)), F.coalesce("pages_unread", F.lit(0))
    return documents.where((unread > 0) & ((unread >= pages) | (F.coalesce(skip_ocr, F.lit(0)) == 0)))


def bookmarked(headings: list[tuple[int, str]], bookmarks: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(heading, level): bookmarks (page, level, title) matched to headings (page, title) by their letters, on their page or the
    one before; each heading is claimed once."""
    letters = lambda t: "".join(c for c in html.unescape(t).lower() if c.isalpha())
    free = {i: (p, letters(t)) for i, (p, t) in enumerate(headings)}
    out = []
    for page, level, title in bookmarks:
        own = letters(title)
        for at in (page, page - 1):
            i = next((i for i, (p, t) in free.items() if p == at and t == own and own), None)
            if i is not None:
                out.append((i, level))
                del free[i]
                break
    return out


def audit(spark: SparkSession, folder: str) -> DataFrame:
    """The audit trail: one JSON record a line, a file for each UTC day."""
    return spark.read.schema("at timestamp, action string, actor string, detail string").json(folder)


__all__ = ["SUPPORTED", "audit", "bookmarked", "converted", "digest_id", "documents", "html_markdown", "refused", "suffix_of"]
