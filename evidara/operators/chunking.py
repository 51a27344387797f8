"""Documents cut into chunks that follow their structure: blocks, sentences, sections, packing, places.

One document is one row of work; a chunk knows its characters, bytes, lines and pages, its heading path and why it starts and ends
where it does. Chunks never overlap, never exceed the size, and hold every visible character but headings and page markers, which
stand in the path and the page numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.settings import ChunkSettings

MARKER = re.compile(r"^[ \t]*<!--\s*page\s+(\d+)\b[^\n]*?-->[ \t]*$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-{2,})[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
TAG = re.compile(r"^ {0,3}<(?:[a-zA-Z/!?])")
# Abbreviations that end no sentence.
ABBREVIATIONS = ("e.g.", "i.e.", "cf.", "etc.", "vs.", "Dr.", "Mr.", "Ms.", "Mrs.", "No.", "Fig.", "p.", "pp.")
STOP = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s+\S)")


@dataclass
class Block:
    kind: str
    start: int
    end: int
    level: int = 0
    title: str = ""
    page: int | None = None


def blocks(text: str, markdown: bool = True) -> list[Block]:
    """The leaf blocks of a text with their places; blank lines belong to none."""
    out: list[Block] = []
    lines: list[tuple[int, str]] = []
    at = 0
    for line in text.splitlines(keepends=True) if "\x0c" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        lines.append((at, line.rstrip("\r\n")))
        at += len(line)
    page = None
    i = 0

    def take(kind: str, first: int, last: int, **more) -> None:
        start, (end, tail) = lines[first][0], lines[last - 1]
        out.append(Block(kind, start, end + len(tail), page=page, **more))

    while i < len(lines):
        line = lines[i][1]
        if not line.strip():
            i += 1
            continue
        if m := MARKER.match(line):
            page = int(m[1])
            i += 1
            continue
        j = i + 1
        if markdown and (m := FENCE.match(line)):
            while j < len(lines) and not (lines[j][1].lstrip().startswith(m[1]) and not lines[j][1].strip().strip(m[1][0])):
                j += 1
            j = min(len(lines), j + 1)
            take("code", i, j)
        elif markdown and (m := ATX.match(line)):
            take("heading", i, j, level=len(m[1]), title=(m[2] or "").strip())
        elif markdown and RULE.match(line):
            take("rule", i, j)
        elif markdown and line.lstrip().startswith("|"):
            while j < len(lines) and lines[j][1].lstrip().startswith("|"):
                j += 1
            take("table", i, j)
        elif markdown and TAG.match(line):
            while j < len(lines) and lines[j][1].strip():
                j += 1
            take("html", i, j)
        elif markdown and re.match(r"^(?: {4}|\t)", line) and not ITEM.match(line):
            while j < len(lines) and (re.match(r"^(?: {4}|\t)", lines[j][1])):
                j += 1
            take("code", i, j)
        else:
            item = markdown and bool(ITEM.match(line))
            while j < len(lines) and lines[j][1].strip() and not MARKER.match(lines[j][1]):
                nxt = lines[j][1]
                if markdown and (ATX.match(nxt) or FENCE.match(nxt) or ITEM.match(nxt) or nxt.lstrip().startswith("|") or SETEXT.match(nxt)):
                    break
                j += 1
            if markdown and not item and j < len(lines) and (m := SETEXT.match(lines[j][1])):
                take("heading", i, j + 1, level=1 if m[1][0] == "=" else 2, title=" ".join(x[1].strip() for x in lines[i:j]))
                i = j + 1
                continue
            take("item" if item else "quote" if markdown and line.lstrip().startswith(">") else "paragraph", i, j)
        i = j
    return out


def sentences(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Where the sentences of a stretch lie; they tile it but for the blanks between."""
    cuts = [start]
    for m in STOP.finditer(text, start, end):
        after = re.compile(r"\s+").match(text, m.end())
        following = text[after.end() : after.end() + 1]
        if following.islower() or text[max(start, m.end() - 6) : m.end()].endswith(ABBREVIATIONS):
            continue
        if after.end() < end:
            cuts.append(after.end())
    return [(a, a + len(text[a:z].rstrip())) for a, z in zip(cuts, [*cuts[1:], end]) if text[a:z].strip()]


def fitted(text: str, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """A stretch in pieces of at most size, cut at lines, else at words, else at characters."""
    out = []
    while end - start > size:
        cut = text.rfind("\n", start + 1, start + size + 1)
        if cut <= start:
            cut = max(text.rfind(" ", start + 1, start + size + 1), text.rfind("\t", start + 1, start + size + 1))
        if cut <= start:
            cut = start + size
        out.append((start, start + len(text[start:cut].rstrip())))
        start = cut + len(text[cut:end]) - len(text[cut:end].lstrip())
    if text[start:end].strip():
        out.append((start, end))
    return [x for x in out if x[1] > x[0]]


@dataclass
class Piece:
    start: int
    end: int
    block: int
    kind: str
    page: int | None
    continued: bool = False


@dataclass
class Cut:
    """Pieces of one chunk. Reasons: edge (of the document), heading, paragraph (a blank line), length_block (full, between blocks of one
    paragraph), length_sentence (full, between sentences), length_oversize (within what is longer than a chunk)."""

    pieces: list[Piece]
    headings: list[str]
    start_reason: str = "edge"
    end_reason: str = "edge"


def cut(text: str, settings: ChunkSettings) -> list[Cut]:
    """Groups of pieces that become chunks, with their heading paths and reasons. A chunk's frame counts toward its size."""
    found = blocks(text, settings.chunker == "markdown")
    open_: list[tuple[int, str]] = []
    sections: list[tuple[list[str], int, list[Piece]]] = [([], settings.chunk_size, [])]
    for n, b in enumerate(found):
        if b.kind == "heading":
            # a heading closes those of its level and deeper
            open_ = [h for h in open_ if h[0] < b.level] + [(b.level, b.title)]
            path = [t for _, t in open_]
            room = settings.chunk_size - (frame_size(frame_of(path, settings.chunk_size)) if settings.frame else 0)
            if sections[-1][2]:
                sections.append((path, room, []))
            else:
                sections[-1] = (path, room, [])
        elif b.kind != "rule":
            _, room, pieces = sections[-1]
            prose = b.kind in ("paragraph", "item", "quote")
            for a, z in sentences(text, b.start, b.end) if prose else [(b.start, b.end)]:
                pieces.extend(Piece(x, y, n, b.kind, b.page, k > 0) for k, (x, y) in enumerate(fitted(text, a, z, room)))
    out: list[Cut] = []
    for path, room, pieces in sections:
        cuts: list[Cut] = []
        short = room * settings.merge_below // 100
        for p in pieces:
            here = cuts[-1] if cuts else None
            before = here.pieces[-1] if here else None
            whole = before is not None and _one_paragraph(text, before, p)
            if here is not None and p.end - here.pieces[0].start <= room:
                # a new paragraph starts a new chunk once the one before is long enough
                if whole or before.end - here.pieces[0].start < short:
                    here.pieces.append(p)
                    continue
            if here is not None:
                here.end_reason = "length_oversize" if p.continued else "length_sentence" if p.block == before.block else "length_block" if whole else "paragraph"
            cuts.append(Cut([p], path, start_reason=here.end_reason if here else "heading"))
        if len(cuts) > 1 and cuts[-1].pieces[-1].end - cuts[-1].pieces[0].start < short and cuts[-1].pieces[-1].end - cuts[-2].pieces[0].start <= room:
            cuts[-2].pieces += cuts.pop().pieces
        if cuts:
            cuts[-1].end_reason = "heading"
        out += cuts
    # what says nothing is no chunk; its reasons go to its neighbours
    out = [c for c in out if any(ch.isalnum() for p in c.pieces for ch in text[p.start : p.end])]
    for before, after in zip(out, out[1:]):
        after.start_reason = before.end_reason
    if out:
        out[0].start_reason = "heading" if out[0].headings else "edge"
        out[-1].end_reason = "edge"
    return out


def _one_paragraph(text: str, a: Piece, b: Piece) -> bool:
    return a.block == b.block or _kin(b, a) or not re.search(r"\n[ \t\r]*\n", text[a.end : b.start])


def _kin(a: Piece, b: Piece) -> bool:
    """Items of one list are one paragraph."""
    return a.kind == b.kind == "item" and a.block - b.block == 1


def frame_of(headings: list[str], size: int) -> list[str]:
    """The heading path within half a chunk: outermost headings go first, and a last one that is still too long is cut."""
    own, room = list(headings), size // 2
    while len(own) > 1 and frame_size(own) > room:
        own.pop(0)
    if own and frame_size(own) > room:
        own = [x for x in [own[0][: max(0, room - frame_size([""]))].rstrip()] if x]
    return own


def frame_size(frame: list[str]) -> int:
    """Characters that a frame takes of a chunk, with the blank line after it."""
    return len(" > ".join(frame)) + 2 if frame else 0


CHUNK = pa.schema(
    [("seq", pa.int32()), ("headings", pa.list_(pa.string())), ("frame", pa.list_(pa.string())), ("text", pa.string()), ("framed", pa.string()),
     *((c, pa.int32()) for c in ("line_start", "line_end", "char_start", "char_end")), ("byte_start", pa.int64()), ("byte_end", pa.int64()),
     ("page_start", pa.int32()), ("page_end", pa.int32()), ("start_reason", pa.string()), ("end_reason", pa.string())]
)
DDL = "seq int, headings array<string>, frame array<string>, text string, framed string, line_start int, line_end int, char_start int, char_end int, byte_start long, byte_end long, page_start int, page_end int, start_reason string, end_reason string"


def located(text: str, settings: ChunkSettings) -> Iterator[tuple]:
    """The chunks of one text as rows of CHUNK."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    byte, at = 0, 0
    for n, c in enumerate(cut(text, settings), 1):
        a, z = c.pieces[0].start, c.pieces[-1].end
        byte += len(text[at:a].encode("utf-8", "surrogatepass"))
        own = text[a:z]
        width = len(own.encode("utf-8", "surrogatepass"))
        frame = frame_of(c.headings, settings.chunk_size) if settings.frame else []
        pages = [p.page for p in c.pieces if p.page is not None]
        yield (n, c.headings, frame, own, (" > ".join(frame) + "\n\n" + own) if frame else own, bisect_right(breaks, a - 1) + 1, bisect_right(breaks, z - 1) + 1,
               a, z, byte, byte + width, min(pages, default=None), max(pages, default=None), c.start_reason, c.end_reason)
        byte, at = byte + width, z


def chunked(documents: DataFrame, id_col: str, text_col: str, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """(id, seq, headings, frame, text, framed, places, reasons) of every chunk. Null and empty texts have none; extra columns are ignored."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, rows, held = [], [], 0
            for i, text in enumerate(b.column("text").to_pylist()):
                new = list(located(text, settings))
                rows += new
                ids += [i] * len(new)
                held += len(text)
                if rows and held > 4_000_000:
                    yield _chunk_batch(b, ids, rows)
                    ids, rows, held = [], [], 0
            if rows:
                yield _chunk_batch(b, ids, rows)

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    return rows.mapInArrow(run, f"id {kind}, {DDL}")


def _chunk_batch(b: pa.RecordBatch, ids: list[int], rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), CHUNK)]
    return pa.record_batch([b.column("id").take(pa.array(ids)), *columns], names=["id", *CHUNK.names])


def part_cuts(total: int, starts: list[int], budget: int, fallback: list[int]) -> list[tuple[int, int]]:
    """[0, total) in parts of at most budget: each ends at the last section start within reach, else at the last fallback, else at the budget."""
    out, at = [], 0
    while total - at > budget:
        options = [x for x in starts if at < x <= at + budget] or [x for x in fallback if at < x <= at + budget]
        end = max(options) if options else at + budget
        out.append((at, end))
        at = end
    return [*out, (at, total)]


def lines(documents: DataFrame, first: int, last: int, text: str = "text") -> DataFrame:
    """The lines first to last, counted from 1, of each document; at most 400."""
    if not 1 <= first <= last or last - first >= 400:
        raise ValueError("1 to 400 lines are read at a time")
    return documents.withColumn("lines", F.slice(F.split(text, "\n"), first, last - first + 1))


def pages(documents: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, page, text): the pages between page markers; text before the first marker is on none."""
    part = F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<!--\s*page\s+\d+[^>]*-->.*?(?=<!--\s*page\s+\d+|\z)"), F.lit(0)))
    rows = documents.select(F.col(id_col).alias("id"), part.alias("_p"))
    return rows.select("id", F.regexp_extract("_p", r"page\s+(\d+)", 1).cast("int").alias("page"), F.trim(F.regexp_replace("_p", r"(?s)\A<!--.*?-->", "")).alias("text"))


def page_counts(documents: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, pages, read_by_ocr, unread) from page markers."""
    def count(pattern: str):
        return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))

    return documents.select(F.col(id_col).alias("id"), count(r"<!--\s*page\s+\d+[^>]*-->").alias("pages"), count(r"<!--\s*page\s+\d+: read by OCR\s*-->").alias("read_by_ocr"), count(r"<!--\s*page\s+\d+: needs OCR, skipped\s*-->").alias("unread"))


def contents(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, level, title, char_offset, byte_offset): the headings of each text, in order."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, rows = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                own = [h for h in blocks(text) if h.kind == "heading"]
                rows += [(n, h.level, h.title, h.start, len(text[: h.start].encode("utf-8", "surrogatepass"))) for n, h in enumerate(own, 1)]
                ids += [i] * len(own)
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64())
                yield pa.record_batch([b.column("id").take(pa.array(ids)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["id", "n", "level", "title", "char_offset", "byte_offset"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(run, f"id {kind}, n int, level int, title string, char_offset int, byte_offset long")
