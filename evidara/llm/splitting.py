"""Oversized texts cut into pieces under a limit, at natural boundaries, with an overlap.

A text is first cut into sections at given byte offsets. Sizes are prefix sums over units (characters, words or tokens), so that the size of
any stretch is one subtraction. Boundaries (ends of paragraphs, of lines and sentences, of words) are sorted arrays;
the last one under the limit is found by binary search, the best kind first as long as the piece is at least half full, and a
section without any is cut hard, at a unit. The next piece starts `overlap` units before the cut.

Null and empty texts have no pieces. Offsets that are null, repeated, negative or past the text's end are passed over; one
inside a character counts as that character's start. Rows of one id with several texts are cut each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import arrow_map
from evidara.llm.tokens import token_starts
from evidara.session import spread


@dataclass(frozen=True)
class SplitSettings:
    """limit and overlap in units ('characters', 'words' or 'tokens'); tokenizer: a vocabulary file, for tokens;
    with_text: whether pieces carry their text."""

    limit: int = 4000
    overlap: int = 200
    unit: str = "characters"
    tokenizer: str | None = None
    with_text: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit:
            raise ValueError("the overlap must be under the limit, and the limit above 0")


#: Where kinds of boundaries lie, best first: after blank lines, after lines and sentences, after words.
KINDS = [re.compile(r"\n[ \t\r]*\n\s*"), re.compile(r"\n|[.!?…][\"'”’)\]]*\s+"), re.compile(r"\s+")]
WORD_STARTS = re.compile(r"(?<!\S)\S")


def unit_starts(text: str, settings: SplitSettings) -> np.ndarray:
    """The character at which each unit starts, and the text's length at the end."""
    if settings.unit == "characters":
        return np.arange(len(text) + 1)
    if settings.unit == "tokens":
        return token_starts(text, settings.tokenizer)
    starts = [m.start() for m in WORD_STARTS.finditer(text)]
    return np.array([0, *starts[1:], len(text)] if starts else [0, len(text)])


def cut(starts: np.ndarray, kinds: list[np.ndarray], begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of the characters begin to end; kinds are sorted boundaries, best first."""
    pieces = []
    first, last = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    at = begin
    while True:
        u = np.searchsorted(starts, at, side="right") - 1 if at != begin else first
        if last - u <= limit:
            pieces.append((at, end))
            return pieces
        top = int(starts[u + limit])
        # what a piece must pass so that the next one starts later: its overlap, and half its limit if it can
        half, least = (int(starts[u + x]) for x in (max(overlap + 1, limit // 2), overlap + 1))
        stop = 0
        for floor in (half, least):
            for b in kinds:
                k = int(np.searchsorted(b, top, side="right")) - 1
                if k >= 0 and b[k] >= floor:
                    stop = int(b[k])
                    break
            if stop:
                break
        # a unit may lie within a character, so that the hard cut must still move on
        stop = stop or max(top, at + 1)
        pieces.append((at, stop))
        if stop >= end:
            return pieces
        # a boundary may lie before the next unit starts; what is between must not get lost
        back = min(stop, int(starts[max(0, np.searchsorted(starts, stop, side="left") - overlap)]))
        at = back if back > at else stop


def section_starts(text: str, offsets: list[int]) -> list[tuple[int, int]]:
    """(byte, character) of each section's start: byte 0, and the offsets that lie in the text."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = sorted({0, *(o for o in offsets if o is not None and 0 < o < len(raw))})
    if len(raw) == len(text):
        return [(o, o) for o in inside]
    begun = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [(o, int(begun[o]) - 1) for o in inside]


PIECE = "id {}, byte_offset long, section_chars int, piece int, pieces int, char_start int, char_end int, size int, text string"


def split_texts(texts: DataFrame, id_col: str, text_col: str, heads: DataFrame | None = None, head_id: str = "", offset_col: str = "", settings: SplitSettings = SplitSettings()) -> DataFrame:
    """(id, byte_offset, section_chars, piece, pieces, char_start, char_end, size, text) of every piece, in characters of the whole text.

    heads has the byte offsets at which sections of a text start.
    """
    docs = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null and text <> ''")
    if heads is None:
        rows = spread(docs).withColumn("offsets", F.array().cast("array<long>"))
    else:
        listed = heads.select(F.col(head_id).alias("id"), F.col(offset_col).cast("long").alias("o")).where("id is not null and o > 0")
        # a text has fewer headings than bytes: its offsets are no larger than itself
        rows = docs.join(listed.groupBy("id").agg(F.collect_set("o").alias("offsets")), "id", "left").select("id", "text", "offsets")
    kind = texts.schema[id_col].dataType.simpleString()
    return arrow_map(rows, _splitter(settings), PIECE.format(kind))


def _splitter(settings: SplitSettings) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    names = ["id", "byte_offset", "section_chars", "piece", "pieces", "char_start", "char_end", "size", "text"]
    kinds = [pa.int64(), *[pa.int32()] * 6, pa.string()]

    def pieces_of(text: str, offsets: list[int]) -> Iterator[tuple]:
        starts = None
        heads = section_starts(text, offsets)
        for (byte, begin), (_, end) in zip(heads, [*heads[1:], (0, len(text))]):
            if settings.unit == "characters" and end - begin <= settings.limit:
                own = [(begin, end)]
            else:
                if starts is None:
                    starts = unit_starts(text, settings)
                    bounds = [np.fromiter((m.end() for m in k.finditer(text)), np.int64) for k in KINDS]
                own = cut(starts, bounds, begin, end, settings.limit, settings.overlap)
            for n, (a, z) in enumerate(own):
                size = z - a if starts is None else int(np.searchsorted(starts, z) - np.searchsorted(starts, a))
                yield byte, end - begin, n, len(own), a, z, size, text[a:z] if settings.with_text else None

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        held = 0
        for i, text, offsets in zip(b.column("id"), b.column("text").to_pylist(), b.column("offsets").to_pylist()):
            new = list(pieces_of(text, offsets or []))
            rows += new
            ids += [i] * len(new)
            held += len(text)
            if held > 4_000_000:
                yield out(ids, rows, b)
                ids, rows, held = [], [], 0
        if rows:
            yield out(ids, rows, b)

    def out(ids: list, rows: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
        kind = b.schema.field("id").type
        return pa.record_batch([pa.array([i.as_py() for i in ids], kind), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    return run


def oversized(pieces: DataFrame) -> DataFrame:
    """(id, byte_offset): the sections that came out in more than one piece."""
    return pieces.where("pieces > 1").select("id", "byte_offset").distinct()


def quoted_runs(results: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(run, collection, document_id, seq_start, seq_end, text): each run of chunks that results quote, put together once.

    A run holds the chunks there are between its ends; a run without any is left out. Repeated chunks count once.
    """
    runs = results.where("document is not null and seq_start <= seq_end").select("collection", F.col("document").alias("name"), "seq_start", "seq_end").distinct()
    named = documents.select("name", "document_id").where("name is not null").groupBy("name").agg(F.min("document_id").alias("document_id"))
    runs = runs.join(named, "name").drop("name")
    own = chunks.where("text is not null").groupBy("collection", "document_id", "seq").agg(F.min("text").alias("text"))
    met = runs.join(own, ["collection", "document_id"]).where("seq between seq_start and seq_end")
    whole = met.groupBy("collection", "document_id", "seq_start", "seq_end").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("own"))
    run = F.concat_ws("/", "collection", "document_id", "seq_start", "seq_end")
    return whole.select(run.alias("run"), "collection", "document_id", "seq_start", "seq_end", F.array_join("own.text", "\n\n").alias("text"))
