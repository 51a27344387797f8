"""Text of scanned pages repaired: page furniture taken out, broken words joined, misread words set right.

Furniture is told by place and by the other pages of its document: page numbers that count on from page to page, running
headers that come again or break into a sentence. Words broken over lines are joined, with or without their hyphen, as the corpus writes them. Misread words
are found through a symmetric-delete index: the corpus's words, and the words of scanned pages, are written as scanners confuse them
and indexed under these forms and all of them with one letter left out; words that meet are candidates. A weighted edit distance, cheap for confusions
and dear for anything else, the words' counts, and where these leave several the counts of their neighbours, pick the repair.

Only documents with pages read by OCR are looked at; counts are of the whole corpus. Null and empty texts hold nothing. Lines end at line feeds.
A repeated id with several texts has the findings of each. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import arrow_map
from evidara.session import few_rows, scratch, spread

# What scanners confuse, as (right, read), and what a confusion costs.
CONFUSED = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("b", "8"), ("g", "9"), ("a", "@"), ("i", "!"), ("l", "!"), ("s", "$"), ("l", "|"), ("i", "l"), ("l", "i"), ("z", "2"), ("b", "6"),
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("e", "f"), ("n", "u"), ("u", "n"), ("o", "c"), ("a", "o"), ("u", "v"), ("y", "v"),
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("u", "ii"), ("n", "ri"), ("ri", "n"), ("h", "li"), ("li", "h"), ("m", "nn"), ("ni", "m"), ("m", "ni"), ("k", "lc"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"),
]
COST = 0.35
#: Signs read for letters.
SIGNS = str.maketrans({"0": "o", "1": "l", "5": "s", "8": "b", "9": "g", "@": "a", "!": "i", "$": "s", "|": "l"})
FOLDS = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("ri", "n"), ("li", "h")]


@dataclass(frozen=True)
class RepairSettings:
    """least: uses that a word needs to be a repair; ratio: how many times the misread word's uses it must have; farthest: weighted edit
    distance at most; margin: lead in score, under which neighbours decide between candidates; longest: characters of a word
    that is looked up, longer ones being no words."""

    least: int = 3
    ratio: float = 5.0
    farthest: float = 0.9
    margin: float = 3.0
    longest: int = 40
    neighbours: int = 1_000_000


MARKER = re.compile(r"^\s*<!--\s*page\s+(\d+)\b.*-->\s*$", re.I)
NUMBER = r"(?:[0-9lIiOoSs|!]{1,4}|[ivxlc]{1,7})"
BARE = re.compile(rf"^(?:([—–-])\s*({NUMBER})\s*[—–-]|\[\s*({NUMBER})\s*\]|P\S{{2,4}}\s+({NUMBER})|({NUMBER})\s*/\s*{NUMBER}|({NUMBER}))$")
BESIDE = re.compile(rf"^(?:({NUMBER})(?:\s*\|\s*|\s{{2,}})(\S.*)|(.*\S)(?:\s*\|\s*|\s{{2,}})({NUMBER}))$")
#: Word-like tokens: letters, and signs read for letters, with inner hyphens.
WORDLIKE = re.compile(r"^[^\W_](?:[^\W_]|[@!$|'’-])*$|^[@!$|](?:[^\W_]|[@!$|'’-])*$")
BREAKS = "-­¬‐"
PLAIN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def value(number: str) -> int | None:
    """A page number as read: arabic, with letters read for digits, or roman."""
    low = number.lower()
    if re.fullmatch("[ivxlc]+", low) and low != "l":
        digits = [ROMAN[c] for c in low]
        return sum(-a if a < b else a for a, b in zip(digits, [*digits[1:], 0]))
    arabic = number.translate(str.maketrans("lIi|!OoSs", "111110055"))
    return int(arabic) if arabic.isdigit() else None


def _alike(a: str, b: str) -> bool:
    """Whether two headers differ by no more than a few misread characters."""
    a, b = a.lower(), b.lower()
    if abs(len(a) - len(b)) > 3:
        return False
    return distance(b, a, 3.5) <= max(1.5, len(a) / 10)


def _title(line: str) -> bool:
    s = line.strip()
    return bool(s) and s[-1] not in ".,;:!?" + BREAKS and (s[0].isupper() or not s[0].isalpha()) and not s.startswith(("#", "|", "`", "-", "*", "+", ">", "<")) and 1 <= len(s.split()) <= 9


def _number(m: re.Match) -> int | None:
    return value(next(x for x in m.groups()[1:] if x))


def _chain(marks: list[tuple[int, int]]) -> list[int]:
    """The lines of the longest run, of (line, number), whose numbers count on from one to the next; up to two pages may be left out between."""
    #: For each number the longest run so far that ends with it, as (length, mark), and of each mark the one before it.
    last: dict[int, tuple[int, int]] = {}
    before: list[int] = []
    best = (0, -1)
    for k, (_, n) in enumerate(marks):
        length, prior = max((last.get(n - step, (0, -1)) for step in (1, 2, 3)), key=lambda x: x[0])
        before.append(prior)
        if length + 1 > last.get(n, (0, -1))[0]:
            last[n] = (length + 1, k)
        if length + 1 > best[0]:
            best = (length + 1, k)
    own, k = [], best[1]
    while k >= 0:
        own.append(marks[k][0])
        k = before[k]
    return own[::-1] if len(own) > 1 else []


def pages_of(lines: list[str]) -> list[tuple[int, list[int]]]:
    """(number, indices of the lines that are not blank) of each page, by markers or form feeds, else by page numbers."""
    pages: list[tuple[int, list[int]]] = [(0, [])]
    parted = any(MARKER.match(x) or "\f" in x for x in lines)
    before: set[int] = set()
    after: set[int] = set()
    if not parted:
        blank = [not x.strip() for x in lines] + [True]
        bare_ones, beside = [], []
        for i, line in enumerate(lines):
            s = line.strip()
            if (m := BARE.match(s)) and (v := _number(m)) is not None:
                bare_ones.append((i, v))
            elif (m := BESIDE.match(s)) and blank[i - 1] and _title(m[2] or m[3]) and (v := value(m[1] or m[4])) is not None:
                beside.append((i, v))
        after, before = set(_chain(bare_ones)), set(_chain(beside))
    for i, line in enumerate(lines):
        if m := MARKER.match(line):
            pages.append((int(m[1]), []))
            continue
        if "\f" in line or i in before:
            pages.append((pages[-1][0] + 1, []))
        if line.strip():
            pages[-1][1].append(i)
        if i in after:
            pages.append((pages[-1][0] + 1, []))
    return [(p, own) for p, own in pages if own]


def furniture(lines: list[str]) -> set[int]:
    """The indices of the lines that are page numbers or running headers."""
    pages = pages_of(lines)
    found: set[int] = set()
    tops: dict[int, tuple[int, str, int | None]] = {}
    bottoms: dict[int, tuple[int, int, bool]] = {}
    for n, (p, own) in enumerate(pages):
        if (m := BARE.match(lines[own[-1]].strip())) and (v := _number(m)) is not None:
            bottoms[n] = (own[-1], v - p, m[6] is None)
        first = lines[own[0]].strip()
        if (m := BARE.match(first)) and len(own) > 1:
            if (v := _number(m)) is not None:
                tops[n] = (own[0], "", v - p)
        elif (m := BESIDE.match(first)) and _title(m[2] or m[3]):
            v = value(m[1] or m[4])
            tops[n] = (own[0], m[2] or m[3], None if v is None else v - p)
        elif _title(first) and not (own[0] + 1 < len(lines) and re.match(r"^\s*[=-]{3,}\s*$", lines[own[0] + 1])):
            tops[n] = (own[0], first, None)
    # numbers that count on with the pages, or stand in signs of their own
    steps = Counter(s for _, s, _ in bottoms.values())
    common = steps.most_common(1)[0] if steps else (0, 0)
    for i, step, signed in bottoms.values():
        if signed or (step == common[0] and (common[1] > 1 or len(pages) <= 2)):
            found.add(i)
    numbered = Counter(s for _, _, s in tops.values() if s is not None)
    sure: set[int] = set()
    held = Counter(t.lower() for _, t, _ in tops.values())
    for n, (_, title, step) in tops.items():
        if step is not None and (title or numbered[step] > 1):
            sure.add(n)
        elif step is None and (held[title.lower()] > 1 or any(t != title.lower() and _alike(title, t) for t in held)):
            sure.add(n)
    width = max((len(x.rstrip()) for i, x in enumerate(lines) if i not in found), default=0)
    left: list[int] = []
    for n, (i, _, step) in tops.items():
        if n in sure or n == 0 or step is not None:
            continue
        before = [x for x in pages[n - 1][1] if x not in found]
        after = [x for x in pages[n][1] if x > i and x not in found]
        left.append(n)
        # a line that the next word would have fitted on was ended on purpose
        if not after or len(lines[i].rstrip()) + 1 + len(lines[after[0]].split()[0]) > width:
            continue
        open_ended = bool(before) and lines[before[-1]].strip()[-1:] not in set(".!?\"'”)")
        if open_ended or after[0] == i + 1:
            sure.add(n)
    if sure:
        sure.update(left)
    return found | {tops[n][0] for n in sure}


def forms(word: str) -> set[str]:
    """A word as it is indexed: with letters for signs, and once more for each pair of letters that scanners take for others."""
    plain = unicodedata.normalize("NFKC", word).translate(SIGNS)
    return {plain, *(plain.replace(a, b) for a, b in FOLDS if a in plain)}


def index_keys(word: str) -> set[int]:
    """Hashes of the word's forms and of these with one letter left out."""
    return {xxhash.xxh64_intdigest(x) - (1 << 63) for f in forms(word) for x in (f, *(f[:i] + f[i + 1 :] for i in range(len(f))))}


_CONFUSIONS: dict[tuple[int, int], set[tuple[str, str]]] = {}
for _right, _read in CONFUSED:
    _CONFUSIONS.setdefault((len(_right), len(_read)), set()).add((_right, _read))


def distance(right: str, read: str, most: float = 9.0) -> float:
    """The weighted edit distance from a right word to what was read: confusions cost little, other edits 1."""
    n, m = len(right), len(read)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            here = d[i, j]
            if here > most:
                continue
            if i < n and j < m:
                d[i + 1, j + 1] = min(d[i + 1, j + 1], here + (right[i] != read[j]))
            if i < n:
                d[i + 1, j] = min(d[i + 1, j], here + 1)
            if j < m:
                d[i, j + 1] = min(d[i, j + 1], here + 1)
            for (a, b), pairs in _CONFUSIONS.items():
                if i + a <= n and j + b <= m and (right[i : i + a], read[j : j + b]) in pairs:
                    d[i + a, j + b] = min(d[i + a, j + b], here + COST)
    return float(d[n, m])


def bare(token: str) -> str:
    """A token without the punctuation around it, lower case; empty if it is no word."""
    token = token.strip("\"“”‘’'()[]{}*_,;:.?…—–").rstrip("!").lower()
    return token if WORDLIKE.match(token) and any(c.isalpha() or c in "@!$|" for c in token) else ""


Line = tuple[int, str, str, str, str, str]


def tokens_of(text: str) -> list[Line]:
    """(line, kind, word, kept, before, after): kind is furniture, hyphen or word. A hyphen's word is joined without, kept with its hyphen."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    out_of = furniture(lines)
    rows: list[Line] = [(i + 1, "furniture", "", "", "", "") for i in sorted(out_of)]
    body, fenced = [], False
    for i, line in enumerate(lines):
        s = line.strip()
        if s.startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if i not in out_of and s and not fenced and not MARKER.match(line) and s[0] not in "|#":
            body.append((i, s.split()))
    running: list[tuple[int, str, str, str]] = []
    skip = False
    for k, (i, parts) in enumerate(body):
        for t, token in enumerate(parts):
            if skip:
                skip = False
                continue
            last = t == len(parts) - 1
            stem = token[:-1]
            if last and token[-1] in BREAKS and k + 1 < len(body) and bare(stem) and stem[-1:].isalnum():
                rest = body[k + 1][1][0]
                if bare(rest) and (rest[0].isalnum() or rest[0] in "@!$|") and not rest[0].isdigit() and not rest[0].isupper():
                    running.append((i + 1, "hyphen", bare(stem + rest), bare(stem + "-" + rest)))
                    skip = True
                    continue
            running.append((i + 1, "word", bare(token), ""))
    for n, (line, kind, word, kept) in enumerate(running):
        if word:
            before = running[n - 1][2] if n else ""
            after = running[n + 1][2] if n + 1 < len(running) else ""
            rows.append((line, kind, word, kept, before, after))
    return rows


def words_of(df: DataFrame) -> DataFrame:
    """(word, n): the uses of every word of the corpus, words with inner hyphens whole."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for t in b.column(0).to_pylist():
            n.update(PLAIN.findall(t.lower()))
            if len(n) > 500_000:
                yield pa.record_batch([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], names=["word", "n"])
                n.clear()
        yield pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    return arrow_map(df.select("text").where("text is not null"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _indexed(words: DataFrame, name: str) -> DataFrame:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, at = [], []
        for i, w in enumerate(b.column("word").to_pylist()):
            own = index_keys(w)
            keys += own
            at += [i] * len(own)
        at = pa.array(at, pa.int64())
        yield pa.record_batch([pa.array(keys, pa.int64()), b.column("word").take(at), b.column("n").take(at)], names=["key", name, f"{name}_n"])

    return arrow_map(words.select("word", "n"), run, f"key long, {name} string, {name}_n long")


def repairs_of(read: DataFrame, lexicon: DataFrame, settings: RepairSettings) -> DataFrame:
    """(read, right, score): what each word of scanned pages may be a misreading of."""
    long_enough = f"length(word) between 2 and {settings.longest}"
    asked = _indexed(read.where(long_enough), "read")
    held = _indexed(lexicon.where(long_enough).where(F.col("n") >= settings.least), "right")
    signed = F.col("read").rlike("[@!$|0-9ﬀ-ﬆ]")
    met = asked.join(held, "key").where("read <> right").where((F.col("right_n") >= settings.ratio * F.col("read_n")) | signed & (F.col("right_n") > F.col("read_n")))
    # a number is no repair, nor is a word with signs
    met = met.where(F.col("right").rlike(r"^[\p{L}-]+$")).select("read", "right", "right_n").distinct()

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        d = np.array([distance(a, r, settings.farthest) for r, a in zip(b.column("read").to_pylist(), b.column("right").to_pylist())])
        score = np.log(np.maximum(1, b.column("right_n").to_numpy())) - 8 * d
        yield pa.record_batch([b.column("read"), b.column("right"), pa.array(score)], names=["read", "right", "score"]).filter(pa.array(d <= settings.farthest))

    return arrow_map(met, run, "read string, right string, score double")


def _neighbours(docs: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """(pair, n): the uses in the corpus of the asked pairs of words, hashed; pairs are looked for a block at a time."""
    result, block_of = None, []

    def counted(part: list[int]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, frozenset(part)))

        def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            asked, n = shared.value[1], Counter()
            for t in b.column(0).to_pylist():
                w = PLAIN.findall(t.lower())
                n.update(k for x, y in zip(w, w[1:]) if (k := xxhash.xxh64_intdigest(x + " " + y) - (1 << 63)) in asked)
            yield pa.record_batch([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["pair", "n"])

        return arrow_map(docs.select("text").where("text is not null"), run, "pair long, n long")

    for r in pairs.toLocalIterator():
        block_of.append(r.pair)
        if len(block_of) == block:
            result = counted(block_of) if result is None else result.unionByName(counted(block_of))
            block_of = []
    if block_of:
        result = counted(block_of) if result is None else result.unionByName(counted(block_of))
    return result.groupBy("pair").agg(F.sum("n").alias("n")) if result is not None else docs.sparkSession.createDataFrame([], "pair long, n long")


def _with_pairs(words: DataFrame) -> DataFrame:
    """words with the hashes of (before, right) and (right, after)."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        before, right, after = (b.column(c).to_pylist() for c in ("before", "right", "after"))
        ahead, behind = ([xxhash.xxh64_intdigest(f"{x} {y}") - (1 << 63) for x, y in zip(*both)] for both in ((before, right), (right, after)))
        yield pa.record_batch([*b.columns, pa.array(ahead, pa.int64()), pa.array(behind, pa.int64())], names=[*b.schema.names, "ahead", "behind"])

    return arrow_map(words, run, "id long, line long, read string, right string, score double, before string, after string, ahead long, behind long")


def findings(df: DataFrame, id_col: str, text_col: str, scanned: str, settings: RepairSettings = RepairSettings()) -> DataFrame:
    """(id, line, kind, read, word): what must be repaired in the texts for which the condition `scanned` holds."""
    docs = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.expr(scanned).alias("scanned")).where("id is not null and text is not null and text <> ''"))
    lexicon = scratch(words_of(docs), "lexicon")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [(i, *r) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) for r in tokens_of(t)]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], schema=TOKENS)

    tokens = scratch(arrow_map(docs.where("scanned").select("id", "text"), run, "id long, line long, kind string, word string, kept string, before string, after string"), "tokens")
    forms = tokens.select(F.explode(F.array("word", "kept")).alias("word")).where("word <> ''").distinct()
    forms = forms.join(lexicon, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    options = scratch(repairs_of(forms, lexicon, settings), "options")
    right = _picked(tokens, options, docs, settings)
    known = lexicon.select("word", "n")
    found = tokens.where("kind = 'furniture'").select("id", "line", "kind", F.lit("").alias("read"), F.lit("").alias("word")).unionByName(_joined(tokens, known, options)).unionByName(right)
    return found.distinct()


TOKENS = pa.schema([("id", pa.int64()), ("line", pa.int64()), *((c, pa.string()) for c in ("kind", "word", "kept", "before", "after"))])


def _picked(tokens: DataFrame, options: DataFrame, docs: DataFrame, settings: RepairSettings) -> DataFrame:
    """The misread words: the best option, or of several close ones the one whose neighbours are most common."""
    best = Window.partitionBy("read").orderBy(F.desc("score"), "right")
    ordered = options.withColumn("place", F.row_number().over(best)).withColumn("top", F.first("score").over(best)).where(F.col("top") - F.col("score") < settings.margin)
    ordered = scratch(ordered.withColumn("several", F.count("*").over(Window.partitionBy("read"))).select("read", "right", "score", "several"), "picked")
    words = tokens.where("kind = 'word'").withColumnRenamed("word", "read")
    one = words.join(ordered.where("several = 1"), "read").select("id", "line", "read", "right")
    close = ordered.where("several > 1")
    if close.limit(1).count():
        met = scratch(_with_pairs(words.join(close, "read").select("id", "line", "read", "right", "score", "before", "after")), "close")
        n = scratch(_neighbours(docs, met.select(F.explode(F.array("ahead", "behind")).alias("pair")).distinct(), settings.neighbours), "pairs")
        for side in ("ahead", "behind"):
            met = met.join(n.select(F.col("pair").alias(side), F.col("n").alias(f"{side}_n")), side, "left")
        total = F.col("score") + 2 * F.log1p(F.coalesce("ahead_n", F.lit(0))) + 2 * F.log1p(F.coalesce("behind_n", F.lit(0)))
        w = Window.partitionBy("id", "line", "read", "before", "after").orderBy(F.desc("total"), "right")
        chosen = met.withColumn("total", total).withColumn("place", F.row_number().over(w)).where("place = 1")
        one = one.unionByName(chosen.select("id", "line", "read", "right"))
    return one.select("id", "line", F.lit("garbled").alias("kind"), "read", F.col("right").alias("word"))


def _joined(tokens: DataFrame, known: DataFrame, options: DataFrame) -> DataFrame:
    """Broken words, joined or with their hyphen, whichever the corpus uses more; set right if neither is known."""
    broken = tokens.where("kind = 'hyphen'").select("id", "line", "word", "kept")
    best = options.groupBy("read").agg(F.max_by("right", F.struct("score", "right")).alias("right"), F.max("score").alias("score"))
    for c in ("word", "kept"):
        broken = broken.join(known.select(F.col("word").alias(c), F.col("n").alias(f"{c}_n")), c, "left")
        broken = broken.join(best.select(F.col("read").alias(c), F.col("right").alias(f"{c}_right"), F.col("score").alias(f"{c}_score")), c, "left")
    n = {c: F.coalesce(f"{c}_n", F.lit(0)) for c in ("word", "kept")}
    score = {c: F.coalesce(f"{c}_score", F.lit(-99.0)) for c in ("word", "kept")}
    repaired = F.when((score["word"] <= -99) & (score["kept"] <= -99), F.lit(None)).when(score["word"] >= score["kept"], F.col("word_right")).otherwise(F.col("kept_right"))
    plain = F.when(n["kept"] > n["word"], F.col("kept")).otherwise(F.col("word"))
    seen = F.greatest(n["word"], n["kept"]) > 0
    # a known form that is itself a rare misreading has a repair as well
    word = F.coalesce(F.when(seen & F.isnull(F.when(n["kept"] > n["word"], F.col("kept_right")).otherwise(F.col("word_right"))), plain), repaired, plain)
    return broken.select("id", "line", F.lit("hyphen").alias("kind"), F.col("word").alias("read"), word.alias("word"))


def repaired(df: DataFrame, id_col: str, text_col: str, scanned: str, settings: RepairSettings = RepairSettings()) -> DataFrame:
    """(id, text): the texts for which `scanned` holds as continuous paragraphs of right words."""
    found = findings(df, id_col, text_col, scanned, settings)
    by_text = found.groupBy("id").agg(F.collect_list(F.struct("line", "kind", "read", "word")).alias("found"))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.expr(scanned)).where("id is not null and text is not null")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [set_right(t, f or []) for t, f in zip(b.column("text").to_pylist(), b.column("found").to_pylist())]
        yield pa.record_batch([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return arrow_map(docs.join(by_text, "id", "left").select("id", "text", "found"), run, "id long, text string")


def _cased(read: str, word: str) -> str:
    return word.upper() if len(read) > 1 and read.isupper() else word[:1].upper() + word[1:] if read[:1].isupper() else word


def set_right(text: str, found: list[dict]) -> str:
    """A text without furniture, its broken words whole and its paragraphs on one line each; code and tables stay as they are."""
    out_of = {f["line"] for f in found if f["kind"] == "furniture"}
    broken = {f["line"]: f["word"] for f in found if f["kind"] == "hyphen"}
    misread = {(f["line"], f["read"]): f["word"] for f in found if f["kind"] == "garbled"}
    paragraphs: list[str] = []
    running: list[str] = []
    gap, fenced, skip, paged = False, False, False, False
    verbatim = -1

    def close() -> None:
        if running:
            paragraphs.append(" ".join(running))
            running.clear()

    for n, line in enumerate((x.rstrip("\r") for x in text.split("\n")), 1):
        s = line.strip()
        if s.startswith(("```", "~~~")) or fenced or s[:1] in ("|", "#"):
            close()
            if verbatim == n - 1:
                paragraphs[-1] += "\n" + line
            else:
                paragraphs.append(line)
            verbatim = n
            fenced = fenced != s.startswith(("```", "~~~"))
            continue
        if MARKER.match(line) or n in out_of:
            paged = True
            continue
        if not s:
            gap = True
            continue
        # a blank line ends a paragraph, but not where only a page does
        ended = not running or running[-1][-1:] in set(".!?:\"'”)")
        if gap and not skip and (not paged or ended):
            close()
        gap = paged = False
        parts = s.split()
        for t, token in enumerate(parts):
            if skip:
                skip = False
                tail = re.search(r"[^\w]*$", token)[0]
                running[-1] += tail
                continue
            own = bare(token)
            if t == len(parts) - 1 and n in broken and token[-1] in BREAKS:
                lead = re.match(r"^[\"“‘'(\[*_]*", token)[0]
                running.append(lead + _cased(token[len(lead) :].rstrip(BREAKS), broken[n]))
                skip = True
            elif (right := misread.get((n, own))) is not None:
                at = token.lower().find(own)
                running.append(token[:at] + _cased(token[at : at + len(own)], right) + token[at + len(own) :])
            else:
                running.append(token)
    close()
    return "\n\n".join(paragraphs)
