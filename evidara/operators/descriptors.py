"""What sections are about: c-TF-IDF terms, diverse descriptors, and a vocabulary of preferred terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from evidara.functions.columns import variant, words
from evidara.functions.stem import stem
from evidara.session import scratch

#: Descriptors of a class, and candidates that they are picked from.
PICKED, CANDIDATES = 6, 20
#: Weight of relevance against likeness in a diverse pick.
RELEVANCE = 0.7
NEIGHBOURS, JUDGED = 32, 0.93
#: Uses of a term in one class before it describes it, where the class has words enough.
LEAST_USES, LEAST_LETTERS = 2, 3

# English function words, and modal verbs and fillers that say nothing about a topic.
FILLERS = """
a about above after again against all also am an and any are aren't as at be because been
before being below between both but by can can't cannot could couldn't did didn't do does
doesn't doing don't down during each either else etc even ever every few for from further get
gets got had hadn't has hasn't have haven't having he he'd he'll he's her here here's hers
herself him himself his how how's however i i'd i'll i'm i've if in into is isn't it it's its
itself just let's like may me might more most much must mustn't my myself neither no nor not
now of off often on once one only or other ought our ours ourselves out over own per rather
same shall shan't she she'd she'll she's should shouldn't since so some such than that that's
the their theirs them themselves then there there's these they they'd they'll they're they've
this those though through thus to too two under until up upon us use used uses using very via
was wasn't we we'd we'll we're we've well were weren't what what's when when's where where's
whether which while who who's whom whose why why's will with within without won't would
wouldn't yes yet you you'd you'll you're you've your yours yourself yourselves
""".split()
# What ends a phrase, what a word is, and a word parted at a line's end.
BREAK = re.compile(r"""[.,;:!?()\[\]{}<>"|=/\\–—“”]|\n\s*\n""")
PHRASED = re.compile(r"\w+(?:['’]\w+)*")
PARTED = re.compile(r"(\w)-[ \t]*\n[ \t]*(\w)")
STOPPED = frozenset(FILLERS)


def phrases(text: str, stemmed: bool = True) -> Iterator[tuple[str, str]]:
    """(term, form): the words of a text that may describe it, and each two of them that stand next to each other within a clause. A term is of
    stems, a form as it is written."""
    for clause in BREAK.split(PARTED.sub(r"\1\2", text or "")):
        before = None
        for form in PHRASED.findall(clause):
            low = form.lower().replace("’", "'")
            if len(low) < LEAST_LETTERS or low in STOPPED or not any(map(str.isalpha, low)):
                before = None
                continue
            own = (stem(low) if stemmed else low, form)
            yield own
            if before:
                yield f"{before[0]} {own[0]}", f"{before[1]} {own[1]}"
            before = own


def term_forms(rows: DataFrame, key: list[str], text: str, stemmed: bool = True) -> DataFrame:
    """(key, term, form, tf): uses of each term in each class, by the form that it is written in. Null texts have none."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n: Counter = Counter()
            for *k, t in zip(*(c.to_pylist() for c in b.columns)):
                n.update((*k, *p) for p in phrases(t, stemmed))
            if n:
                columns = [*zip(*n), tuple(n.values())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [*(b.schema.field(i).type for i in range(len(key))), pa.string(), pa.string(), pa.int64()])], names=[*key, "term", "form", "tf"])

    found = rows.select(*key, F.col(text).alias("_text")).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", term string, form string, tf long")
    return found.groupBy(*key, "term", "form").agg(F.sum("tf").alias("tf"))


def class_terms(rows: DataFrame, key: list[str], text: str, stemmed: bool = True) -> DataFrame:
    """(key, term, tf): uses of each term in each class."""
    return term_forms(rows, key, text, stemmed).groupBy(*key, "term").agg(F.sum("tf").alias("tf"))


def shown(forms: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, form): the form that each term is written in most often, ties to the first by name."""
    total = forms.groupBy(*key, "term", "form").agg(F.sum("tf").alias("n"))
    return total.groupBy(*key, "term").agg(F.min_by("form", F.struct(-F.col("n"), "form")).alias("form"))


def section_terms(terms: DataFrame, runs: DataFrame) -> DataFrame:
    """(collection, document_id, position, depth, term, tf): the terms of chunks(collection, document_id, seq, term, tf) summed up over every run that holds them."""
    own = runs.select("collection", "document_id", "position", "depth", "seq_start", "seq_end")
    met = terms.join(own, ["collection", "document_id"]).where("seq between seq_start and seq_end")
    return met.groupBy("collection", "document_id", "position", "depth", "term").agg(F.sum("tf").alias("tf"))


def ctfidf(terms: DataFrame, key: list[str], depth: list[str] | None = None, widespread: float | None = 0.5) -> DataFrame:
    """(depth, key, term, tf, weight): sqrt(tf / terms of the class) * ln(1 + (N - n + 0.5) / (n + 0.5)) among the classes of a depth.

    Terms that more than `widespread` of the classes use are left out where there are two classes or more; none if it is null.
    """
    rows = _spread(terms, key, depth or [])
    if widespread is not None:
        rows = rows.where(f"classes < 2 or n <= {widespread} * classes")
    return rows.select(*(depth or []), *key, "term", "tf", "weight")


def _spread(terms: DataFrame, key: list[str], depth: list[str]) -> DataFrame:
    sizes = terms.groupBy(*depth, *key).agg(F.sum("tf").alias("size"))
    classes = sizes.groupBy(*depth).agg(F.count("*").alias("classes"))
    spread = terms.groupBy(*depth, "term").agg(F.count("*").alias("n"))
    spread = spread.join(classes, depth) if depth else spread.crossJoin(F.broadcast(classes))  # one row
    rows = terms.join(spread, [*depth, "term"]).join(sizes, [*depth, *key])
    return rows.withColumn("weight", F.sqrt(F.col("tf") / F.col("size")) * F.log1p((F.col("classes") - F.col("n") + 0.5) / (F.col("n") + 0.5)))


def candidates(terms: DataFrame, key: list[str], depth: list[str] | None = None, enough: int = PICKED, widespread: float = 0.5) -> DataFrame:
    """(depth, key, term, tf, weight): what may describe a class: terms that it uses LEAST_USES times or more and that are not widespread.

    A class with fewer than `enough` single words of that kind keeps all terms that are not widespread, and one of which nothing is left keeps all.
    """
    depth = depth or []
    own = Window.partitionBy(*depth, *key)
    rows = _spread(terms, key, depth).withColumn("_fine", (F.col("classes") < 2) | (F.col("n") <= widespread * F.col("classes")))
    often = F.col("_fine") & (F.col("tf") >= LEAST_USES)
    rows = rows.withColumns({"_often": often, "_words": F.sum((often & ~F.contains("term", F.lit(" "))).cast("int")).over(own), "_any": F.max(F.col("_fine").cast("int")).over(own)})
    kept = F.when(F.col("_any") == 0, F.lit(True)).when(F.col("_words") >= enough, F.col("_often")).otherwise(F.col("_fine"))
    return rows.where(kept).select(*depth, *key, "term", "tf", "weight")


def picked(weights: DataFrame, key: list[str], k: int = PICKED, first: int = 64) -> DataFrame:
    """(key, descriptors): the k heaviest terms of each class, without those whose words hold or are held by a kept one's.

    The heaviest `first` terms are looked through; where they give fewer than k and there are more, eight times as many, and so on to the last.
    """
    w = Window.partitionBy(*key).orderBy(F.round("weight", 12).desc(), "term")

    # a fold in the JVM over as many terms as are looked through
    def clash(kept, t):
        ws = F.split(t, " ")
        return F.exists(kept, lambda x: (F.size(F.array_except(F.split(x, " "), ws)) == 0) | (F.size(F.array_except(ws, F.split(x, " "))) == 0))

    left, result = scratch(weights.withColumn("_n", F.row_number().over(w)).select(*key, "_n", "term"), "ordered"), None
    while True:
        listed = left.where(F.col("_n") <= first).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "term"))), lambda x: x["term"]).alias("terms"))
        kept = F.aggregate("terms", F.array().cast("array<string>"), lambda acc, t: F.when((F.size(acc) >= k) | clash(acc, t), acc).otherwise(F.concat(acc, F.array(t))))
        found = scratch(listed.select(*key, kept.alias("descriptors")), "picked")
        more = found.where(F.size("descriptors") < k).select(*key).join(left.where(F.col("_n") == first + 1).select(*key), key, "left_semi")
        if not more.limit(1).count():
            return found if result is None else result.unionByName(found)
        done = found.join(more, key, "left_anti")
        result = done if result is None else result.unionByName(done)
        left, first = left.join(scratch(more, "more"), key, "left_semi"), first * 8


def described(chunks: DataFrame, runs: DataFrame, text: str = "text", stemmed: bool = True, k: int = PICKED) -> DataFrame:
    """(collection, document_id, position, descriptors): what sets each section apart from the others of its depth in its document, as written there."""
    place = ["collection", "document_id"]
    forms = scratch(term_forms(chunks, [*place, "seq"], text, stemmed), "forms")
    terms = scratch(section_terms(forms.groupBy(*place, "seq", "term").agg(F.sum("tf").alias("tf")), runs), "terms")
    best = picked(candidates(terms, ["position"], [*place, "depth"], k).drop("depth"), [*place, "position"], k)
    each = best.select(*place, "position", F.posexplode("descriptors").alias("at", "term")).join(shown(forms, place), [*place, "term"])
    return each.groupBy(*place, "position").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "form"))), lambda x: x["form"]).alias("descriptors"))


def prose(layout: Column, text: Column) -> Column:
    """A chunk's text without its code blocks and tables, each left as a blank line. layout has the type and start of each piece."""
    ends = F.transform(layout, lambda x, i: F.coalesce(F.try_element_at(layout, i + 2)["position"], F.length(text)))
    pieces = F.zip_with(layout, ends, lambda x, e: F.when(x["type"].isin("code", "table"), F.lit("\n\n")).otherwise(F.substring(text, x["position"] + 1, e - x["position"])))
    return F.when(F.size(layout) > 0, F.array_join(pieces, "")).otherwise(text)


def diverse(candidates: DataFrame, key: str, k: int = PICKED) -> DataFrame:
    """(key, item, pick): candidates(key, item, relevance, vector) by relevance against the greatest likeness to what is picked already."""

    def run(it):
        for own in it:
            out = []
            for key_, rows in zip(own[key], own.rows):
                v = np.stack([np.asarray(r["vector"], float) for r in rows])
                n = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(n > 0, n, 1)
                rel = np.array([r["relevance"] for r in rows])
                kept: list[int] = []
                while len(kept) < min(k, len(rows)):
                    like = (v @ v[kept].T).max(1) if kept else np.zeros(len(rows))
                    score = RELEVANCE * rel - (1 - RELEVANCE) * like
                    score[kept] = -np.inf
                    kept.append(int(np.argmax(score)))
                    out.append((key_, rows[kept[-1]]["item"], len(kept)))
            yield pd.DataFrame(out, columns=[key, "item", "pick"])

    types = {f.name: f.dataType.simpleString() for f in candidates.schema}
    top = candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("relevance"), "item"))).where(f"_n <= {CANDIDATES}")
    listed = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", "item", "relevance", "vector"))).alias("rows"))
    return listed.mapInPandas(run, f"{key} {types[key]}, item {types['item']}, pick int")


def variants(sections: DataFrame, descriptors: str = "descriptors") -> DataFrame:
    """(variant, uses, shown): phrases as one where they differ in case or blanks, shown as most often written."""
    each = sections.select(F.explode(descriptors).alias("phrase")).where("trim(phrase) <> ''").groupBy("phrase").agg(F.count("*").alias("n"))
    best = F.min_by("phrase", F.struct(-F.col("n"), "phrase"))
    return each.groupBy(variant("phrase").alias("variant")).agg(F.sum("n").alias("uses"), best.alias("shown"))


def pairs_to_judge(rows: DataFrame, item: str, vector: str, k: int = NEIGHBOURS, least: float = JUDGED, block: int = 16_384, at_once: int = 32) -> DataFrame:
    """(a, b, cosine), a < b: pairs of at least this cosine that are among the k nearest of one of them, exact.

    Items of equal vectors share one row, the lead's, and of them only the k + 1 first can be among anyone's k nearest, ties going to the smaller id. All leads
    are compared with all, in blocks that are broadcast, each two blocks once; each task passes on at most k + 1 for each row and batch. The rows are
    written once, so that no block repeats what they come from, and what blocks find is written for at_once blocks at a time.
    """
    kind, number = rows.schema[item].dataType.simpleString(), np.dtype(np.float32 if isinstance(rows.schema[vector].dataType.elementType, FloatType) else np.float64)
    equal = Window.partitionBy("v").orderBy("item")
    own = rows.select(F.col(item).alias("item"), F.col(vector).alias("v")).where("item is not null and v is not null")
    own = own.withColumns({"lead": F.first("item").over(equal), "copy": F.row_number().over(equal), "lone": (F.row_number().over(equal) == 1) & F.lead("item").over(equal).isNull()})
    members = scratch(own.withColumn("v", F.when(F.col("copy") == 1, F.col("v"))).mapInArrow(_packed(number), f"item {kind}, lead {kind}, copy int, lone boolean, v binary"), "vectors")
    leads, spark, kept = members.where("copy = 1").select("item", "v"), rows.sparkSession, members.where(F.col("copy") <= k + 1)
    parts = -(-leads.count() // block)
    part, near, found, shared = F.pmod(F.xxhash64("item"), F.lit(parts)), members.select(F.col("item").alias("a"), F.col("item").alias("b"), F.lit(0.0).alias("cosine")).where("false"), [], []
    for n in range(parts):
        asked = leads.where(part == n).toArrow()
        if asked.num_rows:
            shared.append(spark.sparkContext.broadcast((pa.array(asked.column("item").to_pylist(), asked.column("item").type), _matrix(asked.column("v").combine_chunks(), number))))
            ahead = 2 * F.pmod(part - n, F.lit(parts))  # of two blocks, one meets the other
            met = leads.where((ahead < parts) | ((ahead == parts) & (part > n))).withColumn("own", part == n)
            found.append(met.mapInArrow(_near(shared[-1], k, least, number), f"a {kind}, b {kind}, cosine double"))
        if found and (len(found) == at_once or n == parts - 1):
            near = near.unionByName(scratch(reduce(DataFrame.unionByName, found), "near"))
            for x in shared:
                x.destroy()
            found, shared = [], []
    met = near.join(kept.select(F.col("lead").alias("b"), F.col("item").alias("y")), "b").select("a", "y", "cosine")
    met = met.unionByName(kept.where("not lone").select(F.col("lead").alias("a"), F.col("item").alias("y"), F.lit(1.0).alias("cosine")))
    first = met.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.rint(F.col("cosine") * 1e9).desc(), "y"))).where(F.col("n") <= k + 1)
    lists = first.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("n", "y", "cosine"))).alias("l"))  # at most k + 1
    each = members.select(F.col("lead").alias("a"), F.col("item").alias("x")).join(lists, "a").select("x", F.explode(F.slice(F.filter("l", lambda e: e["y"] != F.col("x")), 1, k)).alias("e"))
    return each.select(F.least("x", "e.y").alias("a"), F.greatest("x", "e.y").alias("b"), "e.cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _packed(number: np.dtype):
    """The last column, a list of numbers, as bytes; none for null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = b.column("v")
            size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) * number.itemsize
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            flat = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), dtype=number)
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.record_batch([*(b.column(c) for c in ("item", "lead", "copy", "lone")), packed], names=["item", "lead", "copy", "lone", "v"])

    return run


def _matrix(packed: pa.Array, number: np.dtype) -> np.ndarray:
    sizes = set(pc.binary_length(packed).unique().to_pylist())
    if len(sizes) > 1:
        raise ValueError("vectors of one model have one length")
    return np.frombuffer(b"".join(packed.to_pylist()), dtype=number).reshape(len(packed), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _firsts(of: np.ndarray, cosine: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each, nearest first, ties by the other's place."""
    if not len(of) or np.bincount(of).max() <= most:
        return np.arange(len(of))
    order = np.lexsort((other, -np.rint(cosine * 1e9), of))
    start = np.concatenate(([0], np.cumsum(np.bincount(of))))
    return order[np.arange(len(of)) - start[of[order]] < most]


def _near(shared, k: int, least: float, number: np.dtype):
    """(a, b, cosine) both ways, each row's first k + 1 of a batch: single precision tells what can reach the bar, double what does."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        q, place = _unit(q), pc.rank(names).to_numpy()
        q32, slack = q.astype(np.float32), (q.shape[1] + 8) * 2.0**-23
        for b in it:
            if not b.num_rows:
                continue
            item, own = b.column("item"), b.column("own").to_numpy(zero_copy_only=False)
            v, its = _unit(_matrix(b.column("v"), number)), pc.rank(item).to_numpy()
            me = pc.index_in(item, value_set=names).fill_null(-1).to_numpy()
            v32, strip, ahead, back = v.astype(np.float32).T, max(1, (1 << 21) // b.num_rows), [], []
            for s in range(0, len(q), strip):
                near = q32[s : s + strip] @ v32 >= np.float32(least - slack)
                if not near.any():
                    continue
                i, j = np.nonzero(near)
                cos = np.einsum("ij,ij->i", q[s + i], v[j]) if len(i) * q.shape[1] <= 1 << 21 else (q[s : s + strip] @ v.T)[i, j]
                i += s
                fine = np.flatnonzero((cos >= least) & (i != me[j]))
                i, j, cos = i[fine], j[fine], cos[fine]
                one = _firsts(i, cos, its[j], k + 1)
                ahead.append((i[one], j[one], cos[one]))
                # rows of the block itself are asked in their turn
                two = np.flatnonzero(~own[j])
                back.append((i[two], j[two], cos[two]))
                if sum(len(x[0]) for x in back) > 1 << 21:
                    back = _cut(back, place, k + 1)
            for turned, part in ((False, ahead), (True, _cut(back, place, k + 1))):
                for i, j, cos in part:
                    ends = [names.take(pa.array(i)), item.take(pa.array(j))]
                    yield pa.record_batch([*(ends[::-1] if turned else ends), pa.array(cos)], names=["a", "b", "cosine"])

    return run


def _cut(back: list, place: np.ndarray, most: int) -> list:
    if not back:
        return back
    i, j, cos = (np.concatenate(x) for x in zip(*back))
    kept = _firsts(j, cos, place[i], most)
    return [(i[kept], j[kept], cos[kept])]


def _letters(phrase: Column) -> Column:
    return F.array_join(words(phrase), "")


def same_words(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with same: whether both phrases say the same words, but for blanks and signs between them, or for their endings."""

    @F.pandas_udf("boolean")
    def endings(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(p) == len(q) and len(p) > 0 and all(stem(m) == stem(n) for m, n in zip(p, q)) for p, q in zip(x, y)], dtype=bool)

    joined = (F.size(words(a)) > 0) & (_letters(F.col(a)) == _letters(F.col(b)))
    return pairs.withColumn("same", joined | endings(words(a), words(b)))


def pairs_to_ask(pairs: DataFrame, verdicts: DataFrame, judge: str) -> DataFrame:
    """(a, b, cosine): near pairs that do not say the same words and that the judge has no verdict on. verdicts(judge, a, b, score)."""
    known = verdicts.where(F.col("judge") == judge).select("a", "b").distinct()
    return same_words(pairs).where("not same").drop("same").join(known, ["a", "b"], "left_anti")


def one_concept(pairs: DataFrame, verdicts: DataFrame, judge: str, least: float, near: float = JUDGED) -> DataFrame:
    """(a, b, cosine): neighbours that are one concept: of the same words, or near each other and judged to be."""
    told = verdicts.where(F.col("judge") == judge).groupBy("a", "b").agg(F.max("score").alias("score"))
    rows = same_words(pairs).join(told, ["a", "b"], "left")
    return rows.where(F.col("same") | ((F.col("cosine") >= near) & (F.coalesce("score", F.lit(0.0)) >= least))).select("a", "b", "cosine")


def missing_vectors(variants: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The variants that a model has not embedded yet. vectors(model, variant)."""
    return variants.join(vectors.where(F.col("model") == model).select("variant").distinct(), "variant", "left_anti")


def preferred(uses: DataFrame, same: DataFrame) -> DataFrame:
    """(variant, preferred): a variant takes the nearest preferred one that it is one concept with, else is one itself.

    uses(variant, uses), same(a, b, cosine). The most used decide first, of those the shortest, of those the first by name. Only variants with a pair are
    looked at; the others are their own. Rounds, as many as the longest chain of pairs in that order; each writes what it decides and what is left.
    """
    ends = same.where("a <> b").select(F.explode(F.array(F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))).alias("e")).select("e.*")
    ranks = uses.select("variant", F.struct((-F.col("uses")).alias("u"), F.length("variant").alias("l")).alias("place"))
    links = ends.join(ranks.select(F.col("variant").alias("a"), F.col("place").alias("pa")), "a").join(ranks.select(F.col("variant").alias("b"), F.col("place").alias("pb")), "b")
    # a variant's fate is known once those before it that it is linked with are
    earlier = scratch(links.where(F.struct("pb", "b") < F.struct("pa", "a")).select("a", "b", "cosine"), "earlier")
    known = scratch(earlier.select("b").distinct().join(earlier.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select("b", F.col("b").alias("bt")), "fate")
    fates, open_ = None, earlier
    while open_.limit(1).count():
        met = open_.join(known, "b", "left") if fates is None else open_.join(known.unionByName(fates.select(F.col("a").alias("b"), F.col("to").alias("bt"))), "b", "left")
        state = met.groupBy("a").agg(F.bool_and(F.col("bt").isNotNull()).alias("ready"), F.min_by("b", F.when(F.col("bt") == F.col("b"), F.struct(-F.col("cosine"), "b"))).alias("best"))
        new = scratch(state.where("ready").select("a", F.coalesce("best", "a").alias("to")), "fate")
        fates = new if fates is None else fates.unionByName(new)
        open_ = scratch(open_.join(new.select("a"), "a", "left_anti"), "open")
    if fates is None:
        return uses.select("variant", F.col("variant").alias("preferred"))
    return uses.select("variant").join(fates.withColumnRenamed("a", "variant"), "variant", "left").select("variant", F.coalesce("to", "variant").alias("preferred"))


def vocabulary_terms(uses: DataFrame, preferred: DataFrame) -> DataFrame:
    """(variant, term, uses, variants): the preferred terms as shown, with the uses and names of all variants that they stand for, their own first.

    uses(variant, uses, shown).
    """
    rows = uses.join(preferred, "variant")
    listed = F.transform(F.sort_array(F.collect_list(F.struct((F.col("variant") != F.col("preferred")).alias("o"), "variant"))), lambda x: x["variant"])
    return rows.groupBy(F.col("preferred").alias("variant")).agg(F.max(F.when(F.col("variant") == F.col("preferred"), F.col("shown"))).alias("term"), F.sum("uses").alias("uses"), listed.alias("variants"))


def compacted(sections: DataFrame, terms: DataFrame, key: str, descriptors: str = "descriptors") -> DataFrame:
    """(key, descriptors): each phrase as its preferred term, each term once, in order. terms(variant, preferred)."""
    each = sections.select(key, F.posexplode(descriptors).alias("at", "phrase")).withColumn("variant", variant("phrase"))
    mapped = each.join(terms, "variant", "left").select(key, F.coalesce("preferred", "phrase").alias("term"), "at")
    first = mapped.groupBy(key, "term").agg(F.min("at").alias("at"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("descriptors"))
