"""Expressions over columns that stay in the JVM: words, sets, vectors, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters or digits.
WORD = r"[\p{L}\p{N}]+"
# Words of three letters or more that say nothing about what a question asks.
STOPWORDS = "the and for are was were has have had how what when where which who why whom whose does did should would could can may might must shall will not but with from into onto that this these those than then there their them they its about over under between each any all some one two more most other such only own same very just also".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once: in a function over array elements an expression would be computed for each."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def words(text: Column | str) -> Column:
    """The words of a text in order, lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def question_terms(text: Column | str) -> Column:
    """The words of a question that matter: each once, over two letters, no stopwords."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.filter(F.array_distinct(words(text)), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def shingles(w: Column | str, width: int = 3) -> Column:
    """The distinct runs of width words; none where there are fewer."""
    none = F.array().cast("array<string>")

    def runs(v: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(v) - (width - 1)), lambda i: F.array_join(F.slice(v, i, width), " "))
        return F.when(F.size(v) >= width, F.array_distinct(each)).otherwise(none)

    return let(_c(w), runs)


def collapsed(text: Column | str) -> Column:
    """A text with every run of blanks as one, trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def variant(phrase: Column | str) -> Column:
    return F.lower(collapsed(phrase))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column | str) -> Column:
    """A vector of length 1 in its direction; the zero vector stays zero."""
    return let(norm(a), lambda n: F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def cosine(a: Column | str, b: Column | str) -> Column:
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(0.0))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def nearness(distance: Column | str) -> Column:
    """The score of a squared distance."""
    return 1 / (1 + _c(distance))


def row_score(relevance: Column | str, bm25: Column | str, distance: Column | str) -> Column:
    """A row's score: its relevance, else its full-text score, else its nearness, else 0."""
    return F.coalesce(_c(relevance), _c(bm25), nearness(distance), F.lit(0.0))


def sigmoid(x: Column | str) -> Column:
    x = _c(x)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column | str) -> Column:
    near = F.least(F.greatest(_c(p), F.lit(5e-324)), F.lit(1 - 2.0**-53))
    return F.when(_c(p).isNotNull(), F.log(near) - F.log1p(-near))


def harmonic(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return F.when((a > 0) & (b > 0), 2 * a * b / (a + b)).otherwise(0.0)


def score_fold(kind: str, score: Column | str) -> Column:
    """An aggregate of the scores of what is folded into one; 0 for none."""
    total, most = F.coalesce(F.sum(score), F.lit(0.0)), F.coalesce(F.max(score), F.lit(0.0))
    return {"sum": total, "max": most, "harmonic": harmonic(most, total)}[kind]


def citation(name: Column, page_start: Column, page_end: Column, line_start: Column, line_end: Column) -> Column:
    """'doc p.3-4 L10-20': pages only where known, ends only where they differ."""

    def span(mark: str, a: Column, z: Column) -> Column:
        return F.when(a.isNotNull(), F.concat(F.lit(mark), a.cast("string"), F.when(z.isNotNull() & (z != a), F.concat(F.lit("-"), z.cast("string"))).otherwise("")))

    return F.concat_ws(" ", name, span("p.", page_start, page_end), span("L", line_start, line_end))


def header(headings: Column | str) -> Column:
    return F.array_join(_c(headings), " > ")
