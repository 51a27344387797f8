"""The English Snowball stemmer (Porter2), from its published rules; a worker keeps the stems of words it has met."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STAY_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _region(w: str, start: int = 0) -> int:
    m = re.compile("[aeiouy][^aeiouy]").search(w, start)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"(?:^|.*)[^aeiouy][aeiouy][^aeiouywxY]$", w) and len(w) > 2) or bool(re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = re.sub("^y|(?<=[aeiouy])y", "Y", w)
    pre = re.match("gener|commun|arsen", w)
    r1 = pre.end() if pre else _region(w)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in STAY_AFTER_1A:
        return w
    # pasts and participles
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search("[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, new in STEP_2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
                w = w[: -len(end)] + new
            break
    for end, new in STEP_3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    for end in STEP_4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stems(words: Column | str) -> Column:
    """The stems of an array of words, batch by batch."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda own: None if own is None else [stem(x) for x in own])

    return run(words)
