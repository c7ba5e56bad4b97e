"""Full-text vectors: tokens, English stop words, the Porter2 stemmer, match and rank.

A vector is map<lexeme, array<position>>. Texts are split in the JVM; stemming needs Python and runs over
the distinct words of each Arrow batch, whose vectors are put together by sorting whole columns. Match and
rank are JVM expressions over vectors. Postings (id, lexeme, positions) are the same, one row a lexeme.
Known differences from a database's parser: hyphenated words, addresses and file-like tokens are
split at every character that is no letter or digit.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType

#: The customary English stop words of text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who "
    "whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more "
    "most other some such no nor not only own same so than too very s t can will just don should now"
).split()
_STOP = frozenset(STOP_WORDS)

WEIGHT = 0.1
#: Fixed value: the sum of 1/j^2 over all j, by which repeated occurrences are normed.
PI2_6 = 1.64493406685

_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl",
                   sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes")
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
          ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first non-vowel that follows a vowel, and again."""
    def after(start: int) -> int:
        m = re.search(r"[aeiouy][^aeiouy]", w[start:])
        return start + m.end() if m else len(w)

    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


@lru_cache(200_000)
def stem(word: str) -> str:
    """Porter2, the published English stemmer."""
    w = word
    if len(w) <= 2:
        return w
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = w.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    m = re.search(r"(eedly|ingly|edly|eed|ing|ed)$", w)
    if m and m.group() in ("eed", "eedly"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(r"[aeiouy]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    # 3
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


def tokens(text: str) -> list[tuple[str, int]]:
    """(lexeme, position) of a text; stop words count as positions, but are no lexemes."""
    words = re.findall(r"[^\W_]+", text.lower())
    return [(stem(x), i + 1) for i, x in enumerate(words) if x not in _STOP]


def _vectors(words: pa.Array) -> pa.Array:
    """The vectors of lists of words; null of null."""
    distinct = words.flatten().dictionary_encode()
    stems = [None if x in _STOP or not x else stem(x) for x in distinct.dictionary.to_pylist()]
    lexemes = sorted({x for x in stems if x is not None})
    number = {x: i for i, x in enumerate(lexemes)}
    code = np.array([number.get(x, -1) for x in stems], np.int64)[distinct.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
    lengths = np.array([0 if n is None else n for n in pa.compute.list_value_length(words).to_pylist()], np.int64)
    row = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    kept = code >= 0
    row, code, at = row[kept], code[kept], at[kept]
    order = np.lexsort((at, code, row))
    row, code, at = row[order], code[order], at[order]
    fresh = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])]) if len(row) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.r_[fresh, len(row)].astype(np.int32)), pa.array(at.astype(np.int32)))
    keys = pa.array([lexemes[c] for c in code[fresh]], pa.string())
    starts = np.searchsorted(row[fresh], np.arange(len(words) + 1)).astype(np.int32)
    held = pa.MapArray.from_arrays(pa.array(starts), keys, places)
    if words.null_count:
        held = pa.array([None if gone else x for gone, x in zip(words.is_null().to_pylist(), held.to_pylist())], held.type)
    return held


def words_of(text: Column) -> Column:
    """The words of a text in order, longest runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def to_vector(text: Column) -> Column:
    """The vector of a text; null of null."""
    return F.arrow_udf(_vectors, MapType(StringType(), ArrayType(IntegerType())))(words_of(text))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, lexeme, positions of df's texts; rows with equal key and text count once."""
    once = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("t is not null").distinct()
    return once.select("id", F.explode(to_vector(F.col("t"))).alias("lexeme", "positions"))


def vectors_from(posted: DataFrame, terms: list[str]) -> DataFrame:
    """id, search_vector of the texts that hold any of the terms, of which alone the vectors tell."""
    held = posted.where(F.col("lexeme").isin(terms)) if terms else posted.where(F.lit(False))
    return held.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("search_vector"))


def all_terms(query: str) -> list[str]:
    return list(dict.fromkeys(x for x, _ in tokens(query)))


def any_groups(query: str) -> list[list[str]]:
    """One group of terms that must all match for each word of the query that has any."""
    return [g for g in (all_terms(w) for w in query.split()) if g]


def matches_all(vector: Column, terms: list[str]) -> Column:
    """A query without lexemes matches nothing."""
    if not terms:
        return F.lit(False)
    held = F.lit(True)
    for t in terms:
        held = held & F.map_contains_key(vector, F.lit(t))
    return F.coalesce(held, F.lit(False))


def matches_any(vector: Column, groups: list[list[str]]) -> Column:
    held = F.lit(False)
    for g in groups:
        held = held | matches_all(vector, g)
    return held


def rank_any(vector: Column, terms: list[str]) -> Column:
    """Mean over the distinct terms of the weights of their occurrences, the j-th counting 1/j^2."""
    if not terms:
        return F.lit(0.0)
    total = F.lit(0.0)
    for t in terms:
        at = F.coalesce(vector[t], F.array().cast("array<int>"))
        parts = F.transform(at, lambda p, j: F.lit(WEIGHT) / F.pow((j + 1).cast("double"), F.lit(2.0)))
        total = total + F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / PI2_6
    return total / len(terms)


def rank_all(vector: Column, terms: list[str]) -> Column:
    """1 - product of (1 - closeness) over all pairs of positions of different terms."""
    if len(terms) < 2:
        return rank_any(vector, terms)
    left = F.lit(1.0)
    for i, a in enumerate(terms):
        for b in terms[:i]:
            pa, pb = (F.coalesce(vector[t], F.array().cast("array<int>")) for t in (a, b))
            pairs = F.flatten(F.transform(pa, lambda x: F.transform(pb, lambda y: F.abs(x - y))))
            near = lambda d: F.when(d > 100, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
            left = left * F.aggregate(pairs, F.lit(1.0), lambda s, d: s * (1 - F.sqrt(WEIGHT * WEIGHT * near(d))))
    return 1 - left
