"""Name similarity as column expressions; Jaro-Winkler as an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The letter groups of Soundex.
_SOUNDEX_FROM, _SOUNDEX_TO = "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000000"


def soundex(text: Column) -> Column:
    """Soundex whose vowels don't part equal codes; only A-Z count, none gives an empty code."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    codes = F.regexp_replace(F.replace(F.translate(letters, _SOUNDEX_FROM, _SOUNDEX_TO), F.lit("0"), F.lit("")), r"(.)\1+", "$1")
    first = F.translate(F.substring(letters, 1, 1), _SOUNDEX_FROM, _SOUNDEX_TO)
    rest = F.when(first == "0", codes).otherwise(F.substring(codes, 2, 9))
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), rest), 4, "0"))


def tokens(text: Column, separators: str = r"[-_.@/]") -> Column:
    return F.array_distinct(F.filter(F.split(text, separators), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values: both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def token_similarity(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def trigrams(text: Column) -> Column:
    """Distinct substrings of three characters; a shorter text is its own only one."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(F.length(text) < 3, F.array(text)).otherwise(F.array_distinct(cut))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance over the longer text's length in bytes."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def phonetic_similarity(a: Column, b: Column) -> Column:
    """1 for equal Soundex codes, else the share of words of ``a`` with an equal code in ``b`` by the longer word list."""
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    wa, wb = words(a), words(b)
    codes_b = F.transform(wb, soundex)
    hits = F.size(F.filter(F.transform(wa, soundex), lambda s: (s != "") & F.array_contains(codes_b, s)))
    parts = F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(hits / F.greatest(F.size(wa), F.size(wb)))
    return F.when((soundex(a) != "") & (soundex(a) == soundex(b)), 1.0).otherwise(parts)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, common = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                common.append(c)
                break
    if not common:
        return 0.0
    swaps = sum(x != y for x, y in zip(common, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    m = len(common)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    return jaro + 0.1 * prefix * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity (prefix scale 0.1 of at most 4, boost above 0.7); null if either text is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _jaro_winkler(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def inline_difference(a: Column, b: Column) -> Column:
    """STRUCT<prefix INT, suffix INT>: lengths of the common start, and of the common end of what is left."""
    common = lambda x, y, limit: F.size(F.filter(F.sequence(F.lit(0), limit), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i))) - 1
    prefix = common(a, b, F.least(F.length(a), F.length(b)))
    suffix = common(F.reverse(a), F.reverse(b), F.least(F.length(a), F.length(b)) - prefix)
    return F.struct(prefix.cast("int").alias("prefix"), suffix.cast("int").alias("suffix"))
