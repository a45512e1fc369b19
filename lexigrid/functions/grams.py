"""N-grams as array-valued column expressions. They never cross documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions.text import letters


def grams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of n tokens, joined by ``sep``; fewer than n tokens give none.

    The tokens are bound to a lambda's variable, because what a lambda takes
    from outside is computed again for each of its elements."""

    def runs(t: Column) -> Column:
        firsts = F.slice(t, 1, F.greatest(F.size(t) - (n - 1), F.lit(0)))
        return F.transform(firsts, lambda w, i: F.concat(w, *[x for k in range(1, n) for x in (*[F.lit(sep)] * bool(sep), t[i + k])]))

    return F.coalesce(F.get(F.transform(F.array(tokens), runs), F.lit(0)), F.array().cast("array<string>"))


def word_grams(normalized: Column, n: int) -> Column:
    """Word n-grams of a normalized text by one regex scan with lookahead."""
    single = F.regexp_replace(normalized, " +", " ")
    return F.regexp_extract_all(single, F.lit(r"\b(?=([a-z]+" + " [a-z]+" * (n - 1) + "))"), 1)


def char_grams(normalized: Column, n: int) -> Column:
    """Character n-grams in compact form (``the``), by one regex scan."""
    return F.regexp_extract_all(letters(normalized), F.lit("(?=(" + "." * n + "))"), 1)


def spaced(compact: Column) -> Column:
    """``the`` -> ``t h e``; meant for the few rows left after counting."""
    return F.rtrim(F.regexp_replace(compact, "(.)", "$1 "))
