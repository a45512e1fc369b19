"""Column expressions for boilerplate removal, normalization and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters that fold to an ASCII letter.
ACCENTS = {
    "a": "ÀÁÂÃÄÅàáâãäå",
    "e": "ÈÉÊËèéêë",
    "i": "ÌÍÎÏìíîï",
    "o": "ÒÓÔÕÖòóôõö",
    "u": "ÙÚÛÜùúûü",
    "n": "Ññ",
    "c": "Çç",
}
FOLD_FROM = "".join(ACCENTS.values())
FOLD_TO = "".join(k * len(v) for k, v in ACCENTS.items())

# The publisher's markers.
START_MARK = "*** START OF"
END_MARK = "*** END OF"
CLOSE_MARK = "***"

#: Whitespace that becomes a space in either mode; other controls vanish.
BLANKS = " \t\n\r"


def table(punct: str) -> tuple[str, str]:
    """From and to, for one translate(): accents fold, capitals fall, blanks
    (and punctuation) become spaces; what is left of ASCII has no partner in
    ``to``, so it vanishes."""
    upper = "".join(map(chr, range(65, 91)))
    ascii_ = [chr(i) for i in range(128)]
    marks = "".join(c for c in ascii_ if c.isprintable() and not c.isalnum() and c not in BLANKS) if punct == "space" else ""
    gone = "".join(c for c in ascii_ if not c.isalpha() and c not in BLANKS and c not in marks)
    spaced = marks + BLANKS[1:]
    return FOLD_FROM + upper + spaced + gone, FOLD_TO + upper.lower() + " " * len(spaced)


def clean(text: Column) -> Column:
    """Cut the text to what stands between the first START marker's line and
    the first END marker after it. A marker that is not closed changes nothing."""
    mark = F.locate(START_MARK, text)
    close = F.call_function("locate", F.lit(CLOSE_MARK), text, mark + len(START_MARK))
    start = F.when((mark > 0) & (close > 0), close + len(CLOSE_MARK)).otherwise(1)
    end = F.call_function("locate", F.lit(END_MARK), text, start)
    return F.substring(text, start, F.when(end > 0, end - start).otherwise(F.length(text)))


def normalize(text: Column, punct: str = "space") -> Column:
    """Fold accents, delete digits, controls and other non-ASCII characters,
    turn punctuation into spaces (``punct='space'``) or delete it
    (``punct='drop'``), lower-case. One pass over the characters does all of
    it; only texts with other non-ASCII characters are searched for these."""
    if punct not in ("space", "drop"):
        raise ValueError(f"punct must be 'space' or 'drop', not {punct!r}")
    plain = F.translate(text, *table(punct))
    return F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(F.regexp_replace(plain, "[^\\x00-\\x7F]+", ""))


def words(normalized: Column) -> Column:
    """The words of a normalized text, in order."""
    return F.filter(F.split(normalized, " +"), lambda w: w != "")


def letters(normalized: Column) -> Column:
    """The letters of a normalized text as one string without spaces."""
    return F.replace(normalized, F.lit(" "), F.lit(""))


def chars(normalized: Column) -> Column:
    """The letters of a normalized text, in order, across word boundaries."""
    return F.array_remove(F.split(letters(normalized), ""), "")


def char_class(ch: Column) -> Column:
    """Class of one character: alpha, space, punct, digit or other."""
    return (
        F.when(ch.rlike(r"^[A-Za-z]$"), "alpha")
        .when(ch.rlike(r"^[ \t\n\r]$"), "space")
        .when(ch.rlike(r"^[0-9]$"), "digit")
        .when(ch.rlike(r"^[!-/:-@\[-`{-~]$"), "punct")
        .otherwise("other")
    )
