"""Unicode text: normal form, cleaning, headings, words. White space is what Python's str.split takes for it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_FIRST_LINE = re.compile("[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*")
WS_CHARACTERS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: What cleaning takes for a space, beside U+0020.
SPACES = "".join(map(chr, (0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
#: Characters that cleaning removes; U+200C and U+200D stay, spelling needs them (fixed values).
REMOVED = "\ufeff\u200b\u2060\u00ad\u180e\ufffd"


@F.pandas_udf(StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))


def nfc(column: Column) -> Column:
    """Unicode NFC; null becomes empty. Spark has no built-in for it."""
    return _nfc(F.coalesce(column, F.lit("")))


def strip(column: Column) -> Column:
    """Without white space at both ends; Spark's trim takes U+0020 only, unless told the characters."""
    return F.btrim(column, F.lit(WS_CHARACTERS))


def _spaced(text: Column, spaces: str, removed: str = "") -> Column:
    """With one plain space for each run of ``spaces`` and plain ones, and without ``removed``.

    Characters are looked up first, so that the pattern is of plain spaces alone: one of many characters is tried slowly at every place."""
    return F.regexp_replace(F.translate(text, spaces + removed, " " * len(spaces)), "\\x20{2,}", " ")


def clean(column: Column) -> Column:
    """NFC, one kind of line break, no invisible characters, single spaces, at most one blank line, stripped.

    Each step names the one before once, so nothing is evaluated twice."""
    text = F.replace(F.replace(nfc(column), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = _spaced(text, SPACES, REMOVED)
    # Runs of spaces are single by now.
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return strip(F.regexp_replace(text, "\\n{3,}", "\n\n"))


def _same(line: str) -> str:
    return unicodedata.normalize("NFC", line).strip()


def without_headings(text: str, headings: Sequence[str | None]) -> str:
    """Without the first line where that only repeats a heading, for each heading in turn; the rest is stripped."""
    for heading in headings:
        first = _FIRST_LINE.match(text)[0]
        if text and heading and _same(first) == _same(heading):
            text = "\n".join(text[len(first) :].splitlines()).strip()
    return text


@F.pandas_udf(StringType())
def _strip_headings(texts: pd.Series, headings: pd.Series) -> pd.Series:
    return pd.Series([without_headings(t, h) for t, h in zip(texts, headings, strict=True)], dtype=object)


def strip_headings(text: Column, *headings: Column) -> Column:
    """``without_headings`` as a column. Spark would copy the text's expression into each place that names it, so it is one function."""
    return _strip_headings(F.coalesce(text, F.lit("")), F.array(*headings))


def single_spaced(column: Column) -> Column:
    """The words with one plain space between two of them."""
    return _spaced(strip(F.coalesce(column, F.lit(""))), WS_CHARACTERS)


def words_of(spaced: Column) -> Column:
    """The words of a text that is ``single_spaced``; Java splits at one character without a pattern."""
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def words(column: Column) -> Column:
    return words_of(single_spaced(column))


def or_default(column: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(default))


def with_prefix(column: Column, prefix: str) -> Column:
    """Stripped, with the model's prefix unless it already begins with either."""
    bare = strip(F.coalesce(column, F.lit("")))
    return F.when(bare.startswith("query:") | bare.startswith("passage:"), bare).otherwise(F.concat(F.lit(prefix), bare))
