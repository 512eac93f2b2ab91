"""Small shared helpers for Column builders."""

from __future__ import annotations

from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Union[Column, str]

# Fixed value: whitespace class shared by Java regex and RE2.
WS = r"[ \t\n\r\f]"


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: ColumnOrName) -> Column:
    """Trim ASCII whitespace at both ends (SQL ``trim`` strips spaces only);
    ``trim`` with a character set only looks at the ends of the text."""
    return F.trim(as_col(c), F.lit(" \t\n\r\f\x0b"))


def lines(c: ColumnOrName) -> Column:
    """Split into lines like ``str.splitlines`` for ``\n``, ``\r\n`` and
    ``\r`` breaks: a trailing empty element is dropped.  Breaks are
    normalised with literal replaces and split on one character (no regular
    expression over the whole text)."""
    norm = F.replace(F.replace(as_col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    parts = F.split(norm, "\n")
    return F.when(F.element_at(parts, -1) == "",
                  F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def tokens(c: ColumnOrName) -> Column:
    """Whitespace tokens like ``str.split()``: no empty tokens.  After the
    trim no run of whitespace is left at either end, so splitting on runs
    yields no empty token (only the empty text needs a case); no lambda, so
    the expression is code-generated."""
    t = strip_ws(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(
        F.split(t, r"[ \t\n\r\f\x0B]+"))


def empty_to_null(c: ColumnOrName) -> Column:
    return F.nullif(as_col(c), F.lit(""))
