"""Dirty JSON fields read as VARIANT and repaired by their actual type.

A field of scraped records holds now a string, now a list, now nothing.  A
fixed schema turns all but one of these into null; a VARIANT keeps them, and
the functions here bring a field to one type without losing a value that can
be read as that type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrake.functions.common import ColumnOrName, as_col, strip_ws

#: Kinds of a field, by what the record holds.
KINDS = ("missing", "null", "string", "number", "boolean", "list", "object", "other")
_NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def field(v: ColumnOrName, name: str) -> Column:
    """The field ``name`` of an object (any name without a quote), a VARIANT; null where it is missing."""
    return F.try_variant_get(as_col(v), f"$['{name}']", "variant")


def kind(x: ColumnOrName) -> Column:
    """The kind (see ``KINDS``) of a VARIANT; ``missing`` for SQL null."""
    t = F.schema_of_variant(as_col(x))
    return F.when(as_col(x).isNull(), "missing").when(t == "VOID", "null").when(t == "STRING", "string") \
        .when(t == "BOOLEAN", "boolean").when(t.rlike(_NUMBERS), "number").when(t.startswith("ARRAY"), "list") \
        .when(t.startswith("OBJECT"), "object").otherwise("other")


def _filled(s: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(strip_ws(s), F.lit(""))


def _elements(x: Column) -> Column:
    return F.try_variant_get(x, "$", "array<string>")


def as_string(x: ColumnOrName) -> Column:
    """Text: a string stripped, a number or boolean as written, the first
    element of a list with text in it, an object as JSON; blank is null."""
    x = as_col(x)
    first = F.get(F.filter(F.transform(_elements(x), _filled), lambda e: e.isNotNull()), 0)
    return F.when(kind(x) == "list", first).otherwise(_filled(F.try_variant_get(x, "$", "string")))


def as_strings(x: ColumnOrName) -> Column:
    """List of texts: a list's elements without blanks and nulls, any other
    value as a list of one, missing and null as the empty list."""
    x = as_col(x)
    parts = F.when(kind(x) == "list", _elements(x)).when(x.isNotNull(), F.array(F.try_variant_get(x, "$", "string")))
    kept = F.filter(F.transform(parts, _filled), lambda e: e.isNotNull())
    return F.coalesce(kept, F.array().cast("array<string>"))


def as_number(x: ColumnOrName) -> Column:
    """Double: a number, or text that is one (``1,200`` and blanks around it
    included), or such an element at the head of a list; else null."""
    text = F.replace(as_string(x), F.lit(","), F.lit(""))
    return F.when(kind(x).isin("number", "string", "list"),
                  F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.cast("double")))


#: Type of a repaired field -> (function, the kinds that need no repair).
REPAIRS = {"string": (as_string, ("string",)), "strings": (as_strings, ("list",)), "number": (as_number, ("number",))}
