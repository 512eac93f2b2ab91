"""Record parsing: fenced blocks, strict JSON / JSON-lines, citations,
null-entry dropping and list-or-scalar normalisation.

Everything is native (``from_json``, ``parse_json``).  Spark's JSON reader
accepts trailing text (``{"a":1},``, ``{"a":1} xx``), single quotes and an
empty string, while a model answer must be rejected when any line is not
strict JSON: :func:`strict_json` tests that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrake.functions.common import ColumnOrName, as_col, lines, strip_ws

FENCE_END = "```"


def _quote_re(s: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in s)


def fenced_blocks(md: ColumnOrName, start: str, end: str = FENCE_END) -> Column:
    """All non-overlapping blocks between literal ``start`` and ``end``, in
    order; an unterminated last block is ignored."""
    pat = "(?s)" + _quote_re(start) + "(.*?)" + _quote_re(end)
    return F.regexp_extract_all(as_col(md), F.lit(pat), 1)


def fenced_first(md: ColumnOrName, start: str, end: str = FENCE_END,
                 strip: bool = True) -> Column:
    """First block (stripped), null when there is none."""
    b = F.get(fenced_blocks(md, start, end), 0)
    return strip_ws(b) if strip else b


def strict_json(text: ColumnOrName) -> Column:
    """Whether the whole text is exactly one JSON value (white space around
    it is fine); null for null.

    Spark's parser stops after the first value, so the text is parsed inside
    a list, which must then have one element, and inside an object, which
    fails for text that closes the list itself.  Stricter than many parsers
    in two points: a repeated key in one object and ``NaN``/``Infinity`` are
    not valid."""
    t = as_col(text)
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$", "array<variant>")
    boxed = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
    return F.when(t.isNotNull(), F.coalesce(F.size(listed) == 1, F.lit(False)) & boxed.isNotNull())


def strict_jsonl(block: ColumnOrName) -> Column:
    """Whether every line of the stripped block is strict JSON (a blank line
    or a trailing comma fails the whole block); null for null."""
    return F.forall(jsonl_lines(block), strict_json)


def jsonl_lines(block: ColumnOrName) -> Column:
    """Lines of a stripped JSON-lines block."""
    return F.split(strip_ws(block), "\n")


def parse_jsonl_block(block: ColumnOrName, schema: str) -> Column:
    """array<struct> of the block's records, null when any line is not
    strict JSON; an empty block gives an empty array (not an error)."""
    b = as_col(block)
    recs = F.transform(jsonl_lines(b), lambda x: F.from_json(x, schema))
    empty = F.filter(recs, lambda r: F.lit(False))
    return (F.when(b.isNull(), F.lit(None))
            .when(strip_ws(b) == "", empty)
            .when(strict_jsonl(b), recs))


def parse_json_record(text: ColumnOrName, schema: str) -> Column:
    """struct parsed from strict JSON text, null when not strict JSON."""
    t = as_col(text)
    return F.when(strict_json(t), F.from_json(t, schema))


# ---------------------------------------------------------------- citations
# EndNote tag -> field (``A`` repeats and is a list; ``T`` and
# ``A`` values are stripped; other fields keep their text, last one wins).
ENDNOTE_FIELDS = {"0": "type", "T": "title", "A": "authors", "J": "journal", "V": "volume",
                  "N": "number", "P": "pages", "D": "year", "I": "publisher"}


_WS = r"[ \t\f\x0B]*"   # what a strip removes inside one line


def _endnote_text(text: ColumnOrName) -> Column:
    """Line breaks normalised to ``\n`` (``\r\n`` and ``\r`` too)."""
    return F.replace(F.replace(as_col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _tag_values(text: Column, tag: str, strip: bool) -> Column:
    # (?m) line anchors, (?d) only \n ends a line: one match per tagged line
    body = f"{_WS}(.*?){_WS}" if strip else "(.*)"
    return F.regexp_extract_all(text, F.lit(f"(?md)^%{_quote_re(tag)} {body}$"), 1)


def parse_endnote(text: ColumnOrName) -> Column:
    """struct<type, title, authors array<string>, journal, volume, number,
    pages, year, publisher> from EndNote text: ``%X value`` lines, ``A``
    repeats and collects, ``T`` and ``A`` values are stripped, other known
    tags keep the last value; unknown tags are ignored.  A ``%`` line with
    no space is malformed and the whole result is null.  Regular
    expressions only (code-generated), no per-line lambdas."""
    t = _endnote_text(text)
    fields = []
    for tag, name in ENDNOTE_FIELDS.items():
        vals = _tag_values(t, tag, strip=tag in ("T", "A"))
        col = vals if tag == "A" else F.when(F.size(vals) > 0, F.element_at(vals, -1))
        fields.append(col.alias(name))
    malformed = t.rlike(r"(?md)^%[^ \n]*$")
    return F.when(~malformed, F.struct(*fields))


def with_endnote(df, text_col: str, out_col: str = "citation"):
    """Add the parsed citation as ``out_col``."""
    return df.withColumn(out_col, parse_endnote(text_col))


# ---------------------------------------------------------------- maps, variants
def drop_null_entries(m: ColumnOrName) -> Column:
    return F.map_filter(as_col(m), lambda k, v: v.isNotNull())


def scalar_or_first(json_text: ColumnOrName, path: str) -> Column:
    """String at ``path``; when that value is a list, its first element."""
    v = F.try_parse_json(as_col(json_text))
    return F.coalesce(F.try_variant_get(v, f"{path}[0]", "string"),
                      F.try_variant_get(v, path, "string"))
