"""Fill-in-middle transformation by one repeated capture.

A text is cut into units (a run of ASCII letters, or any other code point) by
one ``fullmatch`` of ``(unit)*`` with the regex library, which keeps every
repetition of a group: the ends of the capture are the number of units and, by
two look-ups, both cut offsets.  The draws (cuts, form) come from the document
id's SHA-256, so reruns and any split of the input agree.  Only three numbers
per row leave the Python worker; parts are cut and put together by column
functions, and :func:`restore` is made of column functions alone.

The match takes one piece of a very long text at a time (pieces end behind
code points that are no letters, where a unit always ends), so what a row needs
beside its text is four bytes per unit.

Nothing is shuffled.  Defined results: a null text is an empty one; an empty
text, and one that holds a marker, stays plain; a null id draws as an empty
one; rows of one id have the same draws, repeated rows each keep their row; an
empty table gives an empty result; extra columns are kept, but for those named
like an added one, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import free_name, python_ready

UNIT = r"[A-Za-z]++|[^A-Za-z]"
#: Code points matched at a time.
PIECE = 1 << 20
_ALL = regex.compile(f"({UNIT})*+")
_BORDER = regex.compile(r"(?<=[^A-Za-z])")


@dataclass(frozen=True)
class Markers:
    """The strings before prefix, suffix and middle."""
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = self.every()
        for a in every:
            if not a or any(a in b for b in every if b is not a) or \
                    any(a[-k:] == b[:k] for b in every for k in range(1, len(a))):
                raise ValueError("markers must neither hold nor overlap one another")

    def every(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_ends(text: str) -> np.ndarray:
    """Offset behind each unit of ``text``."""
    if len(text) <= PIECE:
        return np.array(_ALL.fullmatch(text).ends(1), np.int32)
    ends, lo = [], 0
    while lo < len(text):
        border = _BORDER.search(text, min(lo + PIECE, len(text)))
        hi = border.start() if border else len(text)
        ends.append(np.array(_ALL.fullmatch(text, lo, hi).ends(1), np.int32))
        lo = hi
    return np.concatenate(ends)


def _cuts(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """``n`` and the code points before the smaller and the larger cut."""
    rows = []
    for t, a, b in zip(texts, one.to_pylist(), two.to_pylist()):
        ends = unit_ends(t.as_py() or "")
        n = len(ends)
        rows.append((n, *(int(ends[k - 1]) if k else 0 for k in sorted((a % (n + 1), b % (n + 1))))))
    n, lo, hi = zip(*rows) if rows else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, lo, hi)], ["n", "lo", "hi"])


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20,
                   markers: Markers = Markers(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``,
    ``middle_chars`` (null if plain) and ``output``.

    ``percent`` of the documents are transformed, ``spm_percent`` of those with
    the suffix first."""
    python_ready(docs)
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    out = [c for c in docs.columns if c not in added]
    digest, cut_col = free_name(docs, "_digest"), free_name(docs, "_cut")
    draw = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut_at = F.arrow_udf(_cuts, "n bigint, lo bigint, hi bigint")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    cut = docs.withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)) \
        .withColumn(cut_col, cut_at(text, draw[0], draw[1]))
    held = F.lit(False)
    for m in markers.every():
        held = held | F.contains(text, F.lit(m))
    form = F.when((text == "") | held | (draw[2] % 100 >= percent), "plain") \
        .when(draw[3] % 100 < spm_percent, "spm").otherwise("psm")
    lo, hi = F.col(cut_col)["lo"], F.col(cut_col)["hi"]
    prefix, middle = F.substr(text, F.lit(1), lo), F.substr(text, lo + 1, hi - lo)
    suffix = F.substr(text, hi + 1)
    p, s, m = (F.lit(x) for x in markers.every())
    made = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)) \
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).withColumn("output", made) \
        .select(*out, F.col(cut_col)["n"].alias("n"), "form", F.when(moved, lo).alias("prefix_chars"),
                F.when(moved, hi - lo).alias("middle_chars"), "output")


def _between(text: Column, first: str, second: str, third: str) -> tuple[Column, Column, Column]:
    """The parts behind three markers that stand in this order."""
    one = F.substr(text, F.lit(len(first) + 1))
    a = F.substring_index(one, second, 1)
    rest = F.substr(one, F.length(a) + len(second) + 1)
    b = F.substring_index(rest, third, 1)
    return a, b, F.substr(rest, F.length(b) + len(third) + 1)


def restore(form: Column, output: Column, markers: Markers = Markers()) -> Column:
    """The exact text from a row's form and output.  A transformed text holds
    no marker, and markers do not overlap, so the first of each is the one."""
    p, s, m = markers.every()
    prefix, suffix, middle = _between(output, p, s, m)
    suffix2, prefix2, middle2 = _between(output, s, p, m)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)) \
        .when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
