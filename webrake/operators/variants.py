"""Records with union-typed fields: read as VARIANT, counted by kind, repaired.

``typed_records`` is one narrow projection (no shuffle); ``field_kinds`` is
one partial aggregation of (field, kind), so a field that every record holds
is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.functions import variants as V


def typed_records(df: DataFrame, record: str, spec: dict[str, str]) -> DataFrame:
    """``df`` without its VARIANT column ``record``, with one column per field
    of ``spec`` (name -> 'string', 'strings' or 'number'), and ``repairs``: a
    row ``{field, kind, lost}`` per field that was not of its type, in the
    order of ``spec``.  ``lost``: the field held something, but nothing that
    can be read as its type.  A missing or null field needs no repair: it is
    null, or the empty list.  Columns of ``df`` with such names are replaced."""
    fields, notes = [], []
    for name, want in spec.items():
        repair, fine = V.REPAIRS[want]
        x = V.field(record, name)
        value, kind = repair(x), V.kind(x)
        empty = F.size(value) == 0 if want == "strings" else value.isNull()
        fields.append(value.alias(name))
        notes.append(F.when(~kind.isin("missing", "null", *fine),
                            F.struct(F.lit(name).alias("field"), kind.alias("kind"), empty.alias("lost"))))
    taken = {n.lower() for n in (*spec, "repairs", record)}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep, *fields, F.array_compact(F.array(*notes)).alias("repairs"))


def field_kinds(df: DataFrame, record: str) -> DataFrame:
    """``field, kind, n``: in which kinds the fields of all objects come (a
    field that an object does not have is not counted)."""
    v = F.col(record)
    objects = df.where(V.kind(v) == "object").select(v.alias("rec"))
    pairs = objects.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("rec").outer()))
    return pairs.groupBy(F.col("key").alias("field"), V.kind("value").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
