"""Dirty JSON fields: VARIANT reads, kinds and repairs against plain Python."""

import json
import random

from pyspark.sql import functions as F

from webrake.functions import variants as V
from webrake.operators.variants import field_kinds, typed_records
from webrake.plans import profiles as PF
from webrake.sources import readers as RD


def kind(x):
    return ("null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float))
            else "string" if isinstance(x, str) else "list" if isinstance(x, list) else "object")


def filled(x):
    if x is None:
        return None
    s = x.strip() if isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    return s or None


def string(x):
    return next((s for s in map(filled, x) if s), None) if isinstance(x, list) else filled(x)


def strings(x):
    return [s for s in map(filled, x if isinstance(x, list) else [x]) if s]


def number(x):
    try:
        return None if kind(x) in ("boolean", "object", "null") else float(string(x).replace(",", ""))
    except (AttributeError, ValueError):
        return None


def values(rng, n):
    leaf = lambda: rng.choice(["a", " b ", "", " ", "1,200", " 7 ", "-3.5e2", "x1", None, 4, 2.5, True, "é\n"])
    for _ in range(n):
        yield rng.choice([leaf, leaf, lambda: [leaf() for _ in range(rng.randrange(4))], lambda: {"k": leaf()}, lambda: [["q"], {"z": 1}]])()


def test_repairs_against_python(spark, tmp_path):
    rng, rows = random.Random(3), []
    for i, x in enumerate(values(rng, 400)):
        rows.append({"i": i, "odd name.x": x} if i % 9 else {"i": i})
    lines = [json.dumps(r, ensure_ascii=False) for r in rows] + ['{"i": 9', '[1, 2]', '"x"', "", '{"a": 1, "a": 2}']
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(str(tmp_path / "in"))
    good, bad = RD.read_variant_jsonl(spark, str(tmp_path / "in"), to=str(tmp_path / "out"))
    assert sorted((r.reason, r.line) for r in bad.collect()) == [
        ("shape", '"x"'), ("shape", "[1,2]"), ("syntax", '{"a": 1, "a": 2}'), ("syntax", '{"i": 9')]
    x = V.field("record", "odd name.x")
    got = good.select(V.as_number(V.field("record", "i")).cast("int").alias("i"), V.kind(x).alias("kind"), V.as_string(x).alias("s"),
                      V.as_strings(x).alias("ss"), V.as_number(x).alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        held = rows[r.i].get("odd name.x")
        assert (r.s, r.ss, r.n) == (string(held), strings(held), number(held)), (held, r)
        assert r.kind == (kind(held) if "odd name.x" in rows[r.i] else "missing")
    want = {}
    for r in rows:
        for f, v in r.items():
            want[f, kind(v)] = want.get((f, kind(v)), 0) + 1
    assert {(r.field, r.kind): r.n for r in field_kinds(good, "record").collect()} == want


def test_typed_records_notes_and_clashing_names(spark):
    df = spark.sql("""SELECT 1 AS id, 'old' AS name, 'old' AS Repairs, parse_json('{"name": ["x"], "n": "none", "tags": null}') AS record
                      UNION ALL SELECT 2, 'old', 'old', parse_json('{"name": "y", "n": 2, "tags": [" ", 3]}')
                      UNION ALL SELECT 3, 'old', 'old', NULL""")
    got = {r.id: r for r in typed_records(df, "record", {"name": "string", "n": "number", "tags": "strings"}).collect()}
    assert got[1].asDict(True) == {"id": 1, "name": "x", "n": None, "tags": [], "repairs": [
        {"field": "name", "kind": "list", "lost": False}, {"field": "n", "kind": "string", "lost": True}]}
    assert got[2].asDict(True) == {"id": 2, "name": "y", "n": 2.0, "tags": ["3"], "repairs": []}
    assert got[3].asDict(True) == {"id": 3, "name": None, "n": None, "tags": [], "repairs": []}
    assert typed_records(df.where("id > 9"), "record", {"name": "string"}).count() == 0
    assert field_kinds(df.where("id > 9"), "record").count() == 0


def test_long_texts_and_empty_folder(spark, tmp_path):
    long = "w " * 500_000
    spark.createDataFrame([(json.dumps({"name": [None, long]}),)], "value string").write.text(str(tmp_path / "in"))
    good, bad = RD.read_variant_jsonl(spark, str(tmp_path / "in"), to=str(tmp_path / "out"))
    assert good.select(F.length(V.as_string(V.field("record", "name"))).alias("n")).first().n == len(long) - 1
    assert bad.count() == 0
    spark.createDataFrame([], "value string").write.text(str(tmp_path / "none"))
    good, bad = RD.read_variant_jsonl(spark, str(tmp_path / "none"), to=str(tmp_path / "none-out"))
    assert good.count() == bad.count() == 0


def test_stored_profiles(spark, tmp_path):
    lines = ['{"uid": 1, "name": ["", "A"], "co_authors": {"name": ["B", "x"], "url": "u"}}',
             '{"uid": "2", "name": 7, "co_authors": [{"name": "C"}, {"url": "v"}]}', '{"uid": 3, "co_authors": "D"}', "{"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "in"))
    profiles, bad = PF.stored_profiles(spark, str(tmp_path / "in"), {"uid": "number", "name": "string"})
    got = {int(r.uid): (r.name, [tuple(c) for c in r.c]) for r in
           profiles.select("uid", "name", PF.first_names("co_authors_json").alias("c")).collect()}
    assert got == {1: ("A", [("B", "u")]), 2: ("7", [("C", None), (None, "v")]), 3: (None, [])}
    assert [(r.reason, r.line) for r in bad.collect()] == [("syntax", "{")]
