"""Randomised brute force for operators against plain-Python statements of
their rules (fixed seeds)."""

import random
from urllib.parse import quote

from pyspark.sql import functions as F

from webrake.functions import text as T
from webrake.functions import urls as U
from webrake.operators import nested as N


def test_first_per_category_random(spark):
    rnd = random.Random(3)
    words = ["li", "sc"]
    rows = []
    for e in range(60):
        for pos in rnd.sample(range(100), rnd.randint(1, 8)):
            rows.append((f"e{e}", pos, rnd.choice(["li", "sc", "lisc", "x", "scli", "y"]) + str(pos)))
    df = spark.createDataFrame(rows, "k string, pos long, url string")
    got = {r.k: (r.first_0, r.first_1) for r in N.first_per_category(df, "k", "pos", "url", words).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        found = {}
        for _k, _p, url in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if "li" in url and "li" not in found:
                found["li"] = url
            elif "sc" in url and "sc" not in found:
                found["sc"] = url
        want[k] = (found.get("li"), found.get("sc"))
    assert got == want


def _width(v, cap):
    s = ("None" if v is None else str(v)).strip()
    if not s:
        return 0
    return min(max(len(x) for x in s.splitlines()), cap)


def test_column_widths_random(spark):
    rnd = random.Random(4)
    alpha = ["a", "bb", " ", "\n", "ccc", "\r\n", "é"]
    rows = [tuple(None if rnd.random() < 0.1 else "".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 9)))
                  for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "c1 string, longer_name string, c3 string")
    got = {r.column: r.width for r in N.column_widths(df, cap=5).collect()}
    want = {c: max(max(_width(r[i], 5) for r in rows), len(c)) + 1 for i, c in enumerate(df.columns)}
    assert got == want


def test_percent_encode_random(spark):
    rnd = random.Random(6)
    alpha = list("aZ09 -_.~/*+%&=?#@:;,!'()[]") + ["é", "ß", "中", "Ω", " "]
    texts = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 10))) for _ in range(800)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", U.percent_encode("t").alias("e")).collect()
    bad = [(r.t, r.e, quote(r.t)) for r in out if r.e != quote(r.t)]
    assert not bad, bad[:5]


def test_screen_random(spark):
    rnd = random.Random(8)
    allow, deny = ["ab", "b"], ["a", "ca"]
    texts = sorted({"".join(rnd.choice("abcx ") for _ in range(rnd.randint(0, 6))) for _ in range(500)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", T.screen(F.col("t"), allow, deny).alias("s")).collect()

    def spec(t):
        for w in allow:
            if w in t:
                return True, w
        for w in deny:
            if w in t:
                return False, w
        return True, None

    bad = [(r.t, tuple(r.s), spec(r.t)) for r in out if tuple(r.s) != spec(r.t)]
    assert not bad, bad[:5]


def test_jsonl_blocks_random(spark):
    import json
    from webrake.operators.quarantine import explode_jsonl_block
    rnd = random.Random(10)
    pieces = ['{"k": 1}', '{"k": 2, "u": 3}', '{"u": 4}', '{bad', '{"k": 5},', '', ' ', '[1]', '{"k": 6} x']
    blocks = sorted({"\n".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 3))) for _ in range(400)})
    df = spark.createDataFrame(list(enumerate(blocks)), "id long, blk string")
    got = {}
    for r in explode_jsonl_block(df, ["id"], "blk", "k BIGINT, u BIGINT").collect():
        got.setdefault(r.id, []).append((r.status, r.line_no, r.k, r.u))

    def spec(b):
        if b.strip() == "":
            return [("empty", None, None, None)]
        try:
            recs = [json.loads(x) for x in b.strip().split("\n")]
        except ValueError:
            return [("bad", None, None, None)]
        return [("ok", i, r.get("k") if isinstance(r, dict) else None,
                 r.get("u") if isinstance(r, dict) else None) for i, r in enumerate(recs)]

    bad = [(b, sorted(got[i], key=str), spec(b)) for i, b in enumerate(blocks)
           if sorted(got[i], key=lambda x: (x[1] is None, x[1] or 0)) != spec(b)]
    assert not bad, bad[:3]


def test_dedupe_then_filter_random(spark):
    from webrake.operators import rank as R
    rnd = random.Random(12)
    rows = [(i, rnd.choice(["Ann", "ann", "Bob", "BOB", "cy", ""]), rnd.random() < 0.5) for i in range(300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "pos long, name string, ok boolean")
    got = sorted(r.pos for r in R.dedupe_then_filter(df, [F.lower("name")], ["pos"], F.col("ok")).collect())
    seen, want = set(), []
    for pos, name, ok in sorted(rows):
        if name.lower() in seen:
            continue
        seen.add(name.lower())
        if ok:
            want.append(pos)
    assert got == sorted(want)
