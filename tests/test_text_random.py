"""Randomised brute force for the text primitives and parsers against
plain-Python statements of the same rules (fixed seeds)."""

import random

from webrake.functions import records as RC
from webrake.functions.common import lines, strip_ws, tokens

ALPHA = ["a", "b", " ", "\t", "\n", "\r", "\r\n", "x y", "%", "`", "é"]


def _rand_text(rnd, n=12):
    return "".join(rnd.choice(ALPHA) for _ in range(rnd.randint(0, n)))


def test_lines_tokens_strip(spark):
    rnd = random.Random(5)
    texts = sorted({_rand_text(rnd) for _ in range(1500)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", lines("t").alias("l"), tokens("t").alias("k"), strip_ws("t").alias("s")).collect()
    bad = [(r.t, r.l) for r in out if r.l != r.t.splitlines()]
    bad += [(r.t, r.k) for r in out if r.k != r.t.split()]
    bad += [(r.t, r.s) for r in out if r.s != r.t.strip()]
    assert not bad, bad[:5]


def _blocks(md, start, end):
    out, rest = [], md
    while True:
        i = rest.find(start)
        if i < 0:
            return out
        rest = rest[i + len(start):]
        j = rest.find(end)
        if j < 0:
            return out
        out.append(rest[:j])
        rest = rest[j + len(end):]


def test_fenced_blocks(spark):
    rnd = random.Random(9)
    parts = ["```json", "```", "{}", "a", "\n", " ", "``", "json"]
    texts = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(0, 10))) for _ in range(1500)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", RC.fenced_blocks("t", "```json").alias("b")).collect()
    bad = [(r.t, r.b, _blocks(r.t, "```json", "```")) for r in out if r.b != _blocks(r.t, "```json", "```")]
    assert not bad, bad[:5]


FIELDS = {"0": "type", "T": "title", "J": "journal", "V": "volume", "N": "number",
          "P": "pages", "D": "year", "I": "publisher"}


def _endnote(text):
    rec = {"authors": []}
    for line in text.splitlines():
        if not line.startswith("%"):
            continue
        body = line[1:]
        if " " not in body:
            return None
        tag, value = body.split(" ", 1)
        if tag == "A":
            rec["authors"].append(value.strip())
        elif tag in FIELDS:
            rec[FIELDS[tag]] = value.strip() if tag == "T" else value
    return rec


def test_endnote_random(spark):
    rnd = random.Random(13)
    tags = ["%0", "%T", "%A", "%V", "%J", "%@", "%K", "%", "zz", "%A ", "%TX"]
    vals = ["", " v", "  w  ", " 12", "\tx", " a b "]
    texts = set()
    for _ in range(1200):
        n = rnd.randint(0, 6)
        texts.add(rnd.choice(["\n", "\r\n"]).join(rnd.choice(tags) + rnd.choice(vals) for _ in range(n)))
    texts = sorted(texts)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", RC.parse_endnote("t").alias("c")).collect()
    bad = []
    for r in out:
        want = _endnote(r.t)
        if want is None:
            if r.c is not None:
                bad.append((r.t, r.c, None))
            continue
        got = r.c.asDict() if r.c is not None else None
        exp = {"authors": want["authors"], **{f: want.get(f) for f in FIELDS.values()}}
        if got != exp:
            bad.append((r.t, got, exp))
    assert not bad, bad[:3]
