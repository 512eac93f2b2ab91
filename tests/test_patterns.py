"""Screening by rule tables; resumed requests; table cells."""

import random

import pytest
from pyspark.sql import functions as F

from webrake.functions import text as T
from webrake.operators import htmlclean as HC
from webrake.operators import patterns as PT
from webrake.plans import extract as X
from webrake.sources import keystore as KS

RULES = "word string, accept boolean, pos long"


@pytest.mark.parametrize("limit", [200_000, 3])
def test_screen_table_equals_screen(spark, limit):
    """Broadcast and joined: the same as the CASE chain, for short, empty,
    nested and repeated patterns, and texts of any kind."""
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abé🙂 \n.") for _ in range(n))
    allow, deny = [[word(rng.choice([1, 2, 3, 3, 4, 6, 9])) for _ in range(40)] for _ in range(2)]
    texts = [(i, word(rng.choice([0, 1, 2, 3, 5, 12, 40]))) for i in range(400)] + [(900, None), (901, ""), (None, "abab")]
    rules = [(w, True, i) for i, w in enumerate(allow)] + [(w, False, i) for i, w in enumerate(deny)] + [(None, True, 0)]
    for drop_short in (False, True):
        used = [r for r in rules if r[0] is None or not drop_short or len(r[0]) > 3]
        df = spark.createDataFrame(texts, "id long, t string").repartition(3)
        got = {r.id: (r.accept, r.rule) for r in
               PT.screen_table(df, "id", "t", spark.createDataFrame(used, RULES), limit).collect()}
        chain = T.screen("t", [w for w, ok, _ in used if w and ok], [w for w, ok, _ in used if w and not ok])
        want = {r.id: (r.s.accept, r.s.rule) for r in df.select("id", chain.alias("s")).collect()}
        assert got == want and len(set(want.values())) > 3


def test_screen_table_edges(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, t string")
    none = spark.createDataFrame([], RULES)
    assert [(r.accept, r.rule) for r in PT.screen_table(df, "id", "t", none).collect()] == [(True, None)] * 2
    every = spark.createDataFrame([("", False, 1), ("x", False, 0)], RULES)     # the empty word is in every text
    assert {r.id: (r.accept, r.rule) for r in PT.screen_table(df, "id", "t", every).collect()} == {1: (False, "x"), 2: (False, "")}


def test_large_list_is_one_pass(spark):
    rules = spark.range(100_000).select(F.concat(F.lit("pattern "), F.col("id").cast("string"), F.lit(".")).alias("word"),
                                        (F.col("id") % 2 == 0).alias("accept"), F.col("id").alias("pos"))
    df = spark.createDataFrame([(1, "has pattern 77777. in it"), (2, "pattern 5"), (3, "pattern 9. pattern 8. pattern 4.")],
                               "id long, t string")
    got = {r.id: (r.accept, r.rule) for r in PT.screen_table(df, "id", "t", rules).collect()}
    assert got == {1: (False, "pattern 77777."), 2: (True, None), 3: (True, "pattern 4.")}


def test_answered_pages_are_not_requested_again(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p>a"), (2, "<p>b"), (None, "<p>c")], "page_id long, html string")
    done = spark.createDataFrame([(2,), (None,)], "page_id long")
    assert [r.page_id for r in X.extract_requests(pages, ["page_id"], "t", answered=done).collect()] == [1]
    KS.write_keyed(done, f"{tmp_path}/answers", ["page_id"], buckets=4)
    left = X.extract_requests(pages, ["page_id"], "t", answered=f"{tmp_path}/answers").collect()
    assert [(r.page_id, "a" in r.messages[1].content) for r in left] == [(1, True)]


def test_table_cells_are_apart():
    md = HC.clean_and_convert("<table><tr><th>a</th><th>b<tr><td>1<b>2</b></td><td></td><td>3</td></tr></table>")[1]
    assert [" ".join(ln.split()) for ln in md.splitlines() if ln.strip()] == ["a | b", "12 | | 3"]
