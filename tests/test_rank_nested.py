"""Ordered dedupe, slice, nested scores, widths, first-per-category and
partition/order invariance."""

import random

from pyspark.sql import functions as F

from webrake.functions import text as T
from webrake.operators import nested as N
from webrake.operators import rank as R


def test_dedupe_then_filter_hides_later_acceptable(spark):
    df = spark.createDataFrame([(0, "Ann", False), (1, "ann", True), (2, "Bob", True)],
                               "pos long, name string, ok boolean")
    out = R.dedupe_then_filter(df, [F.lower("name")], ["pos"], F.col("ok"))
    assert sorted(r.name for r in out.collect()) == ["Bob"]


def test_slice(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    assert [r.i for r in R.slice_rows(df, [F.col("i")], 3, 5).collect()] == [3, 4]
    assert R.slice_rows(df, [F.col("i")], 5, 3).count() == 0
    assert [r.i for r in R.slice_rows(df, [F.col("i")], 8, 0).collect()] == [8, 9]
    assert [r.i for r in R.slice_rows(df, [F.col("i")], 8, 0).collect()] == [8, 9]
    big = spark.range(1000).withColumnRenamed("id", "i")
    got = [r.i for r in R.slice_rows(big, [F.col("i").desc()], 990, 0).collect()]
    assert got == list(range(9, -1, -1))


def test_dedupe_unique_and_partition_invariant(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["a", "B", "b", "c", "A", ""]) , rnd.randint(0, 5)) for i in range(400)]
    rnd.shuffle(rows)
    df1 = spark.createDataFrame(rows, "pos long, k string, v long").repartition(1)
    df8 = spark.createDataFrame(rows, "pos long, k string, v long").repartition(8)
    o1 = {(r.k.lower(), r.pos) for r in R.dedupe_first_ci(df1, "k", ["pos"]).collect()}
    o8 = {(r.k.lower(), r.pos) for r in R.dedupe_first_ci(df8, "k", ["pos"]).collect()}
    assert o1 == o8
    keys = [k for k, _ in o1]
    assert len(keys) == len(set(keys))
    want = {}
    for pos, k, _ in sorted(rows):
        if k and k.lower() not in want:
            want[k.lower()] = pos
    assert o1 == set(want.items())


def test_topk_stable(spark):
    rows = [("e", i, s) for i, s in enumerate([5, 10, 10, 7, 10])]
    df = spark.createDataFrame(rows, "e string, pos long, s long")
    out = R.score_topk(df, ["e"], "s", "pos", k=3).orderBy("rank").collect()
    assert [r.pos for r in out] == [1, 2, 4]


def test_weighted_longest_score_is_13(spark):
    """Docs with 2 and 3 experiences and 1 and 0 publications; one flagged
    experience in the longer list: 10 + 1 + 1 + 1 = 13."""
    docs = spark.createDataFrame([
        ("p", 0, 2, 2, 1, 1), ("p", 1, 1, 3, 12, 0)],
        "entity_key string, doc_ord long, size long, n_exp long, exp_score long, n_pub long")
    docs = docs.withColumn("pub_score", F.col("n_pub"))
    e = N.longest_list(docs, ["entity_key"], "n_exp", [F.col("doc_ord")], ["exp_score"], "e_")
    p = N.longest_list(docs, ["entity_key"], "n_pub", [F.col("doc_ord")], ["pub_score"], "p_")
    r = e.join(p, "entity_key").first()
    assert r.e_exp_score + r.p_pub_score == 13
    arr = spark.createDataFrame([([(True,), (False,), (None,)],)], "a array<struct<f:boolean>>")
    assert arr.select(N.weighted_count("a", "f").alias("s")).first().s == 12


def test_column_widths(spark):
    df = spark.createDataFrame([("ab\nabcd", "x"), ("x", None)], "h string, longhead string")
    got = {r.column: r.width for r in N.column_widths(df, cap=3).collect()}
    assert got == {"h": 4, "longhead": 9}


def test_first_per_category(spark):
    rows = [("e", 0, "https://linkedin.com/a"), ("e", 1, "https://linkedin.com/b"),
            ("e", 2, "https://scholar.google.com/c"), ("f", 0, "https://linkedin.com/scholar.google")]
    df = spark.createDataFrame(rows, "k string, pos long, url string")
    got = {r.k: (r.first_0, r.first_1) for r in
           N.first_per_category(df, "k", "pos", "url", ["linkedin", "scholar.google"]).collect()}
    assert got["e"] == ("https://linkedin.com/a", "https://scholar.google.com/c")
    assert got["f"] == ("https://linkedin.com/scholar.google", None)


def test_class_filter_in_dedupe(spark):
    df = spark.createDataFrame([(0, "x y", "Undergraduate"), (1, "z", "")], "pos long, name string, title string")
    keep = (F.col("title") == "") | T.is_graduate("title")
    assert [r.name for r in R.dedupe_then_filter(df, ["name"], ["pos"], keep).collect()] == ["z"]
