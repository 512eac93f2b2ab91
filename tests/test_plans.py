"""Physical-plan shape: the scale properties the operators rely on, checked
on the plans Spark actually builds, plus results on a skewed fixture."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from webrake.operators import nested as N
from webrake.operators import rank as R

SF = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_has_partial_limit_before_exchange(spark):
    plan = _plan(E.queries()["p_fetch_plan"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    # the partial limit sits below (before) the exchange
    assert plan.rfind("Partial") > plan.find("Exchange hashpartitioning")


def test_dedupe_is_partial_aggregation(spark):
    plan = _plan(E.queries()["dedupe_url_key"](spark, SF))
    assert "partial_min" in plan
    assert "Window" not in plan


def test_deny_filter_reaches_scan_and_html_is_pruned(spark):
    from webrake.functions import text as T
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    df = pages.where(T.keep_url("url", [".html", "spam"])).select("page_id", "url")
    plan = _plan(df)
    assert "PushedFilters: [Or(IsNull(url)" in plan
    assert "html" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_offset_slice_never_single_partition(spark):
    plan = _plan(E.queries()["slice_offset"](spark, SF))
    assert "CollectLimit" not in plan and "SinglePartition" not in plan
    assert "TakeOrderedAndProject" not in plan


def test_student_scores_one_aggregation_per_person(spark):
    plan = _plan(E.queries()["p_scores"](spark, SF))
    # the three picks share one partial aggregation (one shuffle of the
    # documents by person), not one aggregation each
    lines = [ln for ln in plan.splitlines() if "partial_min" in ln]
    assert len(lines) == 1 and lines[0].count("partial_min") == 3


def test_skewed_key_results(spark):
    """One entity holds a third of all rows: dedupe, top-k, picks and
    weighted sums still equal brute force."""
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        k = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 200)}"
        rows.append((k, i, rnd.randint(0, 9), f"u{rnd.randint(0, 50)}", rnd.random() < 0.2))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, pos long, score long, url string, flag boolean")

    top = {(r.k, r.pos) for r in R.score_topk(df, ["k"], "score", "pos", k=3).collect()}
    want = set()
    for k in {r[0] for r in rows}:
        rs = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:3]
        want |= {(k, r[1]) for r in rs}
    assert top == want

    first = {(r.k, r.url): r.pos for r in R.dedupe_first(df, ["k", "url"], ["pos"]).collect()}
    bf = {}
    for k, pos, _s, url, _f in sorted(rows, key=lambda r: r[1]):
        bf.setdefault((k, url), pos)
    assert first == bf

    w = {r.k: r.score for r in N.weighted_count_rows(df, ["k"], F.col("flag")).collect()}
    bw = {}
    for k, _p, _s, _u, f in rows:
        bw[k] = bw.get(k, 0) + (10 if f else 1)
    assert w == bw
