"""Properties on the driver tables: partition/order invariance, complete
quarantine split, idempotent cleaning, unique dedupe keys."""

from pyspark.sql import functions as F

from webrake.functions import html as H
from webrake.plans import fetch

SF = "/root/testdata/sf0.001"
RULES = [("of the", 10), ("que", 7), ("der", 5), ("los", -5)]


def _plan(pages):
    hits = fetch.hits_from_pages(pages)
    return {tuple(r) for r in fetch.fetch_plan(hits, kind="group", k=3, rules=RULES,
                                               deny_any=[".html"], deny_pairs=[("blog", "utm_")]).collect()}


def test_fetch_plan_partition_and_order_invariant(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    base = _plan(pages)
    assert base
    assert _plan(pages.repartition(1)) == base
    assert _plan(pages.repartition(7, F.rand(3)).orderBy(F.rand(5))) == base


def test_fetch_plan_keys_unique_and_k_bounded(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plan = fetch.fetch_plan(fetch.hits_from_pages(pages), k=2, rules=RULES, deny_any=[])
    rows = plan.collect()
    keys = [(r.entity_key, r.url_key) for r in rows]
    assert len(keys) == len(set(keys))
    per = {}
    for r in rows:
        per[r.entity_key] = per.get(r.entity_key, 0) + 1
    assert max(per.values()) <= 2


def test_quarantine_split_is_complete(spark):
    import __spark_entry__ as E
    good = E.queries()["json_record"](spark, SF).count()
    bad = E.queries()["json_quarantine"](spark, SF).count()
    total = spark.read.parquet(f"{SF}/events.parquet").count()
    assert good + bad == total and bad > 0


def test_native_clean_idempotent(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    once = pages.select("page_id", H.clean_html_native("html").alias("h"))
    twice = once.select("page_id", H.clean_html_native("h").alias("h2"))
    assert once.join(twice, "page_id").where(F.col("h") != F.col("h2")).count() == 0


def test_bfs_output_nodes_unique(spark):
    import __spark_entry__ as E
    rows = E.queries()["bfs_depth2"](spark, "/root/testdata/sf0.01").collect()
    nodes = [r.node for r in rows]
    assert len(nodes) == len(set(nodes))
    assert {r.lvl for r in rows} <= {0, 1, 2}
