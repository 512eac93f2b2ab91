"""URL filters: rules, and a path-template tree for what no rule decides.

Per host the paths form a tree, built from the top, level by level:

* Segments that vary (digits, or many different values for the pages below one
  node) are generalised into the wildcard ``*``.
* Pages that a rule decides are the labelled rows.  Each branch of a node is
  compared with its siblings (two-proportion z test of the blocked share);
  branches without labels or without a significant difference are merged into
  one branch ``~``, and their subtrees continue as one (not below nodes without
  any label, where nothing can be compared).
* A node's purity is its blocked share, smoothed towards its parent's.  A node
  that holds all labelled pages of its parent says nothing new and has its
  parent's purity.

The purity of a page's deepest node decides.  A path that is alone in its node
is finished at once, and a stretch that all paths of a node share is one step,
so there are as many levels as a path has branchings; depth has no limit.  Each
level is a table below the checkpoint folder, which the result reads.

Aggregations carry counts per (host, node, branch) only and are combined before
the shuffle; joins back are on those keys, so a host with a third of all pages
is split like any skewed key.

Defined results: a null url, or one without ``://``, has empty host and path
and the verdict of an unlabelled template (allow); repeated urls are judged
alike and each keep their row; a very long path is one path like any other;
an empty table gives an empty result; extra columns are kept, but for those
named like an added one, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import free_name, reliable
from webrake.session import scratch_path


@dataclass(frozen=True)
class Rule:
    verdict: str     # allow or block
    target: str      # host/path

    @property
    def host(self) -> str:
        return self.target.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.target.partition("/")[2]


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return F.when(F.contains(F.col(url), F.lit("://")),
                  _lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.when(F.contains(F.col(url), F.lit("://")),
                  F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def matching_rule(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """Struct of the longest fitting rule's ``target`` and ``verdict``, else null."""
    out = F.lit(None).cast("struct<target:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.target)):   # later ones are longer and win
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.target).alias("target"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


#: A segment is variable where its node has so many different ones, more than this share of its paths.
MANY, SHARE = 20, 0.5
#: The test's z, the weight of a parent's purity, and the purity of nothing known.
Z, WEIGHT, UNKNOWN = 1.96, 4.0, 0.25
#: Parts into which a host's paths are dealt where they meet the host's row.
SALTS = 32


def _general(segment: Column) -> Column:
    return F.when(segment.rlike("[0-9]"), F.lit("*")).otherwise(segment)


def _purity(block: Column, label: Column, prior: Column) -> Column:
    return (block + F.lit(WEIGHT) * prior) / (label + F.lit(WEIGHT))


def _branches(t: DataFrame) -> DataFrame:
    """``(host, node, next)`` -> ``branch`` and its ``purity``, for paths
    ``t`` (host, node, next, purity of the node, n_label, n_block)."""
    kids = t.groupBy("host", "node", "next").agg(
        F.count("*").alias("paths"), F.sum("n_label").alias("l"), F.sum("n_block").alias("b"), F.first("purity").alias("prior"))
    kids = reliable(kids)
    node = kids.groupBy("host", "node").agg(F.count("*").alias("values"), F.sum("paths").alias("all"),
                                            F.sum("l").alias("nl"), F.sum("b").alias("nb"))
    named = kids.join(node, ["host", "node"])
    wild = (F.col("values") >= MANY) & (F.col("values") > SHARE * F.col("all"))
    named = named.withColumn("name", F.when(wild, F.lit("*")).otherwise(F.col("next")))
    one = named.groupBy("host", "node", "name").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("nl").alias("nl"),
                                                    F.first("nb").alias("nb"), F.first("prior").alias("prior"))
    rest_l, rest_b = F.col("nl") - F.col("l"), F.col("nb") - F.col("b")
    p1, p2, p = (F.col("b") + 1) / (F.col("l") + 2), (rest_b + 1) / (rest_l + 2), (F.col("nb") + 1) / (F.col("nl") + 2)
    test = F.abs(p1 - p2) / F.sqrt(p * (1 - p) * (1 / (F.col("l") + 2) + 1 / (rest_l + 2)))
    one = one.withColumn("own", (F.col("l") > 0) & (test > Z))
    # one branch that is merged with nothing keeps its name
    pool = one.where(~F.col("own")).groupBy("host", "node").agg(F.count("*").alias("pooled"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    one = one.join(pool, ["host", "node"], "left")
    merged = ~F.col("own") & (F.col("pooled") > 1) & (F.col("nl") > 0)
    label, block = F.when(merged, F.col("pl")).otherwise(F.col("l")), F.when(merged, F.col("pb")).otherwise(F.col("b"))
    one = one.select("host", "node", "name", F.when(merged, F.lit("~")).otherwise(F.col("name")).alias("branch"),
                     F.when(label == F.col("nl"), F.col("prior")).otherwise(_purity(block, label, F.col("prior"))).alias("purity"))
    return named.select("host", "node", "next", "name").join(one, ["host", "node", "name"]).drop("name")


def template_tree(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, n_label, n_block: each pair once; no labels
    without those counts) as ``host, path, template`` (an array of generalised
    segments) and ``purity``."""
    if "n_label" not in paths.columns:
        paths = paths.withColumns({"n_label": F.lit(0), "n_block": F.lit(0)})
    spark = paths.sparkSession
    rest = F.transform(F.array_remove(F.split("path", "/"), ""), _general)
    root = paths.groupBy("host").agg(F.sum("n_label").alias("l"), F.sum("n_block").alias("b")) \
        .select("host", _purity(F.col("b"), F.col("l"), F.lit(UNKNOWN)).alias("purity"))
    # a host with a third of all paths meets its one row in SALTS places
    salt = F.pmod(F.xxhash64("path"), F.lit(SALTS))
    root = root.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    t = paths.select("host", "path", "n_label", "n_block", rest.alias("rest"), F.array().cast("array<string>").alias("node"),
                     salt.alias("salt")).join(root, ["host", "salt"]).drop("salt")
    done = []
    while True:
        # a table per level, read back with its real size: the sizes that Spark estimates for joins multiply
        folder = scratch_path(spark, "url-level")
        t.write.parquet(folder)
        t = spark.read.schema(t.schema).parquet(folder)
        node = t.where(F.size("rest") > 0).groupBy("host", "node") \
            .agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        alone = t.groupBy("host", "node").agg(F.count("*").alias("c"))
        t = t.join(alone, ["host", "node"])
        ended = (F.col("c") == 1) | (F.size("rest") == 0)
        done.append(t.where(ended).select("host", "path", F.concat("node", "rest").alias("template"), "purity"))
        # what all paths of a node share is one step: the least and the greatest of them share it
        same = F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y))
        upto = F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 1
        going = t.where(~ended).join(node.select("host", "node", upto.alias("upto")), ["host", "node"])
        going = going.withColumn("node", F.concat("node", F.slice("rest", F.lit(1), F.col("upto")))) \
            .withColumn("rest", F.slice("rest", F.col("upto") + 1, F.size("rest"))).drop("c", "upto")
        stopped = F.size("rest") == 0
        done.append(going.where(stopped).select("host", "path", F.col("node").alias("template"), "purity"))
        going = going.where(~stopped).withColumn("next", F.get("rest", F.lit(0)))
        if going.isEmpty():
            break
        branches = _branches(going).withColumnRenamed("purity", "below")
        t = going.join(branches, ["host", "node", "next"]).select(
            "host", "path", "n_label", "n_block", F.slice("rest", F.lit(2), F.size("rest")).alias("rest"),
            F.concat("node", F.array("branch")).alias("node"), F.col("below").alias("purity"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def url_filter(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", reject: float = 0.6) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``template``, ``purity``
    and ``verdict`` (allow or block: the rule's, else the template's)."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "template", "purity", "verdict")]
    rule = free_name(pages, "_rule")
    judged = pages.select(*kept, host_of(url_col).alias("host"), path_of(url_col).alias("path")) \
        .withColumn(rule, matching_rule(rules))
    paths = judged.groupBy("host", "path").agg(
        F.count(rule).alias("n_label"),
        F.count(F.when(F.col(rule)["verdict"] == "block", 1)).alias("n_block"))
    scored = template_tree(paths)
    verdict = F.coalesce(F.col(rule)["verdict"],
                         F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return judged.join(scored, ["host", "path"], "left").select(
        *kept, "host", "path", F.col(rule)["target"].alias("rule"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "purity", verdict.alias("verdict"))
