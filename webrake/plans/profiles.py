"""Profile jobs (P5, P6, P10): screened report, refresh from stored HTML,
citation index.

Profiles are rows ``(uid, name, url, homepage, brief, cited_stats,
articles ARRAY<STRING>, tags ARRAY<STRING>, html_path)``; everything below
is per-row expressions plus joins, so the work is spread by Spark's scan
partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrake.functions import records as RC
from webrake.functions import text as T
from webrake.functions import urls as U
from webrake.functions import variants as VR
from webrake.operators import dom
from webrake.operators import joins as J
from webrake.operators.dom import Field
from webrake.operators.variants import typed_records
from webrake.sources import readers as RD


# ---------------------------------------------------------------- P5
def screened_report(profiles: DataFrame, allow: Sequence[str], deny: Sequence[str],
                    keep_flag: Column, materialize: bool | str = False) -> tuple[DataFrame, DataFrame]:
    """(report, quarantine).  Profiles pass ``keep_flag`` and the allow/deny
    screen over the lowercased articles and tags; the report carries the
    matched keyword, stats, ratio, search link and multi-line cells.
    Profiles whose citation stats do not parse go to quarantine.

    A caller of one output leaves it lazy.  A caller of both passes
    ``materialize`` (True or a folder): the accepted profiles, with the
    columns used, are written once under the checkpoint folder and both
    outputs read that table."""
    full_text = F.lower(F.array_join(F.concat(F.coalesce("articles", F.array()),
                                              F.coalesce("tags", F.array())), "\n"))
    # Each costly intermediate gets its own projection: Spark does not share
    # subexpressions that contain lambdas, and CollapseProject keeps a costly
    # column separate when it is referenced twice.
    p = profiles.where(keep_flag).withColumn("__ft", full_text) \
        .withColumn("__sc", T.screen(F.col("__ft"), allow, deny)).where(F.col("__sc.accept")) \
        .select("name", "homepage", "brief", "cited_stats", "articles", "tags", F.col("__sc.rule").alias("__rule"))
    if materialize:
        from webrake.session import scratch_path
        spark = profiles.sparkSession
        path = materialize if isinstance(materialize, str) else scratch_path(spark, "screened")
        p.write.mode("overwrite").parquet(path)
        p = spark.read.parquet(path)
    p = p.withColumn("__st", T.cited_stats("cited_stats")) \
         .withColumn("email", T.email_domain("brief"))
    bad = p.where(F.col("__st").isNull()).select("name", "cited_stats")
    good = p.where(F.col("__st").isNotNull())
    report = good.select(
        "name", F.lit(None).cast("string").alias("note"), F.lit(None).cast("double").alias("score"),
        F.coalesce("homepage", F.lit("")).alias("homepage"),
        F.col("__rule").alias("keyword"),
        T.join_list(F.coalesce("tags", F.array()), "\n").alias("tags"),
        F.col("__st.all").alias("cited_all"), F.col("__st.recent").alias("cited_5yr"),
        T.safe_ratio("__st.recent", "__st.all").alias("cited_5yr_ratio"),
        T.last_line("brief").alias("brief"),
        T.join_list(F.coalesce("articles", F.array()), "\n").alias("articles"),
        T.report_search_link("name", "email").alias("search_link"))
    return report, bad


# ---------------------------------------------------------------- P6
# The selectors of a profile page's fields.
PROFILE_FIELDS = {
    "name": Field("div#gsc_prf_in"),
    "brief": Field("div#gsc_prf_w"),
    "cited_stats": Field("table#gsc_rsb_st"),
    "homepage": Field("a.gsc_prf_ila", "href"),
    "articles": Field("a.gsc_a_at", many=True),
    "tags": Field("a.gsc_prf_inta.gs_ibl", many=True),
    "co_author_names": Field("ul.gsc_rsb_a li a", many=True),
    "co_author_urls": Field("ul.gsc_rsb_a li a", "href", many=True),
}
REFRESHED = ("articles", "tags")


def parse_profiles(pages: DataFrame, keys: Sequence[str] = ("uid",), html: str = "html",
                   dealt: bool = False) -> DataFrame:
    """Profile records from stored profile pages: every field of
    ``PROFILE_FIELDS`` and ``co_authors`` as ``array<struct<name, url>>``
    (scalar fields default to '', lists to empty)."""
    found = dom.extract_fields(pages, list(keys), PROFILE_FIELDS, html, dealt).drop(html)
    pairs = F.arrays_zip(F.col("co_author_names").alias("name"), F.col("co_author_urls").alias("url"))
    return found.withColumn("co_authors", F.transform(pairs, lambda p: F.struct(
        p["name"].alias("name"), p["url"].alias("url")))).drop("co_author_names", "co_author_urls")


def first_names(co_authors_json: str) -> Column:
    """A JSON list of co-authors as ``array<struct<name, url>>``, where a name
    that was stored as a list is its first element (null text or no list: empty)."""
    items = F.try_variant_get(F.try_parse_json(F.col(co_authors_json)), "$", "array<variant>")
    return F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.struct(
        F.coalesce(F.try_variant_get(v, "$.name[0]", "string"),
                   F.try_variant_get(v, "$.name", "string")).alias("name"),
        F.try_variant_get(v, "$.url", "string").alias("url")))


def stored_profiles(spark, path, spec: dict[str, str], co_authors: str = "co_authors") -> tuple[DataFrame, DataFrame]:
    """(profiles, quarantine) from stored JSON lines whose fields come in
    several types: ``spec`` (name -> 'string', 'strings', 'number') repaired by
    actual type with ``repairs``, and the co-authors as ``co_authors_json`` for
    :func:`refresh_profiles` (one object counts as a list of one)."""
    records, bad = RD.read_variant_jsonl(spark, path)
    x = VR.field("record", co_authors)
    text = F.to_json(x)
    records = records.withColumn("co_authors_json", F.when(VR.kind(x) == "list", text)
                                 .when(VR.kind(x) == "object", F.concat(F.lit("["), text, F.lit("]"))))
    return typed_records(records, "record", spec), bad


def refresh_profiles(profiles: DataFrame, pages: DataFrame, spec: dict[str, Field | str] | None = None,
                     co_authors_json: str | None = "co_authors_json", dealt: bool = False) -> DataFrame:
    """Re-extract list fields from each profile's stored HTML (joined on
    ``uid``, the pages' key; ``spec``: selectors) and normalise the co-authors:
    ``co_authors`` holds one ``{name, url}`` per element of the stored JSON list."""
    spec = spec or {name: PROFILE_FIELDS[name] for name in REFRESHED}
    found = dom.extract_fields(pages.select("uid", "html"), ["uid"], spec, dealt=dealt).drop("html")
    out = profiles.drop(*spec).join(found, "uid", "left")
    for name, f in spec.items():
        if isinstance(f, str) or f.many:
            out = out.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")))
    if co_authors_json and co_authors_json in profiles.columns:
        out = out.withColumn("co_authors", first_names(co_authors_json))
    return out


# ---------------------------------------------------------------- P10
def citation_index(results: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Article table from search results ``(url, endnote, profiles
    ARRAY<STRUCT<name, url>>)``: new articles only (anti-join on ``url``),
    EndNote parsed, profile ids taken from the links, names kept."""
    if done is not None:
        results = J.anti_processed(results, done, ["url"])
    parsed = RC.with_endnote(results, "endnote", "citation")
    return parsed.select(
        "url", "citation",
        F.transform("profiles", lambda p: F.struct(
            p["name"].alias("name"), p["url"].alias("url"),
            U.url_param(p["url"], "user").alias("uid"))).alias("profiles"))


def distinct_profiles(articles: DataFrame) -> DataFrame:
    """Each linked profile once: ``url`` and ``uid``."""
    links = F.transform("profiles", lambda p: F.struct(p["url"].alias("url"), p["uid"].alias("uid")))
    return J.flatten_distinct(articles, links, "profile").select(
        F.col("profile.url").alias("url"), F.col("profile.uid").alias("uid"))


def distinct_authors(articles: DataFrame) -> DataFrame:
    return J.flatten_distinct(articles, F.col("citation.authors"), "author")
