"""Fetch planning: targets + search hits -> the ordered URLs still to fetch,
with their page keys.  This is the planning half of the crawl jobs; the
fetching itself happens outside Spark and lands in a ``pages`` table.

Plan per kind (all native, one shuffle for top-k, one aggregation for the
key-collision dedupe, an anti-join for resume):

* ``faculty``: one page per target, keyed by ``url_key(no_ext=True)``.
* ``cv`` / ``student``: deny-list filter, first k hits, optional seed URL.
* ``group``: score hits, stable sort by score, deny-list filter, first k.

Two URLs of one entity that map to the same key share one page: the first
in rank order is fetched, the other reuses it (``dedupe_url_key``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.functions import html as H
from webrake.functions import text as T
from webrake.functions import urls as U
from webrake.operators import rank as R
from webrake.sources.keystore import anti_stored

HIT_COLUMNS = ["entity_key", "pos", "url", "title", "snippet"]


def hits_from_pages(pages: DataFrame) -> DataFrame:
    """Stand-in search hits from stored pages: entity = URL network
    location, position = page id, title = ``<title>``, snippet = text of the
    first paragraph.  Only ``page_id``, ``url`` and ``html`` are read."""
    return pages.select(
        U.url_netloc("url").alias("entity_key"),
        F.col("page_id").alias("pos"),
        "url",
        H.html_title("html").alias("title"),
        H.first_paragraph("html").alias("snippet"),
    )


def deny_filter(hits: DataFrame, any_of: Sequence[str] = (),
                pairs: Sequence[tuple[str, ...]] = ()) -> DataFrame:
    return hits.where(T.keep_url("url", any_of, pairs))


# The column that names a target, per kind.
TARGET_NAME = {"group": "advisor", "cv": "name", "student": "name"}


def plan_targets(targets: DataFrame, kind: str, order: Sequence[str],
                 institute: str = "institute") -> DataFrame:
    """The targets to search, each once, with ``entity_key`` and
    ``search_text``.

    Group targets are one per name, case ignored; blank names are no target.
    Targets of one entity key share their stored pages, so the first in
    ``order`` stands for them."""
    name = TARGET_NAME[kind]
    named = targets.where(F.col(name).isNotNull() & (F.col(name) != ""))
    if kind == "group":
        named = R.dedupe_first_ci(named, name, order)
    values = {name: name, "institute": institute}
    keyed = named.withColumn("entity_key", U.entity_key(name, institute)) \
        .withColumn("search_text", T.search_query(kind, **values))
    return R.dedupe_first(keyed, ["entity_key"], order)


def target_plan(targets: DataFrame, hits: DataFrame, kind: str, order: Sequence[str],
                profile_url: str | None = None, institute: str = "institute", **options) -> DataFrame:
    """:func:`fetch_plan` of targets: hits count for planned targets only,
    and a target's own ``profile_url`` is fetched after the hits.  Targets
    that have no stored hits yet are those of :func:`targets_to_search`."""
    planned = plan_targets(targets, kind, order, institute)
    seeds = None
    if profile_url is not None:
        url = F.col(profile_url)
        seeds = planned.where(url.isNotNull() & (url != "")).select("entity_key", url.alias("url"))
    wanted = hits.join(planned.select("entity_key"), "entity_key", "left_semi")
    return fetch_plan(wanted, kind, seeds=seeds, **options)


def targets_to_search(planned: DataFrame, hits: DataFrame) -> DataFrame:
    """Planned targets without stored hits: ``entity_key, search_text``."""
    return planned.select("entity_key", "search_text").join(hits.select("entity_key"), "entity_key", "left_anti")


def faculty_targets(targets: DataFrame, url_col: str, order: Sequence[str]) -> DataFrame:
    """Faculty pages to fetch, one per page key (blank urls are no target)."""
    keyed = targets.where(F.col(url_col).isNotNull() & (F.col(url_col) != "")) \
        .withColumn("url_key", U.url_key(url_col, no_ext=True))
    return R.dedupe_first(keyed, ["url_key"], order)


def fetch_plan(hits: DataFrame, kind: str = "group", k: int = 3,
               rules: Sequence[tuple[str, int]] | None = None,
               deny_any: Sequence[str] | None = None,
               deny_pairs: Sequence[tuple[str, ...]] | None = None,
               done: DataFrame | str | None = None,
               seeds: DataFrame | None = None,
               include_query: bool = False) -> DataFrame:
    """Ordered fetch list: ``entity_key, rank, pos, url, score, url_key``.

    ``done`` (entity_key, url_key) lists pages already stored: they are not
    planned again (resume); a path names a keyed table of them, of which only
    the buckets that the plan touches are read.  ``seeds`` (entity_key, url) are appended after
    the top-k (may duplicate a hit, as the crawl does), ranked k+1.
    """
    if kind == "faculty":
        out = hits.select("entity_key", F.lit(1).cast("bigint").alias("rank"), "pos", "url",
                          F.lit(0).cast("bigint").alias("score"),
                          U.url_key("url", no_ext=True).alias("url_key"))
        return _resume(R.dedupe_first(out, ["entity_key", "url_key"], ["pos"]), done)
    defaults = {
        "cv": (T.CV_DENY, []),
        "student": (T.STUDENT_DENY, T.STUDENT_DENY_PAIRS),
        "group": (T.GROUP_DENY, []),
    }[kind]
    deny_any = defaults[0] if deny_any is None else deny_any
    deny_pairs = defaults[1] if deny_pairs is None else deny_pairs
    if rules is None:
        rules = T.GROUP_HIT_RULES if kind == "group" else []
    score = T.score_hit("title", "snippet", rules).cast("bigint") if rules else F.lit(0).cast("bigint")
    scored = hits.select("entity_key", "pos", "url", score.alias("score"))
    top = R.score_topk(scored, ["entity_key"], "score", "pos", k=k,
                       keep=T.keep_url("url", deny_any, deny_pairs), rank_col="rank")
    top = top.select("entity_key", F.col("rank").cast("bigint").alias("rank"), "pos", "url", "score")
    if seeds is not None:
        top = top.unionByName(seeds.select(
            "entity_key", F.lit(k + 1).cast("bigint").alias("rank"),
            F.lit(None).cast("bigint").alias("pos"), "url",
            F.lit(0).cast("bigint").alias("score")))
    keyed = top.withColumn("url_key", U.url_key("url", include_query=include_query))
    # first URL (in rank order) per page key is the one fetched
    deduped = R.dedupe_first(keyed, ["entity_key", "url_key"], ["rank"])
    return _resume(deduped, done)


def _resume(plan: DataFrame, done: DataFrame | str | None) -> DataFrame:
    if done is None:
        return plan
    if isinstance(done, str):
        return anti_stored(plan, done, ["entity_key", "url_key"])
    return plan.join(done.select("entity_key", "url_key"), ["entity_key", "url_key"], "left_anti")


def link_pick(hits: DataFrame, first: str = "linkedin",
              second: str = "scholar.google") -> DataFrame:
    """Per entity, the first hit URL containing ``first`` and the first
    other hit URL containing ``second`` (a URL taken by the first test is
    not seen by the second).  Two partial aggregations, no window."""
    from webrake.operators.nested import first_per_category
    return first_per_category(hits, "entity_key", "pos", "url", [first, second])
