"""Record jobs over extracted entity records (P1-P4).

Inputs are tables, not directory trees: an ``index`` table per entity
(``entity_key`` + target columns) and child record tables carrying
``entity_key`` plus explicit ordinals (``doc_ord``, ``line_no``).  Every
job is joins, filters and aggregations on those keys; the only per-entity
choices are ``min(struct)`` aggregates, so no entity's rows are ever
collected into one task.
"""

from __future__ import annotations


from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrake.functions import text as T
from webrake.functions import urls as U
from webrake.operators import joins as J
from webrake.operators import nested as N
from webrake.operators import rank as R


# ---------------------------------------------------------------- P1
def roster_candidates(index: DataFrame, faculty: DataFrame,
                      keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Faculty records x their roster page's index row.

    index:   entity_key, page_url, institute, department
    faculty: entity_key, name, title, profile_url
    Returns (candidates, missing_title_report): candidates carry ``src``,
    institute, department and the profile link made absolute against the
    page URL without its query; ``keep`` (e.g. a lexicon test on ``name``)
    selects candidates.  The report counts empty titles per source."""
    j = J.enrich_join(faculty, index, ["entity_key"])
    base = U.strip_query("page_url")
    out = j.select("entity_key", "name", F.coalesce("title", F.lit("")).alias("title"),
                   U.absolutize(base, F.coalesce("profile_url", F.lit(""))).alias("profile_url"),
                   F.col("page_url").alias("src"),
                   F.coalesce("institute", F.lit("")).alias("institute"),
                   F.coalesce("department", F.lit("")).alias("department"))
    report = J.missing_report(out, ["src"], "title")
    if keep is not None:
        out = out.where(keep)
    return out, report


# ---------------------------------------------------------------- P2
def advisor_edges(cvs: DataFrame, experiences: DataFrame) -> DataFrame:
    """One row per experience that names an advisor, for CVs with a name.

    cvs:         cv_id, name, email
    experiences: cv_id, title, institute, group, advisor
    """
    c = J.require_fields(cvs, ["name"]).select("cv_id", F.col("name").alias("member"),
                                               F.coalesce("email", F.lit("")).alias("email"))
    e = J.require_fields(experiences, ["advisor"])
    e = J.project_defaults(e, {"cv_id": None, "title": "", "institute": "", "group": "",
                               "advisor": ""})
    return c.join(e, "cv_id").select("member", "email", "title", "institute", "group", "advisor")


# ---------------------------------------------------------------- P3
def group_rollup(index: DataFrame, hits: DataFrame, k: int = 3, sep: str = "\r\n") -> DataFrame:
    """Per group: institute, group, advisor and its first k valid hit URLs.

    index: entity_key, institute, group, advisor;  hits: entity_key, pos, url"""
    urls = N.rollup_first_k(hits, ["entity_key"], "pos", "url", k=k, sep=sep,
                            keep=T.valid_group_url("url"), out_col="urls")
    return index.join(urls, "entity_key", "left").select(
        F.coalesce("institute", F.lit("")).alias("institute"),
        F.coalesce("group", F.lit("")).alias("group"),
        F.coalesce("advisor", F.lit("")).alias("advisor"),
        F.coalesce("urls", F.lit("")).alias("urls"))


def group_candidates(index: DataFrame, members: DataFrame, keep_flag: Column,
                     title_ok: Column | None = None) -> DataFrame:
    """Members deduplicated by lowercased name over the global order
    (group, file, line) *before* filtering, then kept when ``keep_flag``
    and (empty title or ``title_ok``).

    members: entity_key, group_ord, file_ord, line_no, name, title, email, description"""
    title_ok = T.is_graduate("title") if title_ok is None else title_ok
    m = members.withColumn("name", F.coalesce("name", F.lit("")))
    first = R.dedupe_first(m, [F.lower("name")], ["group_ord", "file_ord", "line_no"])
    t = F.coalesce(F.col("title"), F.lit(""))
    kept = first.where(keep_flag & ((t == "") | title_ok))
    return kept.join(index, "entity_key").select(
        "name", t.alias("title"), F.coalesce("email", F.lit("")).alias("email"),
        F.coalesce("advisor", F.lit("")).alias("advisor"),
        F.coalesce("group", F.lit("")).alias("group"),
        F.coalesce("institute", F.lit("")).alias("institute"),
        F.coalesce("description", F.lit("")).alias("description"))


# ---------------------------------------------------------------- P4
def student_scores(index: DataFrame, docs: DataFrame, hit: int = 10, miss: int = 1,
                   title_ok=None) -> DataFrame:
    """Per person: the base document is the largest (ties by order); the
    person is kept when the base title passes the class test; the longest
    experience list and the longest publication list are chosen
    independently over all documents; people without an index row are skipped; score = per element ``hit`` when
    flagged else ``miss``; id = SHA-256 of the entity key; email falls back
    to the index's.

    index: entity_key, institute, email
    docs:  entity_key, doc_id, size, title, email,
           n_exp, exp_score, n_pub, pub_score (list sizes and their weighted
           sums, computed from child rows by aggregation)"""
    title_ok = title_ok or T.is_graduate
    # One aggregation per person with three picks (one shuffle of the
    # documents): the base document (largest, then doc_id - the crawl lists
    # files by size) and, independently, the longest experience list and
    # the longest publication list (strictly longer wins, so document order
    # breaks ties).  Each pick is a partial min(struct) aggregate.
    def pick(order, payload):
        return F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)],
                              *[F.col(c) for c in payload]))

    size, doc = F.col("size"), F.col("doc_id")
    n_exp = F.coalesce(F.col("n_exp"), F.lit(0))
    n_pub = F.coalesce(F.col("n_pub"), F.lit(0))
    d = docs.withColumn("n_exp", n_exp).withColumn("n_pub", n_pub)
    per = d.groupBy("entity_key").agg(
        pick([-size, doc], ["doc_id", "title", "email"]).alias("b"),
        pick([-F.col("n_exp"), -size, doc], ["doc_id", "n_exp", "exp_score"]).alias("e"),
        pick([-F.col("n_pub"), -size, doc], ["doc_id", "n_pub", "pub_score"]).alias("p"))
    per = per.where(title_ok(F.col("b.title")))
    j = per.join(index.select("entity_key", F.col("institute").alias("ix_institute"),
                              F.col("email").alias("ix_email")), "entity_key")
    score = (F.when(F.col("e.n_exp") > 0, F.col("e.exp_score")).otherwise(F.lit(0))
             + F.when(F.col("p.n_pub") > 0, F.col("p.pub_score")).otherwise(F.lit(0)))
    return j.select(
        "entity_key", F.col("b.doc_id").alias("base_doc"), F.col("b.title").alias("title"),
        F.when(F.col("e.n_exp") > 0, F.col("e.doc_id")).alias("exp_doc"),
        F.col("e.n_exp").cast("bigint").alias("n_exp"),
        F.when(F.col("p.n_pub") > 0, F.col("p.doc_id")).alias("pub_doc"),
        F.col("p.n_pub").cast("bigint").alias("n_pub"),
        score.cast("bigint").alias("score"),
        N.surrogate_id("entity_key").alias("id"),
        F.coalesce("ix_institute", F.lit("")).alias("institute"),
        J.fallback_value("b.email", "ix_email").alias("email"))


def student_records(index: DataFrame, docs: DataFrame, base_fields: Sequence[str] = (), hit: int = 10,
                    miss: int = 1, flag: str = "is_famous", title_ok=None) -> DataFrame:
    """:func:`student_scores` with its payload: the base document's fields,
    and the longest ``experiences`` and ``publications`` lists themselves
    (each the list of one document; a null list is empty).

    index: entity_key, institute, email
    docs:  entity_key, doc_id, size, title, email, experiences, publications
           (arrays of structs with a boolean ``flag`` field), base_fields"""
    title_ok = title_ok or T.is_graduate
    size, doc = -F.col("size"), F.col("doc_id")
    lists = ("experiences", "publications")
    d = docs
    for c in lists:
        d = d.withColumn(c, F.coalesce(c, F.array().cast(docs.schema[c].dataType)))
    base = F.struct(size.alias("o0"), doc.alias("o1"), F.col("title"), F.col("email"),
                    *[F.col(c) for c in base_fields])
    per = d.groupBy("entity_key").agg(F.min(base).alias("b"), *[
        F.min(F.struct((-F.size(c)).alias("o0"), size.alias("o1"), doc.alias("o2"), F.col(c).alias("list"))).alias(c)
        for c in lists])
    per = per.where(title_ok(F.col("b.title")))
    ix = index.select("entity_key", F.col("institute").alias("ix_institute"), F.col("email").alias("ix_email"))
    exp, pub = F.col("experiences")["list"], F.col("publications")["list"]
    return per.join(ix, "entity_key").select(
        "entity_key", F.col("b.o1").alias("base_doc"), F.col("b.title").alias("title"),
        *[F.col(f"b.{c}").alias(c) for c in base_fields],
        (N.weighted_count(exp, flag, hit, miss) + N.weighted_count(pub, flag, hit, miss)).alias("score"),
        exp.alias("experiences"), pub.alias("publications"), N.surrogate_id("entity_key").alias("id"),
        F.coalesce("ix_institute", F.lit("")).alias("institute"),
        J.fallback_value("b.email", "ix_email").alias("email"))


def list_stats(children: DataFrame, doc_key: str, flag: Column, in_second: Column,
               hit: int = 10, miss: int = 1) -> DataFrame:
    """Per document: sizes and weighted sums of two child lists (all
    children; children with ``in_second``) in one aggregation."""
    w = F.when(F.coalesce(flag, F.lit(False)), F.lit(hit)).otherwise(F.lit(miss)).cast("bigint")
    return children.groupBy(doc_key).agg(
        F.count(F.lit(1)).alias("n_exp"), F.sum(w).alias("exp_score"),
        F.count_if(in_second).alias("n_pub"),
        F.coalesce(F.sum(F.when(in_second, w)), F.lit(0).cast("bigint")).alias("pub_score"))

