"""Page -> model request table, model answer table -> records (P8), and
bulk page cleaning (P9).

Calling the model is outside Spark: ``extract_requests`` produces a request
table any batch runner can consume, and ``parse_answers`` reads the answer
table back.  Templates are parameters (``$VAR`` placeholders).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrake.functions import html as H
from webrake.functions import records as RC
from webrake.operators import htmlclean as HC
from webrake.operators import joins as J
from webrake.operators import quarantine as Q
from webrake.sources.keystore import anti_stored

# How page text is framed for the model, and the line that
# stands before the page of a student.
TEXT_OPEN = 'Markdown: """'
TEXT_CLOSE = '"""'
STUDENT_PREFACE = "The below is the markdown file related to $name from $institute"


def render_template(template: str, **values: Column) -> Column:
    """Replace each ``$NAME`` of the template by a column value (null: empty).

    The template is split once, so a value that holds ``$OTHER`` is not
    expanded again and ``$HOST`` does not match ``$HOSTNAME``; names without
    a value stay as they are."""
    parts = []
    for i, piece in enumerate(re.split(r"\$([A-Za-z_][A-Za-z0-9_]*)", template)):
        if i % 2 and piece in values:
            parts.append(F.coalesce(values[piece].cast("string"), F.lit("")))
        else:
            parts.append(F.lit("$" + piece if i % 2 else piece))
    return F.concat(*parts)


def build_requests(df: DataFrame, key_cols: list[str], system: Column, text: Column,
                   preface: Column | None = None) -> DataFrame:
    """``messages ARRAY<STRUCT<role, content>>``: the system prompt, then
    the user message (optional preface line, then the page text fenced)."""
    parts = ([preface] if preface is not None else []) + [F.lit(TEXT_OPEN), text, F.lit(TEXT_CLOSE)]
    user = F.concat_ws("\n", *parts)
    msgs = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
    return df.select(*key_cols, msgs.alias("messages"))


def extract_requests(pages: DataFrame, key_cols: list[str], template: str,
                     native: bool = True, preface: Column | None = None, answered: DataFrame | str | None = None,
                     **values: Column) -> DataFrame:
    """Clean each page, convert it to text and build its request.  Pages whose
    answer is stored already (``answered``: their keys, or the path of a keyed
    table) are left out before any text is touched.  ``native``
    uses the codegen'd regular-expression cleaner; otherwise the parser
    pass (``mapInPandas``) produces markdown.  ``preface`` is a line before
    the page, see :func:`student_preface`."""
    if isinstance(answered, str):
        pages = anti_stored(pages, answered, key_cols)
    elif answered is not None:
        pages = J.anti_processed(pages, answered, key_cols, null_safe=True)
    if native:
        text = H.html_text_native("html")
        src = pages
    else:
        src = HC.clean_pages(pages, passthrough=[c for c in pages.columns if c != "html"])
        text = F.col("markdown")
    return build_requests(src, key_cols, render_template(template, **values), text, preface)


def student_preface(name: Column, institute: Column) -> Column:
    """The line that tells the model whose page it reads."""
    return render_template(STUDENT_PREFACE, name=name, institute=institute)


def parse_answers(answers: DataFrame, key_cols: list[str], schema: str,
                  fence: str = "```json", jsonl: bool = True) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Answer table -> records.  JSON-lines answers explode to one row per
    record with a status (a bad line rejects the whole block); single-object
    answers split into (records, quarantine)."""
    block = RC.fenced_first("answer", fence)
    if jsonl:
        b = answers.select(*key_cols, F.coalesce(block, F.lit("")).alias("__blk"))
        return Q.explode_jsonl_block(b, key_cols, "__blk", schema)
    return Q.split_json_records(answers, "answer", schema, fence)


def student_records(answers: DataFrame, links: DataFrame, schema: str, fence: str = "```json",
                    key: str = "entity_key", url_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(records, errors) of the answers about students (``key, url, answer``).

    A record is the parsed object with the page it came from (``src``) and
    the entity's two profile links (``linkedin``, ``google_scholar``: the
    picks of :func:`webrake.plans.fetch.link_pick`, null when there is none).
    An error row keeps ``src``, the answer and the reason."""
    named = answers.withColumnRenamed(url_col, "src")
    good, bad = Q.split_json_records(named, "answer", schema, fence)
    picked = links.select(F.col(key).alias("__key"), F.col("first_0").alias("linkedin"),
                          F.col("first_1").alias("google_scholar"))
    records = good.drop("answer").join(picked, F.col(key) == F.col("__key"), "left").drop("__key")
    return records, bad


def clean_corpus(pages: DataFrame, out_path: str | None = None, keep: dict | None = None) -> DataFrame:
    """Clean and convert every page in one parser pass; optionally write
    the result (never in place) as parquet."""
    out = HC.clean_pages(pages, keep=keep)
    if out_path:
        out.write.mode("overwrite").parquet(out_path)
        return pages.sparkSession.read.parquet(out_path)
    return out
