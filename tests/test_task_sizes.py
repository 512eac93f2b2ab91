"""Work is dealt over as many tasks as its rows, files or bytes ask for."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

import webrake.catalog as C
from webrake.operators import dom
from webrake.operators import patterns as PT
from webrake.operators import rank as R
from webrake.plans import fileset as FS
from webrake.sources import readers as RD
from webrake.sources import sinks as SK


def tasks(df):
    return df.withColumn("__p", F.spark_partition_id()).select("__p").distinct().count()


def test_keyed_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SK, "FILES_PER_TASK", 4)
    rows = [(i, f"{{\"a\": {i}}}") for i in range(100)] + [(7, "second"), (None, "none"), (200, None)]
    SK.write_keyed_files(spark.createDataFrame(rows, "k long, value string").coalesce(1), f"{tmp_path}/x", "k")
    names = [f for _, _, files in os.walk(f"{tmp_path}/x") for f in files if f.startswith("part-")]
    assert len(names) == 102 and len({n[:10] for n in names}) > 8
    back = {r.file_path.split("k=")[1].split("/")[0]: r.html for r in RD.read_page_blobs(spark, f"{tmp_path}/x").collect()}
    assert sorted(back.pop("7").split("\n")) == ["", "second", '{"a": 7}']
    assert back.pop("__HIVE_DEFAULT_PARTITION__") == "none\n" and back.pop("200") == "\n"
    assert back == {str(i): f'{{"a": {i}}}\n' for i in range(100) if i != 7}


def test_local_files_are_those_of_the_text_writer(spark, tmp_path, monkeypatch):
    """Same folders and contents as Spark's writer, for any key; no process per file."""
    keys = ["plain", "a b", "x/y", "k=v", "50%", "[é]", "q?*:", "back\\\\slash", "'\"#^{", "tab\\t\x7f", "", None, "twice", "twice"]
    rows = spark.createDataFrame([(k, None if i == 3 else f"text {i}\nmore") for i, k in enumerate(keys)], "`the key` string, t string")

    def found(at):
        out = {}
        for folder, _, files in os.walk(at):
            for f in files:
                if f.startswith("part-"):
                    out.setdefault(folder[len(str(at)):], []).extend(x for x in open(f"{folder}/{f}").read().split("\n") if x)
        return {k: sorted(v) for k, v in out.items()}

    SK.write_keyed_files(rows, f"{tmp_path}/now", "the key")
    rows.repartition(2, "the key").write.partitionBy("the key").text(f"{tmp_path}/spark")
    assert found(tmp_path / "now") == found(tmp_path / "spark") and len(found(tmp_path / "now")) == 12
    assert os.path.exists(f"{tmp_path}/now/_SUCCESS")
    with pytest.raises(FileExistsError):
        SK.write_keyed_files(rows, f"{tmp_path}/now", "the key")
    SK.write_keyed_files(rows, f"{tmp_path}/sep", "the key", lineSep="|")
    assert found(tmp_path / "sep")["/the key=plain"] == ["more|", "text 0"] and os.path.exists(f"{tmp_path}/sep/the key=k%3Dv")
    # where Hadoop has another file system than the local one, Spark writes
    monkeypatch.setattr(SK, "_LOCAL_FS", ())
    SK.write_keyed_files(rows, f"{tmp_path}/other", "the key")
    assert found(tmp_path / "other") == found(tmp_path / "spark")
    monkeypatch.undo()

    def started():
        return int(next(x for x in open("/proc/stat") if x.startswith("processes")).split()[1])

    many = spark.range(3000).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    before = started()
    SK.write_keyed_files(many, f"{tmp_path}/many", "k")
    assert started() - before < 2000               # several a file before; tests beside this one may start some


def test_page_files_are_those_of_the_text_reader(spark, tmp_path):
    """Compressed files, odd names, empty files and folders that are none of the store's."""
    for name, data in (("k=1/a.txt", b"one\n"), ("k=1/b.x", b"\xff"), ("k=1/empty.txt", b""), ("k=a b%/c.gz", gzip.compress(b"two")),
                       ("k=2/d.txt", b"three"), ("k=1/_hidden", b"no"), ("k=1/.hidden", b"no")):
        (tmp_path / "s" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "s" / name).write_bytes(data)
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "top.txt").write_bytes(b"top")
    (tmp_path / "t" / "sub" / "deep.txt").write_bytes(b"no page")
    shown = lambda df, c: sorted((r.p, bytes(r.h)) for r in df.select(F.col("file_path").alias("p"), F.col(c).cast("binary").alias("h")).collect())
    for path, n in ((f"{tmp_path}/s", 4), (f"{tmp_path}/s/k=1", 2), (f"{tmp_path}/s/k=*", 4), (f"{tmp_path}/t", 1), (f"file:{tmp_path}/t/", 1)):
        got = shown(RD.read_page_blobs(spark, path), "html")
        assert got == shown(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value"), "value") and len(got) == n


def test_folders_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(200):
        (tmp_path / "s" / f"k={i}").mkdir(parents=True)
        (tmp_path / "s" / f"k={i}" / "f.html").write_text(f"{i}")
    monkeypatch.setattr(RD, "LISTINGS_PER_CORE", 1)
    before, sc = spark.conf.get(RD.LISTING), spark.sparkContext
    for i, read in enumerate((lambda: RD.read_page_blobs(spark, f"{tmp_path}/s"), lambda: FS.list_files(spark, f"{tmp_path}/s"))):
        sc.setJobGroup(f"listing{i}", "")
        assert read().count() == 200
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"listing{i}")]
        first = sc.statusTracker().getStageInfo(min(x for j in jobs for x in j.stageIds))
        assert first.numTasks <= sc.defaultParallelism
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(RD.LISTING) == before


def test_files_of_a_run_are_listed_once(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"{i}.html").write_text(f"<p style='x'>{i}</p>")
    made, stored = [], FS._stored
    monkeypatch.setattr(FS, "_stored", lambda *a: made.append(a) or stored(*a))
    assert FS.clean_files(spark, str(tmp_path), f"{tmp_path}/out") == 3 and len(made) == 1
    assert FS.clean_files(spark, str(tmp_path), f"{tmp_path}/out") == 0 and len(made) == 2


def test_small_files_share_a_task(spark, tmp_path):
    n, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.files.openCostInBytes")
    (tmp_path / "in").mkdir()
    for i in range(80 * n):
        (tmp_path / "in" / f"{i}.html").write_text(f"<p style='x'>{i}</p>")
    assert FS.clean_files(spark, f"{tmp_path}/in", f"{tmp_path}/out") == 80 * n
    parts = [f for _, _, files in os.walk(f"{tmp_path}/out") for f in files if f.endswith(".parquet")]
    assert len(parts) <= n + 1 and spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert FS.cleaned_files(spark, f"{tmp_path}/out").count() == 80 * n


def test_pages_of_a_task_go_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(dom, "TASK_BYTES", 200)
    pages = spark.createDataFrame([(i, "<ul>" + "<li><a href='x'>y</a></li>" * 10 + "</ul>") for i in range(60)]
                                  + [(100, None), (None, "<p>")], "page_id long, html string")
    n = dom.nodes(pages, ["page_id"])
    assert n.count() == 60 * 21 + 1 and tasks(n) > 25
    assert tasks(dom.extract_fields(pages, ["page_id"], {"a": "li a"})) > 25
    assert dom.nodes(pages.limit(0), ["page_id"]).count() == 0


def test_texts_are_screened_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(PT, "TASK_BYTES", 100)
    docs = spark.createDataFrame([(i, f"text with word{i % 5} in it") for i in range(100)], "id long, t string").coalesce(1)
    rules = spark.createDataFrame([("word3", False, 1), ("word4", True, 0)], "word string, accept boolean, pos long")
    for limit in (10, 1):
        screened = PT.screen_table(docs, "id", "t", rules, limit)
        plan = screened._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
        assert {r.id: r.rule for r in screened.collect()} == {i: {3: "word3", 4: "word4"}.get(i % 5) for i in range(100)}


def test_supplied_parts_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "PAIRS_PER_TASK", 10)
    rows = [(i % 40, i % 80) for i in range(400)] + [(None, 1), (None, 1), (1, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = C.supplied_parts(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == set(rows) and got.count() == len(set(rows)) and tasks(got) > 15
    first = R.dedupe_first(got, ["l_partkey"], ["l_suppkey"])
    assert first.count() == 81
