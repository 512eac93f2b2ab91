"""Jobs from targets to records, strict JSON, and what jobs leave behind."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from webrake.functions import html as H
from webrake.functions import records as RC
from webrake.operators import graph as G
from webrake.operators import nested as N
from webrake.plans import extract as X
from webrake.plans import fetch
from webrake.plans import profiles as PF
from webrake.plans import records as PR
from webrake.session import checkpoint_dir, delete_path

TEXTS = ['{"a":1}', '{"a":1},', '{"a":1} xx', "{'a':1}", "", "  ", "1", "1,2", '"x"', "[1,2]", "[1,2],[3]", "1], [2",
         "1]", '{"a":1}]', "null", "true", "True", "-0", "01", "1.", "1e5", '"a\tb"', '"\\ud83d\\ude00"', '"\\x"',
         "/*c*/1", '{"a":[1,{"b":null}]}', '﻿{"a":1}', ' {"a":1}\n', '{"a"}', "{a:1}", "[1,]", '{"a":1,}', '"',
         "1 2", "1}", '{"v":1', '1, "w":2', '1,"v":2', "+1", ".5", "-", "nul", '{"a":1}//c', " 1"]


def _is_json(x):
    try:
        json.loads(x)
        return True
    except ValueError:
        return False


def test_strict_json_agrees_with_the_standard_parser(spark):
    df = spark.createDataFrame(list(enumerate([*TEXTS, None])), "i int, x string")
    got = {r.i: r.ok for r in df.select("i", RC.strict_json("x").alias("ok")).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [_is_json(x) for x in TEXTS]
    assert got[len(TEXTS)] is None


def test_strict_json_refuses_repeated_keys_and_nan(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',), ("NaN",), ('{"a":Infinity}',)], "x string")
    assert [r[0] for r in df.select(RC.strict_json("x")).collect()] == [False] * 3


def test_first_per_category_shared_and_null_positions(spark):
    df = spark.createDataFrame([("k", 1, "b x"), ("k", 1, "a x"), ("k", 2, "x y"), ("k", 3, "y"),
                                ("n", None, "x"), ("n", 5, "x y"), ("none", 1, "q"), ("none", 2, None)],
                               "k string, p int, v string")
    got = {r.k: (r.first_0, r.first_1) for r in N.first_per_category(df, "k", "p", "v", ["x", "y"]).collect()}
    assert got == {"k": ("a x", "x y"), "n": ("x", "x y"), "none": (None, None)}


def test_bfs_stored_edges_and_folders(spark):
    base = checkpoint_dir(spark).removeprefix("file:")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    seeds = spark.createDataFrame([(1,)], "node int")
    stored = G.store_edges(edges)
    own = G.bfs_levels(seeds, edges, depth=2)
    lent = G.bfs_levels(seeds, stored, depth=2, stored_edges=True)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, lent.collect())) == [(1, 0), (2, 1), (3, 2)]
    assert stored.count() == 3                                      # lent edges stay
    assert not [f for f in os.listdir(base) if f.startswith("bfs-") and f.endswith("-edges")]
    before = len([f for f in os.listdir(base) if f.startswith("bfs-")])
    levels = [f.split("/")[-3] for f in own.inputFiles() if "/level=" in f]
    G.drop_levels(own)
    left = os.listdir(base)
    assert levels and len([f for f in left if f.startswith("bfs-")]) <= before
    assert not any(os.listdir(f"{base}/{f}") for f in set(levels) if f in left)


def test_delete_path_refuses_other_folders(spark):
    base = checkpoint_dir(spark)
    for path in ("/root/testdata", base, f"{base}/../x", f"{base}x/y"):
        with pytest.raises(ValueError):
            delete_path(spark, path)


def test_targets_once_per_name(spark):
    targets = spark.createDataFrame([
        (1, "Ann Li", "MIT", "https://a.org/x"), (2, "ANN LI", "CMU", None), (3, "", "MIT", None),
        (4, None, "MIT", None), (5, "Bo/Xu", "MIT", "")], "ord int, advisor string, institute string, own string")
    planned = fetch.plan_targets(targets, "group", ["ord"])
    rows = {r.ord: (r.entity_key, r.search_text) for r in planned.collect()}
    assert set(rows) == {1, 5} and rows[1][0] == "Ann Li-MIT" and rows[5][0] == "Bo_Xu-MIT"
    assert "Ann Li" in rows[1][1] and rows[1][1].endswith(" MIT")
    hits = spark.createDataFrame([("Ann Li-MIT", 0, "https://h.org/1", "", ""), ("other", 0, "https://h.org/2", "", "")],
                                 "entity_key string, pos long, url string, title string, snippet string")
    plan = fetch.target_plan(targets, hits, "group", ["ord"], profile_url="own", k=3)
    assert sorted((r.entity_key, r.rank, r.url) for r in plan.collect()) == [
        ("Ann Li-MIT", 1, "https://h.org/1"), ("Ann Li-MIT", 4, "https://a.org/x")]
    assert [r.entity_key for r in fetch.targets_to_search(planned, hits).collect()] == ["Bo_Xu-MIT"]


def test_faculty_targets_one_per_page_key(spark):
    t = spark.createDataFrame([(1, "https://a.org/p/x"), (2, "http://a.org/p/x"), (3, ""), (4, None)], "ord int, page string")
    assert [(r.ord, r.url_key) for r in fetch.faculty_targets(t, "page", ["ord"]).collect()] == [(1, "a.org_p_x")]


def test_student_requests_and_records(spark):
    pages = spark.createDataFrame([(1, "Ann $institute", "MIT", "<p>hi</p>")], "id int, name string, inst string, html string")
    req = X.extract_requests(pages, ["id"], "T", preface=X.student_preface(F.col("name"), F.col("inst"))).first()
    assert req.messages[1].content.split("\n")[0] == "The below is the markdown file related to Ann $institute from MIT"
    answers = spark.createDataFrame([
        ("a", "u1", 'x\n```json\n{"k": 1}\n```'), ("b", "u2", "sorry"), ("a", "u3", "```json\n```"),
        ("c", "u4", "```json\n{\"k\": }\n```")], "entity_key string, url string, answer string")
    links = spark.createDataFrame([("a", "https://linkedin.com/a", None)], "entity_key string, first_0 string, first_1 string")
    good, bad = X.student_records(answers, links, "k INT")
    assert [(r.entity_key, r.src, r.rec.k, r.linkedin, r.google_scholar) for r in good.collect()] == [
        ("a", "u1", 1, "https://linkedin.com/a", None)]
    assert sorted((r.src, r.error) for r in bad.collect()) == [
        ("u2", "no fenced block"), ("u3", "empty block"), ("u4", "not one strict JSON object")]
    assert [r.answer for r in bad.where("src = 'u2'").collect()] == ["sorry"]


def test_student_record_lists(spark):
    item = "array<struct<t: string, is_famous: boolean>>"
    index = spark.createDataFrame([("p", "MIT", "p@x")], "entity_key string, institute string, email string")
    docs = spark.createDataFrame([
        ("p", 1, 90, "PhD", None, [("e1", True)], None, "base"),
        ("p", 2, 50, "Prof", "q@x", [("e2", None), ("e3", False)], [("b1", True)], "other"),
        ("gone", 3, 10, "PhD", None, [], [], "x")],
        f"entity_key string, doc_id int, size int, title string, email string, experiences {item}, publications {item}, note string")
    (r,) = PR.student_records(index, docs, ["note"]).collect()
    assert (r.base_doc, r.title, r.note, r.email, r.institute) == (1, "PhD", "base", "p@x", "MIT")
    assert [x.t for x in r.experiences] == ["e2", "e3"] and [x.t for x in r.publications] == ["b1"]
    assert r.score == 1 + 1 + 10


def test_co_authors_per_element_and_both_classes(spark):
    co = spark.createDataFrame([('[{"name": ["A", "x"], "url": "u"}, {"name": "B"}]',), ("[]",), (None,), ("{bad",)], "j string")
    got = [[(a.name, a.url) for a in r.c] for r in co.select(PF.first_names("j").alias("c")).collect()]
    assert got == [[("A", "u"), ("B", None)], [], [], []]
    html = ('<a class="gsc_prf_inta gs_ibl" href=x>one</a><a class="gsc_prf_inta">no</a>'
            "<a class='gs_ibl other gsc_prf_inta'>two</a>")
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(H.extract_by_class("html", "a", "gsc_prf_inta gs_ibl")).first()[0] == ["one", "two"]


def test_citation_index_keeps_names(spark):
    res = spark.createDataFrame([("u1", "%0 Book\n%T T", [("Jane", "/c?user=A1")])],
                                "url string, endnote string, profiles array<struct<name: string, url: string>>")
    (r,) = PF.citation_index(res).collect()
    assert [(p.name, p.url, p.uid) for p in r.profiles] == [("Jane", "/c?user=A1", "A1")]
