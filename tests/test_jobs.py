"""Composite job functions on hand-made rows (expected values follow the
rules stated in FIXTURES.md)."""

from pyspark.sql import functions as F

from webrake.functions import text as T
from webrake.plans import records as PR


def test_roster_candidates(spark):
    index = spark.createDataFrame([("e1", "https://h.org/a/b?x", "Inst", None)],
                                  "entity_key string, page_url string, institute string, department string")
    fac = spark.createDataFrame([
        ("e1", "Wei Zhang", "Professor", "/p/1"),
        ("e1", "Ann Lee", "", "p2"),
        ("e1", "Bob Smith", "Lecturer", "https://z/q"),
    ], "entity_key string, name string, title string, profile_url string")
    cands, report = PR.roster_candidates(index, fac, keep=T.any_token_in("name", ["zhang", "lee"]))
    got = {r.name: (r.profile_url, r.src, r.department) for r in cands.collect()}
    assert got == {"Wei Zhang": ("https://h.org/p/1", "https://h.org/a/b?x", ""),
                   "Ann Lee": ("https://h.org/a/bp2", "https://h.org/a/b?x", "")}
    r = report.first()
    assert (r.n_rows, r.n_missing) == (3, 1)


def test_advisor_edges(spark):
    cvs = spark.createDataFrame([(1, "Ann", "a@x"), (2, "", "b@x"), (3, "Cy", None)],
                                "cv_id long, name string, email string")
    exps = spark.createDataFrame([
        (1, "PhD", "MIT", "G1", "Prof X"), (1, "BSc", "MIT", None, ""),
        (2, "PhD", "MIT", "G2", "Prof Y"), (3, None, None, None, "Prof Z"),
    ], "cv_id long, title string, institute string, `group` string, advisor string")
    got = sorted(tuple(r) for r in PR.advisor_edges(cvs, exps).collect())
    assert got == [("Ann", "a@x", "PhD", "MIT", "G1", "Prof X"), ("Cy", "", "", "", "", "Prof Z")]


def test_student_scores(spark):
    index = spark.createDataFrame([("p", "Inst P", "idx@p"), ("q", "Inst Q", "idx@q")],
                                  "entity_key string, institute string, email string")
    docs = spark.createDataFrame([
        # person p: base doc (largest) is a PhD; lists chosen independently:
        # experiences from doc 2 (3 items, one flagged: 10+1+1), publications
        # from doc 1 (1 item, not flagged: 1) -> 13; own email empty -> index
        ("p", 1, 500.0, "PhD student", "", 2, 2, 1, 1),
        ("p", 2, 100.0, "x", "own@p", 3, 12, 0, 0),
        # person q: base title fails the class test -> dropped
        ("q", 3, 900.0, "Undergraduate", "q@q", 1, 1, 0, 0),
    ], "entity_key string, doc_id long, size double, title string, email string, "
       "n_exp long, exp_score long, n_pub long, pub_score long")
    rows = PR.student_scores(index, docs).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.entity_key, r.base_doc, r.exp_doc, r.pub_doc, r.score, r.institute, r.email) == \
        ("p", 1, 2, 1, 13, "Inst P", "idx@p")
    assert len(r.id) == 64


def test_group_candidates_dedupe_before_filter(spark):
    index = spark.createDataFrame([("g1", "Inst", "G", "Adv")],
                                  "entity_key string, institute string, `group` string, advisor string")
    members = spark.createDataFrame([
        ("g1", 0, 0, 0, "Ann Li", "Undergraduate", None, None),   # first 'ann li': rejected
        ("g1", 0, 0, 1, "ann li", "PhD", None, None),             # hidden by the first
        ("g1", 0, 0, 2, "Bo Li", "", "b@x", "d"),                 # empty title kept
    ], "entity_key string, group_ord int, file_ord int, line_no int, name string, title string, "
       "email string, description string")
    out = PR.group_candidates(index, members, keep_flag=T.any_token_in("name", ["li"]))
    assert [(r.name, r.email, r.advisor) for r in out.collect()] == [("Bo Li", "b@x", "Adv")]


def test_screened_report_materialize_equivalent(spark):
    from webrake.catalog.q_jobs import ALLOW, DENY, _profiles_from_documents
    from webrake.plans import profiles as PF
    prof = _profiles_from_documents(spark, "/root/testdata/sf0.001")
    keep = F.col("toxic") == 0
    r1, b1 = PF.screened_report(prof, ALLOW, DENY, keep, materialize=False)
    r2, b2 = PF.screened_report(prof, ALLOW, DENY, keep, materialize=True)
    assert sorted(map(tuple, r1.collect())) == sorted(map(tuple, r2.collect()))
    assert sorted(map(tuple, b1.collect())) == sorted(map(tuple, b2.collect()))
    assert r1.count() > 0


def test_citation_index_resume_and_profile_ids(spark):
    from webrake.plans import profiles as PF
    res = spark.createDataFrame([
        ("u1", "%0 Journal Article\n%T  T1 \n%A Doe, J\n%D 2014", [("Jane", "/c?hl=en&user=A1"), ("Bo", "/c?user=B2")]),
        ("u2", "%0 Book\n%T T2", [("Jane", "/c?user=A1")]),
    ], "url string, endnote string, profiles array<struct<name: string, url: string>>")
    done = spark.createDataFrame([("u2",)], "url string")
    arts = PF.citation_index(res, done)
    rows = arts.collect()
    assert [(r.url, r.citation.title, r.citation.authors, r.citation.year) for r in rows] == \
        [("u1", "T1", ["Doe, J"], "2014")]
    assert sorted(r.uid for r in PF.distinct_profiles(arts).collect()) == ["A1", "B2"]
    assert [r.author for r in PF.distinct_authors(arts).collect()] == ["Doe, J"]
