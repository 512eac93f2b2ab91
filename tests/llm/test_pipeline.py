"""Every stage on its own over odd rows, and the whole run."""

import importlib

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def odd(spark, make_docs):
    prose = " ".join(f"word{i % 97}x{i % 13}" for i in range(120))
    rows = [(1, prose, "a"), (2, prose, "a"), (2, prose, "a"), (None, prose, None), (None, "other " + prose[::-1], "b"),
            (5, None, "a"), (6, "", None), (7, "short", "c"), (8, prose.upper() + " tail", "é")]
    return make_docs(rows, clash=("hits", "size", "fp", "_k"))


@pytest.mark.parametrize("k", range(5))
def test_stage_columns_and_odd_rows(spark, odd, make_docs, k):
    name, stage = pipeline.STAGES[k]
    out = stage(spark, odd, SF)
    rows = out.collect()
    if k < 4:
        assert out.columns == pipeline.COLUMNS
    assert stage(spark, make_docs([]), SF).count() == 0
    ids = [r.doc_id for r in rows]
    if name == "quality":
        assert 5 not in ids and 6 not in ids and 7 not in ids
    if name == "line_dedup":
        assert len(rows) == 9
    if name == "near_dedup":
        # 1, both 2s, 8 (lower-cased) and the nameless copy are one group unless the tail is too far
        assert ids.count(1) == 1 and 2 not in ids and len([r for r in rows if r.doc_id is None]) == 1
        assert (5 in ids) and 6 not in ids
    if name == "decontaminate":
        assert len(rows) == 9
    if name == "mix":
        assert all(r.taken == r["size"] * r.copies and r.copies > 0 for r in rows)


def test_near_dedup_keeps_one_of_a_repeated_id(spark, make_docs):
    out = pipeline.near_dedup_stage(spark, make_docs([(4, "a b c d", "s"), (4, "a b c d", "s"), (9, "e f g h", "s")]), SF)
    assert sorted(r.doc_id for r in out.collect()) == [4, 9]


def test_near_copies_keep_their_lines(spark, make_docs):
    """200 near copies in one source of 500 pages; the menu goes, their text stays."""
    prose = lambda page: [f"page {page} line {k} with words of its own {page * 31 + k}" for k in range(12)]
    rows = []
    for i in range(200):
        lines = prose(-1)
        lines[i % 12] = f"changed {i}"
        rows.append((i, "\n".join(["Menu", *lines]), "s"))
    rows += [(1000 + i, "\n".join(["Menu", *prose(i)]), "s") for i in range(300)]
    got = {r.doc_id: r for r in pipeline.line_dedup_stage(spark, make_docs(rows), SF).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        assert got[i].text == text.removeprefix("Menu\n") and got[i].n_chars == len(got[i].text)


def test_run(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "mix"]
    rows = pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.4 * docs < len(rows) < docs and len({r.doc_id for r in rows}) == len(rows)


def test_registered():
    names = set(E.queries())
    assert {"pipeline", *(f"op{n}" for n in range(1, 14))} <= {n.split("_")[0] if n.startswith("op") else n for n in names}
