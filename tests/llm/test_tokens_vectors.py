"""BPE, centroid clustering and fill-in-middle against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webrake.llm import bpe, centroids, infill
from webrake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
# letters new to Unicode 16 and 17, digits, marks, white space of all kinds, a special string
SIGNS = ["a", "b", "A", "th", "ing", " ", "  ", "\n", "\t", "\x85", "　", "é", "的", "Ω", "1", "٣", "'s", "'", "!",
         "<|endoftext|>", "<|", "ᲊ", "՘", "\U000323b0", "�", "🙂", "é"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_FILE)


@pytest.fixture(scope="module")
def voc():
    return bpe.load(BPE_FILE)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_encode_against_the_library(voc, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, n))) for n in (2, 9, 60, 900) for _ in range(150)]
    expected = [packed(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert bpe.Encoder(voc).encode(texts) == expected
    one = bpe.Encoder(voc)      # any split into lists, in any order
    order = rng.sample(range(len(texts)), len(texts))
    assert [one.encode([texts[i]])[0] for i in order] == [expected[i] for i in order]
    assert [bpe.decode_ids(voc, x) for x in expected] == texts


@pytest.mark.parametrize("long", [2048, 8])
def test_long_words(voc, library, monkeypatch, long):
    """Words merged by reach: long runs with an odd start, and prose without spaces."""
    monkeypatch.setattr(bpe, "LONG", long)
    rng = random.Random(4)
    texts = ["a" * 5000, "th" + "a" * 4999 + "the" + "a" * 3002, " " * 3001 + "x", "的" * 4001, "=" * 2999,
             "".join(rng.choice("etaoinshrdlu") for _ in range(9000)),
             "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(3000)),
             "".join(rng.choice(["aaa", "a", "b", "bb", "ab"]) for _ in range(3000))]
    assert bpe.Encoder(voc).encode(texts) == [packed(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_and_forgetting(voc, library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 40)
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 2000)
    rng = random.Random(5)
    encoder = bpe.Encoder(voc)
    for _ in range(60):
        texts = ["".join(rng.choice([*SIGNS, " of", " the", "\n\n "]) for _ in range(200)) for _ in range(3)]
        assert encoder.encode(texts) == [packed(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_decode_any_ids(voc, library):
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.randrange(50400) for _ in range(rng.randint(0, 20))]   # broken UTF-8, unknown ids
        assert bpe.decode_ids(voc, packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, make_docs, library):
    rows = [(1, None, "s"), (2, "", "s"), (3, "Hello  world\n", None), (3, "Hello  world\n", None),
            (None, "x" * 70000 + " tail", "s"), (4, "of the <|endoftext|> end", "s")]
    docs = make_docs(rows, clash=("ids", "decoded", "N_tokens"))
    got = bpe.decode(bpe.encode(docs, BPE_FILE), BPE_FILE)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids", "decoded"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r["ids"]), r.decoded) == (len(ids), packed(ids), r.text or "")
    assert bpe.encode(make_docs([]), BPE_FILE, keep_text=False).columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]
    assert bpe.encode(make_docs([]), BPE_FILE).count() == 0


def test_bpe_query_whole_result(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))


# -- centroids ----------------------------------------------------------------------------

def slow_cluster(rows, k, rounds, dims, scale):
    """Plain Lloyd rounds in Python integers."""
    whole = [(i, v) for i, v in rows if v is not None and len(v) == dims and
             all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in whole]
    name = lambda i: "" if i is None else str(i)
    first = sorted(whole, key=lambda r: (hashlib.sha256(f"3:{name(r[0])}".encode()).hexdigest(),
                                         np.array(r[1], "<i4").tobytes()))[:k]
    cents = [list(v) for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda v: min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(rounds):
        mine = [pick(v) for _, v in whole]
        for c in range(len(cents)):
            group = [v for (_, v), m in zip(whole, mine) if m == c]
            if group:
                cents[c] = [sum(x) // len(group) for x in zip(*group)]
    out = [(i, pick(v), far(v, cents[pick(v)])) for i, v in whole]
    total = [sum(d for _, c, d in out if c == x) for x in range(len(cents))]
    return sorted(((i, c, d, total[c], sum(total), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for i, c, d in out), key=str)


def clusters_of(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("kind,grid", [("float", 0), ("double", 3)])
def test_cluster_brute_force(spark, kind, grid):
    """Ties on a coarse grid, repeated rows and ids, odd vectors."""
    rng = random.Random(7)
    draw = (lambda: rng.randint(-grid, grid) / 2) if grid else (lambda: float(np.float32(rng.gauss(0, 1))))
    rows = [(i % 70, [draw() for _ in range(4)]) for i in range(150)]
    rows += [rows[0], rows[0], (None, [0.5] * 4), (200, None), (201, []), (202, [1.0] * 3), (203, [1.0] * 500),
             (204, [1.0, None, 0.0, 0.0]), (205, [float("nan")] * 4), (206, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(5)
    got = centroids.cluster(df.withColumn("inertia", F.lit("clash")).withColumn("label", F.lit(1)), k=6, rounds=5,
                            dims=4, scale=1 if grid else 1024)
    assert got.columns == ["vec_id", "embedding", "label", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    expected = slow_cluster(rows, 6, 5, 4, 1 if grid else 1024)
    assert clusters_of(got) == expected and len({c for _, c, *_ in expected}) > 3


def test_nearest_is_exact():
    rng = np.random.default_rng(8)
    for dims, k, span in [(1, 1, 3), (1, 9, 3), (3, 8, 2), (64, 8, 900), (64, 40, 1 << 27), (5, 200, 30)]:
        cents, v = rng.integers(-span, span + 1, (k, dims)), rng.integers(-span, span + 1, (300, dims))
        exact = ((v[:, None] - cents[None]) ** 2).sum(axis=2)
        number, best = centroids.nearest(v, centroids.Lists.of(cents))
        assert (number == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()


def test_cluster_of_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema)).count() == 0
    two = centroids.cluster(spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64)], schema)).collect()
    assert sorted((r.distance, r.inertia) for r in two) == [(0, 0), (0, 0)] and len({r.cluster for r in two}) == 2


def test_far_components_are_limited(spark):
    rows = [(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)]
    got = centroids.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=1, rounds=1)
    assert {r.vec_id: r.distance for r in got.collect()} == {1: 64 << 54, 2: 64 << 54, 3: 0}


def test_clusters_do_not_depend_on_the_split(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert clusters_of(centroids.cluster(df.coalesce(1))) == clusters_of(centroids.cluster(df.repartition(16)))


# -- fill-in-middle -----------------------------------------------------------------------

def slow_infill(i, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    n, text = len(units), text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_brute_force(spark, make_docs):
    rng = random.Random(9)
    signs = ["word", "a", " ", "\n", "é", "🙂", "1", "<", "<P", "<S", "P>", "M>", ">", "\r\n", "的", "\x00"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 2, 5, 80]))), "s") for i in range(400)]
    rows += [(900, "with <P> in it", "s"), (901, "<S>", "s"), (902, "a<M>", "s"), (903, None, "s"), (None, "no id " * 9, None),
             rows[5], rows[5], (905, "letters" * 30000, "s"), (906, "a b\n" * 60000, "s")]
    docs = make_docs(rows, clash=("n", "form", "_cut", "_digest", "output"))
    made = infill.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "_cut", "_digest", "n", "form", "prefix_chars",
                            "middle_chars", "output"]
    found = made.withColumn("back", infill.restore(F.col("form"), F.col("output"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == slow_infill(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(make_docs([])).count() == 0


def test_units_in_pieces(monkeypatch):
    rng = random.Random(10)
    texts = ["".join(rng.choice(["ab", "c", " ", "\n", "é", "1"]) for _ in range(n)) for n in (0, 1, 5, 300) for _ in range(30)]
    whole = [[m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", t)] for t in texts]
    for piece in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(infill, "PIECE", piece)
        assert [infill.unit_ends(t).tolist() for t in texts] == whole


def test_markers_that_overlap_are_refused():
    infill.Markers("<|pre|>", "<|suf|>", "<|mid|>")
    for bad in [("<P>", "P", "<M>"), ("ab", "bc", "x"), ("", "a", "b"), ("aa", "b", "c")]:
        with pytest.raises(ValueError):
            infill.Markers(*bad)
