"""SimHash links and connected components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from webrake.llm import components, simhash


def slow_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < n else [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_fingerprint_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        t = " \t\n".join(rng.choice(["Alpha", "bé", "c", "ÉD"]) for _ in range(n))
        assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1}
    for base in list(fps)[:12]:
        for _ in range(6):      # chains of one to three flipped bits
            x = base
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    low = rng.getrandbits(64) & ~0xFFFF
    fps |= {low | rng.getrandbits(16) for _ in range(150)}      # a posting beyond the direct comparison
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    links = simhash.links(df, 2)
    for a, b in links.collect():
        assert 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    got = {r.node: r.root for r in components.components(links).collect()}
    want = slow_components(fps)
    named = [got.get(signed(f), signed(f)) for f in fps]
    groups = lambda xs: {tuple(i for i, x in enumerate(xs) if x == v) for v in set(xs)}
    assert groups(named) == groups(want)


def test_components_of_long_paths_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (3, 2)]
    got = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(60)} == {100}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_edges(make_docs):
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(20_000))
    rows = [(5, None, "a"), (2, "", "a"), (9, " \n", "b"), (7, "one two", None), (7, "one two", None), (3, long, "a"),
            (4, long + " end", "a"), (None, "one two", "a"), (None, "alone here now", "a")]
    got = simhash.near_duplicates(make_docs(rows, clash=("fp", "node", "root", "first", "component_id"))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[5] == by[2] == by[9] == {2}
    assert by[7] == {7} and by[None] == {7, None}
    assert by[3] == {3} and by[4] <= {3, 4}
    assert simhash.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("bits", [1, 2])
def test_near_duplicates_brute_force(make_docs, bits):
    rng = random.Random(bits)
    base = [[f"w{rng.randrange(300)}" for _ in range(200)] for _ in range(12)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(200)] = "new"
        rows.append((i, " ".join(words), "s"))
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(make_docs(rows), max_bits=bits).collect()}
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    assert [got[i][0] for i in range(60)] == [signed(f) for f in fps]
    if bits == 2:
        assert [got[i][1] for i in range(60)] == slow_components(fps)


def test_forest_spans_large_and_small_groups():
    rng = np.random.default_rng(4)
    for n in (2, 10, 300):
        fps = np.unique(rng.integers(0, 1 << 16, n).astype(np.uint64) << np.uint64(24))
        forest = simhash._forest(fps, 2)
        assert len(forest) < len(fps)
        want = slow_components([int(f) for f in fps])
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in forest:
            root[find(a)] = find(b)
        assert len({find(int(f)) for f in fps}) == len(set(want))
