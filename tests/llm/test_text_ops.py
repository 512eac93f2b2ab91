"""Decontamination, line dedup, mixing and quality against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from webrake.llm import decontaminate, line_dedup, mixing, quality
from webrake.llm.common import word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def slow_contamination(text, items, window):
    words, hit, found = WORD.findall(lowered(text)), set(), set()
    for item, t in items:
        iw = WORD.findall(lowered(t))
        size = min(window, len(iw))
        for i in range(max(1, len(iw) - window + 1) if iw else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == iw[i:i + size]:
                    hit |= set(range(j, j + size))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), ",".join(sorted(found)), len(found)


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_contamination_brute_force(spark, make_docs, block):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "B", "cé", "Dd", "9", "ü"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(3, "zz a B"), (None, "null item words"), (50, None), (10, "a-B.cé")]
    docs = [(i, rng.choice([" ", "-", " \x00"]).join(word() for _ in range(rng.choice([0, 1, 5, 60]))), "s")
            for i in range(40)]
    docs += [(90, None, None), (91, items[5][1] + " null-item words", "s"), (91, "x " * 3000 + items[9][1], "s")]
    got = decontaminate.digest(decontaminate.contamination(
        make_docs(docs, clash=("hits", "items", "item", "h")), spark.createDataFrame(items, "item_id int, text string"),
        window=10, block_bytes=block))
    assert "item" in got.columns
    rows = {(r.doc_id, r.text): (r.n_words, r.n_hit, r.items_sha256, r.n_items, r.contaminated) for r in got.collect()}
    assert len(rows) == len({(i, t) for i, t, _ in docs})
    for i, t, _ in docs:
        n, hit, names, k = slow_contamination(t, items, 10)
        assert rows[i, t] == (n, hit, hashlib.sha256(names.encode()).hexdigest(), k, hit > 0), (i, t)


def test_windows_with_codes_beyond_64_bits():
    rng = random.Random(2)
    item = b" ".join(b"w%d" % rng.randrange(60) for _ in range(400))
    block = decontaminate.Windows([("i", item)], 10, 3)
    block.base = (1 << 40) + 1          # as of a vocabulary that 64 bits cannot hold three words of
    block.codes = {3: np.unique(np.array([c for w in block.windows for c in block._tokens(w)], dtype=np.int64))}
    words = [b"x", *item.split()[37:60], b"y", *item.split()[5:14], b"z"]
    counts = {}
    for k, _, token in block.places(block.ids(words)):
        for t in token.tolist():
            counts[k, t] = counts.get((k, t), 0) + 1
    block.rank(counts)
    spans, items = block.hits(words)
    assert decontaminate._merged(spans) == [(1, 24)] and items == {"i"}


def test_contamination_of_an_item_of_millions_of_words(spark, make_docs):
    n = 2_200_000
    item = " ".join(f"{i:x}" for i in range(n))
    part = " ".join(f"{i:x}" for i in range(1_500_000, 1_500_030))
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.contamination(
        make_docs([(1, f"zz {part} zz", "s"), (2, part[:40], "s")]),
        spark.createDataFrame([(7, item)], "item_id int, text string"))).collect()}
    assert (got[1].n_hit, got[1]["items"], got[2].n_hit) == (30, ["7"], 0)


def test_contamination_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.contamination(make_docs([]), none).count() == 0
    row = decontaminate.contamination(make_docs([(1, "some words", "s")]), none).first()
    assert (row.n_words, row.hits, row["items"]) == (2, [], [])


def slow_lines(rows, ratio):
    """The rule of ``line_dedup`` in plain Python, with groups by union-find."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")

    def often(n, total):
        p, z = n / total, 1.96
        low = (p + z * z / (2 * total) - z * math.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)
        return n >= 2 and low > ratio

    hosts = {}
    for _, t, s in rows:
        hosts.setdefault(s, {})[t] = {strip(x) for x in (t or "").split("\n")} - {""}
    bad = {}
    for s, pages in hosts.items():
        held = Counter(x for ls in pages.values() for x in ls)
        listed = {x for x, n in held.items() if often(n, len(pages))}
        emptied = {t: sorted(ls & listed, key=len, reverse=True) for t, ls in pages.items()
                   if 2 * sum(map(len, ls & listed)) > sum(map(len, ls))}
        root = {t: t for t in emptied}

        def find(t, root=root):
            while root[t] != t:
                t = root[t]
            return t
        by_line = {}
        for t, ls in emptied.items():
            for x in ls:
                if len(x) >= len(ls[min(2, len(ls) - 1)]):
                    root[find(t)] = find(by_line.setdefault(x, t))
        unit = {t: (t,) for t in pages}
        for r in {find(t) for t in emptied}:
            group = [t for t in emptied if find(t) == r]
            k = Counter(x for t in group for x in emptied[t])
            m, fixed = len(group), sum(len(x) * n for x, n in k.items() if n == len(group))
            if not (m >= 5 and 2 * m * m >= sum(k.values()) and fixed >= 0.8 * sum(len(x) * n for x, n in k.items())):
                unit.update((t, r) for t in group)
        total = len(set(unit.values()))
        bad[s] = {x for x in listed if often(len({unit[t] for t, ls in pages.items() if x in ls}), total)}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if strip(x) not in bad[s])) for i, t, s in rows]


def test_line_dedup_brute_force(make_docs):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lines = [f"line {rng.randrange(4000)}" for _ in range(rng.randrange(6))]
        if rng.random() < 0.5:
            lines.insert(0, rng.choice(["MENU", " MENU\t", "", "  "]))
        rows.append((i, "\n".join(lines), rng.choice(["big", "big", "big", "small", None]) if i > 15 else "tiny"))
    rows += [(500 + i, "copied page\nwhole", "big") for i in range(90)] + [(700, None, "big"), (701, "", "big")]
    rows += [(702, "MENU\n" + "a very long text " * 40000, "big")]
    out = line_dedup.drop_boilerplate(make_docs(rows, clash=("n_lines", "_host_key", "line_key")), 0.2)
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert got == sorted(slow_lines(rows, 0.2))
    dropped = {r.doc_id: r.n_dropped for r in out.collect()}
    assert dropped[700] == 0 and sum(dropped.values()) > 50 and dropped[500] == 0 and dropped[702] == 1
    assert line_dedup.drop_boilerplate(make_docs([])).count() == 0


def test_line_dedup_hosts_of_all_sizes(make_docs):
    """Hosts of 1 to 40 pages of menus, near copies and own lines in any mixture."""
    rng, rows = random.Random(16), []
    for host in range(60):
        menu = [f"menu {host} entry {k}" for k in range(rng.choice([0, 1, 3, 8]))]
        base = [f"host {host} prose line {k} " + "w" * rng.randrange(9) for k in range(rng.choice([2, 5, 9]))]
        for page in range(rng.choice([1, 2, 3, 5, 9, 14, 19, 20, 40])):
            kind = rng.random()
            own = [f"own {host} {page} {k} " + "v" * rng.randrange(30) for k in range(rng.randrange(5))]
            near = [x if rng.random() > 0.15 else f"{x} edited {page}" for x in base] if kind < 0.4 else []
            rows.append((len(rows), "\n".join((menu if kind < 0.9 else []) + near + own), f"h{host}"))
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(make_docs(rows)).collect()}
    want = dict(slow_lines(rows, 0.05))
    assert got == want
    assert sum(want[i] != t for i, t, _ in rows) > 100 and sum(want[i] == t for i, t, _ in rows) > 100


@pytest.mark.parametrize("lines", [10, 50])
def test_menu_longer_than_the_article_goes(make_docs, lines):
    menu = [f"entry {k} of the menu" for k in range(lines)]
    rows = [(i, "\n".join([*menu, f"own line of page {i}"]), "s") for i in range(100)]
    got = line_dedup.drop_boilerplate(make_docs(rows)).collect()
    assert all(r.text == f"own line of page {r.doc_id}" and r.n_dropped == lines for r in got)


@pytest.mark.parametrize("copies,others", [(200, 0), (200, 300), (2, 0), (4, 0), (7, 12)])
def test_near_copies_keep_their_lines(make_docs, copies, others):
    """Near copies, each edited in a place of its own, alone on their host or not."""
    rows = []
    for i in range(copies):
        lines = [f"line {k} of the copied prose, with words {k * k}" for k in range(12)]
        lines[(5 * i) % 12] = f"changed {i}"
        rows.append((i, "\n".join(lines), "s"))
    rows += [(1000 + i, "\n".join(f"page {i} line {k}" for k in range(9)), "s") for i in range(others)]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(make_docs(rows)).collect()}
    assert got == {i: t for i, t, _ in rows}


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {s: 0.0 for s in names}, share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += give[s]
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mixing_targets_and_takes(make_docs):
    rng = random.Random(7)
    rows = []
    for i in range(2000):
        s = rng.choice(["b", "b", "b", "b", "a", "Z", "é", None, "only"])
        rows.append((i, None if i == 5 else "  \n".join("w" for _ in range(rng.randrange(40))), s))
    rows += [(3000, "x " * 9, "zero"), (3000, "x " * 9, "zero"), (None, "p q", "a"), (3001, "", "blank")]
    df = make_docs(rows, clash=("size", "_k", "_h", "_cut", "taken"))
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    again = mixing.mix_sources(df.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", r.taken)
    assert [(r.doc_id, r.taken) for r in sorted(out, key=key)] == [(r.doc_id, r.taken) for r in sorted(again, key=key)]
    sizes, taken = {}, {}
    for r in out:
        assert r["size"] == len(SOLID.findall(r.text or ""))
        assert r.taken in (0, r["size"], 2 * r["size"])
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = slow_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40, s
    assert mixing.mix_sources(make_docs([])).count() == 0


def slow_base(text):
    words = SOLID.findall(text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if SOLID.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(hit))


def test_quality_base_counts_brute_force(spark, make_docs):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "a b a b a b a b", "é# ü|é# ü|é#", "x\nx\n x\n\n\nx", "one"]
    for _ in range(40):
        texts.append("".join(rng.choice(["ab", "é", "#", " ", "  ", "\n", "\t", "日本", "\x0b", "\u00a0", "\x85"])
                             for _ in range(rng.choice([3, 30, 300]))))
    texts.append("word " * 400_000)
    df = make_docs([(i, t, "s") for i, t in enumerate(texts)], clash=("quality", "kept", "y", "vec"))
    no_labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality_rules(df, no_labels).drop("text").collect()}
    for i, t in enumerate(texts[:-1]):
        r = rows[i]
        n, chars, symbols, dup, rep = slow_base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), t
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and r.kept == (not r.base_failed)
    r = rows[len(texts) - 1]
    assert (r.n_words, r.n_repeat_words, r.kept) == (400_000, 400_000, False)
    assert quality.quality_rules(make_docs([]), no_labels).count() == 0


def test_quality_held_out(spark):
    """Trained on a part of the labels, it agrees with the others."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~part))
    got = quality.score(docs, model).select("doc_id", "base_failed", F.col("kept").alias("k"), F.col("quality").alias("p")) \
        .join(labels.where(part), "doc_id").where("not base_failed").collect()
    assert len(got) > 80
    assert sum(r.k == bool(r.quality) for r in got) >= 0.95 * len(got)
    assert all(0 <= r.p <= 1 for r in got)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    from webrake.llm import common
    text = ("Ab  cd\tef\n" * 500 + "x" * 5000 + " end").encode()
    whole = word_hashes(text)
    monkeypatch.setattr(common, "PIECE", 64)
    assert (word_hashes(text) == whole).all() and len(whole) == len(text.split())
    assert len(set(whole.tolist())) == len(set(text.split()))


def test_hashes_of_many_texts_at_once(monkeypatch):
    from webrake.llm import common
    rng = random.Random(5)
    for _ in range(300):
        texts = [bytes(rng.choice(b"ab\xff\x00 \t\n\x0b\x0c\r\x1f!") for _ in range(rng.choice((0, 1, 5, 40, 200))))
                 for _ in range(rng.randrange(0, 6))]
        monkeypatch.setattr(common, "PIECE", rng.choice((4, 16, 64, 1 << 16)))
        hashes, sizes = common.text_hashes(texts)
        alone = [word_hashes(t) for t in texts]
        assert sizes.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts] == [len(h) for h in alone]
        assert hashes.tolist() == [x for h in alone for x in h.tolist()]
