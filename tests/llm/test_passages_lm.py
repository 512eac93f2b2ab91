"""Substring dedup and LM scoring."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from webrake.llm import lm, substring
from webrake.llm.common import word_hashes


def slow_best_chain(matches, k, gap):
    m, best = sorted(set(matches)), {}
    for x, y in m:
        best[x, y] = max([k] + [k + best[p] - substring.GAP_COST * (x - p[0] + y - p[1]) for p in m
                                if p[0] < x and p[1] < y and x - p[0] <= gap + k and y - p[1] <= gap + k and p in best])
    return max(best.values())


def test_fenwick_chain_is_the_heaviest():
    rng = random.Random(1)
    for _ in range(60):
        matches = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(2, 25))]
        found = substring.chains(matches, 5, 1000, 1)
        score = lambda c: 5 * len(c) - substring.GAP_COST * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1])
        assert abs(max(map(score, found)) - slow_best_chain(matches, 5, 1000)) < 1e-9
        for c in found:
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))


def test_matches_in_order_need_no_tree(monkeypatch):
    """Matches in order in both texts are chained as by the tree, yet without it."""
    rng = random.Random(13)
    groups = []
    for _ in range(300):
        x = y = 0
        groups.append([])
        for _ in range(rng.randrange(2, 30)):
            x, y = (v + rng.choice((1, 5, 8, 20, 40, 69, 70)) for v in (x, y))
            groups[-1].append((x, y))
        g = groups[-1]
        assert substring._in_order(g, 5, 64) == substring._by_tree(g, 5, 64)
    monkeypatch.setattr(substring, "Fenwick", None)
    for g in groups:
        assert sum(map(len, substring.chains(g, 5, 64, 1))) == len(g)


def test_anchors_meet_once(make_docs):
    """A place that two texts share is one match, not one from either side."""
    passage = words(random.Random(14), 200)
    docs = make_docs([(1, " ".join(["x"] + passage), "s"), (2, " ".join(passage + ["y"]), "s")])
    _, seeds = substring._seed_rows(docs, "doc_id", "text", substring.K, substring.WINDOW, substring.GAP, 50)
    got = [(r.x, r.y) for r in substring._matches(substring._shared(seeds)).collect()]
    assert len(got) == len(set(got)) > 20 and len({x - y for x, y in got}) == 1


def test_winnowing_guarantee_and_blocks():
    rng = np.random.default_rng(2)
    run = rng.integers(1, 1 << 60, substring.WINDOW + substring.K - 1).astype(np.uint64)
    for n in (0, 3, 40, 70_000):
        a = np.concatenate([rng.integers(1, 1 << 60, n).astype(np.uint64), run])
        b = np.concatenate([run, rng.integers(1, 1 << 60, 50).astype(np.uint64)])
        assert set(substring.seeds_of(a)[1].tolist()) & set(substring.seeds_of(b)[1].tolist())
    same = np.full(10_000, 7, dtype=np.uint64)
    assert len(substring.seeds_of(same)[0]) <= 10_000 // substring.WINDOW + 2


def words(rng, n):
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def test_planted_passages(make_docs):
    rng = random.Random(3)
    rows, passage = [(i, " ".join(words(rng, rng.randrange(20, 200))), "s") for i in range(60)], words(rng, 70)
    for i in (100, 101, 102, 103):      # one passage in four documents, one word in fifteen changed
        mine = [w if (j + i) % 15 else "edited" for j, w in enumerate(passage)]
        rows.append((i, " ".join(words(rng, 60) + mine + words(rng, 40)), "s"))
    copy = " ".join(words(rng, 80))
    rows += [(200, copy, "s"), (201, "  " + copy.replace(" ", "\n", 5), "t"), (201, copy, "t"), (300, None, None),
             (301, "", "s"), (None, copy, "s"), (302, "one two three", "s"), (303, "one two three", "s"),
             (304, "same " * 3000, "s"), (305, "same " * 2000, "s")]
    got = substring.passages(make_docs(rows, clash=("node", "seed", "a", "chain"))).collect()
    linked = {}
    for r in got:
        assert r.identity >= 0.8 and r.n_words >= 50
        linked.setdefault(r.class_id, set()).update((r.a, r.b))
    assert {100, 101, 102, 103} in linked.values() and {200, 201} in linked.values() and {304, 305} in linked.values()
    assert set().union(*linked.values()) == {100, 101, 102, 103, 200, 201, 304, 305}
    first = [r for r in got if {r.a, r.b} <= {100, 101, 102, 103}]
    for r in first:
        # up to four words of an end whose edits cost more than its equal words gain
        assert abs(r.a_start - 60) <= 4 and abs(r.a_end - 130) <= 4
    assert substring.passages(make_docs([])).count() == 0


def test_passages_whose_seeds_are_common_elsewhere(make_docs):
    rng = random.Random(5)
    passage = words(rng, 64)
    rows = [(i, " ".join(words(rng, 30) + passage + words(rng, 30)), "s") for i in (1, 2)]
    for i in range(10, 130):        # every slice of the passage stands in many other texts, none of them holds 50 words of it
        at = rng.randrange(0, 64 - 20)
        rows.append((i, " ".join(words(rng, 30) + passage[at:at + 20] + words(rng, 30)), "s"))
    got = substring.passages(make_docs(rows)).collect()
    assert {r.class_id for r in got if {r.a, r.b} & {1, 2}} == {1}
    assert set().union(*({r.a, r.b} for r in got)) == {1, 2}


def test_runs_of_one_word(make_docs):
    rng = random.Random(6)
    rows = []
    for i in range(40):             # runs of 50 words and more among shorter ones of the same word, at any place
        parts = words(rng, rng.randrange(5, 90)) + ["a"] * rng.randrange(5, 40) + words(rng, rng.randrange(1, 40))
        rows.append((i, " ".join(parts + ["a"] * rng.randrange(50, 130) + words(rng, rng.randrange(0, 30))), "s"))
    rows += [(100 + i, " ".join(words(rng, 40) + ["a"] * 30 + words(rng, 40)), "s") for i in range(20)]
    got = substring.passages(make_docs(rows)).collect()
    assert {r.class_id for r in got} == {0}
    assert set().union(*({r.a, r.b} for r in got)) == set(range(40))


def test_edited_passages_are_found(make_docs):
    """60 words in two texts, one in ten replaced: identity 0.9."""
    rng = random.Random(8)
    rows, n = [], 60
    for i in range(n):
        p = words(rng, 60)
        q = list(p)
        for j in rng.sample(range(60), 6):
            q[j] = "edited"
        rows += [(2 * i, " ".join(words(rng, 60) + p + words(rng, 60)), "s"),
                 (2 * i + 1, " ".join(words(rng, 40) + q + words(rng, 60)), "s")]
    got = {frozenset((r.a, r.b)) for r in substring.passages(make_docs(rows)).collect()}
    assert got <= {frozenset((2 * i, 2 * i + 1)) for i in range(n)}
    assert len(got) >= n - 1


def test_passages_with_words_put_in_and_left_out(make_docs):
    """60 words in two texts, a few replaced, put in or left out, down to the least identity of 0.8."""
    rng = random.Random(15)
    for edits, least in ((6, 60), (9, 59), (11, 54)):
        rows, n = [], 60
        for i in range(n):
            p = words(rng, 60)
            q = list(p)
            for t, j in enumerate(sorted(rng.sample(range(60), edits), reverse=True)):
                q[j:j + 1] = [[f"new{t}"], [q[j], f"new{t}"], []][rng.randrange(3)]
            rows += [(2 * i, " ".join(words(rng, 60) + p + words(rng, 60)), "s"),
                     (2 * i + 1, " ".join(words(rng, 40) + q + words(rng, 60)), "s")]
        rows_found = substring.passages(make_docs(rows)).collect()
        assert all(r.identity >= 0.8 and r.n_words >= 50 for r in rows_found)
        got = {frozenset((r.a, r.b)) for r in rows_found}
        assert got <= {frozenset((2 * i, 2 * i + 1)) for i in range(n)} and len(got) >= least


def test_ends_go_on_over_gaps():
    """What an end reaches are equal words in order; nothing is gained from words that differ."""
    rng = random.Random(16)
    a = [rng.randrange(1 << 30) for _ in range(60)]
    b = a[:20] + a[22:40] + [1, 2] + a[40:]
    assert substring._reach(a, b) == (60, 60, 58) and substring._reach(b, a) == (60, 60, 58)
    assert substring._reach(a, a) == (60, 60, 60) and substring._reach([], a) == (0, 0, 0)
    assert substring._reach(a[:20] + list(range(17)) + a[20:], a) == (20, 20, 20)     # too wide a gap
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(60))] for _ in range(2))
        x, y, same = substring._reach(a, b)
        assert same <= substring._lcs(a[:x], b[:y])
    # a chain in the middle, an inserted word on either side
    p = [rng.randrange(1 << 30) for _ in range(60)]
    q = p[:20] + [1] + p[20:40] + [2] + p[40:]
    assert substring.good_parts(p, q, [(25, 26), (32, 33)], 50, 0.8) == [(0, 60, 0, 62, 60)]


def test_seeds_of_all_passes(make_docs):
    rng = random.Random(17)
    docs = make_docs([(i, " ".join(words(rng, 100)), "s") for i in range(20)])
    args = docs, "doc_id", "text", substring.K, substring.WINDOW, substring.GAP, 50
    whole, parts = (sorted(map(tuple, x)) for x in (
        substring._seed_rows(*args)[1].collect(), [r for i in range(3) for r in substring._seed_rows(*args, i, 3)[1].collect()]))
    assert whole == parts and len(whole) > 300


def test_edited_passages_whose_seeds_are_common_elsewhere(make_docs):
    rng = random.Random(9)
    passage = words(rng, 64)
    edited = [w if j % 16 != 15 else "edited" for j, w in enumerate(passage)]     # never 22 equal words beside a seed
    rows = [(i, " ".join(words(rng, 30) + p + words(rng, 30)), "s") for i, p in ((1, passage), (2, edited))]
    for i in range(10, 250):        # every seed stands in many other texts, alone
        at = rng.randrange(0, 64 - 5)
        rows.append((i, " ".join(words(rng, 30) + passage[at:at + 5] + words(rng, 30)), "s"))
    got = substring.passages(make_docs(rows)).collect()
    assert [{r.a, r.b} for r in got] == [{1, 2}]


def test_exact_runs_whose_parts_are_common_elsewhere(make_docs):
    """50 equal words in two texts each; many others hold 49 of them, and nulls without an id hold all."""
    rng = random.Random(10)
    rows, want = [], set()
    for k in range(12):
        passage = words(rng, 50)
        want.add(frozenset((1000 * k, 1000 * k + 1)))
        rows += [(1000 * k + i, " ".join(words(rng, 20) + passage + words(rng, 20)), "s") for i in (0, 1)]
        for i in range(10, 60):
            part = passage[:49] if i % 2 else passage[1:]
            rows.append((1000 * k + i, " ".join(words(rng, 20) + [f"b{i}"] + part + [f"c{i}"] + words(rng, 20)), "s"))
        rows += [(None, " ".join(words(rng, 20) + passage + words(rng, 20)), "s") for _ in range(4)]
    got = substring.passages(make_docs(rows)).collect()
    assert {frozenset((r.a, r.b)) for r in got} == want


def test_exact_run_in_a_diluted_stretch(make_docs):
    """50 equal words, then 3 equal after every 2 different: 0.75 on the whole."""
    rng = random.Random(11)
    passage, tail = words(rng, 50), [words(rng, 3) for _ in range(16)]
    rows = [(i, " ".join(words(rng, 20) + passage + [w for x in tail for w in words(rng, 2) + x] + words(rng, 20)), "s")
            for i in (1, 2)]
    got = substring.passages(make_docs(rows)).collect()
    assert [{r.a, r.b} for r in got] == [{1, 2}]
    assert got[0].a_start <= 21 and got[0].a_end >= 69 and got[0].identity >= 0.8


def test_every_exact_run_has_an_anchor():
    """Any 50 equal words have a seed and a hash of all 50 in common, also where few words repeat."""
    rng = random.Random(12)
    for trial in range(300):
        alphabet = words(rng, rng.choice((2, 2, 3, 5, 100)))
        passage, w = [], rng.choice((1, 4, 20))
        while len(passage) < 50:
            passage += [rng.choice(alphabet)] * rng.randrange(1, w + 1)
        if rng.random() < 0.2:
            passage = alphabet[:2] * 25
        passage = passage[:50]
        if len(set(passage)) == 1:                  # runs of one word have an anchor of their own
            continue
        found, texts = [], []
        for _ in range(2):
            beside = [[rng.choice(alphabet + ["x", "y"]) for _ in range(rng.randrange(0, 30))] for _ in range(2)]
            texts.append(word_hashes(" ".join(beside[0] + passage + beside[1]).encode()))
            h, lo = texts[-1], len(beside[0])
            at, code = substring.seeds_of(h)
            runs = substring.places(h, at, code)[2:]
            keys = [(c, j, int(runs[j // 4][i]) >> 16 * (j % 4) & 0xFFFF) for i, (p, c) in enumerate(zip(at.tolist(), code.tolist()))
                    for j in range(substring.WINDOW) if p - substring.beside_of(50) - j == lo]
            found.append(set(keys))
        assert found[0] & found[1] and all(k[2] for k in found[0] & found[1])
        # many texts at once are each taken by itself
        sizes = np.array([len(t) for t in texts])
        at, code = substring.seeds_of(np.concatenate(texts), sizes=sizes)
        alone = [substring.seeds_of(t)[0] for t in texts]
        assert at.tolist() == alone[0].tolist() + (alone[1] + sizes[0]).tolist()


def test_good_parts_of_a_rejected_chain(make_docs):
    rng = random.Random(7)
    first, second, third = words(rng, 55), words(rng, 55), words(rng, 80)
    rows, want = [], {}
    for k, apart in enumerate((30, 40, 50, 60)):    # two exact passages, that many different words between them
        p, q = words(rng, 55), words(rng, 55)
        for i in (10 * k, 10 * k + 1):
            rows.append((i, " ".join(words(rng, 20) + p + words(rng, apart) + q + words(rng, 20)), "s"))
        want[10 * k, 10 * k + 1] = {(20, 75), (75 + apart, 130 + apart)}
    # a passage on another diagonal, below a longer sparse chain
    line = [words(rng, 8) for _ in range(20)]
    sparse = lambda: [w for x in line for w in x + words(rng, 8)]
    one, two = sparse(), sparse()
    rows += [(100, " ".join(one[:112] + third + one[112:]), "s"), (101, " ".join(third + two), "s")]
    got = substring.passages(make_docs(rows)).collect()
    for (i, j), spans in want.items():
        mine = [r for r in got if {r.a, r.b} == {i, j}]
        assert len(mine) == 2
        for (lo, hi), r in zip(sorted(spans), sorted(mine, key=lambda r: r.a_start)):
            assert abs(r.a_start - lo) <= 1 and abs(r.a_end - hi) <= 1 and r.identity >= 0.98
    assert any({r.a, r.b} == {100, 101} and r.n_words >= 78 for r in got)
    # parts that are good together stay one passage
    a = np.arange(400, dtype=np.uint32)
    b = a.copy()
    b[:100] += 10_000
    b[100:400:60] += 10_000
    chain = [(5, 5)] + [(x, x) for x in range(102, 394, 6) if (b[x:x + 5] == a[x:x + 5]).all()]
    b[5:10] = a[5:10]
    (part,) = substring.good_parts(a, b, chain, 50, 0.9)
    assert part[0] >= 95 and part[1] == 400


def test_align_counts_equal_words():
    a = word_hashes(b"p q r a b c d e X f g h i j k l m s t").astype(np.uint32)
    b = word_hashes(b"v w a b c d e f g h i j Y k l m z z").astype(np.uint32)
    sa, ea, sb, eb, equal = substring.align(a, b, [(3, 2), (9, 7)], 5)
    assert (sa, ea, sb, eb, equal) == (3, 14, 2, 12, 10)      # the extension has no gaps
    b[12:16] = a[14:18]
    assert substring.align(a, b, [(3, 2), (9, 7)], 5) == (3, 18, 2, 16, 14)


def test_gradient():
    rng = np.random.default_rng(4)
    size = lm.LEAST_VOCAB
    w = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in lm.start_weights().items()}
    flat, at = lm.windows(rng.integers(0, size, 35), np.array([30, 0, 5]), size)
    assert len(at) == 35 and (np.delete(flat, at) == size).all() and list(np.delete(np.arange(len(flat)), at)) == [
        0, 1, 32, 33, 34, 35, 41, 42]
    _, grad = lm.step(w, flat, at, True)
    dense = np.zeros_like(w["emb"])
    for j, (rows, g) in enumerate(grad["emb"]):
        dense[j][rows] = g
    grad["emb"] = dense
    loss = lambda: -lm.step(w, flat, at, False).mean()
    assert set(grad) == set(w)
    for name in w:
        order = np.argsort(-np.abs(grad[name]).ravel())[:3]
        for i in order:
            spot = np.unravel_index(i, w[name].shape)
            old = w[name][spot]
            w[name][spot] = old + 1e-5
            up = loss()
            w[name][spot] = old - 1e-5
            down = loss()
            w[name][spot] = old
            assert abs((up - down) / 2e-5 - grad[name][spot]) < 1e-6
    assert abs(sum(np.exp(lm.step(w, np.where(np.arange(len(flat)) == at[3], t, flat), at[3:4], False)[0])
                   for t in range(size)) - 1) < 1e-6      # a distribution over all tokens


def test_vocabulary_grows():
    assert [lm.vocabulary_size(n) for n in (0, 1, 4_000_000, 4_300_000, 10 ** 10)] == [2048, 2048, 2048, 4096, 1 << 17]
    rng = np.random.default_rng(1)
    for size in (2048, 8192):
        v = lm.Vocabulary(rng.integers(-2 ** 62, 2 ** 62, lm.words_of(size)).tolist(), size)
        assert (v.ids_of(v.keys) == v.ids).all()
        other = v.ids_of(rng.integers(0, 2 ** 63, 10_000).astype(np.uint64) * np.uint64(2))
        assert lm.words_of(size) <= other.min() and other.max() == size - 1 and lm.words_of(size) == size * 7 // 8
        assert lm.unpack(lm.pack(lm.start_weights(size)), size)["mem"].tolist() == lm.start_weights(size)["mem"].tolist()


def test_scores(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text, "s") for r in docs.collect()]
    rng = random.Random(5)
    held = [r for r in rows if r[1] and 50 < len(r[1].split()) < 2000]
    for i, t, _ in held[:40]:
        w = t.split()
        rng.shuffle(w)
        rows.append((10_000 + i, " ".join(w), "s"))
    rows += [(5000, None, "s"), (5001, " ", "s"), (5002, "the " * 100_000, "s"), (5002, "the " * 100_000, "s")]
    rows += [(6000 + i, held[0][1], "s") for i in range(30)]
    made = make_docs(rows, clash=("logprob", "key", "n"))
    got = lm.pseudo_likelihood(made, shard=8_000).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and "key" in got[0] and "n" in got[0]
    assert (by[5000].n_tokens, by[5000].logprob, by[5000].mean_logprob) == (0, 0.0, None) == (
        by[5001].n_tokens, by[5001].logprob, by[5001].mean_logprob)
    assert by[5002].n_tokens == 100_000
    assert {(r.n_tokens, r.logprob) for i, r in by.items() if 6000 <= i < 6030} == {(by[held[0][0]].n_tokens, by[held[0][0]].logprob)}
    # the sum over a document alone, by the network and the counts
    counts = lm.word_counts(made)
    vocab, tokens = lm.vocabulary(counts)
    assert tokens == counts.agg(F.sum("n")).first()[0]
    assert set(vocab.keys.view(np.int64).tolist()) == {
        r.h for r in sorted(counts.collect(), key=lambda r: (-r.n, r.h))[:vocab.words]}
    dealt = lm.shards(made, vocab, tokens, shard=8_000)
    assert dealt.count() > 3
    weights = lm.train(dealt, vocab.size)
    rare = {r.key: r.rare for r in lm.rare_words(made, vocab, counts).collect()}
    keys = {r.doc_id: r.k for r in made.selectExpr("doc_id", "xxhash64(text) k").collect()}
    for i, t, _ in held[:8]:
        ids = vocab.encode(t.encode())
        flat, at = lm.windows(ids, np.array([len(ids)]), vocab.size)
        logp = lm.step(weights, flat, at, False)
        assert abs(logp.sum() + (rare[keys[i]] or 0) - by[i].logprob) < 1e-2
    # likelier than an equal share for every token
    some = [vocab.encode(t.encode()) for _, t, _ in held]
    flat, at = lm.windows(np.concatenate(some), np.array(list(map(len, some))), vocab.size)
    assert lm.step(weights, flat, at, False).mean() > -np.log(vocab.size)
    assert lm.pseudo_likelihood(make_docs([])).count() == 0


def test_scores_do_not_depend_on_the_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = ({(r.doc_id, r.n_tokens): r.mean_logprob for r in
                  lm.pseudo_likelihood(d, shard=5_000).collect()} for d in (docs.coalesce(1), docs.repartition(16)))
    assert one.keys() == many.keys()
    assert all(a == many[k] or abs(a - many[k]) < 1e-6 for k, a in one.items())


def test_rare_words_have_probabilities_of_their_own(make_docs):
    rng = random.Random(10)
    common = [f"c{i}" for i in range(lm.words_of(lm.LEAST_VOCAB))]
    rows = [(i, " ".join(rng.choices(common, k=300) + ["twice"] * (i == 0)), "s") for i in range(60)]
    rows += [(100 + i, " ".join(common), "s") for i in range(3)]
    rows += [(200, " ".join(f"Gibberish{i}" for i in range(500)), "s"), (201, "c1 twice c2", "s"), (201, "c1 twice c2", "s"),
             (202, None, "s"), (203, "", "s")]
    docs = make_docs(rows, clash=("_key", "rare", "h"))
    got = lm.pseudo_likelihood(docs).collect()
    assert len(got) == len(rows)
    counts = lm.word_counts(docs)
    vocab, _ = lm.vocabulary(counts)
    kept, seen = set(vocab.keys.tolist()), {}
    for _, t, _ in rows:
        for h in word_hashes((t or "").encode().lower()).tolist():
            if h not in kept:
                seen[h] = seen.get(h, 0) + 1
    assert sum(seen.values()) == 503
    bucket = lambda h: sum(n + 1 for x, n in seen.items() if x >> 56 == h >> 56) + 1
    want = {i: sum(np.log(seen[h] / bucket(h)) for h in word_hashes((t or "").encode().lower()).tolist() if h in seen)
            for i, t, _ in rows}
    rare = {r.key: r.rare for r in lm.rare_words(docs, vocab, counts).collect()}
    keys = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(text) k").collect()}
    for i in want:
        assert abs((rare.get(keys[i]) or 0.0) - want[i]) < 1e-6
    by = {r.doc_id: r for r in got}
    # every one of 500 different words is rarer than its bucket
    assert want[200] < -500 and by[200].mean_logprob < want[200] / 500 and by[200].n_tokens == 500
    assert (by[202].logprob, by[202].mean_logprob, by[203].logprob) == (0.0, None, 0.0)
    assert [c for c in docs.columns if c != "text"] + ["n_tokens", "logprob", "mean_logprob"] == lm.pseudo_likelihood(docs).columns


def peak_mb(job):
    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_training_takes_no_more_memory_for_a_larger_shard():
    """Windows are built a batch at a time: 11 MB here, 28 MB when they were
    built for the whole shard."""
    rng = np.random.default_rng(3)
    sizes = np.array([0, 300_000, *[100] * 7_000, 1, 0, 0, 49_999])
    ids = rng.integers(0, lm.LEAST_VOCAB, sizes.sum()).astype(np.uint16)
    trainer = lm.Trainer(lm.start_weights(), 0.1)
    assert peak_mb(lambda: trainer.feed(ids, sizes)) < 20 and trainer.tokens == len(ids)


def test_batches_of_windows_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    for batch in (1, 2, 7, 64):
        monkeypatch.setattr(lm, "BATCH", batch)
        for _ in range(20):
            sizes = rng.integers(0, 12, rng.integers(1, 20))
            ids = rng.integers(0, 50, sizes.sum())
            flat, at = lm.windows(ids, sizes, 99)
            around = lambda f, a: [f[a + o].tolist() for o in range(-lm.SIDE, lm.SIDE + 1)]
            parts = [around(f, a) for f, a in lm.window_batches(ids, sizes, 99)]
            assert [sum((p[o] for p in parts), []) for o in range(2 * lm.SIDE + 1)] == around(flat, at)
            assert all(len(p[0]) == batch for p in parts[:-1])


def test_words_are_counted_in_bounded_memory():
    """Whatever the session's Arrow batch holds; handed on early, sums are the same."""
    texts = [" ".join(f"W{i * j % 30_011}" for j in range(300)) for i in range(3_000)] + [None, "", " \n"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    want = Counter(w for t in texts for w in word_hashes((t or "").lower().encode()).view(np.int64).tolist())
    for least, most in ((1 << 18, 1 << 19), (1_000, 5_000)):
        got = Counter()
        for b in lm.counted(iter([batch, batch.slice(0, 0)]), least, most):
            for h, n in zip(*(c.to_pylist() for c in b.columns)):
                got[h] += n
        assert got == want
    assert peak_mb(lambda: [None for _ in lm.counted(iter([batch]))]) < 16
    assert list(lm.counted(iter([]))) == []
