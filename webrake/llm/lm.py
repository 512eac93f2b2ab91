"""Masked pseudo-likelihood scores from a bidirectional window network.

Every token is predicted from the ``SIDE`` tokens on either side.  Words are
tokens: the most frequent of the corpus, and hash buckets for the rest.  The
network is numpy: one embedding per offset, summed, tanh, and a two-level
softmax (class, then member), so one prediction costs the square root of the
vocabulary.  The vocabulary grows with the corpus: the power of two from the
square root of the number of different words on, 2,048 at least; an eighth of
it are buckets.

Word counts cover all documents.  Training is data-parallel over the tokens of
all different texts: texts are dealt by their hash into shards of about
``SHARD`` tokens, each one row of a written table with its texts in the order
of their hashes.  In a round every shard starts from the same weights and does
one pass of AdaGrad steps; the weights are averaged by tokens.  A first round
over a sixteenth of the shards gives the common start of ``ROUNDS`` rounds over all.
Shards follow from the texts alone, so weights and scores are the same however
the input is split into tasks (but for rounding).  What reaches the driver is the
vocabulary, one set of weights and the buckets' totals: they grow as the square
root of the number of different words.

A document's score is the sum of the conditional log-probabilities of its
words.  The network gives a bucket's probability; a rare word's is that times
its share of the bucket by the corpus-wide counts of all words, a distributed
table that grows with the corpus and is joined by word.  Counts are smoothed
(Witten-Bell): a word that the table does not have counts as one of as many
unseen words as there are different ones in its bucket, and one more.

Defined results: null and blank texts have no tokens, a sum of zero and a
null mean; repeated rows are scored alike (they count as often in the word
counts, and once in training); words of equal frequency enter the vocabulary
by their hash; a very long text is encoded whole, lies in one shard and makes
it longer; an empty table gives an empty result; extra columns are kept, but
for the text and the documents' own ``n_tokens``, ``logprob``,
``mean_logprob``, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import batches_of, free_name, python_ready, reliable, text_bytes, text_hashes, word_hashes
from webrake.session import scratch_path

SIDE, DIM = 2, 16
LEAST_VOCAB = 2048
BATCH = 16_384
SHARD = 1 << 21                  # tokens of a shard
ROUNDS = 1
_WIDTH = 16                      # weights per row of the averaging shuffle
_PART = 1 << 20                  # bytes of text worked on at once: a worker keeps what its largest step took
_SEEN = 1 << 18                  # texts a task remembers to leave out copies


class Vocabulary:
    """Sorted hashes of the frequent words and their ids (rank by frequency);
    ids from ``words`` to ``size`` are hash buckets."""

    def __init__(self, hashes: list[int], size: int = LEAST_VOCAB):
        self.size, self.words = size, words_of(size)
        h = np.array(hashes, dtype=np.int64).view(np.uint64)
        order = np.argsort(h)
        self.keys, self.ids = h[order], order.astype(np.int32)

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - bucket_bits(self.size))).astype(np.int32)

    def ids_of(self, h: np.ndarray) -> np.ndarray:
        other = self.words + self.bucket(h)
        if not len(self.keys) or not len(h):
            return other.astype(np.int32)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], other).astype(np.int32)

    def encode(self, text: bytes | None) -> np.ndarray:
        return self.ids_of(word_hashes((text or b"").lower()))


def bucket_bits(size: int) -> int:
    return size.bit_length() - 4


def words_of(size: int) -> int:
    """Frequent words of a vocabulary of ``size`` ids."""
    return size - (1 << bucket_bits(size))


def vocabulary_size(different: int) -> int:
    """A power of two, the square root of the number of different words at least."""
    return max(LEAST_VOCAB, 1 << int(np.ceil(np.log2(max(different, 1)) / 2)))


def shapes(size: int) -> dict[str, tuple[int, ...]]:
    classes = 1 << ((size.bit_length() - 1) // 2)
    return {"emb": (2 * SIDE, size + 1, DIM), "cls": (classes, DIM), "mem": (classes, size // classes, DIM),
            "bias_cls": (classes,), "bias_mem": (classes, size // classes), "bias": (DIM,)}


def start_weights(size: int = LEAST_VOCAB, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (np.zeros(s, np.float32) if k.startswith("bias") else rng.normal(0, 0.1, s).astype(np.float32))
            for k, s in shapes(size).items()}


def pack(w: dict[str, np.ndarray]) -> np.ndarray:
    flat = np.concatenate([v.ravel() for v in w.values()])
    return np.concatenate([flat, np.zeros(-len(flat) % _WIDTH, flat.dtype)]).reshape(-1, _WIDTH)


def unpack(rows: np.ndarray, size: int) -> dict[str, np.ndarray]:
    flat, out, at = rows.ravel().astype(np.float32), {}, 0
    for k, s in shapes(size).items():
        n = int(np.prod(s))
        out[k] = flat[at:at + n].reshape(s).copy()
        at += n
    return out


def windows(ids: np.ndarray, sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(padded tokens, places of the tokens) of documents one after the other."""
    shift = SIDE * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    at = np.arange(len(ids)) + shift
    flat = np.full(len(ids) + SIDE * (len(sizes) + 1), pad, dtype=np.int32)
    flat[at] = ids
    return flat, at


def window_batches(ids: np.ndarray, sizes: np.ndarray, pad: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`windows` of ``BATCH`` tokens at a time, whatever documents they
    lie in, so that the memory does not grow with a shard or a long text."""
    ends = np.cumsum(sizes)
    for i in range(0, len(ids), BATCH):
        j = min(i + BATCH, len(ids))
        docs = slice(np.searchsorted(ends, i, side="right"), np.searchsorted(ends, j) + 1)
        first, last = ends[docs] - sizes[docs], ends[docs]
        lo, hi = max(first[0], i - SIDE), min(last[-1], j + SIDE)
        flat, at = windows(ids[lo:hi], np.minimum(last, hi) - np.maximum(first, lo), pad)
        yield flat, at[i - lo:j - lo]


def _soft(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials per column (in place), not yet divided by their sums; their
    sums; the log normalisers."""
    top = z.max(axis=0)
    z -= top
    np.exp(z, out=z)
    s = z.sum(axis=0)
    return s, np.log(s) + top


def step(w: dict[str, np.ndarray], flat: np.ndarray, at: np.ndarray, learn: bool):
    """Log-probabilities of the tokens at ``at``; with ``learn`` also the mean
    gradient of the negative log-likelihood, that of ``emb`` as (rows, values)
    per offset."""
    classes, members, _ = w["mem"].shape
    order = np.argsort((flat[at] // members).astype(np.uint16), kind="stable")      # tokens of a class side by side
    at = at[order]
    y = flat[at]
    cls, mem, cols = y // members, y % members, np.arange(len(y))
    edges = np.searchsorted(cls, np.arange(classes + 1))
    ctx = [flat[at + o] for o in range(-SIDE, SIDE + 1) if o]
    x = w["emb"][0][ctx[0]]
    for j, c in enumerate(ctx[1:], 1):
        x += w["emb"][j][c]
    x += w["bias"]
    h = np.tanh(x, out=x)
    ht = np.ascontiguousarray(h.T)
    z = w["cls"] @ ht
    z += w["bias_cls"][:, None]
    logp = z[cls, cols]
    s, norm = _soft(z)
    logp -= norm
    grad = {"mem": np.zeros_like(w["mem"]), "bias_mem": np.zeros_like(w["bias_mem"])} if learn else None
    dh = np.empty_like(ht) if learn else None
    for c in range(classes):
        lo, hi = edges[c], edges[c + 1]
        if lo == hi:
            continue
        zc = w["mem"][c] @ ht[:, lo:hi]
        zc += w["bias_mem"][c][:, None]
        m, r = mem[lo:hi], cols[:hi - lo]
        logp[lo:hi] += zc[m, r]
        sc, norm = _soft(zc)
        logp[lo:hi] -= norm
        if learn:
            zc /= sc
            zc[m, r] -= 1
            grad["mem"][c] = zc @ h[lo:hi]
            grad["bias_mem"][c] = zc.sum(axis=1)
            dh[:, lo:hi] = w["mem"][c].T @ zc
    out = np.empty_like(logp)
    out[order] = logp
    if not learn:
        return out
    z /= s
    z[cls, cols] -= 1
    grad["cls"], grad["bias_cls"] = z @ h, z.sum(axis=1)
    dh += w["cls"].T @ z
    dh *= 1 - ht * ht
    grad["bias"] = dh.sum(axis=1)
    for g in grad.values():
        g /= len(y)
    back = np.ascontiguousarray(dh.T) / h.dtype.type(len(y))
    grad["emb"] = []
    short = np.uint16 if w["emb"].shape[1] <= 1 << 16 else np.int32      # 16 bits are sorted by radix
    for c in ctx:
        by = np.argsort(c.astype(short), kind="stable")
        starts = np.flatnonzero(np.diff(c[by], prepend=-1))
        grad["emb"].append((c[by[starts]], np.add.reduceat(back[by], starts, axis=0)))
    return out, grad


class Trainer:
    """AdaGrad over minibatches of tokens."""

    def __init__(self, w: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.tokens = w, rate, 0
        self.sq = {k: np.full_like(v, 1e-8) for k, v in w.items()}

    def feed(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        for flat, at in window_batches(ids, sizes, self.w["emb"].shape[1] - 1):
            _, grad = step(self.w, flat, at, True)
            for j, (rows, g) in enumerate(grad.pop("emb")):
                sq = self.sq["emb"][j][rows] + g * g
                self.sq["emb"][j][rows] = sq
                self.w["emb"][j][rows] -= self.rate * g / np.sqrt(sq)
            for k, g in grad.items():
                self.sq[k] += g * g
                self.w[k] -= self.rate * g / np.sqrt(self.sq[k])
            self.tokens += len(at)


def hashed(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows in parts of about ``_PART`` bytes of text, with the hashes of
    their words one behind the other and the number of words of each."""
    for batch in batches:
        for part in batches_of(batch, text, _PART):
            yield part, *text_hashes([(t or b"").lower() for t in text_bytes(part[text])])


def counted(batches: Iterator[pa.RecordBatch], least: int = 1 << 18, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """``h, n`` of the words of the column ``t``: ``least`` words are counted at
    once, and more than ``most`` different ones handed on."""
    keys, sums = np.empty(0, np.uint64), np.empty(0, np.int64)
    parts, size = [], 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        u, n = np.unique(np.concatenate([np.empty(0, np.uint64), *parts]), return_counts=True)
        both, n = np.concatenate([keys, u]), np.concatenate([sums, n])
        order = np.argsort(both, kind="stable")     # two sorted runs
        both, n = both[order], n[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[:len(both)])
        return both[first], np.add.reduceat(n, first) if len(first) else n

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + (1 << 16)]) for x in (keys.view(np.int64), sums)], ["h", "n"])

    for _, h, _ in hashed(batches, "t"):
        parts.append(h)
        size += len(h)
        if size >= least:
            keys, sums = merge()
            parts, size = [], 0
            if len(keys) > most:
                yield from out()
                keys, sums = np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, sums = merge()
    yield from out()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``h, n``: every different word of all documents and how often it occurs."""
    return python_ready(docs).select(F.col(text_col).cast("string").alias("t")) \
        .mapInArrow(counted, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The most frequent words of ``counts``, as many as its different words
    ask for, and the number of all words.  Only words as frequent as the last
    of them, to a power of two, are sorted."""
    bins = {r.bits: r for r in counts.groupBy(F.length(F.bin("n")).alias("bits"))
            .agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()}      # 64 rows at most
    size = vocabulary_size(sum(r.words for r in bins.values()))
    bits, above = 65, 0
    while bits > 1 and above < words_of(size):
        bits -= 1
        above += bins[bits].words if bits in bins else 0
    often = counts.where(F.col("n") >= (1 << bits - 1))
    top = often.orderBy(F.desc("n"), "h").limit(words_of(size)).select("h").toArrow()
    return Vocabulary(top["h"].to_pylist(), size), sum(r.tokens for r in bins.values())


def shards(docs: DataFrame, vocab: Vocabulary, tokens: int, text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """The encoded texts as a written table: a row per shard with the hashes of
    its different texts, their lengths and their ids one after the other.

    A text repeated within a task is handed on once, so copies are combined
    before they are shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)
    kind = np.uint16 if vocab.size <= 1 << 16 else np.uint32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, h, sizes in hashed(batches, "t"):
            words, ends = shared.value.ids_of(h).astype(kind), np.cumsum(sizes).tolist()
            keys, ids = [], []
            for key, lo, hi in zip(part["key"].to_pylist(), [0, *ends], ends):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    ids.append(words[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["key", "ids"])
            if len(seen) > _SEEN:       # bounded: later copies are met again in the shard
                seen.clear()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, parts = None, [], []

        def row() -> pa.RecordBatch:
            sizes = np.array([len(p) // kind().itemsize for p in parts], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.array(keys, np.int64).tobytes()]),
                                               pa.array([sizes.tobytes()]), pa.array([b"".join(parts)])],
                                              ["shard", "keys", "sizes", "ids"])

        for batch in batches:
            for s, key, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if s != now:
                    if parts:
                        yield row()
                    now, keys, parts = s, [], []
                if not keys or keys[-1] != key:
                    keys.append(key)
                    parts.append(ids)
        if parts:
            yield row()

    n = max(1, -(-tokens // shard))
    texts = python_ready(docs).select(F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("t")) \
        .where(F.col("t").isNotNull())
    dealt = texts.mapInArrow(encode, "key bigint, ids binary").where(F.octet_length("ids") > 0) \
        .select(F.pmod("key", F.lit(n)).alias("shard"), "key", "ids") \
        .repartition(-(-n // 2), "shard").sortWithinPartitions("shard", "key")
    path = scratch_path(spark, "lm-shards")
    dealt.mapInArrow(deal, "shard bigint, keys binary, sizes binary, ids binary").write.parquet(path)
    return spark.read.schema("shard bigint, keys binary, sizes binary, ids binary").parquet(path)


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, sizes, ids) of every shard."""
    kind = np.uint16 if size <= 1 << 16 else np.uint32
    for batch in batches:
        for i in range(batch.num_rows):
            keys, sizes, ids = (batch.column(c)[i].as_py() for c in ("keys", "sizes", "ids"))
            yield np.frombuffer(keys, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(ids, kind)


def _round(dealt: DataFrame, size: int, weights: dict[str, np.ndarray], rate: float) -> dict[str, np.ndarray]:
    """One pass over every shard from common weights, averaged by tokens."""
    shared = dealt.sparkSession.sparkContext.broadcast(pack(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = 0, 0
        for _, sizes, ids in _texts(batches, size):
            trainer = Trainer(unpack(shared.value, size), rate)
            trainer.feed(ids, sizes)
            total = total + pack(trainer.w).astype(np.float64) * trainer.tokens
            tokens += trainer.tokens
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.full(len(total), float(tokens))),
                 *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(_WIDTH)]], names)

    names = ["i", "n", *[f"w{j}" for j in range(_WIDTH)]]
    summed = dealt.mapInArrow(run, ", ".join(["i int", *[f"{c} double" for c in names[1:]]])) \
        .groupBy("i").agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow()
    if not summed.num_rows:
        return weights
    order = np.argsort(summed["i"].to_numpy())
    a = np.stack([summed[c].to_numpy()[order] for c in names[1:]], axis=1)
    return unpack(a[:, 1:] / a[:, :1], size)


def train(dealt: DataFrame, size: int, rate: float = 0.05, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights for a vocabulary of ``size`` ids from the table of :func:`shards`."""
    weights = _round(dealt.where(F.pmod("shard", F.lit(16)) == 0), size, start_weights(size), 2 * rate)
    for _ in range(rounds):
        weights = _round(dealt, size, weights, rate)
    return weights


def scores(dealt: DataFrame, size: int, weights: dict[str, np.ndarray]) -> DataFrame:
    """``key, n_tokens, logprob`` of every different text by the network."""
    shared = dealt.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, ids in _texts(batches, size):
            logp = np.empty(len(ids))
            for i, (flat, at) in enumerate(window_batches(ids, sizes, size)):
                logp[i * BATCH:i * BATCH + len(at)] = step(shared.value, flat, at, False)
            sums = np.add.reduceat(logp, np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes), pa.array(sums)], ["key", "n_tokens", "logprob"])

    return dealt.mapInArrow(run, "key bigint, n_tokens bigint, logprob double")


def rare_words(docs: DataFrame, vocab: Vocabulary, counts: DataFrame, text_col: str = "text") -> DataFrame:
    """``key`` (hash of a text), ``rare``: sum of the log-probabilities, given
    their buckets, of the text's words beyond the vocabulary."""
    # an Arrow table needs no Python workers of its own; as bounded as the broadcast vocabulary
    frequent = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"h": vocab.keys.view(np.int64)})))
    bits = bucket_bits(vocab.size)
    bucket = F.shiftrightunsigned("h", 64 - bits).cast("int")
    known = counts.join(frequent, "h", "left_anti").withColumn("bucket", bucket)
    totals = {r.bucket: r.total for r in known.groupBy("bucket").agg((F.sum("n") + F.count("*") + 1).alias("total")).collect()}
    total = F.get(F.lit([float(totals.get(i, 1)) for i in range(1 << bits)]), bucket)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, h, sizes in hashed(batches, "t"):
            found = [], [], []
            if len(seen) > _SEEN:
                seen.clear()
            beyond, ends = shared.value.ids_of(h) >= shared.value.words, np.cumsum(sizes).tolist()
            for key, lo, hi in zip(part["key"].to_pylist(), [0, *ends], ends):
                if key in seen:
                    continue
                seen.add(key)
                u, n = np.unique(h[lo:hi][beyond[lo:hi]], return_counts=True)
                for to, x, own in zip(found, (np.full(len(u), key, np.int64), u.view(np.int64), n.astype(np.int64)),
                                      (key, key, 0)):
                    to += [x, np.array([own], np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in found], ["key", "h", "n"])

    texts = python_ready(docs).select(F.xxhash64(text_col).alias("key"), F.col(text_col).cast("string").alias("t")) \
        .where(F.col("t").isNotNull())
    pairs = texts.mapInArrow(run, "key bigint, h bigint, n bigint")
    logp = F.log(F.coalesce("seen", F.lit(1)) / total)
    # a text met in several tasks gives its words, and its own row of n = 0, as often
    return pairs.join(known.select("h", F.col("n").alias("seen")), "h", "left") \
        .groupBy("key").agg((F.sum(F.col("n") * logp) / F.count_if(F.col("n") == 0)).alias("rare"))


def pseudo_likelihood(docs: DataFrame, text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """Train on all documents and score every word of every one of them:
    ``docs`` without the text, with ``n_tokens``, ``logprob``, ``mean_logprob``."""
    counts = reliable(word_counts(docs, text_col))
    vocab, tokens = vocabulary(counts)
    dealt = shards(docs, vocab, tokens, text_col, shard)
    weights = train(dealt, vocab.size)
    docs = docs.drop("n_tokens", "logprob", "mean_logprob")
    key, rare = free_name(docs, "_key"), free_name(docs, "_rare")
    rares = rare_words(docs, vocab, counts, text_col).select(F.col("key").alias(key), F.col("rare").alias(rare))
    known = scores(dealt, vocab.size, weights).withColumnRenamed("key", key).join(rares, key, "left")
    rows = docs.withColumn(key, F.xxhash64(text_col)).drop(text_col).join(known, key, "left")
    n = F.coalesce("n_tokens", F.lit(0).cast("long"))
    total = F.coalesce(F.col("logprob") + F.coalesce(rare, F.lit(0.0)), F.lit(0.0))
    kept = [c for c in docs.columns if c != text_col]
    return rows.select(*[F.col(f"`{c}`") for c in kept], n.alias("n_tokens"), total.alias("logprob"),
                       F.when(n > 0, total / n).alias("mean_logprob"))
