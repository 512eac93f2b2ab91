"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (a
shorter item is one window).  A window's tokens are its word shingles, ordered
by rarity in the corpus (counted over all documents).  A document contains
the window only if it contains *all* of its shingles, so joining the
necessary prefix, here the single rarest shingle, loses nothing; windows whose
rarest shingle never occurs are out at once.  A match gives the place the
window would have: it must lie inside the document (positional bound) with as
many words as it has (length bound); then its words are compared.

The benchmark side is handled in blocks of at most ``BLOCK_BYTES`` of item
text, each broadcast to one pass over the documents, so what is broadcast is
bounded however large the benchmark is.  Documents are never shuffled.
A block has no bound on its different words: one item may be of any length.

Defined results: null and wordless texts have no words and no hits; wordless
items have no window; a repeated item id counts once, with the windows of all
its rows; a null item id is written as the empty string; repeated documents
each get their row; of equally rare shingles the one with the smaller code
counts; very long texts are cut into words whole, in one task; empty tables
give no rows or no hits; extra columns of the documents are kept, but for
their own ``n_words``, ``hits`` and ``items``, which the results replace.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import python_ready, reliable, text_bytes

#: Item text per block; an item beyond it is a block alone.
BLOCK_BYTES = 4 << 20
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_TABLE).split() if text else []


class Windows:
    """One block's item windows: vocabulary, shingles, rarest shingle first."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[tuple(ids[i:i + window])].add(item)
        self.windows = sorted(owners)
        self.items = [sorted(owners[w]) for w in self.windows]
        # codes are modulo 2**64: of very many words two shingles may share one,
        # which costs a comparison, as every match is compared word by word
        self.base = len(self.vocab) + 1 | 1
        self.shingle = shingle
        # windows shorter than a shingle are one token as long as themselves
        self.sizes = sorted({min(shingle, len(w)) for w in self.windows})
        self.codes = {k: np.unique(np.array([c for w in self.windows if min(shingle, len(w)) == k
                                             for c in self._tokens(w)], dtype=np.int64)) for k in self.sizes}
        self.heads: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _tokens(self, ids: tuple[int, ...]) -> list[int]:
        k = min(self.shingle, len(ids))
        out = []
        for i in range(len(ids) - k + 1):
            code = 0
            for x in ids[i:i + k]:
                code = code * self.base + x + 1
            out.append((code + (1 << 63)) % (1 << 64) - (1 << 63))
        return out

    def places(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per shingle size: positions in the document and the block's tokens there."""
        for k in self.sizes:
            if len(ids) < k:
                continue
            # shift a running start: only positions all of whose words are known
            code, known = ids[:len(ids) - k + 1] + 1, ids[:len(ids) - k + 1] >= 0
            for j in range(1, k):
                nxt = ids[j:len(ids) - k + 1 + j]
                code, known = code * self.base + nxt + 1, known & (nxt >= 0)
            pos = np.flatnonzero(known)
            codes, have = code[pos], self.codes[k]
            at = np.searchsorted(have, codes)
            ok = (at < len(have)) & (have[np.minimum(at, len(have) - 1)] == codes)
            yield k, pos[ok], at[ok]

    def rank(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingle as its prefix: (size, token) -> windows and offsets."""
        heads = defaultdict(list)
        for w, ids in enumerate(self.windows):
            k = min(self.shingle, len(ids))
            tokens = np.searchsorted(self.codes[k], self._tokens(ids)).tolist()
            count, token, offset = min((counts.get((k, t), 0), t, o) for o, t in enumerate(tokens))
            if count:
                heads[k, token].append((w, offset))
        self.heads = dict(heads)
        self.prefix = {k: np.array(sorted(t for kk, t in self.heads if kk == k), dtype=np.int64) for k in self.sizes}

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrences ``[start, end)`` of windows and the items they belong to."""
        ids, found, items, n = self.ids(words), set(), set(), len(words)
        for k, pos, token in self.places(ids):
            rare = np.isin(token, self.prefix[k])
            for q, t in zip(pos[rare].tolist(), token[rare].tolist()):
                for w, offset in self.heads[k, t]:
                    start, length = q - offset, len(self.windows[w])
                    if start < 0 or start + length > n:           # positional and length bounds
                        continue
                    if tuple(ids[start:start + length].tolist()) == self.windows[w]:
                        found.add((start, start + length))
                        items.update(self.items[w])
        return sorted(found), items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str,
                block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks of at most ``block_bytes`` of text (an
    item beyond that is a block alone), one block at a time on the driver."""
    items = benchmark.where(F.col(text_col).isNotNull()) \
        .select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                F.col(text_col).cast("string").alias("text")).distinct() \
        .withColumn("size", F.octet_length("text") + 16)
    items = reliable(items.withColumn("h", F.xxhash64("item", "text")))
    todo = [(1, 0)]
    while todo:
        parts, part = todo.pop()
        mine = items.where(F.pmod("h", F.lit(parts)) == part)
        n, size = mine.agg(F.count("*"), F.sum("size")).first()
        if n > 1 and size > block_bytes:
            todo += [(2 * parts, part), (2 * parts, part + parts)]
        elif n:
            yield [(r.item, r.text.encode()) for r in mine.select("item", "text").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (merged word spans ``{s, e}``) and
    ``items`` (sorted ids of the items with a window in the document)."""
    docs = docs.drop("n_words", "hits", "items")
    out = docs.withColumn("n_words", F.lit(None).cast("long")) \
        .withColumn("hits", F.lit(None).cast("array<struct<s:bigint,e:bigint>>")) \
        .withColumn("items", F.lit(None).cast("array<string>"))
    blocks = 0
    for items in item_blocks(benchmark, item_col, item_text_col, block_bytes):
        if blocks:   # several blocks: each pass stands on the written result of the last
            out = reliable(out)
        out = _pass(out, docs, Windows(items, window, shingle), text_col)
        blocks += 1
    if not blocks:
        out = _pass(out, docs, Windows([], window, shingle), text_col)
    return out


def _pass(out: DataFrame, docs: DataFrame, block: Windows, text_col: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(block)          # at most BLOCK_BYTES of item text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        sums = {k: np.zeros(len(c), dtype=np.int64) for k, c in w.codes.items()}
        for batch in batches:
            for t in text_bytes(batch.column(0)):
                for k, _, token in w.places(w.ids(words_of(t))):
                    sums[k] += np.bincount(token, minlength=len(sums[k]))
        for k, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())],
                ["k", "token", "n"])

    texts = python_ready(docs).select(F.col(text_col).cast("string").alias("t"))
    # one row per token of the block at most
    rows = texts.mapInArrow(count, "k int, token int, n bigint").groupBy("k", "token").agg(F.sum("n").alias("n"))
    block.rank({(r.k, r.token): r.n for r in rows.collect()} if block.windows else {})
    ranked = sc.broadcast(block)
    at = out.columns.index(text_col)
    first = len(out.columns) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = ranked.value
        for batch in batches:
            old = zip(batch.column(first + 1).to_pylist(), batch.column(first + 2).to_pylist())
            n, hits, items = [], [], []
            for t, (h0, i0) in zip(text_bytes(batch.column(at).cast(pa.string())), old):
                words = words_of(t)
                spans, found = w.hits(words)
                n.append(len(words))
                hits.append([{"s": s, "e": e} for s, e in _merged([*[(x["s"], x["e"]) for x in h0 or ()], *spans])])
                items.append(sorted({*(i0 or ()), *found}))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:first], pa.array(n, pa.int64()),
                 pa.array(hits, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                 pa.array(items, pa.list_(pa.string()))], batch.schema.names)

    return out.mapInArrow(run, out.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract columns derived from ``hits`` and ``items``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")) \
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)) \
        .withColumn("contaminated", F.col("n_hit") > 0)
