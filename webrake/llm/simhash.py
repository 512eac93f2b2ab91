"""SimHash near-duplicates by a byte-position inverted index with count filter.

A 64-bit fingerprint has eight positional bytes.  Two fingerprints at most
``max_bits`` bits apart differ in at most ``max_bits`` bytes, so they share at
least ``8 - max_bits`` positional bytes: the guaranteed minimum.  Postings of
single bytes would be a 1/256 part of the corpus each, so the index posts the
*sets* of that many positions: a pair reaches the minimum exactly when it
meets in a posting (for two bits: 28 sets of six positions, keys of 48 bits).
A posting leaves only ``8 * max_bits`` bits free, so it has at most 65,536
different fingerprints for two bits whatever the corpus size: a proven bound.
Inside a posting the shared positional bytes of the pairs that differ by at
most ``max_bits`` free bits are tallied, pairs reaching the minimum are
verified by bit distance, and a spanning forest of the verified pairs is
returned (links that it leaves out join texts already linked), never all
pairs of a group of copies.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; equal fingerprints are one node (any number of copies
costs one row); a null id never becomes a component id unless all ids of the
component are null; repeated rows each get their row; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import python_ready, reliable, text_bytes
from webrake.llm.components import components

#: Shingles hashed before their bits are counted (bounds the work arrays).
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles (repeats included) as an unsigned int."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[:-1]]
        spans = [(s, e - 1) for s, e in zip(starts, ends[shingle - 1:])]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(spans), BLOCK):
        h = np.array([digest(view[s:e], seed) for s, e in spans[i:i + BLOCK]], dtype=np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    bits = (2 * counts > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (signed 64 bits) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in text_bytes(batch.column(0))], dtype=np.uint64)
            cols = [batch.column(i + 1) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], [*keep, "fp"])

    src = python_ready(docs).select(F.col(text_col).cast("string").alias("_text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    return src.mapInArrow(run, f"{schema}, fp bigint")


def _position_sets(max_bits: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(8), 8 - max_bits))


def postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """One row per position set and fingerprint: ``set``, ``key`` (the bytes
    at the set's positions, the others zero) and ``free`` (the other bytes)."""
    entries = []
    for i, kept in enumerate(_position_sets(max_bits)):
        mask = sum(0xFF << (8 * p) for p in kept)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        entries.append(F.struct(F.lit(i).cast("byte").alias("set"),
                                F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    return fps.select("fp", F.explode(F.array(*entries)).alias("p")).select("p.set", "p.key", "fp")


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Verified spanning forest of one posting's fingerprints."""
    fps = np.unique(fps)
    free = np.bitwise_or.reduce(fps ^ fps[0])
    places = [b for b in range(64) if int(free) >> b & 1]
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    if len(fps) <= 64:   # few: compare directly
        i, j = np.triu_indices(len(fps), 1)
    else:                # many: look up the neighbours within max_bits free bits
        left, right = [], []
        for r in range(1, max_bits + 1):
            for bits in itertools.combinations(places, r):
                other = fps ^ np.uint64(sum(1 << b for b in bits))
                at = np.searchsorted(fps, other)
                hit = np.flatnonzero((at < len(fps)) & (fps[np.minimum(at, len(fps) - 1)] == other) & (other > fps))
                left.append(hit)
                right.append(at[hit])
        i, j = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (left, right))
    diff = fps[i] ^ fps[j]
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)          # tally of positional bytes
    reach = shared >= 8 - max_bits                                          # guaranteed minimum
    near = reach & (np.bitwise_count(diff) <= max_bits)                     # verified distance
    for a, b in zip(i[near].tolist(), j[near].tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((int(fps[a].view(np.int64)), int(fps[b].view(np.int64))))
    return out


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints (column ``fp``, each
    once) at most ``max_bits`` bits apart; enough of them to connect whatever
    is connected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for arr in batch.column(0) for e in _forest(arr.values.to_numpy().view(np.uint64), max_bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    # bounded: a posting has at most 2 ** (8 * max_bits) different fingerprints
    groups = postings(fps, max_bits).groupBy("set", "key").agg(F.collect_list("fp").alias("fps")) \
        .where(F.size("fps") > 1).select("fps")
    return groups.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, max_bits: int = 2, shingle: int = 3, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` and ``component_id``, the
    smallest id reachable over links of at most ``max_bits`` bits."""
    rows = reliable(fingerprints(docs, text_col, shingle, seed, (id_col,)))
    nodes = reliable(rows.groupBy("fp").agg(F.min(id_col).alias("first")))
    comp = components(links(nodes.select("fp"), max_bits))
    rooted = comp.join(nodes, comp.node == nodes.fp).select("fp", "root", "first")
    low = rooted.groupBy("root").agg(F.min("first").alias("low"))
    linked = rooted.join(low, "root").select("fp", "low")
    # written, so that the last join stands on two plain exchanges: a fingerprint
    # with very many copies is then split by adaptive skew handling
    named = reliable(nodes.join(linked, "fp", "left")
                     .select("fp", F.coalesce("low", "first").alias("component_id")))
    return rows.join(named, "fp").select(id_col, "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    """A signed 64-bit fingerprint column as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
