"""Shared helpers: reliable checkpoints, Arrow batch access, word tables.

Every operator cuts lineage with :func:`reliable`, which is
``DataFrame.checkpoint()`` in the folder the session names in
``spark.checkpoint.dir``: the rows survive lost executors, and with
``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes them once
nothing refers to them any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from webrake.session import checkpoint_dir, ship_package

#: ASCII white space of the word class ``[^\x20\x09-\x0D]+``.
WHITE = b" \t\n\x0b\x0c\r"


def reliable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def python_ready(df: DataFrame) -> DataFrame:
    """Make the package importable in the Python workers of ``df``'s session."""
    ship_package(df.sparkSession)
    return df


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (whatever columns it brings)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_bytes(col: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8 bytes."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def batches_of(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``limit`` bytes, so numpy
    work arrays stay small whatever the session's Arrow batch size is."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), n]
    for lo, hi in zip(edges, edges[1:]):
        yield batch.slice(lo, hi - lo)


_PRIME = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0..P**n and their inverses modulo 2**64 (grown on demand)."""
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            for base, slot in ((_PRIME, 0), (_INVERSE, 1)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                np.multiply.accumulate(p, out=p)
                _POWERS[slot:slot + 1] = [p]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer for 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


PIECE = 1 << 16


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of ``text``, in order.

    Works in pieces of about 64 KB cut at white space, so a very long text
    needs no more working memory than a short one."""
    return _piece_hashes(np.frombuffer(text, dtype=np.uint8))[1] if 0 < len(text) <= PIECE else text_hashes([text])[0]


def text_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes` of all ``texts``, one behind the other, and the
    number of words of each: numpy calls cost more than short texts do."""
    joined, out = b" ".join(texts), []
    border = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    sizes = np.zeros(len(texts), dtype=np.int64)
    lo, n = 0, len(joined)
    while lo < n:
        hi = n if n - lo <= PIECE else lo + PIECE
        if hi < n:
            cut = max(joined.rfind(w, lo, hi) for w in (b" ", b"\n", b"\t"))
            if cut <= lo:
                cut = min((c for c in (joined.find(w, hi) for w in (b" ", b"\n", b"\t")) if c >= 0), default=n)
            hi = max(cut, lo + 1)
        start, hashes = _piece_hashes(np.frombuffer(joined, dtype=np.uint8, count=hi - lo, offset=lo))
        out.append(hashes)
        first = int(np.searchsorted(border, lo, side="right"))          # texts before this one have no word here
        until = np.searchsorted(start, border[first:int(np.searchsorted(border, hi)) + 1] - lo)
        sizes[first:first + len(until)] += np.diff(until, prepend=0)
        lo = hi
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64), sizes


def _piece_hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and hashes of the words of a piece."""
    word = np.zeros(len(a) + 2, dtype=bool)
    word[1:-1] = (a != 32) & (a - np.uint8(9) > 4)
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    p, inv = powers(len(a))
    c = np.zeros(len(a) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((a + np.uint64(1)) * p[:len(a)], out=c[1:])
        return start, mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64))
