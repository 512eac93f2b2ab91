"""Quality rules: base statistics and a calibrated n-gram logistic regression.

The base statistics are exact over whole texts.  The classifier hashes word
1- and 2-grams and character 4-grams into a fixed number of bins, is trained
in numpy on a bounded sample of labelled rows (``max_rows``, smallest hashes
of the id first), and its margin is turned into a probability by Platt
scaling on the held-out fifth of that sample.  Scoring runs in Arrow batches
against fixed thresholds.

Defined results: null and blank texts have no words and fail the base rules;
null labels are not used for training; an id labelled more than once takes
part once per label; without both classes in the sample there is no model and
the base rules decide; repeated rows are scored alike; an empty table gives
an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import WHITE, mix, python_ready, text_bytes, word_hashes

#: Bins of the hashed features: words, word pairs, character 4-grams.
BINS = 2048
_PARTS = 3
#: Labelled rows the classifier is fitted on, at most.
MAX_ROWS = 2_000
_SYMBOLS = b"#*$%&|<>"
PIECE = 1 << 19


@dataclass(frozen=True)
class Rules:
    """Fixed thresholds."""
    min_words: int = 50
    max_repeat_percent: int = 50
    min_quality: float = 0.5


@dataclass(frozen=True)
class Model:
    """Weights of the hashed bins, margin offset and Platt slope/intercept."""
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        margin = features @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(hashes)
    if n < 4:
        return 0
    _, ids = np.unique(hashes, return_inverse=True)
    ids = ids.astype(np.int64)
    _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1].astype(np.int64) * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[k:n - 2 + k] |= again
    return int(hit.sum())


def base_counts(text: bytes | None, hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if not text:
        return 0, 0, 0, 0, 0
    solid = text.translate(None, WHITE)
    points = len(solid) - int(np.count_nonzero((np.frombuffer(solid, dtype=np.uint8) & 0xC0) == 0x80))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.strip(WHITE):
            dup += line in seen
            seen.add(line)
    return len(hashes), points, len(text) - len(text.translate(None, _SYMBOLS)), dup, repeated_words(hashes)


def features(text: bytes | None, hashes: np.ndarray) -> np.ndarray:
    """Relative frequencies of the hashed bins (square roots), one vector."""
    out = np.zeros(_PARTS * BINS, dtype=np.float32)
    if not text or not len(hashes):
        return out
    shift = np.uint64(64 - BINS.bit_length() + 1)
    with np.errstate(over="ignore"):
        pairs = mix(hashes[:-1] * np.uint64(31) + hashes[1:])
    for part, h in enumerate((hashes, pairs)):
        if len(h):
            out[part * BINS:(part + 1) * BINS] = np.bincount((h >> shift).astype(np.int64), minlength=BINS) / len(h)
    grams = np.zeros(BINS, dtype=np.int64)
    raw = np.frombuffer(text, dtype=np.uint8)
    for lo in range(0, max(0, len(raw) - 3), PIECE):
        a = raw[lo:lo + PIECE + 3].astype(np.uint32)
        code = a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)
        grams += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BINS.bit_length() + 1), minlength=BINS)
    if len(raw) > 3:
        out[2 * BINS:] = grams / (len(raw) - 3)
    return np.sqrt(out)


def _fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression (Adam), classes weighted alike."""
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    m = np.zeros(x.shape[1] + 1, dtype=np.float32)
    v = np.zeros(x.shape[1] + 1, dtype=np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -40, 40)))
        r = share * (p - y)
        g = np.append(r @ x + np.float32(l2) * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return w, float(b)


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the margin's probability (Newton steps, smoothed targets)."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, float(np.abs(margin).mean()))
    z = np.stack([margin / scale, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(hess, z.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
    return float(max(theta[0], 1e-3) / scale), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", max_rows: int = MAX_ROWS) -> Model | None:
    """Fit on at most ``max_rows`` labelled rows; features are computed on the
    executors, the driver gets ``max_rows`` vectors of fixed length."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .select(id_col, F.col(label_col).cast("int").alias("_y"))
    chosen = marks.orderBy(F.xxhash64(id_col), id_col, "_y").limit(max_rows)
    labelled = docs.select(F.col(text_col).cast("string").alias("_text"), id_col) \
        .join(F.broadcast(chosen), id_col).select("_text", id_col, "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = []
            for t in text_bytes(batch.column(0)):
                vecs.append(features(t, word_hashes(t or b"")).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(vecs, pa.binary())],
                                             ["id", "y", "vec"])

    id_type = docs.schema[id_col].dataType.simpleString()
    # repeated ids in the documents must not widen the sample: one row per id and label
    rows = python_ready(labelled).mapInArrow(run, f"id {id_type}, y int, vec binary") \
        .groupBy("id", "y").agg(F.min("vec").alias("vec")).collect()
    rows.sort(key=lambda r: (str(r.id), r.y))
    if not rows or len({int(r.y > 0) for r in rows}) < 2:
        return None
    # the held-out fifth stands last, so that both parts are views of one float32 table
    rows = [r for i, r in enumerate(rows) if i % 5] + rows[::5]
    fit = len(rows) - len(rows[::5]) if len(rows) >= 5 else len(rows)
    y = np.array([float(r.y > 0) for r in rows], dtype=np.float32)
    x = np.empty((len(rows), _PARTS * BINS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r.vec, dtype=np.float16)
    del rows
    if len(np.unique(y[:fit])) < 2 or len(np.unique(y[fit:])) < 2:
        fit = len(y)
    w, b = _fit(x[:fit], y[:fit], l2=1e-4)
    probe = slice(fit, None) if fit < len(y) else slice(None)
    slope, shift = _platt((x[probe] @ w + b).astype(np.float64), y[probe].astype(np.float64))
    return Model(w.astype(np.float32), b, slope, shift)


def score(docs: DataFrame, model: Model | None, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """``docs`` with the base statistics, ``base_failed``, ``quality`` (null
    without a model) and ``kept``."""
    added = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, " \
            "base_failed boolean, quality double, kept boolean"
    names = [c.split()[0] for c in added.split(", ")]
    docs = python_ready(docs).drop(*names)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # fixed size: 3 x BINS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            rows = []
            for t in text_bytes(batch.column(at).cast(pa.string())):
                h = word_hashes(t or b"")
                n, chars, symbols, dup, rep = base_counts(t, h)
                failed = n < rules.min_words or 100 * rep > rules.max_repeat_percent * n
                p = float(fitted.probability(features(t, h))) if fitted is not None else None
                rows.append((n, chars, symbols, dup, rep, failed, p,
                             not failed and (p is None or p >= rules.min_quality)))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, k) for c, k in zip(cols, kinds)]], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, {added}")


def quality_rules(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id",
                  text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs``."""
    return score(docs, train(docs, labels, "quality", id_col, text_col, max_rows), rules, text_col)
