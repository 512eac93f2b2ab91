"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of many texts lie as symbols in one flat array.  A round looks every
pair of neighbours up by binary search over the sorted pair keys, finds the
lowest rank of each word and merges all of its places at once; words without a
known pair leave the array.  A merge makes pairs of higher ranks only (checked
when the file is read), so a round does what merging one place after the other
would do.  Only words that are new to the worker are merged, the others are
gathered from what it knows.

A word of more than ``LONG`` symbols does not wait for its own lowest rank: a
pair is merged as soon as no pair within the longest token's reach on either
side has a lower rank.  What merges farther off can only arrive here as one
token that spans the whole reach, and there is none; a run of equal pairs is
merged when all of it is free, from its left end.

The vocabulary file is read on the driver and broadcast (its size is fixed by
the vocabulary).  Words follow the character classes of the tokenizers
library: code points that the regex library holds for letters or digits and
that one does not are put aside for a stand-in before the text is cut.

Nothing is shuffled.  Very long texts are cut before a white space that
follows another character, which always is a word border, so memory is
bounded by the row and a piece; bytes that are not UTF-8 count as U+FFFD.

Defined results: a null or empty text has no tokens and decodes to an empty
text; repeated rows each keep their row; ties of equal pairs go left to right;
an empty table gives an empty result; extra columns are kept, but for those
named like an added one, which are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from webrake.llm.common import batches_of, python_ready, text_bytes

#: How byte-level BPE cuts texts into words (fixed pattern of the file's kind).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more symbols are merged by reach instead of as a whole.
LONG = 2048
#: Texts are cut into words in pieces of about so many characters.
PIECE = 1 << 20
#: A worker forgets its words beyond so many bytes of them.
KNOWN_BYTES = 48 << 20
_NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary:
    printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary as arrays."""
    byte_ids: np.ndarray      # id of each single byte
    pair_keys: np.ndarray     # left id * 2**32 + right id, sorted
    pair_ranks: np.ndarray
    pair_ids: np.ndarray      # id that the pair merges to
    token_bytes: np.ndarray   # bytes of all tokens, by id
    token_ends: np.ndarray
    special: dict[str, int]   # strings that are one token wherever they stand
    apart: str                # regex class of code points with a stand-in, or ""
    reach: int                # bytes of the longest token


def _apart() -> str:
    """Code points that ``regex`` holds for letters or digits and the
    tokenizers library does not (the two know different Unicode versions)."""
    from tokenizers import Regex, normalizers
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found: list[int] = []
    for kind in (r"\p{L}", r"\p{N}"):
        mine = "".join(regex.findall(kind, every))
        found += map(ord, normalizers.Replace(Regex(kind), "").normalize_str(mine))
    found.sort()
    ranges = []
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def load(path: str) -> Vocabulary:
    """Read a tokenizer file of byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, cut = d["model"], d.get("pre_tokenizer") or {}
    plain = (model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
             and not cut.get("add_prefix_space") and not d.get("normalizer")
             and (d.get("decoder") or {}).get("type") == "ByteLevel"
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                "end_of_word_suffix", "byte_fallback", "ignore_merges")))
    added = d.get("added_tokens", [])
    if not plain or any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
        raise ValueError(f"{path} is not plain byte-level BPE")
    ids = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    letters = byte_letters()
    made = set(letters)
    for a, b in pairs:
        if a not in made or b not in made:
            raise ValueError(f"the merge of {a!r} and {b!r} stands before its parts")
        made.add(a + b)
    keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], dtype=np.int64)
    merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    byte_of = {c: i for i, c in enumerate(letters)}
    names = {i: s for s, i in ids.items()} | {t["id"]: t["content"] for t in added}
    tokens = [bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
              for s in (names.get(i, "") for i in range(max(names) + 1))]
    return Vocabulary(
        np.array([ids[c] for c in letters], dtype=np.int64), keys[order], order.astype(np.int64), merged[order],
        np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum([len(t) for t in tokens], dtype=np.int64),
        {t["content"]: t["id"] for t in added}, _apart(), max(map(len, tokens)))


def _ranks(voc: Vocabulary, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged id of pairs; ``_NEVER`` for those that do not merge."""
    key = (left << 32) | right
    at = np.minimum(np.searchsorted(voc.pair_keys, key), len(voc.pair_keys) - 1)
    known = voc.pair_keys[at] == key
    return np.where(known, voc.pair_ranks[at], _NEVER), voc.pair_ids[at]


def _lowest_near(rank: np.ndarray, reach: int) -> np.ndarray:
    """The least rank at most ``reach`` (or a little more) places away."""
    width = 1
    span = 2 * reach + 1
    low = np.concatenate([np.full(reach, _NEVER), rank, np.full(2 * span, _NEVER)])
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return low[:len(rank)]


def merge_words(voc: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the number of ids of each word."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    sym = voc.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    out_sym, out_word = [], []
    for big in (False, True):
        part = (sizes > LONG)[word] == big
        _merge(voc, sym[part], word[part], big, out_sym, out_word)
    if not out_sym:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    word = np.concatenate(out_word)
    order = np.argsort(word, kind="stable")
    return np.concatenate(out_sym)[order], np.bincount(word, minlength=len(words))


def _merge(voc: Vocabulary, sym: np.ndarray, word: np.ndarray, by_reach: bool,
           out_sym: list[np.ndarray], out_word: list[np.ndarray]) -> None:
    """Merge rounds; words leave in any order, each with its symbols in order."""
    rank, into = np.full(len(sym), _NEVER), np.zeros(len(sym), np.int64)
    fresh = np.flatnonzero(word[:-1] == word[1:])
    while len(sym):
        rank[fresh], into[fresh] = _ranks(voc, sym[fresh], sym[fresh + 1])
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        count = np.diff(np.append(first, len(sym)))
        least = np.minimum.reduceat(rank, first)
        done = np.repeat(least == _NEVER, count)
        if done.any():
            out_sym.append(sym[done])
            out_word.append(word[done])
            sym, word, rank, into = (x[~done] for x in (sym, word, rank, into))
            least, count = least[least != _NEVER], count[least != _NEVER]
            if not len(sym):
                return
        hit = rank == (_lowest_near(rank, voc.reach) if by_reach else np.repeat(least, count))
        hit &= rank != _NEVER
        # neighbouring places of one rank are a run of equal symbols: every other one, from the left
        run = np.concatenate(([True], rank[1:] != rank[:-1])) | (rank == _NEVER)
        start = np.flatnonzero(run)
        length = np.diff(np.append(start, len(rank)))
        if by_reach:
            hit &= np.repeat(np.minimum.reduceat(hit, start), length)
        hit &= (np.arange(len(rank)) - np.repeat(start, length)) % 2 == 0
        at = np.flatnonzero(hit)
        sym[at] = into[at]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))       # places after the right halves are gone
        sym, word, rank, into = (x[keep] for x in (sym, word, rank, into))
        touched = np.zeros(len(sym) + 1, dtype=bool)   # the merged and their left neighbours
        touched[new] = touched[new - 1] = True
        rank[touched[:-1]] = _NEVER
        fresh = np.flatnonzero(touched[:-2] & (word[:-1] == word[1:]))


class _Words(dict):
    """Numbers of words; a new word is put on ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        self.new.append(w)
        return n


class Encoder:
    """Encodes lists of texts and remembers their words."""

    def __init__(self, voc: Vocabulary) -> None:
        self.voc = voc
        self.words = regex.compile(PATTERN).findall
        self.border = regex.compile(r"(?<=\S)(?=\s)").search
        self.apart = regex.compile(f"[{voc.apart}]") if voc.apart else None
        names = sorted(voc.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._forget()

    def _forget(self) -> None:
        self.known, self.bytes, self.odd = _Words(), 0, np.empty(0, np.int64)
        self.ids, self.sizes, self.ends = [np.empty(0, np.int64) for _ in range(3)]

    def _learn(self) -> None:
        """Merge the new words of all texts at hand and append their ids."""
        new = [w.encode() for w in self.known.new]
        self.known.new = []
        ids, sizes = merge_words(self.voc, new)
        self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(sizes)])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.bytes += sum(map(len, new)) + 150 * len(new)

    def _numbers(self, words: list[str]) -> np.ndarray:
        before = len(self.known.new)
        found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.apart is not None:
            odd = [self.known[w] for w in self.known.new[before:] if not w.isascii() and self.apart.search(w)]
            if odd:
                self.odd = np.concatenate([self.odd, np.array(odd, np.int64)])
        return found

    def _cut(self, text: str) -> Iterator[np.ndarray]:
        """The numbers of the words of a text without special strings."""
        lo = 0
        while lo < len(text):
            hi = len(text)
            if hi - lo > PIECE:
                border = self.border(text, lo + PIECE)
                hi = border.start() if border else hi
            piece = text[lo:hi] if lo or hi < len(text) else text
            lo = hi
            found = self._numbers(self.words(piece))
            if len(self.odd) and not piece.isascii() and np.isin(found, self.odd).any():
                cut, at = [], 0
                for w in self.words(self.apart.sub("!", piece)):
                    cut.append(piece[at:at + len(w)])
                    at += len(w)
                found = self._numbers(cut)
            yield found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.bytes > KNOWN_BYTES:
            self._forget()
        parts = [[part if k % 2 else list(self._cut(part))
                  for k, part in enumerate(self.special.split(t) if self.special else [t])] for t in texts]
        if self.known.new:
            self._learn()
        return [b"".join(np.array([self.voc.special[p]], "<u4").tobytes() if isinstance(p, str)
                         else b"".join(map(self._ids, p)) for p in text) for text in parts]

    def _ids(self, at: np.ndarray) -> bytes:
        return _gather(self.ids, self.ends[at], self.sizes[at]).astype("<u4").tobytes()


def _gather(flat: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` with these ends and sizes, one after the other."""
    upto = np.cumsum(sizes)
    return flat[np.repeat(ends - upto, sizes) + np.arange(upto[-1] if len(upto) else 0)]


def decode_ids(voc: Vocabulary, ids: bytes) -> str:
    """The text of packed ids; ids that the vocabulary lacks are left out."""
    at = np.frombuffer(ids, dtype="<u4").astype(np.int64)
    at = at[at < len(voc.token_ends)]
    ends = voc.token_ends[at]
    sizes = ends - np.where(at > 0, voc.token_ends[at - 1], 0)
    return _gather(voc.token_bytes, ends, sizes).tobytes().decode("utf-8", "replace")


def _mapped(df: DataFrame, column: str, added: str, drop: tuple[str, ...], make) -> DataFrame:
    """``df`` without ``drop`` and with the columns that ``make()``'s function
    gives for the Arrow column ``column``, in slices of a few MB."""
    names = [c.split()[0] for c in added.split(", ")]
    df = python_ready(df).drop(*[n for n in names if n != column])
    at = df.columns.index(column)
    out = [f for f in df.schema.fields if f.name not in drop and f.name not in names]
    kept = [df.columns.index(f.name) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in batches_of(whole, whole.schema.names[at]):
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *work(batch.column(at))],
                                                 [*[f.name for f in out], *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return df.mapInArrow(run, f"{fields}, {added}" if fields else added)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``: the tokens of each text as
    packed little-endian unsigned 32-bit integers (see :func:`decode`)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))   # as large as the vocabulary

    def make():
        encoder = Encoder(shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids = encoder.encode([(t or b"").decode("utf-8", "replace") for t in text_bytes(texts)])
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        return work

    return _mapped(docs, text_col, "n_tokens bigint, ids binary", () if keep_text else (text_col,), make)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the packed ids in ``text_col``."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(path))

    def make():
        voc = shared.value
        return lambda ids: [pa.array([decode_ids(voc, x or b"") for x in ids.to_pylist()], pa.string())]

    return _mapped(tokens, ids_col, f"{text_col} string", (), make)
