"""Byte-level BPE encoding and decoding with a segment tree.

Each match of the split pattern is encoded separately: a segment tree over its
byte positions keeps, at every node, the smallest (pair rank, position) below
it, so the root names the leftmost pair of minimum rank.  A merge changes
three leaves (the pair, the pair before it, and the place that died) and
updates the path above each, which costs the logarithm of the length.  The
trees of many pieces of like length stand side by side in one array and merge
in step; a piece that has no pair left drops out.  A few long pieces are
merged one by one instead.

Chunks and pieces that a worker has met are kept in bounded caches, so the
trees run once per distinct piece.  Defined cases: a null text is an empty
one (no ids); repeated rows and null ids give their own rows; other columns of
the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_file
from .tokens import CACHE_ENTRIES, ChunkCoder, spaced_chunks

CELLS = 1 << 19  # leaves that are merged side by side
ALONE = 12  # of so few rows each is merged by itself: array operations cost the same for one row as for many
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pairs.tolist()], dtype=np.int64)
        size = max(self.ranks.values()) + 1
        names: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            names[rank] = token
        self.lengths = np.array([len(x) for x in names], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(names), np.uint8)
        self._rank_of: dict[int, int] | None = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 where there is none."""
        key = left << 24 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], -1)

    def rank_of(self) -> dict[int, int]:
        """The pair table as a dictionary, made when first needed."""
        if self._rank_of is None:
            self._rank_of = dict(zip(self.pairs.tolist(), self.pair_rank.tolist(), strict=True))
        return self._rank_of

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.offsets[ids] - ends + n, n)
        return self.blob[at].tobytes()


def merge_side_by_side(vocab: Vocabulary, pieces: list[bytes], width: int) -> list[bytes]:
    """The ids (little-endian unsigned 32-bit bytes) of pieces of at most
    ``width`` bytes, ``width`` a power of two."""
    n = len(pieces)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    place = np.arange(width)
    token = np.where(place < sizes[:, None], vocab.bytes_of[raw], -1)
    after = np.where(place + 1 < sizes[:, None], place + 1, width)
    after = np.ascontiguousarray(after)
    before = np.broadcast_to(place - 1, (n, width)).copy()

    def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(rank < 0, _NONE, rank * width + at)

    tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
    pair = np.full((n, width), -1, dtype=np.int64)
    both = (place[:-1] + 1 < sizes[:, None])
    pair[:, :-1][both] = vocab.rank(token[:, :-1][both], token[:, 1:][both])
    tree[:, width:] = leaf(pair, place)
    lo = width
    while lo > 1:
        tree[:, lo // 2:lo] = np.minimum(tree[:, lo:2 * lo:2], tree[:, lo + 1:2 * lo:2])
        lo //= 2
    t, tok, aft, bef = tree.reshape(-1), token.reshape(-1), after.reshape(-1), before.reshape(-1)
    row = np.flatnonzero(tree[:, 1] != _NONE)
    while len(row):
        root = t[row * 2 * width + 1]
        here, merged = root % width, root // width
        base = row * width
        gone = aft[base + here]
        nxt = aft[base + gone]
        tok[base + here] = merged
        tok[base + gone] = -1
        aft[base + here] = nxt
        has = nxt < width
        bef[(base + nxt)[has]] = here[has]
        right = np.full(len(row), -1, dtype=np.int64)
        right[has] = vocab.rank(merged[has], tok[(base + nxt)[has]])
        prev = bef[base + here]
        had = prev >= 0
        up = row * 2 * width
        t[up + width + gone] = _NONE
        t[up + width + here] = leaf(right, here)
        touched = [gone, here]
        if had.any():
            p = prev[had]
            left = vocab.rank(tok[base[had] + p], merged[had])
            t[up[had] + width + p] = leaf(left, p)
            touched.append(np.where(had, prev, here))
        level = np.stack(touched) + width
        while level[0, 0] > 1:
            level >>= 1
            at = up + level
            t[at] = np.minimum(t[at + level], t[at + level + 1])
        row = row[t[up + 1] != _NONE]
    alive = token >= 0
    ids = token[alive].astype("<u4").tobytes()
    ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def merge_alone(vocab: Vocabulary, piece: bytes) -> bytes:
    """The ids of one piece of any length, with the same tree in flat arrays
    of machine integers (about 40 bytes of memory a byte)."""
    n = len(piece)
    width = 1 << max(0, n - 1).bit_length()
    codes = vocab.bytes_of[np.frombuffer(piece, np.uint8)].astype(np.int64)
    levels = [np.full(width, _NONE, dtype=np.int64)]
    rank = vocab.rank(codes[:-1], codes[1:])
    levels[0][:n - 1] = np.where(rank < 0, _NONE, rank * width + np.arange(n - 1))
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = array("q", [_NONE])  # the root is at 1, as in the trees side by side
    for level in reversed(levels):
        tree.frombytes(level.tobytes())
    del levels
    token, after, before = array("q"), array("q"), array("q")
    token.frombytes(codes.tobytes())
    after.frombytes(np.arange(1, n + 1).tobytes())
    before.frombytes(np.arange(-1, n - 1).tobytes())
    rank_of = vocab.rank_of().get

    def put(at: int, value: int) -> None:
        at += width
        tree[at] = value
        while at > 1:
            low = tree[at ^ 1]
            if value < low:
                low = value
            at >>= 1
            if tree[at] == low:
                return
            tree[at] = value = low

    while tree[1] != _NONE:
        merged, here = divmod(tree[1], width)
        gone = after[here]
        nxt = after[gone]
        token[here], token[gone], after[here] = merged, -1, nxt
        put(gone, _NONE)
        right = -1
        if nxt < n:
            before[nxt] = here
            right = rank_of(merged << 24 | token[nxt], -1)
        put(here, _NONE if right < 0 else right * width + here)
        prev = before[here]
        if prev >= 0:
            left = rank_of(token[prev] << 24 | merged, -1)
            put(prev, _NONE if left < 0 else left * width + prev)
    ids = np.frombuffer(token, np.int64)
    return ids[ids >= 0].astype("<u4").tobytes()


class Encoder(ChunkCoder):
    """Texts to ids with the vocabulary's ranks; pieces that the caches miss
    are merged side by side."""

    skip = 1  # the first chunk stands after an imagined line end, one token

    def __init__(self, path: str, entries: int = CACHE_ENTRIES // 2):
        super().__init__(entries)
        self.vocab = Vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        if b"\n" not in self.vocab.ranks:
            raise ValueError("the vocabulary has no token for a line end")

    def chunks(self, texts: pa.Array):
        return spaced_chunks(texts)

    def pieces(self, chunks: list[str]) -> list[list[str]]:
        split = self.split
        return [split(k if k[0] == "\n" else " " + k) for k in chunks]

    def ids_of_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[tuple[int, bytes]]] = {}
        for i, p in enumerate(pieces):
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.vocab.ranks.get(raw)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((i, raw))
        for width, group in by_width.items():
            step = max(1, CELLS // width)
            for lo in range(0, len(group), step):
                part = group[lo:lo + step]
                if len(part) <= ALONE:
                    ids = [merge_alone(self.vocab, raw) for _, raw in part]
                else:
                    ids = merge_side_by_side(self.vocab, [raw for _, raw in part], width)
                for (i, _), v in zip(part, ids, strict=True):
                    out[i] = v
        return out

    def ids_of_text(self, text: str) -> bytes:
        pieces = self.split(text)
        return b"".join(map(self.learn_pieces(set(pieces)).__getitem__, pieces))


_encoders: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every text; the
    last digest is over the bytes that the ids decode to."""
    path = path or tokenizer_file("byte_bpe_50k.tiktoken")

    def run(batches):
        enc = worker_encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 8000):
                part = b.slice(lo, 8000)
                n, sha, back, kept = [], [], [], []
                for ids in enc.encode(part.column(1)):
                    n.append(len(ids))
                    sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    back.append(hashlib.sha256(enc.vocab.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids.astype(np.int64))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int64()))] * keep_ids, names=names)

    d = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                        + ", ids array<long>" * keep_ids)
