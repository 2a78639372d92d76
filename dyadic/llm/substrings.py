"""Removal of long repeated byte strings with a run-length index.

Every 200-byte window has an anchor: the place inside it whose 32-byte string
hashes lowest (the leftmost of ties).  Equal windows have equal anchors at
equal distances, so a window can only repeat one whose anchor string is the
same.  A document is thus a series of contexts - the windows of one anchor,
at most 368 bytes - and work is dealt out by anchor string:

* an anchor string met once repeats nothing;
* one whose contexts are all equal repeats all their windows;
* the distinct contexts of the others go to shards of bounded size.  A shard
  builds the suffix order of its text, its Burrows-Wheeler transform as runs,
  and keeps samples at the run ends only: the common prefix of the two
  suffixes that meet there.  Matching statistics stream from those samples
  (inside a run each next place matches one byte less), and windows whose
  match is 200 bytes or more are marked;
* an anchor string with more contexts than a shard should hold is settled by
  counting its windows' hashes, which Spark combines in the map tasks.

Then each document's marked windows are merged and cut.  Documents are keyed
by a 128-bit hash of their text, so null or repeated ids do no harm.

Defined cases: a null text is empty; texts under 200 bytes keep everything; a
repeated row is another copy of its text; an empty table gives an empty
result; other columns pass through ``without_repeats`` unread.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_set, in_bit_set, release_memory, stored

LENGTH = 200
ANCHOR = 32
SHARD_BYTES = 2 << 20
CROWD = 4000  # contexts of one anchor string beyond which its windows are counted instead

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 17  # bytes hashed at a time


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]).astype(np.uint64))


_POW = _powers(_BASE, _STEP + ANCHOR)
_INV = _powers(pow(_BASE, -1, 1 << 64), _STEP + ANCHOR)


def anchor_hashes(b: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each ANCHOR-byte string."""
    out = []
    for lo in range(0, len(b) - ANCHOR + 1, _STEP):
        x = b[lo:lo + _STEP + ANCHOR - 1].astype(np.uint64) + np.uint64(1)
        c = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * _POW[:len(x)], out=c[1:])
        h = (c[ANCHOR:] - c[:-ANCHOR]) * _INV[:len(x) - ANCHOR + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if len(out) > 1 else out[0]


def contexts(b: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor place, first window, last window) of a text's contexts."""
    none = np.zeros(0, dtype=np.int64)
    if len(b) < length:
        return none, none, none, none
    h = anchor_hashes(b)
    w = length - ANCHOR + 1
    n = len(b) - length + 1  # windows
    # minima of blocks from both ends; the place in the block travels in the low bits, so ties go to the left
    bits = np.uint64(w.bit_length())
    pad = -len(h) % w
    x = np.concatenate([h >> bits << bits, np.full(pad, _M64 >> int(bits) << int(bits), np.uint64)]).reshape(-1, w)
    x = x | np.arange(w, dtype=np.uint64)
    left = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    right = np.minimum.accumulate(x, axis=1).ravel()[w - 1:w - 1 + n]
    block = np.arange(n) // w * w
    low = np.uint64((1 << int(bits)) - 1)
    place = np.where(left >> bits <= right >> bits, block + (left & low).astype(np.int64),
                     block + w + (right & low).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    return h[place[first]].view(np.int64), place[first], first, last


def _context_hash(raw: bytes, a: int, z: int) -> int:
    return xxhash.xxh3_64_intdigest(raw[a:z]) - (1 << 63)


def _text_key(raw: bytes) -> tuple[int, int]:
    k = xxhash.xxh3_128_intdigest(raw)
    return (k >> 64) - (1 << 63), (k & _M64) - (1 << 63)


def _seen(length: int):
    """Batches of texts to (h, c, n): contexts of a batch, counted."""

    def run(batches):
        for b in batches:
            hs, cs = [], []
            for t in b.column(0):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                h, _, first, last = contexts(np.frombuffer(raw, np.uint8), length)
                hs.append(h)
                cs += [_context_hash(raw, a, z + length) for a, z in zip(first.tolist(), last.tolist(), strict=True)]
            h, c = np.concatenate(hs) if hs else np.zeros(0, np.int64), np.array(cs, dtype=np.int64)
            o = np.lexsort((c, h))
            h, c = h[o], c[o]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(c[new]), pa.array(n.astype(np.int64))], names=["h", "c", "n"])
        release_memory()

    return run


def _cut_out(length: int, repeated, mixed):
    """Batches of texts to the contexts whose anchor string may repeat:
    (k1, k2, h, c, starts, windows, anchor, context), the context's bytes only where
    contexts of an anchor string differ, once a batch."""

    def run(batches):
        again, unlike = repeated.value, mixed.value
        for b in batches:
            rows: list[tuple] = []
            have: set[tuple[int, int]] = set()
            for t in b.column(0):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                h, place, first, last = contexts(np.frombuffer(raw, np.uint8), length)
                keep = in_bit_set(again, h) if len(h) else np.zeros(0, bool)
                if not keep.any():
                    continue
                key = _text_key(raw)
                own: dict[tuple[int, int], list] = {}
                for v, p, a, z, x in zip(h[keep].tolist(), place[keep].tolist(), first[keep].tolist(), last[keep].tolist(),
                                         in_bit_set(unlike, h[keep]).tolist(), strict=True):
                    k = (v, _context_hash(raw, a, z + length))
                    if k in own:
                        own[k][4].append(a)
                        continue
                    text = None
                    if x and k not in have:
                        have.add(k)
                        text = raw[a:z + length]
                    own[k] = [*key, *k, [a], z - a + 1, p - a, text]
                rows += own.values()
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _CUT_TYPES, strict=True)],
                                             names=["k1", "k2", "h", "c", "starts", "windows", "anchor", "context"])
        release_memory()

    return run


_CUT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary()]
_CUT_SCHEMA = "k1 long, k2 long, h long, c long, starts array<int>, windows int, anchor int, context binary"


def suffix_order(text: np.ndarray, packed: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of (at least) their first ``depth`` symbols, by
    prefix doubling on the ones that are still tied."""
    n = len(text)
    place = np.arange(n)
    order = np.argsort(packed, kind="stable")
    new = np.concatenate([[True], packed[order[1:]] != packed[order[:-1]]])
    head = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = head
    size = np.diff(np.append(np.flatnonzero(new), n))
    tied = order[np.repeat(size > 1, size)]
    h = SYMBOLS
    while len(tied) and h < depth:
        k1 = rank[tied]
        key = k1 * (n + 1) + rank[np.minimum(tied + h, n)] + 1
        o = np.argsort(key, kind="stable")
        s, key, k1 = tied[o], key[o], k1[o]
        m = np.arange(len(s))
        old = np.concatenate([[True], k1[1:] != k1[:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        slot = k1 + m - np.maximum.accumulate(np.where(old, m, 0))
        order[slot] = s
        rank[s] = slot[np.maximum.accumulate(np.where(new, m, 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(s)))
        tied = s[np.repeat(size > 1, size)]
        h *= 2
    return order


SYMBOLS = 7  # 9-bit symbols in a word


def _pack(text: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text.astype(np.int64), np.zeros(SYMBOLS, np.int64)])
    out = np.zeros(len(text), dtype=np.int64)
    for j in range(SYMBOLS):
        out = out << 9 | padded[j:j + len(text)]
    return out


def common_prefix(packed: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix lengths of suffix pairs, up to about ``most``."""
    n = len(packed)
    got = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + got[live], b[live] + got[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        d = packed[x] ^ packed[y]
        for j in range(1, SYMBOLS + 1):
            got[live] += d >> (9 * (SYMBOLS - j)) == 0
        live = live[(d == 0) & (got[live] < most)]
    return got


class RunLengthIndex:
    """Burrows-Wheeler runs of a text of separated strings, with the common
    prefix of the two suffixes that meet at each run boundary."""

    def __init__(self, strings: list[bytes], length: int):
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        self.ends = np.cumsum(sizes + 1) - 1
        raw[self.ends] = 0
        self.starts = self.ends - sizes
        packed = _pack(raw)
        # two suffixes agree at most over the rest of one string, a separator and another string
        depth = 2 * int(sizes.max()) + 2
        order = suffix_order(raw, packed, depth)
        bwt = np.where(order > 0, raw[order - 1], -1)
        self.run = np.flatnonzero(bwt[1:] != bwt[:-1])  # places where a run ends
        self.symbols = bwt[np.append(self.run, len(bwt) - 1)]
        self.last, self.next = order[self.run], order[self.run + 1]  # the samples
        self.edge_last, self.edge_next = order[-1], order[0]
        self.common = common_prefix(packed, self.last, self.next, depth)
        self.n = len(raw)

    def matching_statistics(self) -> np.ndarray:
        """At each place the longest match that starts anywhere else, streamed
        from the samples: inside a run a next place matches one byte less."""
        out = np.zeros(self.n, dtype=np.int64)
        place = np.arange(self.n)
        for at, edge in ((self.next, self.edge_next), (self.last, self.edge_last)):
            sample = np.full(self.n, -1, dtype=np.int64)
            sample[at] = self.common
            sample[edge] = 0
            source = np.maximum.accumulate(np.where(sample >= 0, place, 0))
            out = np.maximum(out, np.maximum(sample[source], 0) - (place - source))
        return out


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of its windows also stand in another one."""
    index = RunLengthIndex(strings, length)
    long_ = index.matching_statistics() >= length
    return [long_[a:z - length + 1] for a, z in zip(index.starts.tolist(), index.ends.tolist(), strict=True)]


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def _index_shard(length: int):
    """The distinct contexts of a shard to (h, c, first, last): the ranges of
    their windows that repeat."""
    side = (length - ANCHOR + 1) // 2  # a common window reaches this far on one side of the anchor

    def run(t: pa.Table) -> pa.Table:
        h, c = t.column("h").to_numpy(), t.column("c").to_numpy()
        n, anchor = t.column("n").to_numpy(), t.column("anchor").to_numpy()
        text = t.column("context").to_pylist()
        left = [xxhash.xxh3_64_intdigest(s[p - side:p]) if p >= side else None for s, p in zip(text, anchor.tolist(), strict=True)]
        right = [xxhash.xxh3_64_intdigest(s[p + ANCHOR:p + ANCHOR + side]) if len(s) >= p + ANCHOR + side else None
                 for s, p in zip(text, anchor.tolist(), strict=True)]
        met: dict = {}
        for k, (v, a, z) in enumerate(zip(h.tolist(), left, right, strict=True)):
            if a is not None:
                met.setdefault((v, 0, a), []).append(k)
            if z is not None:
                met.setdefault((v, 1, z), []).append(k)
        ask = sorted({k for group in met.values() if len(group) > 1 for k in group})
        found: dict[int, np.ndarray] = {}
        if ask:
            found = dict(zip(ask, repeated_windows([text[k] for k in ask], length), strict=True))
        out: tuple[list, ...] = ([], [], [], [])
        for k in range(len(text)):
            flags = np.ones(len(text[k]) - length + 1, bool) if n[k] > 1 else found.get(k)
            if flags is not None and flags.any():
                a, z = _ranges(flags)
                out[0].append(int(h[k]))
                out[1].append(int(c[k]))
                out[2].append(a)
                out[3].append(z)
        return pa.table({"h": pa.array(out[0], pa.int64()), "c": pa.array(out[1], pa.int64()),
                         "first": pa.array(out[2], pa.list_(pa.int32())), "last": pa.array(out[3], pa.list_(pa.int32()))})

    return run


def _window_hashes(length: int):
    def run(batches):
        for b in batches:
            for h, c, n, text in zip(*(b.column(k).to_pylist() for k in ("h", "c", "n", "context")), strict=True):
                m = len(text) - length + 1
                d = [xxhash.xxh3_64_intdigest(text[i:i + length]) - (1 << 63) for i in range(m)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * m, pa.int64()), pa.array([c] * m, pa.int64()), pa.array(range(m), pa.int32()),
                     pa.array(d, pa.int64()), pa.array([n] * m, pa.int64())], names=["h", "c", "i", "d", "n"])

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(k1, k2, a, z): byte ranges [a, z) of the text with that key that repeat;
    ranges may touch or overlap."""
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    seen = text.mapInArrow(_seen(length), "h long, c long, n long")
    known = stored(seen.groupBy("h").agg(F.sum("n").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
                   .filter("n > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    again = spark.sparkContext.broadcast(bit_set(known, "h"))
    unlike = spark.sparkContext.broadcast(bit_set(known.filter("mixed"), "h"))
    cut = stored(text.mapInArrow(_cut_out(length, again, unlike), _CUT_SCHEMA), "contexts")

    whole = (cut.select("k1", "k2", "h", "starts", "windows").join(known.filter("not mixed").select("h"), "h")
             .select("k1", "k2", F.explode("starts").alias("a"), "windows")
             .select("k1", "k2", "a", (F.col("a") + F.col("windows") - 1 + length).alias("z")))

    groups = stored(cut.join(known.filter("mixed").select("h"), "h")
                    .groupBy("h", "c").agg(F.sum(F.size("starts")).alias("n"), F.max("anchor").alias("anchor"),
                                           F.max("context").alias("context")), "distinct-contexts")
    crowded = groups.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > crowd).select("h")
    crowded = stored(crowded, "crowded")
    total = groups.agg(F.sum(F.length("context"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    few = groups.join(crowded, "h", "left_anti") if crowded.count() else groups
    indexed = (few.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
               .groupBy("shard").applyInArrow(_index_shard(length), "h long, c long, first array<int>, last array<int>"))
    windows = groups.join(crowded, "h").mapInArrow(_window_hashes(length), "h long, c long, i int, d long, n long")
    twice = windows.groupBy("h", "d").agg(F.sum("n").alias("n"), F.min("i").alias("i0"), F.max("i").alias("i1"))
    counted = (windows.select("h", "c", "i", "d").join(twice.filter("n > 1").select("h", "d"), ["h", "d"])
               .select("h", "c", F.array("i").alias("first"), F.array("i").alias("last")))
    marked = indexed.unionByName(counted)
    some = (cut.select("k1", "k2", "h", "c", "starts").join(marked, ["h", "c"])
            .select("k1", "k2", "starts", F.explode(F.arrays_zip("first", "last")).alias("r"))
            .select("k1", "k2", F.explode("starts").alias("s"), "r")
            .select("k1", "k2", (F.col("s") + F.col("r.first")).alias("a"), (F.col("s") + F.col("r.last") + length).alias("z")))
    return whole.unionByName(some).distinct()


def _remaining(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left, and the number of maximal removed runs; ``ranges`` in
    order, they may touch or overlap."""
    kept, end, spans = [], 0, 0
    for a, z in ranges:
        if spans == 0 or a > end:
            spans += 1
            kept.append(raw[end:a])
            end = z
        elif z > end:
            end = z
    kept.append(raw[end:])
    return b"".join(kept), spans


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row:
    ``row`` holds its columns but the text, ``kept`` the remaining bytes."""
    ranges = stored(repeated_ranges(docs, length).groupBy("k1", "k2")
                    .agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("ranges")), "ranges")
    words = docs.sparkSession.sparkContext.broadcast(bit_set(ranges, "k1"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    base = docs.select(row.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row_type = base.schema["row"].dataType.simpleString()

    def keyed(batches):
        """Only rows whose text may have ranges: those are joined."""
        for b in batches:
            raw = [t.as_py().encode("utf-8", "surrogatepass") for t in b.column(1)]
            keys = [_text_key(x) for x in raw]
            k1 = np.array([k for k, _ in keys], dtype=np.int64)
            hit = pa.array(in_bit_set(words.value, k1))
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(k1), pa.array([k for _, k in keys], pa.int64())],
                                             names=["row", "text", "k1", "k2"])
            yield out.filter(hit)

    def result(rows, raw, ranges):
        left = [_remaining(x, r) for x, r in zip(raw, ranges, strict=True)]
        return pa.RecordBatch.from_arrays(
            [rows, pa.array([len(x) for x in raw], pa.int64()),
             pa.array([len(x) - len(k) for x, (k, _) in zip(raw, left, strict=True)], pa.int64()),
             pa.array([n for _, n in left], pa.int64()),
             pa.array([hashlib.sha256(k).hexdigest() for k, _ in left], pa.string()),
             pa.array([k for k, _ in left], pa.binary())],
            names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    def untouched(batches):
        for b in batches:
            raw = [t.as_py().encode("utf-8", "surrogatepass") for t in b.column(1)]
            k1 = np.array([_text_key(x)[0] for x in raw], dtype=np.int64)
            keep = np.flatnonzero(~in_bit_set(words.value, k1))
            yield result(b.column(0).take(pa.array(keep)), [raw[i] for i in keep.tolist()], [[]] * len(keep))

    def cut(batches):
        for b in batches:
            raw = [t.as_py().encode("utf-8", "surrogatepass") for t in b.column(1)]
            rs = [[(r["a"], r["z"]) for r in x or ()] for x in b.column(2).to_pylist()]
            yield result(b.column(0), raw, rs)

    schema = f"row {row_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    joined = (base.mapInArrow(keyed, f"row {row_type}, text string, k1 long, k2 long")
              .join(ranges, ["k1", "k2"], "left").select("row", "text", "ranges"))
    return base.mapInArrow(untouched, schema).unionByName(joined.mapInArrow(cut, schema))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of their texts; a row of whose
    text nothing but white space is left goes.  Bytes of a character that was
    cut in two go with it; ``n_chars`` follows the text."""
    out = cut_repeats(docs, length)
    def decoded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.decode("utf-8", "ignore") for x in b.column(2).to_pylist()], pa.string())],
                names=["row", "n_removed", "text"])

    row_type = out.schema["row"].dataType.simpleString()
    left = out.select("row", "n_removed", "kept").mapInArrow(decoded, f"row {row_type}, n_removed long, text string")
    left = left.filter((F.col("n_removed") == 0) | F.col("text").rlike("\\S"))
    kinds = dict(docs.dtypes)

    def col(c: str):
        if c == "text":
            return F.col("text").cast(kinds[c]).alias(c)
        if c == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("text").cast(kinds[c])).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)

    return left.select(*[col(c) for c in docs.columns])
