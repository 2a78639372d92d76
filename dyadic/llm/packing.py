"""Best-fit packing by minimum bin slack.

Texts become token pieces of at most ``capacity`` ids (only longer texts are
cut); pieces are packed into sequences of that capacity.  What the search
needs is the histogram of piece lengths, which has at most ``capacity`` rows
for any corpus: per bin a bitset subset-sum dynamic program over the available
lengths finds the fullest feasible combination around the longest remaining
piece, and that combination is removed, as often as the counts allow at once.
The resulting plan (which lengths stand together in how many bins) is bounded
like the histogram.  Spark then ranks the pieces of each length - a length
shared by a third of all pieces spans many tasks - and each piece finds its
bin and offset from (length, rank).

Defined cases: a null or empty text is the end id alone; null or repeated ids
are packed like any others, and a repeated row is packed again; an empty table
gives no pieces; other columns of the input are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.operators.ranking import rank_within

from .common import release_memory, stored, tokenizer_file
from .tokens import ROWS_AT_ONCE, WordCoder, worker_coder

CAPACITY = 4096
END_ID = 1


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID,
                 keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text."""
    path = path or tokenizer_file("word_bpe_49k.json")
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int64())))

    def run(batches):
        coder = worker_coder(WordCoder, path)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(lo, ROWS_AT_ONCE)
                rows: list[list] = [[] for _ in fields]
                take: list[int] = []
                for i, ids in enumerate(coder.encode(part.column(1))):
                    ids = np.append(ids, np.uint32(end_id))
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        own = ids[a:a + capacity]
                        take.append(i)
                        vals = [k, a, len(own), zlib.crc32(own.tobytes())]
                        if keep_ids:
                            vals.append(own.astype(np.int64))
                        for r, v in zip(rows, vals, strict=True):
                            r.append(v)
                out = [part.column(0).take(pa.array(take, pa.int32()))]
                out += [pa.array(r, t) for r, (_, t) in zip(rows, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", *(n for n, _ in fields)])
        release_memory()

    d = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return d.mapInArrow(run, schema)


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most
    ``room``: bit s of a set says that sum s can be reached."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, many = min(available[length], room // length), 1
        while left > 0:  # counts by doubling: 1, 2, 4, ... and the rest
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << (length * many)) & mask
            left, many = left - many, many * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + many
            total -= length * many
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(number of bins, {length: pieces of it in each})], minimum bin slack."""
    left = {x: n for x, n in counts.items() if n > 0}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError("a piece is longer than the capacity, or empty")
    plan = []
    while left:
        longest = max(left)
        left[longest] -= 1
        bin_ = fullest({x: n for x, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(left[x] // m for x, m in bin_.items())
        plan.append((times, bin_))
        for x, m in bin_.items():
            left[x] -= times * m
            if not left[x]:
                del left[x]
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Per (length, first rank): pieces a bin, first bin, first offset."""
    rows, used, first_bin = [], {}, 0
    for times, bin_ in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            m = bin_[length]
            rows.append((length, used.get(length, 0), m, first_bin, offset))
            used[length] = used.get(length, 0) + times * m
            offset += length * m
        first_bin += times
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "many", "bin", "offset"), a.T, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``) plus ``sequence_id`` and ``offset``.  Reads
    ``pieces`` twice: pass a stored table."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(plan_bins(counts, capacity))
    ranked = rank_within(pieces, "length", ["doc_id", "piece"], rank="__rank")
    names = pieces.columns

    def run(batches):
        key = places["length"] << 44 | places["rank"]
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            rank = b.column("__rank").to_numpy().astype(np.int64)
            at = np.searchsorted(key, length << 44 | rank, side="right") - 1
            inside = rank - places["rank"][at]
            seq = places["bin"][at] + inside // places["many"][at]
            off = places["offset"][at] + inside % places["many"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)],
                                             names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
                     keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack all texts of ``docs``."""
    return pack(stored(token_pieces(docs, capacity, path, keep_ids=keep_ids), "pieces"), capacity)
