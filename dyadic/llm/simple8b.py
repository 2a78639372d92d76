"""Token ids in binary files, Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and 60 bits of data: the selector says
how many ids of which width follow.  Each word takes the longest run that
fits.  An id of 2^60 or more has no width: selector 0 is the escape, its
data count the raw 64-bit words that follow it.

File layout (little endian)::

    "S8IDS001"
    blocks: words, 8 bytes each
    block table, 3 x u64 each: first byte, number of words, number of ids
    document table: ids i64, null marks u8, number of ids i64
    u64 number of blocks, u64 number of documents, u64 first byte of the tables
    "S8IDS001"

A block holds up to ``BLOCK`` ids, so a reader decodes any block alone, with a
few array operations per selector, whatever its documents are.

Spark range-partitions the texts by id; each task sorts its range and writes
one file under a name of its own attempt; the table of files that succeeded is
what readers follow, so files of lost attempts are never read.  Files go to
the shared folder through its own file system.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dyadic.session import scratch_path

from .common import release_memory, stored, tokenizer_file
from .tokens import ROWS_AT_ONCE, ByteCoder, worker_coder

MAGIC = b"S8IDS001"
BLOCK = 1 << 16
END_ID = 0

# Fixed values of Simple-8b: selector -> (ids in a word, bits of each)
WIDTHS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8),
          10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 0
_COUNT = np.array([WIDTHS.get(s, (0, 0))[0] for s in range(16)], dtype=np.int64)


def _longest(v: np.ndarray) -> np.ndarray:
    """For each place the selector of the longest run starting there that fits
    (0 where the id itself needs an escape)."""
    n = len(v)
    top = int(v.max(initial=0))
    best = np.full(n, 15, dtype=np.uint8)
    if top >= 1 << 60:
        best[v >= 1 << 60] = ESCAPE
    fits = best == 15  # runs of the selector before; ever longer runs of ever smaller ids fit only where it did
    for s in range(14, 1, -1):
        many, bits = WIDTHS[s]
        if many > n:
            break
        fits = fits[:n - many + 1]
        if top >> bits:
            small = v < (1 << bits)
            fits = fits & small[:len(fits)]
            for k in range(1, many):
                fits &= small[k:k + len(fits)]
            if not fits.any():
                break
        best[:len(fits)][fits] = s
    return best


def encode_block(ids: np.ndarray) -> np.ndarray:
    v = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(v)
    best = _longest(v)
    step = _COUNT[best]
    step[step == 0] = 1
    jumps, starts, i = step.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += jumps[i]
    at = np.array(starts, dtype=np.int64)
    sel = best[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel).tolist():
        if s == ESCAPE:
            continue
        many, bits = WIDTHS[s]
        w = np.flatnonzero(sel == s)
        for k in range(many):
            words[w] |= v[at[w] + k] << np.uint64(bits * k)
    raw = sel == ESCAPE
    if not raw.any():
        return words
    # an escape word stands before each raw word
    place = np.arange(len(words)) + np.cumsum(raw)
    out = np.zeros(len(words) + int(raw.sum()), dtype=np.uint64)
    out[place] = words
    out[place[raw] - 1] = (np.uint64(ESCAPE) << np.uint64(60)) | np.uint64(1)
    out[place[raw]] = v[at[raw]]
    return out


def decode_block(words: np.ndarray, n_ids: int) -> np.ndarray:
    sel = (words >> np.uint64(60)).astype(np.int64)
    escaped = sel == ESCAPE
    raw = np.zeros(len(words), dtype=bool)
    if escaped.any():  # a raw word may look like anything: walk the escapes in order
        i, hits = 0, np.flatnonzero(escaped).tolist()
        for h in hits:
            if h < i:
                continue
            k = int(words[h] & np.uint64((1 << 60) - 1))
            raw[h + 1:h + 1 + k] = True
            i = h + 1 + k
    many = np.where(raw, 1, _COUNT[sel])
    first = np.cumsum(many) - many
    out = np.empty(int(many.sum()), dtype=np.uint64)
    for s in np.unique(sel[~raw]).tolist():
        if s == ESCAPE:
            continue
        per, bits = WIDTHS[s]
        w = np.flatnonzero((sel == s) & ~raw)
        word, to, mask = words[w], first[w], np.uint64((1 << bits) - 1)
        for k in range(per):
            out[to + k] = (word >> np.uint64(bits * k)) & mask
    if raw.any():
        out[first[raw]] = words[raw]
    if len(out) != n_ids:
        raise ValueError("a block does not hold the ids its table names")
    return out


def filesystem(path: str):
    """The file system of a shared path and the path inside it."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FileWriter:
    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at, self.blocks, self.docs, self.rest = len(MAGIC), [], [], np.zeros(0, np.uint64)

    def add(self, doc_ids: list, counts: list[int], ids: np.ndarray) -> None:
        self.docs += zip(doc_ids, counts, strict=True)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for lo in range(0, whole, BLOCK):
            self._block(ids[lo:lo + BLOCK])
        self.rest = ids[whole:]

    def _block(self, ids: np.ndarray) -> None:
        raw = encode_block(ids).astype("<u8").tobytes()
        self.out.write(raw)
        self.blocks.append((self.at, len(raw) // 8, len(ids)))
        self.at += len(raw)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self.out.write(np.array(self.blocks, dtype="<u8").tobytes())
        self.out.write(np.array([d or 0 for d, _ in self.docs], dtype="<i8").tobytes())
        self.out.write(np.array([d is None for d, _ in self.docs], dtype="u1").tobytes())
        self.out.write(np.array([n for _, n in self.docs], dtype="<i8").tobytes())
        self.out.write(np.array([len(self.blocks), len(self.docs), self.at], dtype="<u8").tobytes() + MAGIC)
        self.out.close()


class FileReader:
    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.src = self.fs.open_input_file(self.path)
        size = self.src.size()
        tail = self.src.read_at(32, size - 32)
        if tail[24:] != MAGIC or self.src.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no id file, or is cut short")
        n_blocks, n_docs, at = np.frombuffer(tail[:24], "<u8").tolist()
        raw = self.src.read_at(size - 32 - at, at)
        self.blocks = np.frombuffer(raw, "<u8", 3 * n_blocks).reshape(-1, 3).tolist()
        at = 24 * n_blocks
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        self.nulls = np.frombuffer(raw, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self.counts = np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs)

    def block(self, k: int) -> np.ndarray:
        at, n_words, n_ids = self.blocks[k]
        return decode_block(np.frombuffer(self.src.read_at(8 * n_words, at), "<u8"), n_ids)

    def documents(self):
        """The ids of each document in turn; at most one document and one
        block are held."""
        have, k = np.zeros(0, np.uint64), 0
        for n in self.counts.tolist():
            parts, got = [have], len(have)
            while got < n:
                parts.append(self.block(k))
                got += len(parts[-1])
                k += 1
            ids = np.concatenate(parts) if len(parts) > 1 else have
            yield ids[:n]
            have = ids[n:]


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts below ``folder`` in ascending doc_id order
    (null ids first, equal ids by a hash of the text, so that they may span
    files) and return the stored table of files: (part, file, n_docs, n_ids),
    ``part`` being the place of the file's range."""
    path = path or tokenizer_file("byte_bpe_50k.json")

    def run(batches):
        coder, out, total, docs_n = worker_coder(ByteCoder, path), None, 0, 0
        name = f"{folder}/ids-{uuid.uuid4().hex}.s8"
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(lo, ROWS_AT_ONCE)
                ids = part.column(0).to_pylist()
                if out is None:
                    out = FileWriter(name)
                got = [np.append(x, np.uint32(end_id)) for x in coder.encode(part.column(1))]
                v = np.concatenate(got).astype(np.uint64)
                out.add(ids, list(map(len, got)), v)
                total, docs_n = total + len(v), docs_n + len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]),
                 pa.array([docs_n], pa.int64()), pa.array([total], pa.int64())], names=["part", "file", "n_docs", "n_ids"])
        release_memory()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = d.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    return stored(ordered.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "id-files")


def read_ids(files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files.  ``start``
    counts the ids of all files before; the table of files has one row per
    write task, so its running sum is small."""
    before = F.coalesce(F.sum("n_ids").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = files.select("file", before.alias("before"))
    n = files.count()

    def run(batches):
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = FileReader(name)
                start = at + np.cumsum(r.counts) - r.counts
                crc, kept = [], []
                done = 0

                def rows(lo, hi):
                    cols = [pa.array(r.doc_ids[lo:hi], mask=r.nulls[lo:hi]), pa.array(start[lo:hi]),
                            pa.array(r.counts[lo:hi]), pa.array(crc, pa.int64())]
                    if keep_ids:
                        cols.append(pa.array(kept, pa.list_(pa.int64())))
                    return pa.RecordBatch.from_arrays(cols, names=names)

                for ids in r.documents():
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    if keep_ids:
                        kept.append(ids.astype(np.int64))
                    if len(crc) == 1000:
                        yield rows(done, done + 1000)
                        done, crc, kept = done + 1000, [], []
                if crc:
                    yield rows(done, done + len(crc))
        release_memory()

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return listed.repartition(max(1, n), "file").mapInArrow(run, schema)


def id_files(spark: SparkSession, docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Write the ids of ``docs`` to a fresh shared folder and read them back."""
    return read_ids(write_ids(docs, scratch_path(spark, "ids"), path), keep_ids)
