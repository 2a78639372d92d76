"""WARC archives: write pages as records, read them back from any split.

Writing: of records with equal payloads of at least ``REVISIT_BYTES`` bytes,
the one with the largest page id is a response and the others are revisits of
it; all others are responses.  Pages whose digest cannot repeat (its hash
bucket, one of 2^20, holds no repeated digest) are written straight from the
scan; only the rest is joined with the repeated digests.  Spark's own text
writer commits the files: a line is a record, the line separator is the empty
line pair that ends a record.

Reading: archives are cut into splits.  A task looks for every place in its
split that could begin a record (the magic and a header with a length) and
emits where that record's successor would start.  Payloads may hold the magic
themselves, so these are only candidates.  Inside a split chains are followed
locally; between splits pointer jumping from the file start doubles its reach
each round, and only records that the chain from offset 0 reaches are read.

Defined cases: a null payload is empty; a null url has no target header; a
null page id is written as such and read back null, and is a revisit only of a
page with an id; rows that repeat the largest page id of their group are all
responses; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.session import ensure_checkpoint_dir, scratch_path

from .common import stored
from .simple8b import filesystem

# Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 1000
BUCKETS = 1 << 20  # bounds the broadcast set of buckets with repeated digests
SPLIT = 4 << 20
HEADER_BYTES = 2048  # the first read of a header; longer ones are read on


def record_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                      payload.alias("payload"))
         .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
         .withColumn("payload_digest", F.sha1(F.col("payload").cast("binary"))))
    long_ = F.col("payload_bytes") >= REVISIT_BYTES
    again = stored(p.filter(long_).groupBy("payload_digest")
                   .agg(F.count("*").alias("n"), F.max("page_id").alias("response_id"))
                   .filter("n > 1 and response_id is not null").select("payload_digest", "response_id"), "repeated")
    bucket = F.pmod(F.xxhash64("payload_digest"), F.lit(BUCKETS))
    buckets = again.select(bucket.alias("bucket")).distinct()  # at most BUCKETS rows
    p = p.withColumn("bucket", bucket).join(F.broadcast(buckets.withColumn("maybe", F.lit(True))), "bucket", "left")
    single = p.filter(F.col("maybe").isNull() | ~long_).withColumn("refers_to", F.lit(None).cast("long"))
    rest = p.filter(F.col("maybe") & long_).join(again, "payload_digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")))
    cols = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
    return single.select(cols).unionByName(rest.select(cols))


def _record() -> Column:
    name = lambda col: F.concat(F.lit("<urn:page:"), F.coalesce(col.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("page_id"))),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", uri)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("refers_to"))),
                                 line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write_archives(pages: DataFrame, folder: str) -> str:
    """Write all pages as archives below ``folder``."""
    record_types(pages).select(_record().alias("value")).write.option("lineSep", END.decode()).text(folder)
    return folder


class _File:
    """Reads ranges of one archive, a buffer at a time."""

    def __init__(self, path: str, size: int):
        fs, inner = filesystem(path)
        self.src, self.size = fs.open_input_file(inner), size
        self.lo, self.raw = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not (self.lo <= at and at + n <= self.lo + len(self.raw)):
            self.lo = at
            self.raw = self.src.read_at(max(n, min(1 << 20, self.size - at)), at)
        return self.raw[at - self.lo:at - self.lo + n]

    def header(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """Fields, first byte of the block and first byte after the record."""
        n = HEADER_BYTES
        head = self.read(at, n)
        if not head.startswith(MAGIC):
            return None
        end = head.find(END)
        while end < 0 and n < self.size - at:  # a header has no greatest length
            cut = head.rfind(b"\r\n")
            if cut > len(MAGIC) and any(b":" not in line for line in head[len(MAGIC):cut].split(b"\r\n")):
                return None
            seen, n = max(0, len(head) - len(END) + 1), 2 * n
            head = self.read(at, n)
            end = head.find(END, seen)
        if end < 0:
            return None
        fields = {}
        for line in head[len(MAGIC):end].split(b"\r\n"):
            key, colon, value = line.partition(b":")
            if not colon:
                return None
            fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit() and len(length) < 16):
            return None
        block = at + end + len(END)
        after = block + int(length) + len(END)
        return (fields, block, after) if after <= self.size else None


def _splits(spark: SparkSession, folder: str, split: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select(
        F.col("path").alias("file"), F.col("length").alias("size"))
    cut = files.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))))
    return stored(cut, "splits")


def candidates(splits: DataFrame, split: int = SPLIT) -> DataFrame:
    """(file, at, leaves): every place that could begin a record, and where
    the chain from it leaves its split."""

    def run(batches):
        for b in batches:
            for name, size, lo in zip(*(b.column(k).to_pylist() for k in ("file", "size", "lo")), strict=True):
                f, hi = _File(name, size), min(lo + split, size)
                raw = f.src.read_at(min(hi + len(MAGIC) - 1, size) - lo, lo)
                at, succ = [], []
                k = raw.find(MAGIC)
                while k >= 0:
                    h = f.header(lo + k)
                    if h is not None:
                        at.append(lo + k)
                        succ.append(h[2])
                    k = raw.find(MAGIC, k + 1)
                at, succ = np.array(at, dtype=np.int64), np.array(succ, dtype=np.int64)
                # local pointer jumping: a successor inside the split that is a candidate is replaced by its own
                while len(at):
                    near = np.searchsorted(at, succ)
                    hop = np.minimum(near, len(at) - 1)
                    inside = (at[hop] == succ) & (succ < hi)
                    if not inside.any():
                        break
                    succ = np.where(inside, succ[hop], succ)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(succ)], names=["file", "at", "leaves"])

    n = max(1, splits.count())
    return splits.repartition(min(n, 100_000), "file", "lo").mapInArrow(run, "file string, at long, leaves long")


def reached_entries(cand: DataFrame) -> DataFrame:
    """(file, at): where the chain from each file start enters its splits.
    Only places that some chain leaves to can be entries, so the jumps run on
    about one row per split; each round doubles the length of the jumps."""
    starts = cand.select("file", F.col("leaves").alias("at")).union(cand.select("file", F.lit(0).cast("long"))).distinct()
    jump = cand.join(starts, ["file", "at"], "left_semi").checkpoint()
    reach = jump.filter("at = 0").select("file", "at").checkpoint()
    n = reach.count()
    while True:
        step = reach.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        step = step.join(jump.select("file", "at"), ["file", "at"], "left_semi")
        reach = reach.union(step).distinct().checkpoint()
        m = reach.count()
        if m == n:
            return reach
        n = m
        two = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("far"))
        jump = (jump.join(two, ["file", "leaves"], "left")
                .select("file", "at", F.coalesce("far", "leaves").alias("leaves")).checkpoint())


def read_archives(spark: SparkSession, folder: str, split: int = SPLIT, keep_payload: bool = False,
                  whole: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to
    [, url, payload]) of every record that the chain reaches.  With ``whole``
    an archive whose chain does not end at its size is an error."""
    ensure_checkpoint_dir(spark)
    splits = _splits(spark, folder, split)
    cand = stored(candidates(splits, split), "candidates")
    entries = reached_entries(cand)
    sizes = splits.select("file", "size").distinct()
    if whole:
        ends = entries.join(cand, ["file", "at"]).select("file", F.col("leaves").alias("size"))
        broken = sizes.join(ends, ["file", "size"], "left_anti").head()
        if broken:
            raise ValueError(f"{broken['file']}: the records from its start do not end at its size")
    work = entries.join(sizes, "file").withColumn("hi", (F.floor(F.col("at") / split) + 1) * split)

    def number(v: str | None) -> int | None:
        v = (v or "").removeprefix("<urn:page:").removesuffix(">")
        return int(v) if v.lstrip("-").isdigit() else None

    def run(batches):
        for b in batches:
            for name, size, at, hi in zip(*(b.column(k).to_pylist() for k in ("file", "size", "at", "hi")), strict=True):
                f = _File(name, size)
                rows: list[tuple] = []
                while at < min(hi, size):
                    h = f.header(at)
                    if h is None:  # a broken archive: nothing after this place is reachable
                        break
                    fields, block, at = h
                    kind = fields.get("warc-type")
                    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "revisit":
                        body, n, digest = b"", int(fields.get("warc-payload-length", 0)), said
                    else:
                        body = f.read(block, at - len(END) - block)
                        n, digest = len(body), hashlib.sha1(body).hexdigest()
                        if said and said != digest:
                            raise ValueError(f"{name}: the record at {block} does not have its digest")
                    row = (number(fields.get("warc-record-id")), n, digest, kind, number(fields.get("warc-refers-to")))
                    rows.append(row + (fields.get("warc-target-uri"), body.decode("utf-8", "replace")) * keep_payload)
                    if len(rows) == 1000:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * 2 * keep_payload
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * keep_payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    schema = ", ".join(f"{n} {kinds[t]}" for n, t in zip(names, types, strict=True))
    n = max(1, entries.count())
    return work.repartition(min(n, 100_000), "file", "at").mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Write ``pages`` to a fresh shared folder and read the archives back."""
    return read_archives(spark, write_archives(pages, scratch_path(spark, "warc")), keep_payload=keep_payload, whole=True)
