"""Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the SHA-256 of its fields; the leaves of a source, in order of
their ids, are the bottom of a tree of fanout 16, and the sources' roots are
the bottom of one more tree of the same kind, whose root names the dataset.

Leaves are dealt into aligned blocks of 16^3 of one source, and a block hashes
its own subtree.  The upper levels are a butterfly exchange: in round k the 16
blocks that agree on all base-16 digits of their number but the k-th swap the
roots they hold, and each of them hashes the parent for itself.  So after
log16(blocks) rounds every block knows the tree's root and the siblings on its
whole upper path; no pass leads down again.  A block that the last, ragged
subtree lacks is replaced by another block of that subtree, which sends its
root to several groups.  A round ships a row or two per block (blocks are 4096
times fewer than rows); a source with a third of all rows is only many blocks.

``audit`` recomputes the dataset's root from each leaf of a second state of the
table and the proofs of the first.

Defined cases: a null field is ``-``, an empty text ``0:``; a null id is placed
first and is never tampered with; rows of equal ids stand in order of their
leaves; an empty table gives no rows; other columns are not read; a text of any
length is only ever hashed by its own task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import positions, stored

FANOUT = 16
DEPTH = 3  # levels of a block's own subtree
SPREAD = 64  # parts of a source in the lookup of its top proof

UP = "array<struct<before:string,after:string>>"


def field(c: str | Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(text: str | Column = "text") -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in ("doc_id", "source", "lang", "n_chars", text)]), 256))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def sides(nodes: list[str], fanout: int = FANOUT) -> list[tuple[str, str]]:
    """Per node the joined siblings of its run, those before and after it."""
    out = []
    for lo in range(0, len(nodes), fanout):
        run = nodes[lo:lo + fanout]
        whole = "".join(run)
        out += [(whole[:64 * j], whole[64 * (j + 1):]) for j in range(len(run))]
    return out


def subtree(nodes: list[str], levels: int | None, fanout: int = FANOUT) -> tuple[list[list[tuple[str, str]]], str]:
    """Sides on each level above ``nodes`` and the node on top: ``levels``
    levels, or with None as many as lead to a single node."""
    path: list[list[tuple[str, str]]] = []
    while len(path) < levels if levels is not None else len(nodes) > 1:
        path.append(sides(nodes, fanout))
        nodes = [digest(*nodes[lo:lo + fanout]) for lo in range(0, len(nodes), fanout)]
    return path, nodes[0]


def blocks_of(leaves: DataFrame, order: list, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """One row per block of ``leaves`` (tree, leaf, row), a tree's leaves in
    the given order: (tree, block, m, row list, leaf list, node), ``m`` being
    the blocks of the tree.  Written, as the exchange and the proofs read it."""
    size = fanout ** depth
    placed = positions(leaves, "tree", order)
    dealt = placed.withColumns({"block": F.expr(f"pos div {size}"), "m": F.expr(f"(n_rows + {size - 1}) div {size}")})
    held = (dealt.groupBy("tree", "block", "m").agg(F.sort_array(F.collect_list(F.struct("pos", "row", "leaf"))).alias("x"))
            .select("tree", "block", "m", F.col("x.row").alias("row"), F.col("x.leaf").alias("leaf")))
    schema = T.StructType([*held.schema.fields, T.StructField("node", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tops = [subtree([x.hex() for x in leaf], depth if m > 1 else None, fanout)[1]
                    for leaf, m in zip(b.column("leaf").to_pylist(), b.column("m").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tops, pa.string())], [*b.schema.names, "node"])
    return stored(held.mapInArrow(run, schema), "blocks")


def butterfly(blocks: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, block, root, up): the root of each block's tree and the sides of
    its path above the block, from the bottom up."""
    df = blocks.select("tree", "block", "m", "node", F.array().cast(UP).alias("up"))
    most = blocks.agg(F.max("m")).first()[0] or 1
    stride = 1
    while stride < most:
        df = _swap(df, stride, fanout)
        stride *= fanout
    return df.select("tree", "block", F.col("node").alias("root"), "up")


def _swap(df: DataFrame, stride: int, fanout: int) -> DataFrame:
    """One round: blocks that differ in one digit swap nodes and hash the
    parent.  ``lane`` is the lower digits, which all of a group share."""
    d = df.withColumns({
        "part": F.expr(f"block div {stride}"), "lane": F.expr(f"block % {stride}"),
        "last": F.expr(f"(m - 1) div {stride}")})
    d = d.withColumns({"digit": F.col("part") % fanout, "grp": F.expr(f"part div {fanout}"),
                       "held": F.when(F.col("part") < F.col("last"), F.lit(stride)).otherwise(F.col("m") - F.col("last") * stride)})
    # lanes that some block of the group has; those that a ragged subtree lacks are served by its other blocks
    lanes = F.when(F.col("digit") == 0, F.col("held")).otherwise(F.lit(stride))
    d = d.withColumn("to", F.explode(F.sequence(F.col("lane"), lanes - 1, F.col("held"))))
    met = d.groupBy("tree", "grp", "to").agg(
        F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("x"),
        F.collect_list(F.when(F.col("to") == F.col("lane"), F.struct("block", "m", "digit", "node", "up"))).alias("own"))
    met = met.select("tree", "x", F.sha2(F.array_join("x.node", ""), 256).alias("parent"), F.explode("own").alias("o"))
    near = lambda keep: F.array_join(F.transform(F.filter("x", keep), lambda y: y["node"]), "")
    step = F.struct(near(lambda y: y["digit"] < F.col("o.digit")).alias("before"),
                    near(lambda y: y["digit"] > F.col("o.digit")).alias("after"))
    open_ = F.col("o.m") > stride  # a smaller tree is whole already
    return met.select("tree", "o.block", "o.m", F.when(open_, F.col("parent")).otherwise(F.col("o.node")).alias("node"),
                      F.when(open_, F.array_append("o.up", step)).otherwise(F.col("o.up")).alias("up"))


def _paths(nodes: list[str], m: int, up: list[dict], fanout: int, depth: int):
    """For each leaf of a block, the sides of its whole path."""
    path, _ = subtree(nodes, depth if m > 1 else None, fanout)
    upper = [(u["before"], u["after"]) for u in up]
    for i in range(len(nodes)):
        yield [side[i // fanout ** k] for k, side in enumerate(path)] + upper


def top_tree(blocks: DataFrame, paths: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(source, root, up) of every source: the tree over the sources' roots."""
    kind = dict(blocks.dtypes)["tree"]
    subroots = paths.filter("block = 0").select(
        F.lit(0).alias("tree"), F.unhex("root").alias("leaf"), F.struct(F.col("tree").alias("source")).alias("row"))
    top = blocks_of(subroots, [F.col("row.source").asc_nulls_first()], fanout, depth)
    top = top.join(butterfly(top, fanout), ["tree", "block"])
    schema = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("up", T._parse_datatype_string(UP))])

    def run(batches):
        arrow = pa.schema([("row", b_row), ("root", pa.string()), ("up", b_up)])
        for b in batches:
            rows = b.select(["row", "leaf", "m", "root", "up"]).to_pylist()
            out = [{"row": row, "root": r["root"], "up": [{"before": x, "after": y} for x, y in p]}
                   for r in rows
                   for row, p in zip(r["row"], _paths([x.hex() for x in r["leaf"]], r["m"], r["up"], fanout, depth), strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
    from pyspark.sql.pandas.types import to_arrow_type
    row_type = T.StructType([T.StructField("source", T._parse_datatype_string(kind))])
    b_row, b_up = to_arrow_type(row_type), to_arrow_type(schema["up"].dataType)
    out = top.mapInArrow(run, T.StructType([T.StructField("row", row_type), T.StructField("root", T.StringType()), schema["up"]]))
    return out.select("row.source", "root", "up")


def manifest(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root and the proof (sides
    from the bottom up, as ``proof``); with ``tampered``, the leaf of another
    state of the row (null: unchanged), also the root that this state folds to
    and whether it verifies.  ``proof_sha256`` is the proof's digest."""
    other = (tampered if tampered is not None else F.lit(None)).cast("binary")
    leaves = docs.select(F.col("source").alias("tree"), leaf_of().alias("leaf"),
                         F.struct(F.col("doc_id"), other.alias("other")).alias("row"))
    blocks = blocks_of(leaves, [F.col("row.doc_id").asc_nulls_first(), F.col("leaf")], fanout, depth)
    paths = stored(butterfly(blocks, fanout), "paths")
    top = top_tree(blocks, paths, fanout, depth)
    # the hot source's blocks look their top path up in parts
    top = top.select(F.col("source").alias("s"), F.col("root").alias("top"), F.col("up").alias("over"),
                     F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    paths = (paths.withColumn("at", (F.col("block") % SPREAD).cast("int"))
             .join(top, F.col("tree").eqNullSafe(F.col("s")) & (F.col("at") == F.col("part")))
             .select(F.col("tree").alias("t"), F.col("block").alias("b"), F.col("root").alias("subroot"), "top", F.concat("up", "over").alias("up")))
    whole = blocks.join(paths, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))).select(
        "m", "row", "leaf", "subroot", F.col("top").alias("root"), "up")
    doc_type = next(f for f in docs.schema.fields if f.name == "doc_id")
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(doc_type.dataType)
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            b = None
            for r in rows:
                nodes = [x.hex() for x in r["leaf"]]
                proofs, folds = [], []
                for leaf, row, path in zip(nodes, r["row"], _paths(nodes, r["m"], r["up"], fanout, depth), strict=True):
                    proofs.append(digest(*[s for side in path for s in side]))
                    node = leaf if row["other"] is None else row["other"].hex()
                    for x, y in path:
                        node = digest(x, node, y)
                    folds.append(node)
                n = len(nodes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["doc_id"] for x in r["row"]], id_type), pa.array(nodes), pa.array([r["subroot"]] * n), pa.array([r["root"]] * n),
                     pa.array(proofs), pa.array(folds), pa.array([f == r["root"] for f in folds])],
                    ["doc_id", *names, "verified"])
    schema = T.StructType([T.StructField("doc_id", doc_type.dataType), *[T.StructField(x, T.StringType()) for x in names],
                           T.StructField("verified", T.BooleanType())])
    return whole.mapInArrow(run, schema)


def lowered(text: str = "text") -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit(docs: DataFrame) -> DataFrame:
    """The manifest next to a state in which every row whose id's CRC-32 five
    divides has its text lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, F.when(hit, leaf_of(lowered())))
