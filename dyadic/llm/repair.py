"""Repair of conversation structure by least edits.

The rows of a conversation, in order of their turns, are edited (Keep 0, Rerole
2, Delete 3, Insert 2, one more for a truncated row that stays) until the
initials of their roles read ``(s?(ua)+)?``.  Among the cheapest edits those
with the ASCII-least string of edit initials (the audit) are taken.

A state is what has been put out so far (nothing, s, ..u, ..a).  A dynamic
program gives every node (row, state) its least cost to the end; an arc of a
node is optimal if it keeps to that cost.  The optimal arcs are then ranked by
their audits of length 1, 2, 4, ...: a rank for length 2^(k+1) is that of the
pair of ranks of the arc and of the arc that its pointer reaches after 2^k
edits, and the pointers double with the ranks.  The least arc of a node is the
one of least rank; the initials that leave a node differ, so one pointer per arc
is enough.  The path is read off the doubled pointers.

Rows are range partitioned on (conversation, turn, ...), so a conversation may
span any number of tasks, and the stream of a partition is cut into blocks of at
most ``BLOCK`` rows of one conversation.  A conversation that lies inside one
block is finished there.  For the others each block gives its 4 x 4 matrix of
least costs; suffix products of the matrices (min, +), by doubling over the
block numbers, give the costs at its end; then each block ranks its arcs, and
the block's map of entry to exit state is composed by doubling again.  Only the
digest of such a conversation's text runs as one stream, over pieces of a
block's length that one task reads in order and does not hold: a SHA-256 has no
other form.  Equal rows are one row with a count before anything is sorted.

Defined cases: a null role or text is one space, a null conversation is a
conversation, null turns come first; rows of equal turns stand in order of role
and text; a conversation without rows has zeros, an empty audit and the digest
of nothing; an empty table gives no rows; other columns are not read; text and
conversations of any length are cut by rows only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLOCK = 20_000        # rows of a block
BLOCK_BYTES = 8 << 20  # text of a block, but for its last row
FAR = 1 << 40         # cost of what cannot be reached

# states: nothing put out, s, ..u, ..a; the last may end, and so may the first
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NEXT = (2, 2, 3, 2)   # state after one more user or assistant turn
ROLE = ("user", "user", "assistant", "user")
END = (0, 4, 2, 0)    # inserts that are still needed at the end, by cost
LEGAL = {"su", "ua", "au"}


# ---------------------------------------------------------------- damage
def damaged(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after the stated damage, equal
    rows with their number; a conversation that lost all its rows keeps one
    with n = 0."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))
    d = conv.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                    (F.crc32(key.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    d = d.select(
        "conv_id", F.when(kind != 0, F.col("turn")).alias("turn"),
        F.when(kind == 0, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"))
    return counted(d)


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows as one with the sum of ``n``; texts meet by their digest."""
    d = rows.withColumn("k", F.unhex(F.sha2("text", 256)))
    return d.groupBy("conv_id", "turn", "role", "k").agg(F.sum("n").alias("n"), F.first("text").alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``blank``, ``first`` (no equal role and text earlier in
    the conversation) and ``cut`` (truncated)."""
    last = F.substring(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    d = rows.withColumns({"blank": last == "", "cut": ~last.isin(".", "!", "?")})
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    least = (d.filter("n > 0 and not blank").groupBy(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("k").alias("__k"))
             .agg(F.min(place).alias("p")))
    least = least.select("__c", "__r", "__k", F.col("p.turn").alias("__t"), F.lit(True).alias("first"))
    on = (F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("turn").eqNullSafe(F.col("__t"))
          & (F.col("role") == F.col("__r")) & (F.col("k") == F.col("__k")))
    return (d.join(least, on, "left").withColumn("first", F.coalesce("first", F.lit(False)))
            .select("conv_id", "turn", "role", "text", "n", "blank", "first", "cut"))


# ---------------------------------------------------------------- least edits of a token string
# A row is one letter: the role's initial (x: none of s, u, a), in capitals if
# truncated, or d for a row that has to go.
def choices(token: str, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, state) of the edits of one row."""
    out = [("D", DELETE, state)]
    if token != "d":
        extra = TRUNCATED if token.isupper() else 0
        to = AFTER.get(token.lower(), (None,) * 4)[state]
        if to is not None:
            out.append(("K", KEEP + extra, to))
        out.append(("R", REROLE + extra, NEXT[state]))
    return out


CHOICES = {t: [choices(t, q) for q in range(4)] for t in "suaxSUAXd"}


def costs_to_end(tokens: str, end: list[int]) -> list[list[int]]:
    """Least cost from each node to the end, given those behind the tokens."""
    out = [list(end)]
    for t in reversed(tokens):
        after, here = out[-1], CHOICES[t]
        c = [min([w + after[q] for _, w, q in here[s]]) for s in range(4)]
        # inserts before the row; after two of them a state comes back
        c3, c2 = min(c[3], INSERT + c[2]), min(c[2], INSERT + c[3])
        out.append([min(c[0], INSERT + c2), min(c[1], INSERT + c2), c2, c3])
    out.reverse()
    return out


def last_costs() -> list[int]:
    return [min(END[0], FAR), END[1], END[2], END[3]]


def matrix(tokens: str) -> list[int]:
    """Least costs from each state before the tokens to each behind them."""
    cols = [costs_to_end(tokens, [0 if q == p else FAR for q in range(4)])[0] for p in range(4)]
    return [min(cols[p][q], FAR) for q in range(4) for p in range(4)]


def optimal_arcs(tokens: str, cost: list[list[int]], final: bool) -> tuple[list[int], list[int], list[int]]:
    """(tail, initial, head) of the optimal arcs; node = 4 * row + state.  At
    the end of a block that is not the last, nothing leaves a node."""
    tail, label, head = [], [], []
    n = len(tokens)
    for i in range(n + 1 if final else n):
        row, c = CHOICES[tokens[i]] if i < n else None, cost[i]
        for q in range(4):
            v = 4 * i + q
            if row is not None:
                for name, w, to in row[q]:
                    if w + cost[i + 1][to] == c[q]:
                        tail.append(v), label.append(ord(name)), head.append(v - q + 4 + to)
            elif q in (0, 3):
                continue
            if INSERT + c[NEXT[q]] == c[q]:
                tail.append(v), label.append(ord("I")), head.append(v - q + NEXT[q])
    return tail, label, head


def least_paths(tail: list[int], label: list[int], head: list[int], starts: list[int]) -> list[tuple[str, int]]:
    """The least audit from each start node and the node in which it ends."""
    t, h, m = np.asarray(tail, np.int64), np.asarray(head, np.int64), len(tail)
    rank = np.append(np.asarray(label, np.int64), 0)  # the last place stands for "no more edits"
    if m == 0:
        return [("", s) for s in starts]

    def best(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank[:m], t))
        lead = np.r_[True, t[order][1:] != t[order][:-1]]
        return t[order][lead], order[lead]

    def lookup(nodes: np.ndarray, keys: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, nodes), len(keys) - 1)
        return np.where(keys[at] == nodes, arcs[at], m)

    jump = np.append(lookup(h, *best(rank)), m)
    jumps = [jump]
    while (jump < m).any():
        _, rank = np.unique(rank * (m + 257) + rank[jump], return_inverse=True)  # pairs of ranks, ranked anew
        jump = jump[jump]
        jumps.append(jump)
    out = []
    for first in lookup(np.asarray(starts, np.int64), *best(rank)):
        path = np.array([first])
        for j in jumps:
            path = np.concatenate([path, j[path]])
        path = path[path < m]
        out.append((bytes(np.asarray(label, np.uint8)[path]).decode(), int(h[path[-1]]) if len(path) else -1))
    return out


def cheapest(tokens: str, end: list[int] | None = None) -> tuple[list[int], list[str], list[int]]:
    """Per entry state: least cost, audit and exit state.  ``end``: the costs
    behind the tokens, by default those of a conversation's end."""
    cost = costs_to_end(tokens, end if end is not None else last_costs())
    paths = least_paths(*optimal_arcs(tokens, cost, end is None), [0, 1, 2, 3])
    return (cost[0], [a for a, _ in paths],
            [q if at < 0 else at % 4 for q, (_, at) in enumerate(paths)])


def edited(audit: str, state: int, roles: list[str], texts: list[str], tokens: str) -> Iterator[str]:
    """The repaired ``role:text`` lines of one block, entered in ``state``."""
    i = k = 0
    for e in audit:
        if e == "I":
            yield ROLE[state] + ":"
            state = NEXT[state]
            continue
        t = tokens[i]
        i += 1
        if t == "d":
            continue
        if e == "K":
            yield f"{roles[k]}:{texts[k]}"
            state = AFTER[t.lower()][state]
        elif e == "R":
            yield f"{ROLE[state]}:{texts[k]}"
            state = NEXT[state]
        k += 1


# ---------------------------------------------------------------- blocks
STATS = ("blank", "duplicate", "truncated", "illegal", "turns")


class _Block:
    """Rows of one conversation that follow each other in a partition."""

    def __init__(self, conv, seq: int):
        self.conv, self.seq, self.rows, self.size = conv, seq, 0, 0
        self.tokens: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.n = dict.fromkeys(STATS, 0)
        self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None

    def add(self, r: dict, n: int, head: bool) -> None:
        """``n`` copies of a row; ``head``: the first of them is not a copy."""
        initial = r["role"][:1]
        if r["turn"] is not None and r["turn"] != self.last_turn:
            self.n["turns"] += 1
            self.first_turn = r["turn"] if self.first_turn is None else self.first_turn
            self.last_turn = r["turn"]
        if self.rows:
            self.n["illegal"] += self.last_role + initial not in LEGAL
        else:
            self.first_role = initial
        self.n["illegal"] += n - 1
        self.last_role = initial
        self.rows += n
        if r["blank"]:
            self.n["blank"] += n
        else:
            self.n["duplicate"] += n - head
        if head:
            self.n["truncated"] += r["cut"]
            t = initial if initial in ("s", "u", "a") else "x"
            self.tokens.append((t.upper() if r["cut"] else t) + "d" * (n - 1))
            self.roles.append(r["role"])
            self.texts.append(r["text"])
            self.size += len(r["text"])
        else:
            self.tokens.append("d" * n)

    def full(self) -> bool:
        return self.size >= BLOCK_BYTES


RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _done(conv, n: dict, gaps: int, cost: int, audit: str, sha: str) -> tuple:
    return conv, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost, audit, sha


def _finish(b: _Block) -> tuple:
    tokens = "".join(b.tokens)
    cost, audits, _ = cheapest(tokens)
    lines = "\n".join(edited(audits[0], 0, b.roles, b.texts, tokens))
    gaps = b.last_turn - b.first_turn + 1 - b.n["turns"] if b.first_turn is not None else 0
    return _done(b.conv, b.n, gaps, cost[0], audits[0], hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest())


def _types(id_type: T.DataType) -> tuple[T.StructType, T.StructType]:
    """Rows of results and of open blocks, side by side in one table."""
    long, text = T.LongType(), T.StringType()
    done = [T.StructField("conv_id", id_type), *[T.StructField(c, long) for c in RESULT[1:7]], T.StructField("audit", text),
            T.StructField("repaired_sha256", text)]
    block = [T.StructField("part", T.IntegerType()), T.StructField("seq", long),
             T.StructField("tokens", text), T.StructField("roles", T.ArrayType(text)), T.StructField("texts", T.ArrayType(text)),
             T.StructField("cost_of", T.ArrayType(long)), *[T.StructField(f"n_{c}", long) for c in STATS],
             T.StructField("first_turn", long), T.StructField("last_turn", long), T.StructField("first_role", text), T.StructField("last_role", text)]
    return T.StructType(done), T.StructType(block)


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Results of conversations that lie inside a partition and a block, and
    the blocks of the others (``part`` not null), in one written table."""
    id_type = rows.schema["conv_id"].dataType
    done, open_ = _types(id_type)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    # range bounds are kept by the driver, so they hold the beginning of a text
    ranged = rows.repartitionByRange(*order, F.substring("text", 1, 200)).sortWithinPartitions(*order, "text")
    ranged = ranged.withColumn("part", F.spark_partition_id())
    schema = T.StructType([*done.fields, *open_.fields])
    names = schema.names
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def open_row(b: _Block, part: int) -> dict:
        tokens = "".join(b.tokens)
        return {"conv_id": b.conv, "part": part, "seq": b.seq, "tokens": tokens, "roles": b.roles, "texts": b.texts, "cost_of": matrix(tokens),
                **{f"n_{c}": b.n[c] for c in STATS}, "first_turn": b.first_turn, "last_turn": b.last_turn,
                "first_role": b.first_role, "last_role": b.last_role}

    def run(batches):
        out, size, cur, part, first = [], 0, None, 0, True
        shut = False  # whether the current conversation already has a written block, or may begin in an earlier partition

        def rows_of(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    yield from b.slice(lo, 1000).to_pylist()

        def close(more: bool) -> None:
            nonlocal size
            whole = not (shut or more)
            out.append(dict(zip(RESULT, _finish(cur), strict=True)) if whole else open_row(cur, part))
            size += 0 if whole else cur.size + len(out[-1]["tokens"])

        def batch():
            nonlocal out, size
            b = pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in out], schema=arrow)
            out, size = [], 0
            return b
        for r in rows_of(batches):
            part = r["part"]
            if cur is None or r["conv_id"] != cur.conv:
                if cur is not None:
                    close(False)
                    first = False
                cur, shut = _Block(r["conv_id"], 0 if cur is None else cur.seq + 1), first
            left, head = r["n"], r["first"] and not r["blank"]
            while left:
                if cur.rows >= block or cur.full():
                    close(True)
                    cur, shut = _Block(cur.conv, cur.seq + 1), True
                n = min(left, block - cur.rows)
                cur.add(r, n, head)
                left, head = left - n, False
            if len(out) >= 2000 or size >= BLOCK_BYTES:
                yield batch()
        if cur is not None:
            close(True)  # the last conversation may go on in the next partition
        if out:
            yield batch()
    return stored(ranged.mapInArrow(run, schema), "conversations")


# ---------------------------------------------------------------- chains of blocks
def _product(a: str, b: str) -> Column:
    """(min, +) product of two 4 x 4 matrices in array columns."""
    at = lambda c, i: F.element_at(c, i + 1)
    return F.array(*[F.least(F.lit(FAR), *[at(a, 4 * q + r) + at(b, 4 * r + p) for r in range(4)])
                     for q in range(4) for p in range(4)])


def _doubled(chain: DataFrame, value: str, ahead: bool, join, most: int) -> DataFrame:
    """``value`` of each block combined with those of all blocks ahead of it
    (or behind), 2^k of them after k rounds."""
    step = 1
    while step < most:
        other = chain.select(F.col("conv_id").alias("c2"), (F.col("at") - step if ahead else F.col("at") + step).alias("a2"), F.col(value).alias("v2"))
        chain = chain.join(other, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("at") == F.col("a2")), "left")
        chain = stored(chain.withColumn(value, F.when(F.col("v2").isNull(), F.col(value)).otherwise(join(value, "v2"))).drop("c2", "a2", "v2"), "chain")
        step *= 2
    return chain


def _chained(blocks: DataFrame) -> DataFrame:
    """Results of the conversations that consist of several blocks."""
    one = Window.partitionBy("conv_id")  # rows of this window stand for BLOCK rows each
    line = one.orderBy("part", "seq")
    seam = F.lag("last_role").over(line)
    pair = F.concat(seam, F.col("first_role"))
    turn_before = F.last("last_turn", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    chain = blocks.select("conv_id", "part", "seq", "cost_of", *[f"n_{c}" for c in STATS], "first_turn", "last_turn", "first_role", "last_role")
    chain = chain.withColumns({
        "at": F.row_number().over(line) - 1, "m": F.count("*").over(one),
        # the seams between blocks: an illegal pair more, a turn counted twice
        "n_illegal": F.col("n_illegal") + F.when(seam.isNotNull() & ~pair.isin(*LEGAL), 1).otherwise(0),
        "n_turns": F.col("n_turns") - F.when(F.col("first_turn") == turn_before, 1).otherwise(0)})
    chain = stored(chain.drop("first_role", "last_role"), "chain")
    most = chain.agg(F.max("m")).first()[0] or 1
    sums = _doubled(chain.select("conv_id", "at", "cost_of"), "cost_of", True, _product, most)
    end = F.array(*[F.lit(c) for c in last_costs()])
    at_end = F.array(*[F.least(*[F.element_at("cost_of", 4 * q + p + 1) + F.element_at(end, p + 1) for p in range(4)]) for q in range(4)])
    suffix = sums.select(F.col("conv_id").alias("c3"), (F.col("at") - 1).alias("a3"), at_end.alias("end"), F.col("cost_of").alias("rest"))
    ends = chain.join(suffix, F.col("conv_id").eqNullSafe(F.col("c3")) & (F.col("at") == F.col("a3")), "left").select("conv_id", "part", "seq", "at", "m", "end")
    texts = blocks.select(F.col("conv_id").alias("c4"), F.col("part").alias("p4"), F.col("seq").alias("s4"), "tokens")
    ends = ends.join(texts, F.col("conv_id").eqNullSafe(F.col("c4")) & (F.col("part") == F.col("p4")) & (F.col("seq") == F.col("s4"))).drop("c4", "p4", "s4")
    kinds = T.StructType([*ends.drop("tokens", "end").schema.fields, T.StructField("cost", T.ArrayType(T.LongType())),
                          T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("exit", T.ArrayType(T.IntegerType()))])

    def solve(batches):
        for b in batches:
            got = [cheapest(t, e) for t, e in zip(b.column("tokens").to_pylist(), b.column("end").to_pylist(), strict=True)]
            keep = [c for c in b.schema.names if c not in ("tokens", "end")]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.string())),
                 pa.array([g[2] for g in got], pa.list_(pa.int32()))], [*keep, "cost", "audits", "exit"])
    solved = stored(ends.mapInArrow(solve, kinds), "solved")
    # the state in which a block is entered: the exits of all blocks before it, one after the other
    follow = lambda v, earlier: F.transform(earlier, lambda q: F.element_at(v, q + 1))
    through = _doubled(solved.select("conv_id", "at", "exit"), "exit", False, follow, most)
    entry = through.select(F.col("conv_id").alias("c5"), (F.col("at") + 1).alias("a5"), F.element_at("exit", 1).alias("state"))
    path = (solved.join(entry, F.col("conv_id").eqNullSafe(F.col("c5")) & (F.col("at") == F.col("a5")), "left")
            .withColumn("state", F.coalesce("state", F.lit(0)))
            .select("conv_id", "part", "seq", "at", "m", "state", F.element_at("cost", 1).alias("cost"), F.expr("element_at(audits, state + 1)").alias("audit")))
    path = stored(path, "path")
    one_row = chain.groupBy("conv_id").agg(*[F.sum(f"n_{c}").alias(c) for c in STATS], F.min("first_turn").alias("lo"), F.max("last_turn").alias("hi"))
    audit = path.groupBy(F.col("conv_id").alias("c6")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit"),
        F.max(F.when(F.col("at") == 0, F.col("cost"))).alias("cost"))
    sha = _digests(path, blocks)
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0))
    return (one_row.join(audit, F.col("conv_id").eqNullSafe(F.col("c6"))).join(sha, F.col("conv_id").eqNullSafe(F.col("c7")))
            .withColumn("gaps", gaps).select(*RESULT))


def _digests(path: DataFrame, blocks: DataFrame) -> DataFrame:
    """The digest of each conversation's repaired lines: a task streams the
    pieces of its conversations in order and keeps only the running digest."""
    b = blocks.select(F.col("conv_id").alias("c4"), F.col("part").alias("p4"), F.col("seq").alias("s4"), "tokens", "roles", "texts")
    whole = path.join(b, F.col("conv_id").eqNullSafe(F.col("c4")) & (F.col("part") == F.col("p4")) & (F.col("seq") == F.col("s4")))
    whole = whole.select("conv_id", "at", "m", "state", "audit", "tokens", "roles", "texts")
    id_type = path.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), T.StructField("at", T.IntegerType()), T.StructField("m", T.LongType()),
                           T.StructField("lines", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def lines(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                # every line ends with the mark that joins it to the next; the stream takes the last one back
                out = "".join(x + "\n" for x in edited(r["audit"], r["state"], r["roles"], r["texts"], r["tokens"]))
                yield pa.RecordBatch.from_pylist([{"conv_id": r["conv_id"], "at": r["at"], "m": r["m"], "lines": out.encode("utf-8", "surrogatepass")}],
                                                 schema=arrow)
    pieces = whole.mapInArrow(lines, schema).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at")
    final = T.StructType([T.StructField("c7", id_type), T.StructField("repaired_sha256", T.StringType())])
    arrow_final = to_arrow_schema(final)

    def run(batches):
        h, hold = hashlib.sha256(), b""
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["at"] == 0:
                    h, hold = hashlib.sha256(), b""
                if r["lines"]:
                    h.update(hold)
                    h.update(memoryview(r["lines"])[:-1])
                    hold = b"\n"
                if r["at"] == r["m"] - 1:
                    yield pa.RecordBatch.from_pylist([{"c7": r["conv_id"], "repaired_sha256": h.hexdigest()}], schema=arrow_final)
    return pieces.mapInArrow(run, final)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``RESULT`` for each conversation of ``rows`` (conv_id, turn, role, text
    without nulls, n)."""
    table = blocks_of(faults(rows), block)
    done = table.filter("part IS NULL").select(*RESULT)
    return done.unionByName(_chained(table.filter("part IS NOT NULL").drop(*RESULT[1:])))


def damage_and_repair(conv: DataFrame, block: int = BLOCK) -> DataFrame:
    return repair(damaged(conv), block)
