"""Iteration driver pieces (TR-9): lineage cuts into the shared checkpoint
folder, early stopping and the per-iteration history table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadic.session import scratch_path


def row_partitions(spark: SparkSession) -> int:
    """Shuffle partition count: a key with more than total / this many rows
    is hot (see :func:`dyadic.operators.joins.plan_salts`)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table_at(spark: SparkSession, path: str, schema) -> DataFrame:
    """A written table, without a job to find its schema."""
    return spark.read.schema(schema).parquet(path)


def _joined_by_shuffle(df: DataFrame) -> bool:
    return "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def cut(df: DataFrame, spread: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder (shared storage,
    survives the loss of an executor) and read it back: lineage ends there,
    the plan runs once, and later reads take only the columns they need.

    ``spread``: rebalance the rows first (the REBALANCE hint: adaptive
    execution deals rows into partitions of the advisory size, so the
    partition count follows the data size at any scale).  Row frames are
    deliberately not partitioned by an entity: a hot entity holding a third
    of the rows would make one task a third of every later scan; the grouped
    sums downstream combine per task anyway.  Rows that leave a join by
    shuffle are dealt out already (adaptive execution sizes its partitions and
    splits skewed ones), so they are not sent over the network once more."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    if spread and not _joined_by_shuffle(df):
        df = df.hint("rebalance")
    df.write.option("compression", "zstd").parquet(path)
    return table_at(spark, path, df.schema)


@dataclass
class History:
    """Per-iteration RMSE with the early-stop rule: stop when the gain
    prev - rmse falls below ``eps``."""
    eps: float = 0.0
    rows: list = field(default_factory=list)

    def add(self, it: int, train_rmse: float | None, test_rmse: float | None = None,
            objective: float | None = None) -> bool:
        """Record; return True if the fit should stop."""
        prev = self.rows[-1][1] if self.rows else None
        self.rows.append((it, train_rmse, test_rmse, objective))
        return prev is not None and train_rmse is not None and (prev - train_rmse) < self.eps

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(int(i), None if a is None else float(a), None if b is None else float(b),
              None if o is None else float(o)) for i, a, b, o in self.rows],
            "iter int, train_rmse double, test_rmse double, objective double")


KEYS_HELD = 200_000  # keys of one set that a task keeps before it hands their sums on


class TaskSums:
    """Sums by key that a task adds up over its Arrow batches, for several sets
    of keys at once; :meth:`ready` and :meth:`rest` hand on rows (set, key, n,
    v0..).  What is held is bounded by ``KEYS_HELD`` keys a set."""

    def __init__(self, names: list[str], wide: int):
        self.names, self.wide, self.held = names, wide, [[] for _ in names]

    def add(self, i: int, key, values: list) -> None:
        import numpy as np
        own, inv = np.unique(key, return_inverse=True)
        sums = np.stack([np.bincount(inv, c, len(own)) for c in values], axis=1)
        self.held[i].append((own, np.bincount(inv, minlength=len(own)), sums))

    def _merge(self, i: int) -> None:
        import numpy as np
        parts = self.held[i]
        own, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n, x = np.zeros(len(own), np.int64), np.zeros((len(own), parts[0][2].shape[1]))
        np.add.at(n, inv, np.concatenate([p[1] for p in parts]))
        np.add.at(x, inv, np.concatenate([p[2] for p in parts]))
        self.held[i] = [(own, n, x)]

    def _rows(self, i: int):
        import numpy as np
        import pyarrow as pa
        own, n, x = self.held[i].pop()
        cols = [pa.array(x[:, j]) if j < x.shape[1] else pa.array(np.zeros(len(own))) for j in range(self.wide)]
        return pa.RecordBatch.from_arrays([pa.array([self.names[i]] * len(own), pa.string()), pa.array(own), pa.array(n), *cols],
                                          ["set", "key", "n", *[f"v{j}" for j in range(self.wide)]])

    def ready(self):
        for i, h in enumerate(self.held):
            if sum(len(p[0]) for p in h) > KEYS_HELD:
                self._merge(i)
                if len(self.held[i][0][0]) > KEYS_HELD // 2:
                    yield self._rows(i)

    def rest(self):
        for i, h in enumerate(self.held):
            if h:
                self._merge(i)
                yield self._rows(i)

    @staticmethod
    def schema(wide: int) -> str:
        return "set string, key long, n long, " + ", ".join(f"v{j} double" for j in range(wide))


def group_sums(df: DataFrame, sets: list[tuple[str, str | None, list]]) -> DataFrame:
    """Several grouped sums over one scan and one shuffle.

    ``sets``: (name, key column or None for a global sum, [value columns]).
    A task adds its rows up by key in Arrow batches, for all sets at once, and
    hands on one row per set and key: ``(set, key, n, v0..v{L-1})``; those
    are summed after one exchange.  A value used by several sets is
    computed once, a null one adds nothing; a null key is no key.  A hot key
    costs one row per task."""
    import numpy as np
    wide = max(len(v) for _, _, v in sets)
    keys = list(dict.fromkeys(k for _, k, _ in sets if k is not None))
    values, places = {}, []
    for _, _, vals in sets:
        places.append([list(values).index(repr(v)) if values.setdefault(repr(v), v) is not None else 0 for v in vals])
    flat = df.select(*[F.col(k).cast("long").alias(f"k{i}") for i, k in enumerate(keys)],
                     *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"c{i}") for i, v in enumerate(values.values())])
    at = [None if k is None else keys.index(k) for _, k, _ in sets]
    nk, names = len(keys), [n for n, _, _ in sets]

    def run(batches):
        held = TaskSums(names, wide)
        for b in batches:
            if not b.num_rows:
                continue
            known = [None if c.null_count == 0 else c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns[:nk]]
            cols = [c.fill_null(0).to_numpy(zero_copy_only=False) for c in b.columns]
            for i, k in enumerate(at):
                key = np.zeros(b.num_rows, np.int64) if k is None else cols[k]
                x = [cols[nk + j] for j in places[i]]
                if k is not None and known[k] is not None:
                    key, x = key[known[k]], [c[known[k]] for c in x]
                held.add(i, key, x)
            yield from held.ready()
        yield from held.rest()
    return flat.mapInArrow(run, TaskSums.schema(wide)).groupBy("set", "key").agg(
        F.sum("n").alias("n"), *[F.sum(f"v{j}").alias(f"v{j}") for j in range(wide)])
