"""Commit records of a fit (SNK-3): where a fit stands after each epoch, so that
one that was stopped goes on from its last complete epoch.

An epoch is a folder ``epoch=N`` with one Parquet table per parameter and, last
of all, a one-line record of scalars, small arrays and the history.  An epoch
without a finished record does not count.  Random draws are functions of (seed,
epoch, ...), so the epoch is the position of the generator too.  The last two
complete epochs are kept.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from dyadic.session import remove_path


def _plain(x):
    if isinstance(x, np.ndarray):
        return {"array": x.tolist()}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_plain(v) for v in x]
    return x.item() if isinstance(x, np.generic) else x


def _back(x):
    if isinstance(x, dict):
        return np.array(x["array"], dtype=float) if set(x) == {"array"} else {k: _back(v) for k, v in x.items()}
    return [_back(v) for v in x] if isinstance(x, list) else x


class Epochs:
    """The epochs of one fit below ``path`` (None: nothing is kept)."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path

    def _at(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def complete(self) -> list[int]:
        if self.path is None:
            return []
        at, fs = self._at()
        if not fs.exists(at):
            return []
        found = [re.fullmatch(r"epoch=(\d+)", s.getPath().getName()) for s in fs.listStatus(at)]
        return sorted(int(m[1]) for m in found if m and fs.exists(self._at(m[0], "record", "_SUCCESS")[0]))

    def last(self) -> tuple[int, dict, dict] | None:
        """(epoch, values, tables) of the last complete epoch."""
        done = self.complete()
        if not done:
            return None
        folder = os.path.join(self.path, f"epoch={done[-1]}")
        record = json.loads(self.spark.read.text(os.path.join(folder, "record")).first()[0])
        tables = {t: self.spark.read.parquet(os.path.join(folder, t)) for t in record["tables"]}
        return done[-1], _back(record["values"]), tables

    def commit(self, epoch: int, tables: dict[str, DataFrame], values: dict) -> None:
        if self.path is None:
            return
        folder = os.path.join(self.path, f"epoch={epoch}")
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(os.path.join(folder, name))
        line = json.dumps({"values": _plain(values), "tables": list(tables)})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(folder, "record"))
        for old in self.complete()[:-2]:
            remove_path(self.spark, os.path.join(self.path, f"epoch={old}"))
