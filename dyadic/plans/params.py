"""Formula-initialised parameter tables for the scoring / importance
queries: every value is a counter draw of (id, stream, component), so the
same numbers are produced by Spark (tables built from the data's ids) and by
the SQL oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions.crng import crng_init, crng_init_np, crng_init_sql

STD = 0.5


def vec_table(ids: DataFrame, key: str, stream: int, k: int, std: float = STD,
              name: str = "vec") -> DataFrame:
    return ids.select(key, F.array(*[crng_init(key, stream, l, std) for l in range(k)]).alias(name))


def scalar_table(ids: DataFrame, key: str, stream: int, std: float = STD, name: str = "b") -> DataFrame:
    return ids.select(key, crng_init(key, stream, 0, std).alias(name))


def mat(rows: int, stream: int, cols: int, std: float = STD) -> np.ndarray:
    """rows x cols matrix, entry (a, b) = init(b, stream, a)."""
    return np.array([[crng_init_np(b, stream, a, std) for b in range(cols)] for a in range(rows)])


def init_sql(id_sql: str, stream, draw, std: float = STD) -> str:
    return crng_init_sql(id_sql, stream, draw, std)
