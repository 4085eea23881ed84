"""What the vector operators share: usable rows, a join that hot keys cannot slow, Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that at least this share of all rows has is hot; so there are at most SLOTS hot keys.
SLOTS = 1024


def finite(vec: str) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    sound = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.coalesce(sound, F.lit(False))


def usable(vectors: DataFrame, vec: str) -> tuple[DataFrame, int, int]:
    """The rows whose vector is finite and as long as most are (of equally many the shorter), their length and number."""
    rows = vectors.where(finite(vec))
    sizes = rows.groupBy(F.size(vec).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    if not sizes:
        return rows, 0, 0
    return rows.where(F.size(vec) == sizes[0]["n"]), sizes[0]["n"], sizes[0]["rows"]


def matrix(column: pa.ListArray, dtype) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix."""
    flat = np.asarray(column.flatten(), dtype=dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def join_weighted(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, slots: int = SLOTS) -> DataFrame:
    """``rows`` with the columns of ``table`` (one row a key, each key of ``rows`` in it) but ``weight``; null keys are equal.

    ``weight`` is the number of rows that have the key. Keys of a ``slots``-th of all rows or more, at
    most ``slots`` of them whatever the input's size, are broadcast; rows of all other keys are shuffled,
    and no task gets more than a small share of them for one key.
    """
    renamed = table.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in table.columns if c not in keys))
    same = [rows[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    added = [c for c in table.columns if c not in keys and c != weight]
    hot = F.broadcast(renamed.where(F.col(weight) * slots >= total))
    cold = renamed.where(F.col(weight) * slots < total)
    by_hot = rows.join(hot, same, "inner").select(*rows.columns, *added)
    rest = rows.join(hot, same, "left_anti")
    return by_hot.unionByName(rest.join(cold, [rest[k].eqNullSafe(cold[f"__{k}"]) for k in keys], "inner").select(*rows.columns, *added))
