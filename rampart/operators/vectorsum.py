"""Sums of long vectors that tasks have made, in two levels.

Each task offers one partial vector a key, cut by position into pieces. A key's pieces first meet
in about the square root of the tasks' number of groups, then once more, so no task reads more
than about the square root of the partials, however many tasks there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: doubles of a piece
PIECE = 1 << 17
#: partials of at most so many bytes in all are added on the driver
DRIVER_BYTES = 32 << 20


def pieces(vector: np.ndarray, piece: int = PIECE) -> list[tuple[int, bytes]]:
    """(piece number, little-endian doubles) of one vector."""
    v = np.ascontiguousarray(vector, "<f8").ravel()
    return [(i, v[a:a + piece].tobytes()) for i, a in enumerate(range(0, max(len(v), 1), piece))]


def add_up(vectors: Sequence[bytes]) -> bytes:
    total = np.frombuffer(vectors[0], "<f8").copy()
    for v in vectors[1:]:
        total += np.frombuffer(v, "<f8")
    return total.tobytes()


def sum_vectors(partials: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """(keys, piece, v): the sums of ``v`` (binary doubles) by keys and piece. ``parts`` is about the
    number of tasks that made the partials, whose numbers are in column ``part``. NULL keys are a
    key; an empty table gives no rows."""
    keys = list(keys)

    def add(t: pa.Table) -> pa.Table:
        return t.slice(0, 1).select(out).set_column(len(out) - 1, "v", pa.array([add_up(t.column("v").to_pylist())], pa.binary()))

    out = [*keys, "piece", "v"]
    types = dict(partials.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in out)
    salts = max(1, math.isqrt(max(parts, 1)))
    if salts > 1:
        salted = partials.withColumn("_salt", F.pmod(F.col("part"), F.lit(salts)))
        partials = salted.groupBy(*keys, "piece", "_salt").applyInArrow(add, schema)
    return partials.select(*out).groupBy(*keys, "piece").applyInArrow(add, schema)


def total(partials: DataFrame | RDD, size: int, parts: int) -> np.ndarray:
    """One vector of ``size`` doubles from partials without keys, rows or tuples of (part, piece, v): a few
    small partials are added on the driver, others in two levels (the driver then gets the sum alone)."""
    small, plain = parts * size * 8 <= DRIVER_BYTES, isinstance(partials, RDD)
    if small and plain:
        rows = [{"piece": piece, "v": v} for _, piece, v in partials.collect()]
    elif small:
        rows = partials.select("piece", "v").collect()
    else:
        rows = sum_vectors(partials.toDF("part long, piece long, v binary") if plain else partials, [], parts).collect()
    by: dict[int, list[bytes]] = {}
    for r in rows:
        by.setdefault(r["piece"], []).append(bytes(r["v"]))
    if not by:
        return np.zeros(size)
    return np.frombuffer(b"".join(add_up(by[k]) for k in sorted(by)), "<f8")
