"""Cells of a quadtree that follows the density of points.

The tree starts from square cells of one size and splits each cell that holds more than
``capacity`` points into four, level by level. Counts come from a sample of at most about
``SAMPLE`` points (all of a small table), picked by a hash of their coordinates; no cell with fewer
than ``LEAST`` of them is split, so a level has at most ``SAMPLE / LEAST`` split cells, and these
are all that the tree knows and sends to tasks. Points belong to
one leaf each, boxes to every leaf they touch, and both meet by equality on
(level, cx, cy): a place where points crowd becomes many leaves and so many tasks, and
where there are few a leaf stays as large as the tree began. Results never depend on the tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 4096
SAMPLE = 50_000
LEAST = 16
DEPTH = 14
CELL = ("level", "cx", "cy")
_WIDE = 1 << 32


_LEAF = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType())])


def _is_in(keys: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    key = cx * _WIDE + cy % _WIDE
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


def _leaves(level: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64())], fields=[pa.field("level", pa.int32()), pa.field("cx", pa.int64()), pa.field("cy", pa.int64())])


@dataclass
class Quadtree:
    """Square cells of ``size`` at level 0; ``split`` holds the keys of the split cells of each level, in order.

    A tree without splits is a plain grid of column expressions. With splits, batches
    descend level by level in Arrow UDFs: a plan with an expression for each level
    would outgrow the compiler."""

    size: float
    split: list[np.ndarray] = field(default_factory=list)

    def _floor(self, v: np.ndarray, level: int) -> np.ndarray:
        return np.floor(v * 2.0**level / self.size).astype(np.int64)

    def _leaf_of(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        level = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        for k, keys in enumerate(self.split):
            open_ = open_[_is_in(keys, self._floor(x[open_], k), self._floor(y[open_], k))]
            level[open_] = k + 1
        return level, np.floor(x * 2.0**level / self.size).astype(np.int64), np.floor(y * 2.0**level / self.size).astype(np.int64)

    def _touched(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, level, cx, cy) of the leaves that boxes touch."""
        low_x, low_y = self._floor(x0, 0), self._floor(y0, 0)
        wide, high = self._floor(x1, 0) - low_x + 1, self._floor(y1, 0) - low_y + 1
        row = np.repeat(np.arange(len(x0)), wide * high)
        k = np.arange(len(row)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
        cx, cy = low_x[row] + k // high[row], low_y[row] + k % high[row]
        found = []
        for level in range(len(self.split) + 1):
            inner = _is_in(self.split[level], cx, cy) if level < len(self.split) else np.zeros(len(row), bool)
            found.append((row[~inner], np.full((~inner).sum(), level), cx[~inner], cy[~inner]))
            row, cx, cy = (np.repeat(v[inner], 4) for v in (row, cx, cy))
            part = np.tile(np.arange(4), inner.sum())
            cx, cy = cx * 2 + part // 2, cy * 2 + part % 2
            kept = (cx >= self._floor(x0, level + 1)[row]) & (cx <= self._floor(x1, level + 1)[row]) & (cy >= self._floor(y0, level + 1)[row]) & (cy <= self._floor(y1, level + 1)[row])
            row, cx, cy = row[kept], cx[kept], cy[kept]
        row, level, cx, cy = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], level[order], cx[order], cy[order]

    def place(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """``points`` with the leaf (level, cx, cy) of each; null without coordinates."""
        if not self.split:
            return points.withColumns({"level": F.lit(0), "cx": F.floor(F.col(x) / self.size), "cy": F.floor(F.col(y) / self.size)})

        @F.arrow_udf(_LEAF)
        def leaf(x: pa.Array, y: pa.Array) -> pa.Array:
            return _leaves(*self._leaf_of(*(v.to_numpy(zero_copy_only=False).astype(float) for v in (x, y))))

        known = F.col(x).isNotNull() & F.col(y).isNotNull()
        at = leaf(F.coalesce(F.col(x).cast("double"), F.lit(0.0)), F.coalesce(F.col(y).cast("double"), F.lit(0.0)))
        placed = points.withColumn("__leaf", at)
        return placed.withColumns({c: F.when(known, F.col(f"__leaf.{c}")) for c in CELL}).drop("__leaf")

    def deal(self, rows: DataFrame, x_low: Column, x_high: Column, y_low: Column, y_high: Column) -> DataFrame:
        """``rows`` once for each leaf (level, cx, cy) that their box touches; not at all without a box."""
        sides = [x_low, x_high, y_low, y_high]
        if not self.split:
            span = lambda a, b: F.sequence(F.floor(a / self.size), F.floor(b / self.size))
            cells = F.flatten(F.transform(span(x_low, x_high), lambda cx: F.transform(span(y_low, y_high), lambda cy: F.struct(F.lit(0).alias("level"), cx.alias("cx"), cy.alias("cy")))))
            return rows.withColumn("__cell", F.explode(cells)).select(*rows.columns, *(f"__cell.{c}" for c in CELL))

        @F.arrow_udf(T.ArrayType(_LEAF))
        def leaves(x0: pa.Array, x1: pa.Array, y0: pa.Array, y1: pa.Array) -> pa.Array:
            row, *leaf = self._touched(*(v.to_numpy(zero_copy_only=False).astype(float) for v in (x0, x1, y0, y1)))
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x0) + 1)), pa.int32()), _leaves(*leaf))

        boxed = rows.withColumns({f"__b{i}": c.cast("double") for i, c in enumerate(sides)}).where(" and ".join(f"__b{i} is not null" for i in range(4)))
        dealt = boxed.withColumn("__cells", leaves(*(f"__b{i}" for i in range(4)))).withColumn("__cell", F.explode("__cells"))
        return dealt.select(*rows.columns, *(f"__cell.{c}" for c in CELL))


def build(points: DataFrame, size: float, capacity: int = CAPACITY, x: str = "x", y: str = "y") -> Quadtree:
    """The tree over ``points`` (a table that is cheap to read) from cells of ``size``."""
    n = points.count()
    if n <= capacity:
        return Quadtree(size)
    every = -(-n // SAMPLE)
    some = points.where(F.pmod(F.xxhash64(x, y), F.lit(every)) == 0)
    fine = size / 2**DEPTH
    # One row for each finest cell that the sample meets: no more than it has different places.
    found = some.groupBy(F.floor(F.col(x) / fine).alias("cx"), F.floor(F.col(y) / fine).alias("cy")).agg(F.count("*").alias("n")).where("cx is not null and cy is not null").toPandas()
    cx, cy, count = (found[c].to_numpy(np.int64) for c in ("cx", "cy", "n"))
    split: list[np.ndarray] = []
    for level in range(DEPTH):
        key = (cx >> (DEPTH - level)) * _WIDE + (cy >> (DEPTH - level)) % _WIDE
        keys, at = np.unique(key, return_inverse=True)
        hot = keys[np.bincount(at, count, len(keys)) * every > max(capacity, LEAST * every)]
        if not len(hot):
            break
        split.append(hot)
    return Quadtree(size, split)
