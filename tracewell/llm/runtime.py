"""What the operators share: reading tables, cutting lineage, Arrow plumbing and bounded memo tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.lineage import Written, cut, remove, shared_dir, written


__all__ = ["Memo", "Written", "cut", "map_rows", "packed", "passed", "remove", "shared_dir", "signed", "table", "utf8", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(value: str) -> bytes:
    """UTF-8 of a text; a lone surrogate, which has no UTF-8, becomes ``?``."""
    return value.encode("utf-8", "replace")


def map_rows(
    df: DataFrame, schema: str, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """``mapInArrow`` with a DDL schema."""
    return df.mapInArrow(work, schema)


def packed(row: DataFrame, name: str = "doc") -> DataFrame:
    """All columns as one struct, so that further columns can't clash with theirs."""
    return row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns]).alias(name))


def passed(bounds: list[int], value: Column) -> Column:
    """How many of sorted bounds a value has reached: binary search in a constant array."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0))
    listed = F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])

    def step(at: Column, s: Column) -> Column:
        return F.when((at + s <= len(bounds)) & (F.get(listed, at + s - 1) <= value), at + s).otherwise(at)

    return F.when(value.isNotNull(), F.aggregate(steps, F.lit(0), step))


def signed(column: Column) -> Column:
    return column.cast("long")


class Memo(dict):
    """A dict of at most twice ``limit`` entries: the older generation goes when the younger one is full.

    ``get`` of the younger generation is the plain dict's; ``recall`` looks into the older one and promotes.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def recall(self, key: Any) -> Any:
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key: Any, value: Any) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
