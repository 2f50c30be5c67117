"""Lists as repetition and definition levels, and back.

A layer may have null items, null lists and empty lists; each kind that it has takes the next definition
level, in that order, and level 0 is a value that is there. Repetition 1 begins a list, 0 continues it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layer:
    null_items: bool = True
    null_lists: bool = True
    empty_lists: bool = True

    def level(self, kind: str) -> int | None:
        """The definition level of ``null_items``, ``null_lists`` or ``empty_lists``; None if there are none."""
        kinds = [k for k in ("null_items", "null_lists", "empty_lists") if getattr(self, k)]
        return kinds.index(kind) + 1 if kind in kinds else None


def shred(df: DataFrame, key: list[str], column: str, layer: Layer = Layer()) -> DataFrame:  # noqa: B008
    """``(*key, pos, rep, def, value)`` with a row for each item, and one for each null or empty list."""
    out = df.select(*key, F.col(column).isNull().alias("none"), F.posexplode_outer(column).alias("pos", "value"))
    level = lambda kind: F.lit(n) if (n := layer.level(kind)) else F.raise_error(F.lit(f"the layer has no {kind.replace('_', ' ')}")).cast("int")
    definition = F.when(F.col("none"), level("null_lists")).when(F.col("pos").isNull(), level("empty_lists")).when(F.col("value").isNull(), level("null_items")).otherwise(0)
    return out.select(*key, F.coalesce("pos", F.lit(0)).alias("pos"), F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0).alias("rep"), definition.alias("def"), "value")


def assemble(levels: DataFrame, key: list[str], layer: Layer = Layer()) -> DataFrame:  # noqa: B008
    """``(*key, items)``: the lists that `shred` took apart."""
    item = F.struct("pos", "value")
    lists = levels.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("l"), F.max("def").alias("top"))
    items = F.transform("l", lambda x: x["value"])
    made = F.when(F.col("top") == (layer.level("null_lists") or -1), F.lit(None)).when(F.col("top") == (layer.level("empty_lists") or -1), F.slice(items, 1, 0)).otherwise(items)
    return lists.select(*key, made.alias("items"))


def valid_at(levels: DataFrame, current: int) -> DataFrame:
    """Levels with ``valid``: whether the value, or the struct at this depth, is there."""
    return levels.withColumn("valid", F.col("def") <= current)


def nest(df: DataFrame, key: list[str], order: list[str], fields: list[str], out: str = "items") -> DataFrame:
    """Rows of a key as a list of structs in order."""
    lists = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("l"))
    return lists.select(*key, F.transform("l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out))
