"""Joining a large table to facts about its keys, where no key's rows may meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of texts in them, that are sent to every executor at most; longer lists are joined by a shuffle.
BROADCAST_KEYS, BROADCAST_BYTES = 400_000, 32 << 20
#: A key of one in so many rows or more is hot, so there are at most as many hot keys.
HOT = 1000


def extent(df: DataFrame, rows: str | None = None) -> tuple[bool, int, int]:
    """Of the written table ``df``: whether it is within the bounds of a broadcast, and the sum and the greatest of ``rows``."""
    texts = sum(
        (F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in ("string", "binary")), F.lit(0).cast("long")
    )
    weight = F.col(rows) if rows else F.lit(1)
    count, size, total, most = df.agg(F.count("*"), F.sum(texts), F.sum(weight), F.max(weight)).first()
    return count <= BROADCAST_KEYS and (size or 0) <= BROADCAST_BYTES, total or 0, most or 0


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast where it is within the bounds."""
    return F.broadcast(df) if extent(df)[0] else df


def matched(left: DataFrame, right: DataFrame, on: list[str], rows: str, how: str = "inner") -> DataFrame:
    """``left`` joined to the written table ``right``, of one row a key, which says in ``rows`` how many rows of ``left`` have the key.

    ``how``: inner, left or left_semi. Within the bounds ``right`` is broadcast. Beyond them the hot keys are, of
    which there are at most ``HOT``, and only rows of other keys are shuffled; the rows are the same either way.
    """
    within, total, most = extent(right, rows)
    if within:
        return left.join(F.broadcast(right), on, how)
    if most * HOT < total:
        return left.join(right, on, how)
    hot = F.broadcast(right.where(F.col(rows) * HOT >= total))
    tagged = left.join(hot.select(*on, F.lit(True).alias("_hot")), on, "left")
    often = tagged.where("_hot").drop("_hot").join(hot, on, "left_semi" if how == "left_semi" else "inner")
    return often.unionByName(tagged.where("_hot IS NULL").drop("_hot").join(right.where(F.col(rows) * HOT < total), on, how))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in the written table ``dropped``, which has that one column. Null ids stay."""
    return docs.join(small(dropped.where(F.col(id_col).isNotNull())), id_col, "left_anti").select(*docs.columns)
