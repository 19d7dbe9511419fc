"""Column helpers for texts, lines and ordered runs."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, line`` (from 1), ``text``: one row for each line."""
    return df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_pos", "text")).select(*keys, (F.col("_pos") + 1).alias("line"), "text")


#: What ends a line besides a line feed (Unicode line boundaries).
LINE_END = "\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def split_lines(text: Column) -> Column:
    """The lines of a text, ended by any Unicode line boundary; the last may lack its end. None for an empty text."""
    other = functools.reduce(lambda a, b: a | b, (text.contains(end) for end in "\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029"))
    # Texts with line feeds only are not searched for the other boundaries.
    body = F.when(other, F.regexp_replace(text, f"(?:{LINE_END})\\z", "")).when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, F.when(other, LINE_END).otherwise("\n"), -1))


def run_id(flag: Column, partition: list[str], order: str) -> Column:
    """Number of rows with ``flag`` up to this one: constant within a run."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def running_max(df: DataFrame, keys: list[str], index: str, value: Column, name: str, block: int = 1000) -> DataFrame:
    """Adds ``name``: the largest non-null ``value`` of the rows of smaller ``index`` (0, 1, 2, ...) with the same ``keys``.

    Rows are taken in blocks of ``block``; a block's own maximum and those of
    the blocks before it are put together, so no window holds all rows of a key.
    """
    cut = df.withColumns({"_value": value, "_block": F.floor(F.col(index) / block)})
    before = lambda order: Window.partitionBy(*keys, *(["_block"] if order == index else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*keys, "_block").agg(F.max("_value").alias("_top"))
    tops = tops.select(*keys, "_block", F.max("_top").over(before("_block")).alias("_before"))
    inside = cut.withColumn("_inside", F.max("_value").over(before(index)))
    return inside.join(tops, [*keys, "_block"]).withColumn(name, F.greatest("_inside", "_before")).drop("_value", "_block", "_inside", "_before")


def share(part: Column, whole: Column, digits: int = 3) -> Column:
    """``part / whole`` rounded half to even; 0 for an empty whole."""
    return F.bround(part / F.greatest(whole, F.lit(1)), digits)


FIXED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"}
MOST_BROADCAST_BYTES = 64_000_000


def sized(rows: DataFrame, most: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """``rows`` with a broadcast hint if they are ``most`` bytes at most, by their own count and mean width; else as they are."""
    width = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) if t in ("string", "binary") else F.length(F.to_json(F.struct(c)))) if t not in FIXED else F.lit(16) for c, t in rows.dtypes)
    size = rows.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(rows) if size <= most else rows


def normal_form(form: str):
    """Unicode normal form ``form`` of a string column (Spark has no such function), in Arrow batches."""

    @F.pandas_udf("string")
    def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        for s in batches:
            yield s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normalize


def in_form(form: str, text: Column) -> Column:
    """``text`` in a Unicode normal form; texts in ASCII are in every form and are not sent to Python."""
    return F.coalesce(normal_form(form)(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
