"""Records inside files and texts: JSON lines with their places, delimited rows, and manifests published with an index."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions.text import sized
from loamline.operators.ingest import SEVERITY

DELIMITERS = (",", ";", "\t", "|")
CELL_END, ROW_END, EMPTY = "", "", ""


def numbered_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, line, text`` of the text files below ``path``; lines are numbered from 1 in each file.

    Files are read in splits, side by side. A split's lines come in order, so
    their running ids tell their places in it; the splits of a file are counted,
    and the lines of those before are added. Only counts of splits are shuffled.
    """
    files = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    rows = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("path", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(sized(splits), ["path", "_split"]).select("path", (F.col("_id") + F.col("_shift")).alias("line"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """Good rows (``path, line, r``) and bad ones (``path, line, raw``) of JSON lines; blank lines count as lines and are dropped."""
    rows = numbered_lines(spark, path, glob).where(F.trim("text") != "")
    rows = rows.withColumn("r", F.from_json("text", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return rows.where(~bad).select("path", "line", F.col("r").dropFields("_corrupt_record").alias("r")), rows.where(bad).select("path", "line", F.col("text").alias("raw"))


def _rows(text: Column, delimiter: str) -> Column:
    """Array of arrays of cells. A cell that starts with a quote runs to the next lone one, over delimiters and line ends."""
    d = re.escape(delimiter) if delimiter != "\t" else r"\t"
    quoted, plain, end = r'"[^"]*+(?:""[^"]*+)*+"?', rf"[^{d}\r\n]*+", rf"(?:{d}|\r\n|[\r\n]|\z)"

    def encoded(cell: Column) -> Column:
        inside = F.replace(F.regexp_extract(cell, rf'(?s)^"([^"]*+(?:""[^"]*+)*+)"?({plain})', 1), F.lit('""'), F.lit('"'))
        after = F.regexp_extract(cell, rf"(?s)^{quoted}({plain})", 1)
        whole = F.concat(inside, after)
        open_cell = F.when(cell.startswith('"'), F.when(whole == "", EMPTY).otherwise(whole)).otherwise(F.regexp_extract(cell, f"^{plain}", 0))
        # a cell without an end is the last of the text
        bare = F.when(cell.startswith('"'), F.regexp_replace(cell, rf"(?s)^{quoted}{plain}", "")).otherwise(F.regexp_replace(cell, f"^{plain}", ""))
        return F.concat(open_cell, F.when(bare == delimiter, CELL_END).when(bare == "", "").otherwise(ROW_END))

    marked = F.translate(F.coalesce(text, F.lit("")), CELL_END + ROW_END + EMPTY, "���")
    cells = F.regexp_extract_all(marked, F.lit(rf"(?:{quoted}{plain}|{plain}){end}"), F.lit(0))
    rows = F.split(F.array_join(F.transform(cells, encoded), ""), ROW_END, -1)
    rows = F.when(F.element_at(rows, -1) == "", F.slice(rows, F.lit(1), F.size(rows) - 1)).otherwise(rows)
    none = F.array().cast("array<string>")
    return F.transform(rows, lambda r: F.when(r == "", none).otherwise(F.transform(F.split(r, CELL_END, -1), lambda c: F.when(c == EMPTY, "").otherwise(c))))


def delimited_rows(texts: DataFrame, key: str, text: str, delimiter: str = "delimiter") -> DataFrame:
    """``key, row`` (from 1), ``cells`` of delimited texts, each by its own ``delimiter`` (see ``sniff_delimiter``).

    Quoted cells hold delimiters, line ends and doubled quotes; a quote inside
    an unquoted cell is a character, one that is never closed runs to the end.
    Lines end with line feed, carriage return or both; a blank line is a row
    without cells. Null and empty texts have no rows. The four delimiters are
    constants of the plan, so a text is split by expressions alone; the marks in
    between are private-use characters, which a text's own are replaced for.
    """
    rows = None
    for d in DELIMITERS:
        mine = F.col(delimiter) == d
        rows = F.when(mine, _rows(F.col(text), d)) if rows is None else rows.when(mine, _rows(F.col(text), d))
    return texts.select(key, F.posexplode(rows).alias("_at", "cells")).select(key, (F.col("_at") + 1).alias("row"), "cells")


def publish_manifest(manifest: DataFrame, path: str, folder: str = "folder", code: str = "exit_code") -> None:
    """Writes one JSON file for each row, in ``path/files/<folder>``, and then an index of the batch, ``path/index``.

    The index has the rows without nested columns and ``batch_code``, the worst
    code. It is written beside its place and moved there in one step when all
    files are there; an older one is taken away first. A run that ends before
    leaves files without an index, so a reader never sees an index of files that
    are not there.
    """
    spark = manifest.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    index, draft = make(f"{path}/index"), f"{path}/_index-{uuid.uuid4().hex}"
    store = index.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(index, True)
    manifest.withColumn("_folder", F.col(folder)).write.mode("overwrite").partitionBy("_folder").option("maxRecordsPerFile", 1).json(f"{path}/files")
    rank = F.lit(0)
    for place, known in enumerate(reversed(SEVERITY)):
        rank = F.when(F.col(code) == known, place).otherwise(rank)
    plain = [f.name for f in manifest.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    worst = manifest.agg(F.max_by(code, rank).alias("batch_code"))
    manifest.select(*plain).crossJoin(F.broadcast(worst)).write.json(draft)  # one row
    if not store.rename(make(draft), index):
        raise OSError(f"cannot publish {path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The published index of a batch; None where the batch has none."""
    index = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index")
    if not index.getFileSystem(spark._jsc.hadoopConfiguration()).exists(index):
        return None
    return spark.read.json(f"{path}/index")
