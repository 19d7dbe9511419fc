"""Sources and sinks: files, JSON lines, delimited texts, tables and sections inside texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.functions.text import lines, run_id


def read_files(spark: SparkSession, path: str, glob: str = "*", excluded: tuple[str, ...] = (".git", "node_modules", "__pycache__")) -> DataFrame:
    """``path, size, ext, content`` of the files below ``path``, without the excluded folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    for name in excluded:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    return files.select("path", F.col("length").alias("size"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("ext"), "content")


def parse_jsonl(texts: DataFrame, key: str, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows (``key, line, r``) and bad ones (``key, line, raw``) of JSON lines; blank lines are dropped."""
    rows = lines(texts, [key], text).where(F.trim("text") != "")
    rows = rows.withColumn("r", F.from_json("text", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return rows.where(~bad).select(key, "line", F.col("r").dropFields("_corrupt_record").alias("r")), rows.where(bad).select(key, "line", F.col("text").alias("raw"))


def salvage_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Adds ``parsed``: the JSON, or else that between the first ``{`` and the last ``}``; null if neither parses."""
    strict = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return df.withColumn("parsed", F.coalesce(strict(F.col(column)), strict(F.regexp_extract(column, r"(?s)(\{.*\})", 1))))


def sniff_delimiter(texts: DataFrame, text: str, ext: str | None = None) -> DataFrame:
    """Adds ``delimiter`` (the most frequent of comma, semicolon, tab, bar in the first 8192 characters) and ``n_rows``."""
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, 8192)
    counts = F.array(*(F.struct((F.length(head) - F.length(F.replace(head, F.lit(d)))).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate((",", ";", "\t", "|"))))
    best = F.array_max(counts)
    found = F.when(best["n"] > 0, best["d"]).otherwise(",")
    if ext is not None:
        found = F.when(F.lower(F.col(ext)) == ".tsv", "\t").otherwise(found)
    return texts.withColumns({"delimiter": found, "n_rows": F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda l: F.trim(l) != ""))})


def parse_pipe_tables(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, table, row, cells`` of Markdown pipe tables; separator rows are dropped, cells trimmed of blanks and backticks.

    Each row of ``df`` is a text with its own ``key``, and its tables are found
    inside that row, without a shuffle. A line outside tables becomes an empty
    one; so tables are what empty lines set apart.
    """
    bars = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda l: F.when(F.trim(l).rlike(r"^\|.*\|$"), l).otherwise(""))
    tables = df.select(key, F.posexplode(F.split(F.btrim(F.array_join(bars, "\n"), F.lit("\n")), "\n\n+", -1)).alias("_at", "_table")).where("_table <> ''")
    rows = F.filter(F.split("_table", "\n", -1), lambda l: ~F.trim(l).rlike(r"^\|[ :|-]+\|$"))
    found = tables.select(key, (F.col("_at") + 1).cast("long").alias("table"), F.posexplode(rows).alias("_row", "text"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|", -1), lambda c: F.regexp_replace(F.trim(c), "^`+|`+$", ""))
    return found.select(key, "table", (F.col("_row") + 1).alias("row"), cells.alias("cells"))


def split_sections(df: DataFrame, key: str, text: str = "text", marker: str = r"^(<!-- page \d+ -->|## Slide \d+|## Sheet .+|<!-- chapter .+ -->)$") -> DataFrame:
    """``key, section, marker, body``: texts cut at marker lines; section 0 is what stands before the first."""
    ls = lines(df, [key], text).withColumn("_m", F.col("text").rlike(marker)).withColumn("section", run_id(F.col("_m"), [key], "line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("_m"), F.struct("line", "text")))), lambda s: s["text"]), "\n")
    return ls.groupBy(key, "section").agg(F.max(F.when(F.col("_m"), F.col("text"))).alias("marker"), body.alias("body"))


def html_to_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``title`` and ``body``: tags, scripts, styles and comments removed, cells set off by bars, common entities decoded."""
    h = F.coalesce(F.col(html), F.lit(""))
    for pattern, to in ((r"(?is)<script[^>]*>.*?</script>", " "), (r"(?is)<style[^>]*>.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)</t[dh]>", " | "), (r"(?i)<br ?/?>|</p>|</div>|</li>|</tr>|</h[1-6]>", "\n"), (r"(?s)<[^>]*>", "")):
        h = F.regexp_replace(h, pattern, to)
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        h = F.replace(h, F.lit(entity), F.lit(to))
    h = F.regexp_replace(F.regexp_replace(h, "[ \t]+", " "), " ?\n[ \n]*", "\n")
    return df.withColumns({"title": F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "body": F.regexp_replace(h, "^[ \n]+|[ \n]+$", "")})


def parse_frontmatter(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, name, value`` of the leading ``---`` block: top-level keys, quotes stripped, indented lines joined to their key; nested keys give ''."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    ls = lines(df.select(key, block.alias("_b")).where("_b <> ''"), [key], "_b").where(F.trim("text") != "")
    top = F.col("text").rlike(r"^[A-Za-z0-9_-]+:")
    ls = ls.withColumn("_n", run_id(top, [key], "line")).where("_n > 0")
    ls = ls.withColumns({"_name": F.regexp_extract("text", r"^([A-Za-z0-9_-]+):", 1), "_rest": F.trim(F.regexp_replace("text", r"^[A-Za-z0-9_-]+:", ""))})
    parts = ls.groupBy(key, "_n").agg(F.sort_array(F.collect_list(F.struct("line", "_name", "_rest"))).alias("p"))
    first = F.get("p", F.lit(0))
    more = F.transform(F.slice("p", F.lit(2), F.size("p")), lambda s: s["_rest"])
    folded = first["_rest"].isin(">", ">-", "|", "|-")
    value = F.when(folded, F.array_join(more, " ")).when((first["_rest"] == "") & F.exists(more, lambda m: m.rlike(r"^([A-Za-z0-9_-]+:|- )")), "").otherwise(F.trim(F.concat_ws(" ", first["_rest"], F.array_join(more, " "))))
    return parts.select(key, first["_name"].alias("name"), F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2").alias("value"))


def sink_manifest(df: DataFrame, path: str, partition: str = "status") -> None:
    """Writes one JSON row for each file, in folders by status."""
    df.write.mode("overwrite").partitionBy(partition).json(path)
