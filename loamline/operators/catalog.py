"""Catalogues, calendars and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.text import sized


def classify_title(items: DataFrame, keywords: DataFrame, key: str, title: str, fallback: str) -> DataFrame:
    """``key, category``: the first category (by ``category_order``) with a keyword in the title."""
    hits = items.join(sized(keywords), F.lower(F.col(title)).contains(F.lower(F.col("keyword"))))
    best = hits.groupBy(key).agg(F.min_by("category", "category_order").alias("category"))
    return items.select(key).join(best, key, "left").withColumn("category", F.coalesce("category", F.lit(fallback)))


def sync_status(items: DataFrame, local: DataFrame, key: str, slug: str) -> DataFrame:
    """``key, folder``: the first local folder (by ``pos``) that has the item's id or its slug."""
    by_id = items.select(key).join(local.select(F.col("local_id").alias(key), "pos", "folder"), key)
    by_slug = items.select(key, F.col(slug).alias("local_slug")).join(local.select("local_slug", "pos", "folder"), "local_slug").select(key, "pos", "folder")
    best = by_id.unionByName(by_slug).groupBy(key).agg(F.min_by("folder", "pos").alias("folder"))
    return items.select(key).join(best, key, "left")


def catalog_rollup(items: DataFrame, category: str, sources: str, synced: str) -> DataFrame:
    """Totals by category and overall (null): items, sources, synced share."""
    return items.rollup(category).agg(F.count("*").alias("items"), F.sum(sources).alias("sources"), F.bround(F.avg(F.col(synced).cast("int")), 3).alias("synced_share"))


def best_content(df: DataFrame, full: str, content: str, placeholder: str, least: int = 50) -> DataFrame:
    """Adds ``best`` and ``origin``: the full text if over ``least`` characters, else the content, else the placeholder."""
    long = F.length(full) > least
    has = F.coalesce(F.length(content), F.lit(0)) > 0
    return df.withColumns({"best": F.when(long, F.col(full)).when(has, F.col(content)).otherwise(placeholder), "origin": F.when(long, "fulltext").when(has, "content").otherwise("placeholder")})


def latest_sync(log: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last record of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(key, "_r.*")


def sync_outcomes(results: DataFrame, status: str) -> DataFrame:
    return results.groupBy(status).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def next_pending(calendar: DataFrame, group: str, pos: str, status: str) -> DataFrame:
    """``group, next, pending``: the first row (by ``pos``) that is pending, in any case; null where the queue is empty."""
    pending = F.upper(F.trim(status)) == "PENDING"
    return calendar.groupBy(group).agg(F.min(F.when(pending, F.col(pos))).alias("next"), F.count_if(pending).alias("pending"))


def apply_status(calendar: DataFrame, updates: DataFrame, key: str, status: str) -> tuple[DataFrame, DataFrame]:
    """The calendar with its statuses set by id, and the updates whose id is not in it."""
    u = updates.select(F.col(key).alias("_k"), F.col("new_status"))
    done = calendar.join(u, F.col(key) == F.col("_k"), "left").withColumn(status, F.coalesce("new_status", status)).drop("_k", "new_status")
    return done, updates.join(calendar.select(key), key, "left_anti")


def apply_patches(entities: DataFrame, patches: DataFrame, key: str, fields: list[str], style: str | None = None) -> DataFrame:
    """The entities with the last patch of each field applied, and ``patches``, how many hit them.

    ``patches(key, seq, field, new_value)``; a null field means the first one,
    a null value is a value. With ``style``, the name of a map of both tables,
    the maps are merged by their keys: the last patch that has a key gives its
    value, and keys that no patch has stay.
    """
    p = patches.withColumn("field", F.coalesce("field", F.lit(fields[0])))
    value = lambda f: F.max_by(F.when(F.col("field") == f, F.struct("new_value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}")
    last = p.groupBy(F.col(key).alias("_k")).agg(*map(value, fields), F.count("*").alias("_n"))
    j = entities.join(last, F.col(key) == F.col("_k"), "left")
    set_ = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.new_value")).otherwise(F.col(f)) for f in fields}
    j = j.withColumns(set_ | {"patches": F.coalesce("_n", F.lit(0))}).drop("_k", "_n", *(f"_{f}" for f in fields))
    if style is None:
        return j
    entries = patches.select(F.col(key).alias("_k"), "seq", F.explode(style).alias("_name", "_set")).groupBy("_k", "_name").agg(F.max_by(F.struct("_set"), "seq").alias("_s"))
    maps = entries.groupBy("_k").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", F.col("_s._set"))))).alias("_style"))
    own = F.coalesce(F.col(style), F.map_from_arrays(F.array(), F.array()).cast(dict(entities.dtypes)[style]))
    merged = F.when(F.col("_style").isNull(), F.col(style)).otherwise(F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key("_style", k)), F.col("_style")))
    return j.join(maps, F.col(key) == F.col("_k"), "left").withColumn(style, merged).drop("_k", "_style")


def retain_snapshots(revisions: DataFrame, group: str, order: list, n: int = 20) -> DataFrame:
    return revisions.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def handoff_edges(contracts: DataFrame, key: str, gives: str, takes: str) -> DataFrame:
    """``src, dst, given, taken``: edges of both declarations; one-sided ones lack a flag."""
    out = contracts.select(F.col(key).alias("src"), F.explode(gives).alias("dst")).distinct().withColumn("given", F.lit(True))
    back = contracts.select(F.explode(takes).alias("src"), F.col(key).alias("dst")).distinct().withColumn("taken", F.lit(True))
    return out.join(back, ["src", "dst"], "full").select("src", "dst", F.coalesce("given", F.lit(False)).alias("given"), F.coalesce("taken", F.lit(False)).alias("taken"))


def category_default(items: DataFrame, defaults: DataFrame, name: str, category: str) -> DataFrame:
    """Adds ``resolved``: the own category, else the default of the name, else ``other``."""
    m = sized(defaults.select(F.col("name").alias("_n"), F.col("category").alias("_c")))
    return items.join(m, F.col(name) == F.col("_n"), "left").withColumn("resolved", F.coalesce(F.nullif(F.col(category), F.lit("")), F.col("_c"), F.lit("other"))).drop("_n", "_c")
