"""Queries of the catalogue operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import catalog
from loamline.plans.core import query, table


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'jewels' WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') THEN 'colours' ELSE 'other' END AS category FROM part""")
def classify_title(spark, d):
    words = spark.createDataFrame([(1, "jewels", "ring"), (2, "colours", "red"), (2, "colours", "Blue")], "category_order int, category string, keyword string")
    return catalog.classify_title(table(spark, d, "part"), words, "p_partkey", "p_name", "other")


@query("""
    WITH l AS (SELECT o_orderkey AS pos, o_custkey AS id, 'c' || (o_orderkey % 977) AS slug, 'f' || o_orderkey AS folder FROM orders),
    m AS (SELECT c_custkey, pos, folder FROM customer JOIN l ON id = c_custkey UNION ALL SELECT c_custkey, pos, folder FROM customer JOIN l ON slug = 'c' || c_custkey)
    SELECT c.c_custkey, f.folder FROM customer c LEFT JOIN (SELECT c_custkey, arg_min(folder, pos) AS folder FROM m GROUP BY 1) f USING (c_custkey)""")
def sync_status(spark, d):
    o = table(spark, d, "orders")
    local = o.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("local_id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 977).cast("string")).alias("local_slug"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("folder"))
    items = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("slug"))
    return catalog.sync_status(items, local, "c_custkey", "slug")


@query("SELECT p_brand, count(*) AS items, CAST(sum(p_size) AS BIGINT) AS sources, round_even(avg(CAST(p_retailprice > 1000 AS INTEGER)), 3) AS synced_share FROM part GROUP BY ROLLUP (p_brand)")
def catalog_rollup(spark, d):
    p = table(spark, d, "part").withColumn("synced", F.col("p_retailprice") > 1000)
    return catalog.catalog_rollup(p, "p_brand", "p_size", "synced")


@query("SELECT doc_id, CASE WHEN length(text) > 50 AND doc_id % 3 = 0 THEN 'fulltext' WHEN doc_id % 5 > 0 THEN 'content' ELSE 'placeholder' END AS origin, md5(CASE WHEN length(text) > 50 AND doc_id % 3 = 0 THEN text WHEN doc_id % 5 > 0 THEN source ELSE '(none)' END) AS best_md5 FROM documents")
def best_content(spark, d):
    docs = table(spark, d, "documents").withColumns({"full": F.when(F.col("doc_id") % 3 == 0, F.col("text")), "part": F.when(F.col("doc_id") % 5 > 0, F.col("source"))})
    return catalog.best_content(docs, "full", "part", "(none)").select("doc_id", "origin", F.md5("best").alias("best_md5"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_sync(spark, d):
    return catalog.latest_sync(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def sync_outcomes(spark, d):
    return catalog.sync_outcomes(table(spark, d, "events"), "event_type")


@query("SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'P') AS next, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY o_custkey")
def next_pending(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "pending ").otherwise("DONE"))
    return catalog.next_pending(o, "o_custkey", "o_orderkey", "status")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'SENT' ELSE o_orderstatus END AS status FROM orders
    UNION ALL SELECT -1 - c_custkey, 'NOT_FOUND' FROM customer WHERE c_custkey < 5""")
def apply_status(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    up = o.where("k % 4 = 0").select("k").union(table(spark, d, "customer").where("c_custkey < 5").select(-1 - F.col("c_custkey"))).withColumn("new_status", F.lit("SENT"))
    done, lost = catalog.apply_status(o, up, "k", "status")
    return done.unionAll(lost.select("k", F.lit("NOT_FOUND").alias("status")))


@query("""
    WITH p AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'c_mktsegment' ELSE 'c_name' END AS f, 'v' || o_orderkey AS v FROM orders),
    l AS (SELECT k, arg_max(v, seq) FILTER (f = 'c_name') AS n, arg_max(v, seq) FILTER (f = 'c_mktsegment') AS s, count(*) AS c FROM p GROUP BY k)
    SELECT c_custkey, coalesce(n, c_name) AS c_name, coalesce(s, c_mktsegment) AS c_mktsegment, coalesce(c, 0) AS patches FROM customer LEFT JOIN l ON c_custkey = k""")
def apply_patches(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "F", "c_mktsegment").alias("field"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("new_value"))
    return catalog.apply_patches(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), p, "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5")
def retain_snapshots(spark, d):
    o = table(spark, d, "orders")
    return catalog.retain_snapshots(o, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 5).select("o_custkey", "o_orderkey")


@query("""
    WITH g AS (SELECT DISTINCT s_suppkey AS src, (s_suppkey + 1) % 20 AS dst FROM supplier), t AS (SELECT DISTINCT (s_suppkey + 7) % 20 AS src, s_suppkey AS dst FROM supplier UNION SELECT s_suppkey - 1, s_suppkey FROM supplier)
    SELECT coalesce(g.src, t.src) AS src, coalesce(g.dst, t.dst) AS dst, g.src IS NOT NULL AS given, t.src IS NOT NULL AS taken FROM g FULL JOIN t ON g.src = t.src AND g.dst = t.dst""")
def handoff_edges(spark, d):
    s = F.col("s_suppkey")
    c = table(spark, d, "supplier").select("s_suppkey", F.array((s + 1) % 20).alias("gives"), F.array((s + 7) % 20, s - 1).alias("takes"))
    return catalog.handoff_edges(c, "s_suppkey", "gives", "takes")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_brand = 'Brand#1' THEN 'first' WHEN p_brand = 'Brand#2' THEN 'second' ELSE 'other' END AS resolved FROM part")
def category_default(spark, d):
    defaults = spark.createDataFrame([("Brand#1", "first"), ("Brand#2", "second")], "name string, category string")
    p = table(spark, d, "part").withColumn("category", F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, ""))
    return catalog.category_default(p, defaults, "p_brand", "category").select("p_partkey", "resolved")


@query("""
    WITH p AS (SELECT o_custkey AS k, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN [('color', o_orderpriority), ('font', 'f' || o_orderkey % 7)] ELSE [('p' || o_orderkey % 3, o_orderstatus)] END AS style FROM orders),
    e AS (SELECT k, seq, unnest(style) AS s FROM p), l AS (SELECT k, s[1] AS name, arg_max(s[2], seq) AS v FROM e GROUP BY ALL),
    own AS (SELECT c_custkey AS k, unnest(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE [('color', 'own'), ('size', c_mktsegment)] END) AS s FROM customer),
    m AS (SELECT k, name, v FROM l UNION ALL SELECT k, s[1], s[2] FROM own WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k = own.k AND l.name = own.s[1])),
    t AS (SELECT k, string_agg(name || '=' || v, ';' ORDER BY name) AS style FROM m GROUP BY k), n AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT c_custkey, style, coalesce(n, 0) AS patches FROM customer LEFT JOIN t ON t.k = c_custkey LEFT JOIN n ON n.k = c_custkey""")
def apply_styles(spark, d):
    """Style maps of customers, patched by their orders: different keys survive, of one key the last patch counts."""
    k = F.col("o_orderkey")
    style = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.create_map(F.lit("color"), "o_orderpriority", F.lit("font"), F.concat(F.lit("f"), (k % 7).cast("string")))).otherwise(F.create_map(F.concat(F.lit("p"), (k % 3).cast("string")), "o_orderstatus"))
    patches = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), k.alias("seq"), F.lit(None).cast("string").alias("field"), F.lit("v").alias("new_value"), style.alias("style"))
    own = F.when(F.col("c_custkey") % 3 != 0, F.create_map(F.lit("color"), F.lit("own"), F.lit("size"), "c_mktsegment"))
    done = catalog.apply_patches(table(spark, d, "customer").select("c_custkey", "c_name", own.alias("style")), patches, "c_custkey", ["c_name"], "style")
    told = F.array_join(F.transform(F.array_sort(F.map_entries("style")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return done.select("c_custkey", told.alias("style"), "patches")
