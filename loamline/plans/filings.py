"""Queries of the filing operators; rates here are examples, given as parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import filings
from loamline.plans.core import query, table

_B = [(0.0, 1000.0, 0.05), (1000.0, 3000.0, 0.10), (3000.0, None, 0.20)]
_TAX = "greatest(least(x, 1000) - 0, 0) * 0.05 + greatest(least(x, 3000) - 1000, 0) * 0.10 + greatest(x - 3000, 0) * 0.20"


@query("""
    WITH p(name, value, f, s) AS (VALUES ('P', 0.1, DATE '1996-01-01', 'VERIFIED'), ('P', 0.2, DATE '1997-07-01', 'VERIFIED'), ('F', 0.3, DATE '1996-06-01', 'UNVERIFIED'), ('O', 0.4, DATE '1994-01-01', 'VERIFIED'))
    SELECT o_orderkey, CAST(arg_max(value, f) AS DOUBLE) AS value, max(f) AS effective_from, coalesce(arg_max(s, f) <> 'VERIFIED', true) AS rejected FROM orders LEFT JOIN p ON name = o_orderstatus AND f <= o_orderdate GROUP BY o_orderkey""")
def param_asof(spark, d):
    rows = [("P", 0.1, "1996-01-01", "VERIFIED"), ("P", 0.2, "1997-07-01", "VERIFIED"), ("F", 0.3, "1996-06-01", "UNVERIFIED"), ("O", 0.4, "1994-01-01", "VERIFIED")]
    params = spark.createDataFrame(rows, "name string, value double, effective_from string, verification_status string").withColumn("effective_from", F.to_date("effective_from"))
    out = filings.param_asof(table(spark, d, "orders"), params, "o_orderdate", F.col("o_orderstatus"))
    return out.select("o_orderkey", "value", "effective_from", "rejected")


@query(f"SELECT c_custkey, round(CAST({_TAX.replace('x', 'x')} AS DOUBLE), 4) AS tax FROM (SELECT c_custkey, greatest(CAST(c_acctbal AS DECIMAL(20,4)), 0) AS x FROM customer)")
def progressive_tax(spark, d):
    b = spark.createDataFrame(_B, "lo double, hi double, rate double")
    return filings.progressive_tax(table(spark, d, "customer"), b, ["c_custkey"], F.col("c_acctbal")).select("c_custkey", F.round(F.col("tax").cast("double"), 4).alias("tax"))


@query(f"""
    WITH g AS (SELECT c_custkey, abs(c_acctbal) AS g, c_nationkey % 3 AS k FROM customer), i AS (SELECT *, round(g * 0.08, 0) AS ins_social, round(g * 0.015, 0) AS ins_health FROM g),
    t AS (SELECT *, greatest(g - ins_social - ins_health - 1500 - k * 400, 0.0) AS x FROM i), y AS (SELECT *, round({_TAX}, 0) AS tax FROM t)
    SELECT c_custkey, ins_social, ins_health, round(x, 2) AS taxable, tax, round(g - ins_social - ins_health - tax, 2) AS net FROM y""")
def gross_to_net(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("g"), (F.col("c_nationkey") % 3).alias("k"))
    out = filings.gross_to_net(p, "g", "k", {"social": 0.08, "health": 0.015}, 1500.0, 400.0, _B)
    return out.select("c_custkey", "ins_social", "ins_health", F.round("taxable", 2).alias("taxable"), "tax", F.round("net", 2).alias("net"))


@query("""
    WITH n AS (SELECT c_custkey, abs(c_acctbal) AS n, 1500.0 + (c_nationkey % 3) * 400 AS d FROM customer)
    SELECT c_custkey, round(CASE WHEN n <= d THEN n / 0.905 WHEN (n - d) / 0.95 <= 1000 THEN ((n - d) / 0.95 + d) / 0.905
        WHEN (n - d + 50 - 100) / 0.9 <= 3000 THEN ((n - d + 50 - 100) / 0.9 + d) / 0.905 ELSE ((n - d + 250 - 600) / 0.8 + d) / 0.905 END, 0) AS gross FROM n""")
def net_to_gross(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("n"), (F.col("c_nationkey") % 3).alias("k"))
    return filings.net_to_gross(p, "n", "k", 0.095, 1500.0, 400.0, _B).select("c_custkey", "gross")


@query(f"""
    WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS inc, CAST(count(*) * 8000 AS DOUBLE) AS w FROM orders GROUP BY ALL),
    t AS (SELECT *, greatest(inc - 500.0 * 12, 0.0) AS x FROM y), l AS (SELECT *, round(greatest(least(x, 12000), 0) * 0.05 + greatest(least(x, 36000) - 12000, 0) * 0.10 + greatest(x - 36000, 0) * 0.20, 0) AS liability FROM t)
    SELECT o_custkey, CAST(y AS INTEGER) AS y, liability, round(liability - w, 2) AS balance, CASE WHEN round(liability - w, 2) > 0 THEN 'DUE' WHEN round(liability - w, 2) < 0 THEN 'REFUND' ELSE 'SETTLED' END AS status FROM l""")
def annual_settlement(spark, d):
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("inc"), (F.count("*") * 8000).cast("double").alias("w"))
    return filings.annual_settlement(y, F.col("inc"), F.col("w"), F.lit(500.0), _B).select("o_custkey", "y", "liability", "balance", "status")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 OR o_orderstatus = 'P' THEN 0.0 ELSE round(o_totalprice * 0.1, 4) END AS withheld FROM orders")
def flat_withholding(spark, d):
    return filings.flat_withholding(table(spark, d, "orders"), F.col("o_totalprice"), 0.1, (F.col("o_totalprice") < 50000) | (F.col("o_orderstatus") == "P")).select("o_orderkey", F.round("withheld", 4).alias("withheld"))


@query("SELECT c_custkey, round((c_nationkey * 1.5 + (c_custkey % 9) * 2.0) * c_acctbal, 4) AS amount FROM customer")
def lump_sum(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(filings.lump_sum(F.col("c_nationkey"), F.col("c_custkey") % 9, F.col("c_acctbal")), 4).alias("amount"))


@query("""
    WITH r(o_orderstatus, v, i) AS (VALUES ('F', 0.01, 0.005), ('O', 0.05, 0.02), ('P', 0.03, 0.015)), a AS (SELECT o_custkey, o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY ALL)
    SELECT o_custkey, o_orderstatus, CASE WHEN t <= 1000000 THEN 0.0 ELSE round(amount * v, 6) END AS vat, CASE WHEN t <= 1000000 THEN 0.0 ELSE round(amount * i, 6) END AS income_tax FROM (SELECT *, round(sum(amount) OVER (PARTITION BY o_custkey), 2) AS t FROM a) JOIN r USING (o_orderstatus)""")
def activity_tax(spark, d):
    from pyspark.sql import Window

    rates = spark.createDataFrame([("F", 0.01, 0.005), ("O", 0.05, 0.02), ("P", 0.03, 0.015)], "o_orderstatus string, vat_rate double, income_rate double")
    a = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    a = a.withColumn("total", F.round(F.sum("amount").over(Window.partitionBy("o_custkey")), 2))
    return filings.activity_tax(a, rates, "o_orderstatus", "amount", F.col("total"), 1_000_000).select("o_custkey", "o_orderstatus", F.round("vat", 6).alias("vat"), F.round("income_tax", 6).alias("income_tax"))


@query("""
    WITH l AS (SELECT l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(20,4)) * (CASE WHEN l_returnflag <> 'A' AND l_shipdate <= TIMESTAMP '1997-12-31' THEN 8 ELSE 10 END) / 100 AS DOUBLE) AS o, CAST(l_extendedprice AS DECIMAL(20,4)) * 6 / 100 AS i FROM lineitem),
    s AS (SELECT l_suppkey, sum(CAST(o AS DECIMAL(20,4))) AS o, sum(CAST(i AS DECIMAL(20,4))) AS i FROM l GROUP BY 1)
    SELECT l_suppkey, round(CAST(o AS DOUBLE), 1) AS output_vat, round(CAST(greatest(o - i - 100, 0) AS DOUBLE), 1) AS payable FROM s""")
def vat_deduction(spark, d):
    li = table(spark, d, "lineitem")
    x = F.col("l_extendedprice")
    out = filings.vat_deduction(li, "l_suppkey", "l_shipdate", x, F.lit(0.10), F.col("l_returnflag") != "A", "1997-12-31", x * 0.06, F.lit(100))
    return out.select("l_suppkey", F.round(F.col("output_vat").cast("double"), 1).alias("output_vat"), F.round(F.col("payable").cast("double"), 1).alias("payable"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey * 100 <= 30000 THEN 0.15 WHEN o_custkey * 100 <= 90000 THEN 0.17 ELSE 0.2 END AS DOUBLE) AS rate, round(o_totalprice * CASE WHEN o_custkey * 100 <= 30000 THEN 0.15 WHEN o_custkey * 100 <= 90000 THEN 0.17 ELSE 0.2 END, 6) AS tax FROM orders")
def company_tax(spark, d):
    return filings.company_tax(table(spark, d, "orders"), F.col("o_totalprice"), F.col("o_custkey") * 100, [(30000, 0.15), (90000, 0.17), (None, 0.2)]).select("o_orderkey", "rate", F.round("tax", 6).alias("tax"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 1, 0) AS days, round(l_extendedprice * 0.0003 * greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 1, 0), 6) AS interest FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def late_payment(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return filings.late_payment(j, "o_orderdate", "l_shipdate", F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("days").cast("long").alias("days"), F.round("interest", 6).alias("interest"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_returnflag = 'A' THEN (l_extendedprice - 5) / (1 + l_tax) ELSE l_extendedprice END, 2) AS base, round((CASE WHEN l_returnflag = 'A' THEN (l_extendedprice - 5) / (1 + l_tax) ELSE l_extendedprice END * l_tax + 5) * l_quantity, 5) AS excise FROM lineitem")
def excise(spark, d):
    out = filings.excise(table(spark, d, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax"), F.lit(5), F.col("l_returnflag") == "A")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "base", F.round("excise", 5).alias("excise"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice / (1 - 0.05) ELSE o_totalprice END, 2) AS revenue FROM orders")
def contractor_tax(spark, d):
    return filings.contractor_tax(table(spark, d, "orders"), F.col("o_totalprice"), F.lit(0.05), F.col("o_orderstatus") == "F").select("o_orderkey", "revenue")


@query("""SELECT o_orderkey AS name, CAST(o_orderdate AS DATE) AS effective_from, CASE WHEN o_orderstatus = 'P' THEN 'no value' ELSE 'no source' END AS problem FROM orders WHERE o_orderstatus = 'P' OR o_custkey % 10 = 0""")
def validate_params(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.to_date("o_orderdate").alias("effective_from"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"), F.when(F.col("o_custkey") % 10 != 0, F.lit("law")).alias("source"))
    return filings.validate_params(p)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(20,4)) END AS value FROM orders")
def parse_number(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole = F.replace(F.format_number(F.floor(cents / 100), 0), F.lit(","), F.lit("."))
    text = F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    text = F.when(F.col("o_orderkey") % 11 == 0, "-").when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(F.concat(text, F.lit(" VND")))
    return table(spark, d, "orders").select("o_orderkey", filings.parse_number(text).alias("value"))


@query("""
    WITH l AS (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END * CAST(l_extendedprice AS DECIMAL(20,4))) AS c FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CAST(o_totalprice AS DECIMAL(20,4)) - c AS diff, abs(CAST(o_totalprice AS DECIMAL(20,4)) - c) <= 0.5 AS ok FROM l JOIN orders ON o_orderkey = l_orderkey""")
def reconcile(spark, d):
    parts = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("code"), F.col("l_extendedprice").alias("v"))
    totals = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("T").alias("code"), F.col("o_totalprice").alias("v"))
    formulas = spark.createDataFrame([("T", "O", 1), ("T", "F", -1)], "total string, part string, sign int")
    return filings.reconcile(parts.unionAll(totals), formulas, ["l_orderkey"], "code", "v").select("l_orderkey", "diff", "ok")


@query("""SELECT o_orderkey, '110' AS code, 'curr' AS period, CAST(o_orderkey * 1000 AS DECIMAL(20,4)) AS value FROM orders UNION ALL SELECT o_orderkey, '110', 'prev', CAST(-o_custkey AS DECIMAL(20,4)) FROM orders""")
def statement_lines(spark, d):
    k = F.replace(F.format_number(F.col("o_orderkey") * 1000, 0), F.lit(","), F.lit("."))
    text = F.concat(F.lit("Report\n110 Cash and such "), k, F.lit(" ("), F.col("o_custkey").cast("string"), F.lit(")\n110 Again 1 2\nnote"))
    return filings.statement_lines(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t")


@query("""
    WITH f AS (SELECT c_custkey, greatest((c_acctbal * 5000 + 12000000) * 0.895 - 11000000 - (c_nationkey % 3) * 4400000, 0) AS taxable, greatest(c_acctbal, 0) * 1000 * 12 * 0.1 AS w FROM customer),
    t AS (SELECT *, 12 * (least(taxable, 5e6) * 0.05 + greatest(least(taxable, 1e7) - 5e6, 0) * 0.1 + greatest(least(taxable, 18e6) - 1e7, 0) * 0.15 + greatest(taxable - 18e6, 0) * 0.2) AS t FROM f)
    SELECT c_custkey, round(taxable, 2) AS taxable, round_even(t, 0) AS salary_tax, round_even(w, 0) AS withheld, round_even(t + w, 0) AS total FROM t""")
def scenario_tax(spark, d):
    c = table(spark, d, "customer")
    brackets = [(0.0, 5e6, 0.05), (5e6, 1e7, 0.1), (1e7, 18e6, 0.15), (18e6, None, 0.2)]
    salary = F.col("c_acctbal").cast("double") * 5000 + 12000000
    freelance = F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)) * 1000
    out = filings.scenario_tax(c, salary, F.lit(0.105), F.col("c_nationkey") % 3, freelance, F.lit(0.1), 11e6, 4.4e6, brackets)
    return out.select("c_custkey", F.round("taxable", 2).alias("taxable"), "salary_tax", "withheld", "total")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1997-01-01' THEN 'second' WHEN o_orderdate >= DATE '1994-07-01' THEN 'first' END AS regime,
        o_orderstatus = 'F' OR o_totalprice > 150000 AS mandatory FROM orders""")
def regime_switch(spark, d):
    o = table(spark, d, "orders")
    return filings.regime_switch(o, "o_orderdate", "o_orderstatus", F.col("o_totalprice"), [("1997-01-01", "second"), ("1994-07-01", "first")], ["F"], 150000.0).select("o_orderkey", "regime", "mandatory")
