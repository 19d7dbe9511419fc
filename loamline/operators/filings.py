"""Tax and statement batch jobs: one row for each taxpayer, filing or payment.

Rates, brackets and thresholds are parameter tables; none is built in. Money is
``decimal(20,4)`` inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.text import lines, sized

MONEY = "decimal(20,4)"


def param_asof(facts: DataFrame, params: DataFrame, date: str, name: Column) -> DataFrame:
    """Adds ``value, effective_from`` of the parameter in force, and ``rejected`` where there is none or it is unverified.

    ``params(name, value, effective_from, verification_status)``. Each becomes an
    interval up to the next one, so the join is a range join on a small table.
    """
    until = F.lead("effective_from").over(Window.partitionBy("name").orderBy("effective_from"))
    spans = params.withColumn("_until", until).select(F.col("name").alias("_name"), "value", "effective_from", "_until", "verification_status")
    on = (name == F.col("_name")) & (F.col(date) >= F.col("effective_from")) & (F.col("_until").isNull() | (F.col(date) < F.col("_until")))
    j = facts.join(sized(spans), on, "left")
    bad = F.col("value").isNull() | (F.col("verification_status") != "VERIFIED")
    return j.withColumn("rejected", F.coalesce(bad, F.lit(True))).drop("_name", "_until", "verification_status")


def progressive_tax(facts: DataFrame, brackets: DataFrame, key: list[str], income: Column) -> DataFrame:
    """``key, tax``: the sum over brackets ``(lo, hi, rate)`` of the income inside each times its rate; ``hi`` null is open."""
    j = facts.select(*key, income.alias("_x")).crossJoin(sized(brackets))
    part = F.greatest(F.least(F.greatest(F.col("_x").cast(MONEY), F.lit(0).cast(MONEY)), F.coalesce(F.col("hi").cast(MONEY), F.col("_x").cast(MONEY))) - F.col("lo").cast(MONEY), F.lit(0).cast(MONEY))
    return j.groupBy(*key).agg(F.sum(part * F.col("rate").cast("decimal(9,6)")).cast(MONEY).alias("tax"))


def tax_expression(income: Column, brackets: list[tuple[float, float | None, float]]) -> Column:
    """The same tax as one expression over a short list of brackets."""
    out = F.lit(0.0)
    for lo, hi, rate in brackets:
        top = income if hi is None else F.least(income, F.lit(float(hi)))
        out = out + F.greatest(top - F.lit(float(lo)), F.lit(0.0)) * rate
    return out


def gross_to_net(payroll: DataFrame, gross: str, dependants: str, rates: dict[str, float], personal: float, dependant: float, brackets: list, ceiling: float | None = None) -> DataFrame:
    """Adds insurance parts, ``taxable``, ``tax``, ``net`` and ``effective_rate`` (percent)."""
    base = F.col(gross) if ceiling is None else F.least(F.col(gross), F.lit(float(ceiling)))
    out = payroll.withColumns({f"ins_{k}": F.round(base * r, 0) for k, r in rates.items()})
    insurance = sum((F.col(f"ins_{k}") for k in rates), F.lit(0.0))
    out = out.withColumn("taxable", F.greatest(F.col(gross) - insurance - personal - F.col(dependants) * dependant, F.lit(0.0)))
    out = out.withColumn("tax", F.round(tax_expression(F.col("taxable"), brackets), 0))
    return out.withColumn("net", F.col(gross) - insurance - F.col("tax")).withColumn("effective_rate", F.bround(100 * F.col("tax") / F.nullif(F.col(gross), F.lit(0.0)), 2))


def net_to_gross(payroll: DataFrame, net: str, dependants: str, insurance_rate: float, personal: float, dependant: float, brackets: list) -> DataFrame:
    """Adds ``gross``: the inverse, solved in closed form on each bracket; the one whose taxable income fits holds.

    Without tax, gross = net / (1 - insurance rate). In a bracket with rate r
    and tax t0 below it, taxable x has net deduct + x - t0 - r (x - lo).
    """
    deduct = F.lit(float(personal)) + F.col(dependants) * float(dependant)
    keep = 1 - insurance_rate
    gross, below = None, 0.0
    untaxed = F.col(net) <= deduct
    for lo, hi, rate in brackets:
        x = (F.col(net) - deduct + F.lit(below) - F.lit(rate * lo)) / (1 - rate)
        fits = x <= (F.lit(float("inf")) if hi is None else F.lit(float(hi)))
        gross = F.when(fits, (x + deduct) / keep) if gross is None else gross.when(fits, (x + deduct) / keep)
        below += 0.0 if hi is None else (hi - lo) * rate
    return payroll.withColumn("gross", F.round(F.when(untaxed, F.col(net) / keep).otherwise(gross), 0))


def annual_settlement(filings: DataFrame, income: Column, withheld: Column, deduction: Column, brackets: list) -> DataFrame:
    """Adds ``liability`` on yearly brackets (twelve monthly ones), ``balance`` and ``status``."""
    yearly = [(lo * 12, None if hi is None else hi * 12, r) for lo, hi, r in brackets]
    out = filings.withColumn("liability", F.round(tax_expression(F.greatest(income - deduction * 12, F.lit(0.0)), yearly), 0)).withColumn("balance", F.round(F.col("liability") - withheld, 2))
    return out.withColumn("status", F.when(F.col("balance") > 0, "DUE").when(F.col("balance") < 0, "REFUND").otherwise("SETTLED"))


def flat_withholding(payments: DataFrame, amount: Column, rate: float, exempt: Column) -> DataFrame:
    return payments.withColumn("withheld", F.when(exempt, F.lit(0.0)).otherwise(amount * rate))


def lump_sum(before: Column, after: Column, wage: Column) -> Column:
    return (before * 1.5 + after * 2.0) * wage


def activity_tax(revenue: DataFrame, rates: DataFrame, activity: str, amount: str, total: Column, threshold: float) -> DataFrame:
    """Adds ``vat`` and ``income_tax`` of each activity; none up to the threshold of total revenue."""
    j = revenue.join(sized(rates), activity, "left")
    taxed = lambda r: F.when(total <= threshold, F.lit(0.0)).otherwise(F.col(amount) * F.col(r))
    return j.withColumns({"vat": taxed("vat_rate"), "income_tax": taxed("income_rate")}).drop("vat_rate", "income_rate")


def vat_deduction(lines: DataFrame, filer: str, date: str, net: Column, rate: Column, reduced: Column, reduced_until: str, input_vat: Column, carry: Column, from_rate: float = 0.10, to_rate: float = 0.08) -> DataFrame:
    """``filer, output_vat, input_vat, payable, carry_over``: the standard rate is reduced for eligible lines up to a date."""
    r = F.when(reduced & (rate == from_rate) & (F.col(date) <= F.lit(reduced_until).cast("timestamp")), F.lit(to_rate)).otherwise(rate)
    per = lines.groupBy(filer).agg(F.sum((net * r).cast(MONEY)).alias("output_vat"), F.sum(input_vat.cast(MONEY)).alias("input_vat"), F.max(carry).cast(MONEY).alias("_c"))
    owed = F.col("output_vat") - F.col("input_vat") - F.col("_c")
    return per.select(filer, "output_vat", "input_vat", F.greatest(owed, F.lit(0)).alias("payable"), F.greatest(-owed, F.lit(0)).alias("carry_over"))


def company_tax(filings: DataFrame, profit: Column, prior_revenue: Column, steps: list[tuple[float | None, float]]) -> DataFrame:
    """Adds ``rate`` (of the first step whose limit the prior revenue does not pass) and ``tax``."""
    rate = None
    for limit, r in steps:
        cond = F.lit(True) if limit is None else prior_revenue <= limit
        rate = F.when(cond, r) if rate is None else rate.when(cond, r)
    return filings.withColumn("rate", rate).withColumn("tax", F.greatest(profit, F.lit(0.0)) * F.col("rate"))


def late_payment(bills: DataFrame, due: str, paid: str, amount: Column, daily: float = 0.0003) -> DataFrame:
    """Adds ``days`` (both ends excluded, never negative) and ``interest``."""
    days = F.greatest(F.datediff(paid, due) - 1, F.lit(0))
    return bills.withColumn("days", days).withColumn("interest", amount * daily * F.col("days"))


def excise(goods: DataFrame, price: Column, quantity: Column, rate: Column, absolute: Column, included: Column) -> DataFrame:
    """Adds ``base`` and ``excise``: ad valorem plus an absolute amount a unit; with the tax included, the base is (price - absolute) / (1 + rate)."""
    base = F.when(included, (price - absolute) / (1 + rate)).otherwise(price)
    return goods.withColumn("base", F.round(base, 2)).withColumn("excise", (base * rate + absolute) * quantity)


def contractor_tax(payments: DataFrame, amount: Column, rate: Column, net_agreed: Column) -> DataFrame:
    """Adds ``revenue`` (grossed up where a net amount was agreed) and ``tax``."""
    gross = F.when(net_agreed, amount / (1 - rate)).otherwise(amount)
    return payments.withColumn("revenue", F.round(gross, 2)).withColumn("tax", F.round(gross * rate, 2))


def validate_params(params: DataFrame) -> DataFrame:
    """``name, effective_from, problem`` of parameter rows without value or source, or that repeat a date."""
    n = F.count("*").over(Window.partitionBy("name", "effective_from"))
    problem = F.when(F.col("value").isNull(), "no value").when(F.col("source").isNull(), "no source").when(n > 1, "overlap")
    return params.withColumn("problem", problem).where("problem is not null").select("name", "effective_from", "problem")


def parse_number(text: Column, machine: Column | None = None) -> Column:
    """Decimal of a number with thousand dots and a decimal comma, ``(x)`` negative, percent and currency suffixes; else null.

    In machine form a dot is the decimal point.
    """
    t = F.regexp_replace(F.trim(text), r"(?i)\s*(đ|vnd|%)$", "")
    negative = t.rlike(r"^\(.*\)$")
    t = F.regexp_replace(t, r"^\((.*)\)$", "$1")
    human = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = human if machine is None else F.when(machine, t).otherwise(human)
    value = F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), plain.cast(MONEY))
    value = F.when(negative, -value).otherwise(value)
    return F.when(text.rlike(r"%\s*\)?$"), value / 100).otherwise(value).cast(MONEY)


def reconcile(rows: DataFrame, formulas: DataFrame, keys: list[str], code: str, value: str, tolerance: float = 0.5) -> DataFrame:
    """``keys, total, stated, computed, diff, ok``: totals recomputed from signed components ``formulas(total, part, sign)``."""
    parts = rows.join(sized(formulas), F.col(code) == F.col("part")).groupBy(*keys, "total").agg(F.sum(F.col(value).cast(MONEY) * F.col("sign")).alias("computed"))
    stated = rows.select(*keys, F.col(code).alias("total"), F.col(value).cast(MONEY).alias("stated"))
    return parts.join(stated, [*keys, "total"]).withColumn("diff", F.col("stated") - F.col("computed")).withColumn("ok", F.abs("diff") <= tolerance)


def statement_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, code, period, value``: loose text lines ``code name current previous``; a code's first line counts."""
    ls = lines(texts, [key], text).withColumn("code", F.regexp_extract("text", r"^\s*([0-9]{2,3})\s", 1)).where("code <> ''")
    first = ls.groupBy(key, "code").agg(F.min_by("text", "line").alias("t"))
    nums = F.regexp_extract_all("t", F.lit(r"(\(?-?[0-9][0-9.]*(?:,[0-9]+)?\)?)(?=\s|$)"), F.lit(1))
    both = first.withColumn("n", nums).where(F.size("n") >= 3)
    each = both.select(key, "code", F.posexplode(F.slice("n", F.size("n") - 1, F.lit(2))).alias("p", "v"))
    return each.select(key, "code", F.when(F.col("p") == 0, "curr").otherwise("prev").alias("period"), parse_number(F.col("v")).alias("value"))


def scenario_tax(facts: DataFrame, salary: Column, insurance_rate: Column, dependants: Column, freelance: Column, withholding_rate: Column, personal: float, dependant: float, brackets: list) -> DataFrame:
    """Adds ``taxable`` (a month), ``salary_tax`` and ``withheld`` (a year) and their sum ``total``, from monthly gross amounts.

    The salary less insurance and deductions is taxed month by month on the
    brackets; freelance income only bears its flat withholding.
    """
    taxable = F.greatest(salary * (1 - insurance_rate) - F.lit(personal) - dependants * dependant, F.lit(0.0))
    out = facts.withColumns({"taxable": taxable, "_w": freelance * 12 * withholding_rate})
    out = out.withColumn("_t", tax_expression(F.col("taxable"), brackets) * 12)
    return out.withColumns({"salary_tax": F.bround("_t", 0), "withheld": F.bround("_w", 0), "total": F.bround(F.col("_t") + F.col("_w"), 0)}).drop("_t", "_w")


def regime_switch(filings: DataFrame, date: str, entity: str, revenue: Column, regimes: list[tuple[str, str]], always: list[str], threshold: float) -> DataFrame:
    """Adds ``regime``, the latest of ``(first day, rule)`` in force on the date (null before the first), and ``mandatory``.

    Electronic filing is mandatory for the entities ``always``, and for others above the threshold of revenue.
    """
    regime = F.lit(None).cast("string")
    for since, rule in sorted(regimes):
        regime = F.when(F.col(date) >= F.lit(since).cast("date"), F.lit(rule)).otherwise(regime)
    return filings.withColumns({"regime": regime, "mandatory": F.col(entity).isin(*always) | (revenue > threshold)})
