"""Claim linting: rules over the lines of documents, citations and gates.

Rule packs are tables: ``rule_order int, profile, kind (banned | conditional),
category, severity, pattern, suggestion``; patterns are in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from loamline.functions.patterns import prefilter
from loamline.functions.text import lines, run_id, sized

OPEN, CLOSE = "\ue000", "\ue001"

RULE_SCHEMA = "rule_order int, profile string, kind string, category string, severity string, pattern string, suggestion string"


def lint_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, line, text`` of the lines outside code fences that are no footnote definitions."""
    ls = lines(docs, [key], text)
    fence = F.trim("text").startswith("```")
    ls = ls.withColumn("_f", fence).withColumn("_open", run_id(F.col("_f"), [key], "line") % 2 == 1)
    return ls.where(~F.col("_f") & ~F.col("_open") & ~F.col("text").rlike(r"^\s*\[\^[A-Za-z0-9_]+\]:")).select(key, "line", "text")


def footnotes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, note, body`` (lower case); the last definition of a note wins."""
    ls = lines(docs, [key], text)
    note = F.regexp_extract("text", r"^\s*\[\^([A-Za-z0-9_]+)\]:\s*(.*)$", 1)
    body = F.lower(F.regexp_extract("text", r"^\s*\[\^([A-Za-z0-9_]+)\]:\s*(.*)$", 2))
    return ls.withColumns({"note": note, "body": body}).where("note <> ''").groupBy(key, "note").agg(F.max_by("body", "line").alias("body"))


def mask_phrases(df: DataFrame, text: str, patterns: list[str]) -> DataFrame:
    """Adds ``masked``: the line in lower case, allowed phrases replaced by as many blanks, so places stay."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    for p in patterns:
        t = F.aggregate(F.regexp_extract_all(t, F.lit(p), F.lit(0)), t, lambda acc, m: F.when(m == "", acc).otherwise(F.replace(acc, m, F.repeat(F.lit(" "), F.length(m)))))
    return df.withColumn("masked", t)


def match_places(line: Column, pattern: Column) -> Column:
    """Array of ``struct(start, end, text)`` (1-based, end exclusive) of all matches in a line.

    Each match is put between two marks where it is found, so look-around counts
    as it stands; the marks' own characters (private use) are no part of a match.
    """
    kind = "array<struct<start:int,end:int,text:string>>"
    clean = F.translate(line, OPEN + CLOSE, "\ufffd\ufffd")
    parts = F.split(F.regexp_replace(clean, pattern, F.lit(OPEN + "$0" + CLOSE)), OPEN, -1)

    def step(state: Column, part: Column) -> Column:
        matched = F.substring_index(part, CLOSE, 1)
        end = state["at"] + F.length(matched)
        place = F.struct(state["at"].alias("start"), end.alias("end"), matched.alias("text"))
        found = F.when(matched == "", state["found"]).otherwise(F.array_append(state["found"], place))
        return F.struct((state["at"] + F.length(part) - 1).alias("at"), found.alias("found"))

    start = F.struct((F.length(F.get(parts, F.lit(0))) + 1).alias("at"), F.array().cast(kind).alias("found"))
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda state: state["found"])


@dataclass(frozen=True)
class RulePack:
    """The rules of a profile in their order, with ``needed``: an expression that any text with a match has, or None."""

    rules: tuple[Row, ...]
    needed: str | None

    def may_match(self, text: Column) -> Column:
        """Whether a text, split into lines or not, can have a match at all."""
        return F.lower(text).rlike(self.needed) if self.needed else F.lit(bool(self.rules)) & text.isNotNull()


def compile_rules(rules: DataFrame, profile: str = "general", most: int = 10_000) -> RulePack:
    """The pack of ``profile``; rule packs are small, one of more than ``most`` rules is an error."""
    own = rules.where(F.col("profile").isin("general", profile)).orderBy("rule_order").limit(most + 1).collect()
    if len(own) > most:
        raise ValueError(f"a pack has {most} rules at most")
    return RulePack(tuple(own), prefilter(r["pattern"] for r in own))


def lintable(docs: DataFrame, pack: RulePack, text: str = "text") -> DataFrame:
    """The documents whose whole text has a literal of some rule: no others can have a finding."""
    return docs.where(pack.may_match(F.col(text)))


def rule_matches(ls: DataFrame, rules: DataFrame | RulePack, keys: list[str], text: str, profile: str = "general") -> DataFrame:
    """``keys, rule columns, start, end, matched``: every match of every rule of the profile.

    One automaton of the literals that the rules need is run over a line first
    (and over whole texts, see ``lintable``); a line that has one meets the
    rules, each a constant of the plan. A line enters no join.
    """
    pack = rules if isinstance(rules, RulePack) else compile_rules(rules, profile)
    line = F.col(text)
    names = ["rule_order", "kind", "category", "severity", "suggestion"]

    def found(rule: Row) -> Column:
        about = [F.lit(rule[n]).cast("int" if n == "rule_order" else "string").alias(n) for n in names]
        places = F.when(line.rlike(rule["pattern"]), match_places(line, F.lit(rule["pattern"])))
        return F.transform(places, lambda m: F.struct(*about, m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("matched")))

    kind = "array<struct<rule_order:int,kind:string,category:string,severity:string,suggestion:string,start:int,end:int,matched:string>>"
    every = F.filter(F.array(*map(found, pack.rules)), lambda one: one.isNotNull()) if pack.rules else F.array()
    matches = ls.where(pack.may_match(line)).select(*keys, text, F.explode(F.flatten(every) if pack.rules else every.cast(kind)).alias("_m"))
    return matches.select(*keys, text, *(F.col(f"_m.{n}").alias(n) for n in [*names, "start", "end", "matched"]))


def drop_mentions(matches: DataFrame, text: str, negation: str = r"(not|never|no)\s*$", cue: str = r"(avoid|instead of|do not (use|say)|replace)") -> DataFrame:
    """Leaves out matches that a negation stands before (within 14 characters), or that are quoted on an instruction line."""
    before = F.substring(F.col(text), F.greatest(F.col("start") - 14, F.lit(1)), F.least(F.col("start") - 1, F.lit(14)))
    spans = match_places(F.col(text), F.lit("[\"“”«»'][^\"“”«»'\\n]{1,120}[\"“”«»']|\\*[^*\\n]{1,120}\\*"))
    quoted = F.exists(spans, lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end")))
    return matches.where(~(before.rlike(negation) | (F.col(text).rlike(cue) & quoted)))


def suppress_overlaps(matches: DataFrame, keys: list[str]) -> DataFrame:
    """In rule order, drops a match that starts inside a span of the line accepted before. The fold is bounded by a line."""
    cols = [c for c in matches.columns if c not in keys]
    per = matches.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("rule_order").alias("_o"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.struct(*cols).alias("m")))).alias("all"))
    empty = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", empty, lambda acc, x: F.when(F.exists(acc, lambda a: (x["_s"] >= a["_s"]) & (x["_s"] < a["_e"])), acc).otherwise(F.array_append(acc, x)))
    return per.select(*keys, F.explode(kept).alias("x")).select(*keys, *(F.col(f"x.m.{c}").alias(c) for c in cols))


def citation_ok(ls: DataFrame, notes: DataFrame, key: str, text: str, citation: str = r"\b(source|according to)\b[^.;]{3,100}\b(19|20)[0-9]{2}\b", weak: str = "internal|self-published") -> DataFrame:
    """Adds ``cited``: the line names a dated source, or a footnote with a year, that is not a weak one."""
    ref = ls.withColumn("_note", F.regexp_extract(text, r"\[\^([A-Za-z0-9_]+)\]", 1))
    j = ref.join(notes.select(F.col(key).alias("_k"), F.col("note").alias("_n"), F.col("body").alias("_body")), (F.col(key) == F.col("_k")) & (F.col("_note") == F.col("_n")), "left")
    own = F.lower(F.col(text)).rlike(citation) & ~F.lower(F.col(text)).rlike(weak)
    noted = F.coalesce(F.col("_body").rlike("(19|20)[0-9]{2}") & ~F.col("_body").rlike(weak), F.lit(False))
    return j.withColumn("cited", own | noted).drop("_note", "_k", "_n", "_body")


def conditional_claims(matches: DataFrame, cited: DataFrame, keys: list[str], profile: str = "general") -> DataFrame:
    """Adds ``outcome`` to matches: banned ones are violations; conditional ones, unless cited, warnings (violations in other profiles)."""
    j = matches.join(cited.select(*keys, "cited"), keys, "left")
    missing = "warning" if profile == "general" else "violation"
    return j.withColumn("outcome", F.when(F.col("kind") == "banned", "violation").when(F.coalesce("cited", F.lit(False)), "cited").otherwise(missing))


def lint_status(docs: DataFrame, findings: DataFrame, key: str, readable: Column, strict: bool = False) -> DataFrame:
    """``key, violations, warnings, status`` for every document."""
    per = findings.groupBy(F.col(key).alias("_k")).agg(F.count_if(F.col("outcome") == "violation").alias("violations"), F.count_if(F.col("outcome") == "warning").alias("warnings"))
    j = docs.join(per, F.col(key) == F.col("_k"), "left").withColumns({"violations": F.coalesce("violations", F.lit(0)), "warnings": F.coalesce("warnings", F.lit(0))})
    status = F.when(~readable, "BLOCKED").when(F.col("violations") > 0, "FAIL").when(F.col("warnings") > 0, "FAIL" if strict else "REQUIRES_EVIDENCE").otherwise("PASS")
    return j.withColumn("status", status).drop("_k")


def lint_summary(findings: DataFrame) -> DataFrame:
    """Cube of findings over category and severity."""
    return findings.cube("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("matched").alias("phrases"))


def hard_blocker(docs: DataFrame, key: str, text: str, phrases: list[str], terms: list[str]) -> DataFrame:
    """``key, status``: FAIL if a phrase occurs, PASS if a compliance term does, else UNKNOWN."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: t.contains(x))
    return docs.select(key, F.when(hit(phrases), "FAIL").when(hit(terms), "PASS").otherwise("UNKNOWN").alias("status"))


def publish_gate(posts: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """The posts whose lint status is PASS."""
    return posts.join(status.where("status <> 'PASS'").select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def first_hits(ls: DataFrame, patterns: DataFrame, keys: list[str], text: str) -> DataFrame:
    """First line of each ``keys`` and pattern ``id`` that matches: ``keys, id, line``."""
    return ls.join(sized(patterns), F.expr(f"{text} rlike pattern")).groupBy(*keys, "id").agg(F.min("line").alias("line"))


def top_phrases(findings: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent matched phrases of each category, ties by phrase."""
    counts = findings.groupBy("category", "matched").agg(F.count("*").alias("n"))
    w = Window.partitionBy("category").orderBy(F.col("n").desc(), "matched")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
