"""Queries of the claim-linting operators, with an English rule pack for the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamline.operators import linting
from loamline.plans.core import query, table

RULES = [
    (1, "general", "banned", "superlative", "high", "worthless", "say what is wrong"),
    (2, "general", "banned", "insult", "high", "idiot|moron|stupid", "leave out"),
    (3, "general", "banned", "insult", "medium", "loser|clown|scum", "leave out"),
    (4, "ads", "banned", "licence", "medium", "apache license", "name the licence once"),
    (5, "general", "conditional", "comparison", "medium", "disgusting|pathetic", "give a source"),
]
_LINES = r"""
    l0 AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
    l AS (SELECT doc_id, lang, line, lower(raw) AS t FROM l0 WHERE NOT regexp_matches(raw, '^\s*\[\^[A-Za-z0-9_]+\]:')),
    r(rule_order, kind, category, severity, p) AS (VALUES (1, 'banned', 'superlative', 'high', 'worthless'), (2, 'banned', 'insult', 'high', 'idiot|moron|stupid'),
        (3, 'banned', 'insult', 'medium', 'loser|clown|scum'), (5, 'conditional', 'comparison', 'medium', 'disgusting|pathetic')),
    m AS (SELECT doc_id, lang, line, t, kind, category, severity, unnest(regexp_extract_all(t, p)) AS matched FROM l, r WHERE regexp_matches(t, p)),
    f AS (SELECT *, CASE WHEN kind = 'banned' THEN 'violation' WHEN regexp_matches(t, '\b(source|according to)\b[^.;]{3,100}\b(19|20)[0-9]{2}\b') THEN 'cited' ELSE 'warning' END AS outcome FROM m)"""


def _rules(spark):
    return spark.createDataFrame(RULES, linting.RULE_SCHEMA)


def _findings(spark, d, profile="general"):
    docs = table(spark, d, "documents")
    pack = linting.compile_rules(_rules(spark), profile)
    some = linting.lintable(docs, pack)
    ls = linting.mask_phrases(linting.lint_lines(some, "doc_id"), "text", ["not worthless"])
    ls = ls.where(pack.may_match(F.col("masked")))
    matches = linting.suppress_overlaps(linting.rule_matches(ls, pack, ["doc_id", "line"], "masked"), ["doc_id", "line"])
    cited = linting.citation_ok(ls, linting.footnotes(some, "doc_id"), "doc_id", "text")
    return docs, linting.conditional_claims(matches, cited, ["doc_id", "line"], profile)


@query(rf"""
    WITH {_LINES}
    SELECT lang, category, count(DISTINCT doc_id) AS docs, count(*) AS findings FROM f GROUP BY lang, category""")
def lint_by_language(spark, d):
    docs, found = _findings(spark, d)
    return found.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "category").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("findings"))


@query(rf"""
    WITH {_LINES}, s AS (SELECT doc_id, count(*) FILTER (outcome = 'violation') AS violations, count(*) FILTER (outcome = 'warning') AS warnings FROM f GROUP BY doc_id)
    SELECT d.doc_id, coalesce(violations, 0) AS violations, coalesce(warnings, 0) AS warnings,
        CASE WHEN violations > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'REQUIRES_EVIDENCE' ELSE 'PASS' END AS status
    FROM documents d LEFT JOIN s USING (doc_id)""")
def lint_status(spark, d):
    docs, found = _findings(spark, d)
    return linting.lint_status(docs, found, "doc_id", F.col("text").isNotNull()).select("doc_id", "violations", "warnings", "status")


@query(rf"""WITH {_LINES} SELECT category, severity, count(*) AS n, count(DISTINCT matched) AS phrases FROM f GROUP BY CUBE (category, severity)""")
def lint_summary(spark, d):
    return linting.lint_summary(_findings(spark, d)[1])


@query(rf"""
    WITH {_LINES}, c AS (SELECT category, matched, count(*) AS n FROM f GROUP BY ALL)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, matched) AS INTEGER) AS rank FROM c) WHERE rank <= 3""")
def lint_top_phrases(spark, d):
    return linting.top_phrases(_findings(spark, d)[1], 3)


@query(rf"""WITH {_LINES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE outcome IN ('violation', 'warning'))""")
def publish_gate(spark, d):
    docs, found = _findings(spark, d)
    status = linting.lint_status(docs, found, "doc_id", F.col("text").isNotNull())
    return linting.publish_gate(docs, status, "doc_id").select("doc_id")


@query("""
    WITH m AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN contains(t, 'then the') OR contains(t, 'der die') THEN 'FAIL' WHEN contains(t, 'and') OR contains(t, 'und') THEN 'PASS' ELSE 'UNKNOWN' END AS status FROM m""")
def hard_blocker(spark, d):
    conv = table(spark, d, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    out = linting.hard_blocker(conv, "key", "text", ["then the", "der die"], ["and", "und"])
    return out.select("key.conv_id", "key.turn", "status")


@query("""
    WITH n AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
    SELECT doc_id, 'a' AS note, CASE WHEN k = 0 THEN 'first' ELSE 'report ' || (2000 + k) END AS body FROM n UNION ALL SELECT doc_id, 'b', 'internal 2001' FROM n""")
def footnotes(spark, d):
    last = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("\n[^a]: Report "), (F.col("doc_id") % 4 + 2000).cast("string")))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("x[^a]\n[^a]: First\n[^b]: Internal 2001"), last).alias("text"))
    return linting.footnotes(docs, "doc_id")


_TOLD = r"""
    t AS (SELECT doc_id, string_split(lower(text || chr(10) || 'not idiot but stupid' || chr(10) || 'avoid "stupid" and stupid: ' || lang), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM t),
    w AS (SELECT doc_id, line, t, word, unnest(list_filter(range(1, length(t) + 1), lambda i: substring(t, i, length(word)) = word)) AS start
          FROM l, (VALUES ('idiot'), ('stupid'), ('moron')) AS words(word) WHERE contains(t, word)),
    q AS (SELECT *, substring(t, greatest(start - 14, 1), least(start - 1, 14)) AS before,
          list_filter(regexp_extract_all(t, '["“”«»''][^"“”«»''\n]{1,120}["“”«»'']|\*[^*\n]{1,120}\*'), lambda s: instr(t, s) <= start AND start + length(word) <= instr(t, s) + length(s)) AS spans FROM w)"""


@query(rf"""
    WITH {_TOLD}
    SELECT doc_id, line, start, word AS matched FROM q
    WHERE NOT regexp_matches(before, '(not|never|no)\s*$') AND NOT (regexp_matches(t, '(avoid|instead of|do not (use|say)|replace)') AND len(spans) > 0)""")
def drop_mentions(spark, d):
    told = F.concat_ws("\n", "text", F.lit("not idiot but stupid"), F.concat(F.lit('avoid "stupid" and stupid: '), "lang"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", told.alias("text"))
    pack = linting.compile_rules(_rules(spark).where("rule_order = 2"))
    ls = linting.mask_phrases(linting.lint_lines(linting.lintable(docs, pack), "doc_id"), "text", [])
    found = linting.drop_mentions(linting.rule_matches(ls, pack, ["doc_id", "line"], "masked"), "masked")
    return found.select("doc_id", "line", F.col("start").cast("long").alias("start"), "matched")
