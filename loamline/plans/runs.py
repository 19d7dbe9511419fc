"""Queries of the run-evaluation operators: events and conversations stand for transcripts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamline.operators import runs
from loamline.plans.core import query, table

_IDX = "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx"
_CALLS = f"c AS (SELECT user_id AS run, {_IDX}, event_id, ts, value, CASE event_type WHEN 'view' THEN 'view_file' WHEN 'click' THEN 'run_command' WHEN 'purchase' THEN 'write_to_file' WHEN 'error' THEN 'replace_file_content' ELSE '' END AS name, '/skills/s' || (CAST(floor(value) AS INTEGER) % 5) || CASE WHEN event_id % 3 = 0 THEN '/SKILL.md' WHEN event_id % 3 = 1 THEN '/scripts/pytest' ELSE '/rules/r' || (event_id % 4) || '.md' END AS arg, event_type FROM events)"


def _calls(spark, d):
    e = table(spark, d, "events")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    name = F.when(F.col("event_type") == "view", "view_file").when(F.col("event_type") == "click", "run_command").when(F.col("event_type") == "purchase", "write_to_file").when(F.col("event_type") == "error", "replace_file_content").otherwise("")
    tail = F.when(F.col("event_id") % 3 == 0, "/SKILL.md").when(F.col("event_id") % 3 == 1, "/scripts/pytest").otherwise(F.concat(F.lit("/rules/r"), (F.col("event_id") % 4).cast("string"), F.lit(".md")))
    arg = F.concat(F.lit("/skills/s"), (F.floor("value").cast("int") % 5).cast("string"), tail)
    return e.select(F.col("user_id").alias("run"), idx.alias("idx"), "event_id", "ts", "value", "event_type", name.alias("name"), arg.alias("arg"))


def _steps(spark, d):
    conv = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "USER_INPUT").when(F.col("role") == "assistant", "PLANNER_RESPONSE").otherwise("GENERIC")
    return conv.select(
        F.col("conv_id").alias("run"), F.col("turn").alias("idx"), kind.alias("type"), F.when(F.col("role") == "assistant", "MODEL").otherwise("USER").alias("source"), F.when(F.col("turn") % 5 == 3, "ERROR").otherwise("DONE").alias("status"),
        F.col("text").alias("content"), F.when(F.col("turn") > 0, F.concat(F.lit("2024-01-01T00:00:0"), F.col("turn").cast("string"), F.lit("Z"))).alias("created_at"), (F.col("turn") % 2).cast("int").alias("exit_code"), F.lit(0).alias("n_calls"),
    )


@query("""
    SELECT conv_id AS run, count(*) AS steps, count(*) FILTER (role = 'assistant') AS model_steps, count(*) FILTER (turn % 5 = 3) AS errors,
        '2024-01-01T00:00:0' || (min(turn) FILTER (turn > 0)) || 'Z' AS first_ts, '2024-01-01T00:00:0' || (max(turn) FILTER (turn > 0)) || 'Z' AS last_ts,
        CAST(coalesce(sum(length(text)) FILTER (role NOT IN ('user', 'assistant')), 0) AS BIGINT) AS tool_chars
    FROM conversations GROUP BY conv_id""")
def step_facts(spark, d):
    return runs.step_facts(_steps(spark, d), "run")


@query("SELECT conv_id AS run, md5(arg_min(trim(text), turn)) AS prompt_md5 FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def first_prompt(spark, d):
    return runs.first_prompt(_steps(spark, d), "run").select("run", F.md5("prompt").alias("prompt_md5"))


@query("SELECT conv_id AS run, md5(arg_max(trim(text), turn)) AS response_md5 FROM conversations WHERE role = 'assistant' AND text <> '' GROUP BY conv_id")
def final_response(spark, d):
    return runs.final_response(_steps(spark, d), "run").select("run", F.md5("response").alias("response_md5"))


@query(f"WITH {_CALLS} SELECT run, name, count(*) AS calls FROM c WHERE name <> '' GROUP BY run, name")
def tool_histogram(spark, d):
    return runs.tool_histogram(_calls(spark, d), "run")


@query(f"WITH {_CALLS} SELECT run, count(*) AS reads, count(DISTINCT arg) AS distinct_reads, count(*) - count(DISTINCT arg) AS repeated, round_even((count(*) - count(DISTINCT arg)) / count(*), 3) AS duplication FROM c WHERE name = 'view_file' GROUP BY run")
def file_reads(spark, d):
    return runs.file_reads(_calls(spark, d).where("name = 'view_file'"), "run")


@query(f"WITH {_CALLS}, p AS (SELECT run, arg, count(*) AS reads, min(idx) AS f FROM c WHERE name = 'view_file' GROUP BY run, arg HAVING count(*) > 1) SELECT run, arg, reads, CAST(row_number() OVER (PARTITION BY run ORDER BY reads DESC, f) AS INTEGER) AS rank FROM p")
def repeated_files(spark, d):
    return runs.repeated_files(_calls(spark, d).where("name = 'view_file'"), "run")


@query(f"""WITH {_CALLS} SELECT run, count(DISTINCT arg) FILTER (contains(arg, '/skills/') AND arg LIKE '%SKILL.md') AS skills, count(DISTINCT arg) FILTER (contains(arg, '/rules/') AND arg LIKE '%.md') AS rules, count(DISTINCT arg) FILTER (contains(arg, 'fixtures/')) AS fixtures,
    count(DISTINCT arg) FILTER (NOT (contains(arg, '/skills/') OR contains(arg, '/rules/') OR contains(arg, 'fixtures/'))) AS other FROM c GROUP BY run""")
def read_categories(spark, d):
    return runs.read_categories(_calls(spark, d), "run")


@query(rf"""WITH {_CALLS}, s AS (SELECT run, idx, CASE WHEN name = 'view_file' THEN regexp_extract(arg, '/skills/([A-Za-z0-9_-]+)/SKILL\.md', 1) WHEN name = 'run_command' THEN regexp_extract(arg, '/skills/([A-Za-z0-9_-]+)/scripts/', 1) END AS skill FROM c)
    SELECT run, arg_min(skill, idx) AS skill, min(idx) AS idx FROM s WHERE skill IS NOT NULL AND skill <> '' GROUP BY run""")
def skill_intake(spark, d):
    return runs.skill_intake(_calls(spark, d), "run").withColumn("idx", F.col("idx").cast("long"))


@query(rf"""WITH {_CALLS}, r AS (SELECT run, regexp_extract(arg, '(rules/[A-Za-z0-9_-]+\.md)', 1) AS r, min(idx) AS i FROM c WHERE regexp_matches(arg, 'rules/[A-Za-z0-9_-]+\.md') GROUP BY ALL) SELECT run, string_agg(r, ',' ORDER BY i) AS rules FROM r GROUP BY run""")
def rules_read(spark, d):
    return runs.rules_read(_calls(spark, d), "run")


@query(f"""WITH {_CALLS}, s AS (SELECT run, idx, name, arg, lead(event_type) OVER w AS t, lead(CAST(event_id % 3 AS INTEGER)) OVER w AS x FROM c WINDOW w AS (PARTITION BY run ORDER BY idx))
    SELECT run, idx, 'pytest' AS verifier, CASE WHEN t = 'error' THEN 1 ELSE coalesce(x, 0) END AS exit_code FROM s WHERE name = 'run_command' AND contains(arg, 'pytest')""")
def verifier_runs(spark, d):
    calls = _calls(spark, d)
    steps = calls.select("run", "idx", F.when(F.col("event_type") == "error", "ERROR").alias("status"), (F.col("event_id") % 3).cast("int").alias("exit_code"))
    return runs.verifier_runs(steps, calls.where("name = 'run_command'"), ["pytest", "tsc"], "run").withColumn("idx", F.col("idx").cast("long"))


@query(f"WITH {_CALLS} SELECT run, count(*) AS modified, count(*) FILTER (name = 'write_to_file') AS created, min(idx) FILTER (name = 'write_to_file') AS first_write, max(idx) FILTER (name = 'write_to_file') AS last_write FROM c WHERE name IN ('write_to_file', 'replace_file_content') GROUP BY run")
def artifact_writes(spark, d):
    return runs.artifact_writes(_calls(spark, d), "run").withColumns({"first_write": F.col("first_write").cast("long"), "last_write": F.col("last_write").cast("long")})


@query("""
    SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'UNKNOWN' WHEN substring(o_orderpriority, 1, 1) = '1' THEN 'PASS' ELSE 'FAIL' END AS status FROM orders""")
def routing_status(spark, d):
    got = F.when(F.col("o_orderpriority") != "5-LOW", F.substring("o_orderpriority", 1, 1))
    return table(spark, d, "orders").select("o_orderkey", runs.equal_status(got, F.lit("1")).alias("status"))


@query("""
    WITH r AS (SELECT l_orderkey, l_returnflag, CAST(l_tax > 0.07 AS INTEGER) AS x FROM lineitem), p AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r, max(x) AS x FROM r GROUP BY 1)
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'PASS' WHEN NOT coalesce(a, false) OR (o_orderstatus = 'F' AND NOT coalesce(r, false)) OR coalesce(x, 0) <> 0 THEN 'FAIL' ELSE 'PASS' END AS status
    FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def verification_status(spark, d):
    need = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("A"), F.lit("R"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    tasks = table(spark, d, "orders").select("o_orderkey", need.alias("required"))
    ran = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("verifier"), (F.col("l_tax") > 0.07).cast("int").alias("exit_code"))
    return runs.verification_status(tasks, ran, "o_orderkey")


@query("""
    WITH h AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0), s AS (SELECT DISTINCT source FROM documents), n AS (SELECT source, x FROM s, (VALUES ('en'), ('es'), ('xx')) t(x))
    SELECT source, count(*) FILTER (h.lang IS NULL) AS missing FROM n LEFT JOIN h USING (source) WHERE false GROUP BY source
    UNION ALL SELECT n.source, count(*) FILTER (NOT EXISTS (SELECT 1 FROM h WHERE h.source = n.source AND h.lang = n.x)) FROM n GROUP BY n.source""")
def artifact_match(spark, d):
    docs = table(spark, d, "documents")
    tasks = docs.select("source").distinct().withColumn("expected", F.array(F.lit(".en"), F.lit(".es"), F.lit(".xx")))
    paths = docs.where("doc_id % 3 = 0").select("source", F.concat(F.lit("out/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"))
    return runs.artifact_match(tasks, paths, "source", F.regexp_extract("path", r"(\.[a-z]+)$", 1))


@query(r"""
    WITH t AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), h AS (SELECT *, regexp_matches(t, '\bund der\b') AS going, regexp_extract(t, '(\bthe (and|of)\b)', 1) AS a, regexp_extract(t, '(\bund die\b)', 1) AS b FROM t)
    SELECT conv_id, turn, concat_ws(';', CASE WHEN a <> '' AND (NOT going OR contains(a, 'and')) THEN a END, CASE WHEN b <> '' AND NOT going THEN b END) AS evidence,
        (a <> '' AND (NOT going OR contains(a, 'and'))) OR (b <> '' AND NOT going) AS claimed FROM h""")
def completion_claim(spark, d):
    """A null text claims nothing either way: null."""
    out = runs.completion_claim(table(spark, d, "conversations"), "text", [r"\bthe (?:and|of)\b", r"\bund die\b"], [r"\bund der\b"], ["and"])
    return out.select("conv_id", "turn", "evidence", F.when(F.col("text").isNotNull(), F.col("claimed")).alias("claimed"))


@query("""
    SELECT event_id, CASE WHEN event_type = 'error' AND value > 10 THEN 'COMPLETED' WHEN event_type = 'error' THEN 'INTERRUPTED_IN_PROGRESS' WHEN event_type = 'click' THEN CASE WHEN value > 10 THEN 'INTERRUPTED_IN_PROGRESS' ELSE 'FAILED' END
        WHEN event_type = 'view' THEN 'BLOCKED' WHEN event_type = 'signup' OR event_id % 2 = 0 THEN 'COMPLETED' ELSE 'UNKNOWN' END AS ended FROM events""")
def termination(spark, d):
    t = F.col("event_type")
    status = F.when(t == "error", "TIMEOUT").when(t == "click", "ERROR").when(t == "view", "BLOCKED").when(t == "signup", "PASS").otherwise("SUCCESS")
    conv = F.when(F.col("event_id") % 2 == 0, F.col("user_id"))
    return table(spark, d, "events").select("event_id", runs.termination(status, F.lit(None).cast("string"), conv, F.col("value") > 10).alias("ended"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 100000 OR o_custkey % 2 = 0 ELSE o_totalprice > 100000 AND (o_custkey % 3 = 0 OR o_custkey % 5 = 0) END AS false_done,
        CASE WHEN o_custkey % 7 = 0 OR o_orderpriority = '1-URGENT' THEN 'FAIL' WHEN o_orderpriority = '2-HIGH' THEN 'UNKNOWN' ELSE 'PASS' END AS overall FROM orders""")
def false_done_and_status(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_custkey")
    done = runs.false_done(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, k % 2 == 0, k % 3 == 0, k % 5 == 0)
    checks = F.create_map(F.lit("substantive_x"), F.when(F.col("o_orderpriority") == "3-MEDIUM", "UNKNOWN").when(F.col("o_orderpriority") == "1-URGENT", "FAIL").otherwise("PASS"), F.lit("format"), F.when(F.col("o_orderpriority") == "2-HIGH", "UNKNOWN").otherwise("PASS"))
    overall = runs.overall_status(F.lit("COMPLETED"), F.lit(False), F.lit("PASS"), F.when(k % 7 == 0, "FAIL").otherwise("PASS"), checks)
    return o.select("o_orderkey", done.alias("false_done"), overall.alias("overall"))


@query(f"""WITH {_CALLS}, r AS (SELECT run, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS model_steps, count(arg) FILTER (name = 'view_file') AS reads, count(arg) FILTER (name = 'view_file') - count(DISTINCT arg) FILTER (name = 'view_file') AS repeated,
        max(idx) FILTER (name = 'write_to_file') AS last_write, max(event_id) AS total_tokens, min(event_id) AS output_tokens FROM c GROUP BY run)
    SELECT run, round_even(calls / greatest(model_steps, 1), 3) AS tool_density, round_even(repeated / greatest(reads, 1), 3) AS duplication, CASE WHEN total_tokens > 0 THEN round_even(output_tokens / total_tokens, 4) END AS output_share,
        CASE WHEN last_write IS NULL THEN 0 ELSE greatest(0, model_steps - last_write) END AS steps_after_write FROM r""")
def efficiency(spark, d):
    view = F.col("name") == "view_file"
    facts = _calls(spark, d).groupBy("run").agg(
        F.count("*").alias("calls"), F.count_if(F.col("event_type") != "error").alias("model_steps"), F.count_if(view).alias("reads"), (F.count_if(view) - F.countDistinct(F.when(view, F.col("arg")))).alias("repeated"),
        F.max(F.when(F.col("name") == "write_to_file", F.col("idx"))).cast("long").alias("last_write"), F.max("event_id").alias("total_tokens"), F.min("event_id").alias("output_tokens"),
    )
    return runs.efficiency(facts).select("run", "tool_density", "duplication", "output_share", "steps_after_write")


@query("""
    WITH r AS (SELECT CAST(user_id % 4 AS INTEGER) AS suite, event_type AS task, CASE WHEN value > 8 THEN 'PASS' ELSE 'FAIL' END AS status, value AS seconds, CASE WHEN event_id % 5 > 0 THEN event_id END AS tokens, event_id % 9 = 0 AS fd FROM events)
    SELECT suite, task, count(*) AS runs, count(*) FILTER (status = 'PASS') AS passed, median(seconds) AS median_seconds, CAST(median(tokens) AS DOUBLE) AS median_tokens, avg(CAST(fd AS INTEGER)) AS false_done_rate FROM r GROUP BY GROUPING SETS ((suite, task), (suite))""")
def suite_scorecard(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 4).cast("int").alias("suite"), F.col("event_type").alias("task"), F.when(F.col("value") > 8, "PASS").otherwise("FAIL").alias("status"), F.col("value").alias("seconds"), F.when(F.col("event_id") % 5 > 0, F.col("event_id")).alias("tokens"), (F.col("event_id") % 9 == 0).alias("false_done"))
    return runs.suite_scorecard(e, "suite", "task")


@query("""
    WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(count(*) AS DOUBLE) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders GROUP BY ALL),
    l AS (SELECT o_custkey, y, 'orders' AS metric, orders AS v FROM y UNION ALL SELECT o_custkey, y, 'spend', spend FROM y),
    j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.metric, b.metric) AS metric, a.v AS base, b.v AS variant FROM (SELECT * FROM l WHERE y = 1996) a FULL JOIN (SELECT * FROM l WHERE y = 1997) b ON a.o_custkey = b.o_custkey AND a.metric = b.metric)
    SELECT o_custkey, metric, base, variant, round(variant - base, 2) AS delta FROM j""")
def ab_compare(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").cast("double").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"))
    out = runs.ab_compare(o.where("y = 1996").drop("y"), o.where("y = 1997").drop("y"), "o_custkey", ["orders", "spend"])
    return out.select("o_custkey", "metric", "base", "variant", F.round("delta", 2).alias("delta"))


@query("""
    WITH o AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 15 <> 1)
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.s AS old_status, n.s AS new_status FROM o FULL JOIN n USING (o_orderkey) WHERE o.s IS DISTINCT FROM n.s""")
def reclassify_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 15 <> 1").withColumn("status", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("status")))
    return runs.reclassify_diff(o.where("o_orderkey % 10 <> 0"), new, "o_orderkey", ["status"])


@query(f"WITH {_CALLS}, p AS (SELECT run, arg, count(*) - 1 AS x FROM c GROUP BY run, arg) SELECT arg, CAST(sum(x) AS BIGINT) AS extra_reads, count(*) FILTER (x > 0) AS runs FROM p GROUP BY arg ORDER BY extra_reads DESC, arg LIMIT 15")
def repeat_hotspots(spark, d):
    return runs.repeat_hotspots(_calls(spark, d), "run", "arg", 15)


@query("""
    WITH c AS (SELECT event_id, event_type, user_id FROM events)
    SELECT event_id, CASE event_type WHEN 'error' THEN 'recursive delete' WHEN 'purchase' THEN 'forced push' ELSE 'hard reset' END AS reason FROM c WHERE event_type IN ('error', 'purchase', 'click')""")
def command_audit(spark, d):
    cmd = F.when(F.col("event_type") == "error", "cd x && sudo rm -rf build; git reset --hard").when(F.col("event_type") == "purchase", "A=1 git push --force origin main").when(F.col("event_type") == "click", "git fetch | env git reset --hard HEAD~1").otherwise("ls -la; git status")
    rules = spark.createDataFrame([(1, r"^rm\s+-\w*r", "recursive delete"), (2, r"^git\s+push\s.*--force", "forced push"), (3, r"^git\s+reset\s+--hard", "hard reset")], "rule_order int, pattern string, reason string")
    return runs.command_audit(table(spark, d, "events").select("event_id", cmd.alias("cmd")), rules, ["event_id"], "cmd")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
def pending_runs(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
    return runs.pending_runs(table(spark, d, "customer").select("c_custkey"), done.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""
    SELECT event_id, 'props' AS field, 'missing' AS problem FROM events WHERE event_id % 6 = 0
    UNION ALL SELECT event_id, 'event_type', 'not allowed' FROM events WHERE event_type NOT IN ('view', 'click', 'signup')""")
def validate_records(spark, d):
    e = table(spark, d, "events").withColumn("props", F.when(F.col("event_id") % 6 != 0, F.col("props")))
    return runs.validate_records(e, "event_id", ["props", "ts"], {"event_type": ["view", "click", "signup"]})


@query("""
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND turn < 4 THEN CASE WHEN contains(lower(text), 'the') THEN 'VALID_CLARIFICATION' ELSE 'UNNECESSARY_CLARIFICATION' END END AS kind FROM conversations""")
def clarification(spark, d):
    conv = table(spark, d, "conversations")
    return conv.select("conv_id", "turn", runs.clarification(F.col("turn") % 2 == 0, F.when(F.col("turn") < 4, 0).otherwise(1), F.col("text"), ["the"]).alias("kind"))


@query(f"""
    WITH {_CALLS}, n AS (SELECT run, count(*) AS calls FROM c WHERE name <> '' GROUP BY 1), r AS (SELECT run, count(*) AS reads, count(DISTINCT arg) AS distinct_reads FROM c WHERE name = 'view_file' GROUP BY 1)
    SELECT u.run, calls, reads, distinct_reads, n.run IS NULL AS idle FROM (SELECT DISTINCT run FROM c) u LEFT JOIN n ON n.run = u.run LEFT JOIN r ON r.run = u.run""")
def run_records(spark, d):
    c = _calls(spark, d)
    reads = runs.file_reads(c.where("name = 'view_file'"), "run").select("run", "reads", "distinct_reads")
    out = runs.run_records(c, "run", {"tools": c.where("name <> ''").groupBy("run").agg(F.count("*").alias("calls")), "files": reads})
    return out.select("run", "record.tools.calls", "record.files.reads", "record.files.distinct_reads", F.col("record.tools").isNull().alias("idle"))


_FACTS = f"""{_CALLS}, f AS (SELECT run, count(*) FILTER (name = 'view_file') AS reads, count(DISTINCT arg) FILTER (name = 'view_file') AS unique_reads, list(arg ORDER BY idx) FILTER (name = 'view_file') AS files,
    list(arg ORDER BY idx) FILTER (name = 'run_command') AS commands, max(idx) + 1 AS steps FROM c GROUP BY run)"""


def _facts(spark, d):
    """One row a run; some runs lack a prompt, have a status that is not allowed, or no commands at all."""
    c = _calls(spark, d)
    told = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("name") == name, F.struct("idx", "arg")))), lambda s: s["arg"])
    is_read = F.col("name") == "view_file"
    per = c.groupBy("run").agg(F.count_if(is_read).alias("file_read_count"), F.countDistinct(F.when(is_read, F.col("arg"))).alias("unique_file_read_count"), told("view_file").alias("files_read"), told("run_command").alias("commands_run"), (F.max("idx") + 1).alias("total_agent_steps"))
    none = F.array().cast("array<string>")
    return per.select(
        F.concat(F.lit("run-"), F.col("run").cast("string")).alias("run_id"), F.concat(F.lit("T"), (F.col("run") % 12).cast("string")).alias("task_id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("antigravity_cli").alias("interface"),
        F.lit("0abc").alias("git_commit"), F.when(F.col("run") % 7 != 0, "do it").alias("raw_prompt"), F.lit("writer").alias("skill"), F.lit("NONE").alias("evidence_level"), none.alias("rules_explicitly_read"), none.alias("tools_called"),
        "files_read", F.when(F.size("commands_run") > 0, F.col("commands_run")).alias("commands_run"), none.alias("files_modified"), none.alias("artifacts_created"), none.alias("artifact_paths"), F.array().alias("agent_verifiers_executed"),
        F.when(F.col("run") % 5 == 0, "MAYBE").otherwise("PASS").alias("overall_status"), F.lit("PASS").alias("status"), F.lit(False).alias("false_done_detected"), F.create_map(F.lit("table"), F.lit("PASS")).alias("layer_l2_artifact_quality"),
        "file_read_count", "unique_file_read_count", "total_agent_steps",
    )


def _records(spark, d):
    behavior = "evaluation.layer_l1_agent_behavior."
    status = {f"{behavior}{name}": "status" for name in ("skill_routing", "workflow_compliance", "agent_verification")} | {"evaluation.layer_l0_infrastructure": "status"}
    return runs.agent_run_records(_facts(spark, d).drop("agent_verifiers_executed").withColumn("agent_verifiers_executed", F.array().cast(runs.RECORD["observed"]["agent_verifiers_executed"])), status)


@query(f"""
    WITH {_FACTS} SELECT 'run-' || run AS run_id, 'T' || (run % 12) AS task_id, CAST(reads AS INTEGER) AS reads, CAST(unique_reads AS INTEGER) AS unique_reads, CAST(steps AS INTEGER) AS steps, array_to_string(coalesce(files, []), ',') AS files,
        CAST(NULL AS DOUBLE) AS elapsed, CASE WHEN run % 5 = 0 THEN 'MAYBE' ELSE 'PASS' END AS overall FROM f""")
def agent_run_records(spark, d):
    r = _records(spark, d)
    loop = "record.metrics.execution_loop_complexity.total_agent_steps"
    return r.select("run_id", "record.task_id", F.col("record.metrics.file_read_count").alias("reads"), F.col("record.metrics.unique_file_read_count").alias("unique_reads"), F.col(loop).alias("steps"), F.array_join("record.observed.files_read", ",").alias("files"), F.col("record.metrics.elapsed_seconds").alias("elapsed"), F.col("record.evaluation.overall_status").alias("overall"))


@query(f"""
    WITH {_FACTS} SELECT 'run-' || run AS run_id, 'input.raw_prompt' AS field, 'missing' AS problem FROM f WHERE run % 7 = 0 UNION ALL SELECT 'run-' || run, 'observed.commands_run', 'missing' FROM f WHERE commands IS NULL
    UNION ALL SELECT 'run-' || run, 'evaluation.overall_status', 'not allowed' FROM f WHERE run % 5 = 0""")
def record_errors(spark, d):
    return runs.record_errors(_records(spark, d))
