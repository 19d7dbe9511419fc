"""Small examples, nulls and empty inputs of the core operators."""

from pyspark.sql import functions as F

from loamline.operators import citations, filings, ingest, linting, reuse, runs
from loamline.sources import readers


def test_detect_format_and_encoding(spark):
    rows = [(1, b"%PDF-1.7 x", ".txt"), (2, b"\x89PNG\r\n", ".pdf"), (3, b"", ".md"), (4, None, ".md"), (5, b"PK\x03\x04word/document.xml", ".zip"), (6, b"a,b\n", ".csv"), (7, b"\x00\x01\x02abc", ".txt"), (8, b"<!DOCTYPE html><p>", ".x"), (9, "hé".encode("utf-16-le"), ".txt")]
    df = spark.createDataFrame(rows, "id int, content binary, ext string")
    got = {r["id"]: r["format"] for r in ingest.detect_format(df).collect()}
    assert got == {1: "pdf", 2: "image", 3: "empty", 4: "empty", 5: "zip", 6: "csv", 7: "binary", 8: "html", 9: "binary"}
    kinds = {r["id"]: r["kind"] for r in ingest.zip_kind(df).collect()}
    assert kinds[5] == "docx" and kinds[1] is None
    enc = {r["id"]: r["encoding"] for r in ingest.detect_encoding(df.where("id in (3, 6)")).collect()}
    assert enc == {3: None, 6: "utf-8"}


def test_encoding_of_few_bytes(spark):
    """A zero among under 8 bytes is no UTF-16."""
    raw = {b"A\0BC": "utf-8", b"A\0BCxy": "utf-8", "four".encode("utf-16-le"): "utf-16-le", "four".encode("utf-16-be"): "utf-16-be", b"A\0BC" + b"x" * 30: "utf-8", b"\0" * 40: "utf-8", b"\xe9t\xe9": "legacy"}
    df = spark.createDataFrame([(i, c, ".txt") for i, c in enumerate(raw)], "id int, content binary, ext string")
    got = ingest.detect_encoding(ingest.detect_format(df)).orderBy("id").collect()
    assert [r["encoding"] for r in got] == list(raw.values()) and [r["format"] for r in got] == ["binary"] * 6 + ["text"]


def test_layout_rows_measure_from_the_first_box(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 10.0, "a"), (1, 10.0, 4.0, 15.0, 14.0, "b"), (1, 20.0, 8.0, 25.0, 18.0, "c")], "page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = sorted((r["row"], r["text"]) for r in ingest.layout_rows(boxes, "page").collect())
    assert got == [(1, "a | b"), (2, "c")]


def test_merge_ocr_passes(spark):
    rows = [(1, 1, 1, "abc", 0.0, 0.0, 10.0, 10.0), (1, 2, 2, "漢", 1.0, 1.0, 9.0, 9.0), (1, 3, 1, "far", 50.0, 50.0, 60.0, 60.0), (1, 4, 2, "latin", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "page int, id int, pass int, text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["id"] for r in ingest.merge_ocr_passes(df, "page").collect()) == [2, 3]


def test_lint_overlaps_and_mentions(spark):
    rules = spark.createDataFrame([(1, "general", "banned", "c", "s", "very good", ""), (2, "general", "banned", "c", "s", "good", "")], linting.RULE_SCHEMA)
    docs = spark.createDataFrame([(1, "very good and good\n```\ngood\n```\nnot good"), (2, None)], "doc_id int, text string")
    ls = linting.mask_phrases(linting.lint_lines(docs, "doc_id"), "text", [])
    found = linting.rule_matches(ls, rules, ["doc_id", "line"], "masked")
    kept = linting.suppress_overlaps(found, ["doc_id", "line"])
    assert sorted((r["line"], r["start"], r["matched"]) for r in kept.collect()) == [(1, 1, "very good"), (1, 15, "good"), (5, 5, "good")]
    assert sorted(r["line"] for r in linting.drop_mentions(kept, "masked").collect()) == [1, 1]


def test_quotes(spark):
    df = spark.createDataFrame([("a quick brown fox jumps over", "quick brown ... jumps over"), ("a quick", "jumps ... quick"), (None, None)], "t string, q string")
    got = [r[0] for r in df.select(citations.match_quote(F.col("t"), citations.quote_segments(F.col("q")))).collect()]
    assert got[:2] == [3, 0]


def test_verdicts(spark):
    long = "this quotation is certainly long enough to count"
    claims = spark.createDataFrame([(1, long, "1"), (2, long, "2"), (3, "short", None), (4, None, None), (5, "another quotation that no source of ours has", None)], "id int, quote string, article string")
    sources = spark.createDataFrame([("s", "1", f"before {long} after")], "source string, article string, text string")
    pairs = claims.select("id", F.lit("s").alias("source"), F.lit(0).alias("pos"))
    got = {r["id"]: r["verdict"] for r in citations.verify_claims(claims, sources, pairs, "id", "source").collect()}
    assert got == {1: "VERIFIED", 2: "WRONG_ARTICLE", 3: "INVALID", 4: "INVALID", 5: "MISSING"}


def test_late_payment_excludes_both_ends(spark):
    df = spark.createDataFrame([("2025-04-30", "2025-05-05", 1e8)], "due string, paid string, amount double")
    r = filings.late_payment(df, "due", "paid", F.col("amount")).first()
    assert (r["days"], round(r["interest"])) == (4, 120000)


def test_parse_number(spark):
    df = spark.createDataFrame([("1.234,5", "1234.5"), ("(10)", "-10"), ("-", None), ("12,5%", "0.125"), ("3.000 VND", "3000"), ("x", None)], "t string, want string")
    for r in df.select(filings.parse_number(F.col("t")).alias("got"), "want").collect():
        assert (None if r["got"] is None else float(r["got"])) == (None if r["want"] is None else float(r["want"]))


def test_completion_claim(spark):
    df = spark.createDataFrame([("All finished.",), ("work finished, in progress",), ("was successfully created in progress",), (None,)], "t string")
    got = [r["claimed"] for r in runs.completion_claim(df, "t", [r"\bfinished\b", r"\bsuccessfully created\b"], [r"\bin progress\b"], ["successfully"]).collect()]
    assert got == [True, False, True, False]


def test_claims_end_at_ascii_boundaries(spark):
    df = spark.createDataFrame([("Und dieükeit",), ("üund die",), ("und diet",), ("und die, schund derü",), ("und die und derü",)], "t string")
    got = [(r["evidence"], r["claimed"]) for r in runs.completion_claim(df, "t", [r"\bund die\b"], [r"\bund der\b"], []).collect()]
    assert got == [("und die", True), ("und die", True), ("", False), ("und die", True), ("", False)]


def test_salvage_json(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('x {"k": 2} y',), ("none",), (None,)], "t string")
    assert [r["parsed"] and r["parsed"]["k"] for r in readers.salvage_json(df, "t", "k long").collect()] == [1, 2, None, None]


def test_read_files_and_manifest(spark, tmp_path):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in" / "a.MD").write_bytes(b"x")
    (tmp_path / "in" / ".git" / "b.md").write_bytes(b"y")
    got = readers.read_files(spark, str(tmp_path / "in")).collect()
    assert [(r["ext"], r["size"]) for r in got] == [(".md", 1)]
    readers.sink_manifest(spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, status string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_short_and_other_scripts_are_verified(spark):
    sources = [(1, "…; a plan for internationalisation of telecommunications infrastructure, and more"), (2, "本事業では、ベトナムのハノイ医科大学との国際交流活動を実施する。"), (3, "Điều 5. Người nộp thuế phải khai   đúng thời hạn quy định."), (4, "nothing")]
    claims = [
        (1, "internationalisation of telecommunications infrastructure", None), (2, "ハノイ医科大学との国際交流活動を実施", None), (3, "người nộp thuế phải khai đúng thời hạn", 4), (4, "internationalisation of tele-communications infra structures", None),
        (5, "short", None), (6, None, None), (7, "医科大学 ... 国際交流活動を実施する", 2),
    ]
    c = spark.createDataFrame(claims, "claim int, quote string, declared_source int").withColumn("article", F.lit(None).cast("string"))
    s = spark.createDataFrame(sources, "source int, text string").withColumn("article", F.lit(None).cast("string"))
    found = citations.candidate_pairs(c, s, "claim", "source", "quote", "text", "declared_source")
    assert {(r["claim"], r["source"]) for r in found.where("declared").collect()} == {(3, 4), (7, 2)}
    found = found.withColumn("pos", F.when(F.col("declared"), -1).otherwise(F.col("source"))).drop("declared")
    got = {r["claim"]: (r["verdict"], r["source"]) for r in citations.verify_claims(c, s.select("source", "article", "text"), found, "claim", "source").collect()}
    assert got == {1: ("VERIFIED", 1), 2: ("VERIFIED", 2), 3: ("VERIFIED", 3), 4: ("MISSING", None), 5: ("INVALID", None), 6: ("INVALID", None), 7: ("VERIFIED", 2)}
    none = c.where("quote is null")
    assert citations.candidate_pairs(none, s, "claim", "source", "quote", "text").count() == 0


def test_near_duplicates_do_not_need_a_common_opening(spark):
    body = [f"line {i}" for i in range(20)]
    rows = [(1, "a", "\n".join(body)), (2, "b", "\n".join(["new first line", *body[1:]])), (3, "b", "\n".join(["license"] * 20)), (4, "c", "\n".join(["license"] * 19 + ["x"])), (5, "a", "\n".join(body[::-1])), (6, "d", "")]
    df = spark.createDataFrame(rows, "k int, o string, t string")
    got = reuse.near_duplicates(df, "k", "o", "t", 0.8, sequence=False).collect()
    assert {(r["a"], r["b"], r["ratio"]) for r in got} == {(1, 2, 0.95), (2, 5, 0.95), (3, 4, 0.95)}
    got = reuse.near_duplicates(df, "k", "o", "t", 0.8).collect()  # lines in reverse are no copy
    assert {(r["a"], r["b"], r["ratio"]) for r in got} == {(1, 2, 0.95), (3, 4, 0.95)}


def test_slugs_take_the_next_free_number(spark):
    names = ["a", "a", "a-2", "a 2 x", "A", "é", "Đỗ", "", None, "a 2"]
    got = ingest.unique_slugs(spark.createDataFrame(list(enumerate(names)), "k int, n string"), "k", "n").orderBy("k").collect()
    slugs = [r["slug"] for r in got]
    assert len(set(slugs)) == len(slugs) and slugs == ["a", "a-3", "a-2", "a-2-x", "a-4", "e", "do", "file", "file-2", "a-2-2"]
