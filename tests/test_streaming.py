from loamline.operators import linting
from loamline.streaming.batches import lint_stream


def test_lint_stream(spark, tmp_path):
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a bad word"), (2, "fine"), (3, None)], schema).write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([(1, "general", "banned", "c", "s", "bad", "")], linting.RULE_SCHEMA)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    lint_stream(stream, rules, "doc_id", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
