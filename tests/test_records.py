"""Files of JSON lines in splits, delimited rows against the standard library, manifests and their index."""

import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.functions.text import sized
from loamline.sources import records


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = ['{"k": %d}' % i if i % 9 else ("" if i % 2 else "{bad") for i in range(1, 60_001)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.jsonl").write_text("\n".join(lines))
    (tmp_path / "two.jsonl").write_text('{"k": 1}\r\n\r\n{"k": "x"}\n')
    (tmp_path / "none.jsonl").write_text("")
    (tmp_path / "other.txt").write_text("not read")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        good, bad = records.read_jsonl(spark, str(tmp_path), "k long", "*.jsonl")
        assert good.rdd.getNumPartitions() > 8
        found = {(r["path"].rpartition("/")[2], r["line"]): r["r"]["k"] for r in good.collect()}
        broken = {(r["path"].rpartition("/")[2], r["line"]): r["raw"] for r in bad.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert found == {("one.jsonl", i): i for i in range(1, 60_001) if i % 9} | {("two.jsonl", 1): 1}
    assert broken == {("one.jsonl", i): "{bad" for i in range(18, 60_001, 18)} | {("two.jsonl", 3): '{"k": "x"}'}


def read(text, delimiter):
    return list(csv.reader(io.StringIO(text), delimiter=delimiter))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b c", '"', '""', ",", ";", "|", "\n", "é", '"x"', '"y,z"', '"p\nq"', '"r""s"', " "]), max_size=12).map("".join), min_size=30, max_size=30))
def test_rows_are_those_of_the_standard_library(spark, texts):
    texts = [*texts, "", "\n", "a,b\n", "a,b\n\n", ",", '""', '""\n', '"unclosed, \n b', 'x"y,"z', '"a"b,c']
    df = spark.createDataFrame([(i, t, d) for i, t in enumerate(texts) for d in (",", ";", "|")], "id int, text string, delimiter string")
    got = {}
    for r in records.delimited_rows(df.withColumn("key", F.struct("id", "delimiter")), "key", "text").collect():
        got.setdefault((r["key"]["id"], r["key"]["delimiter"]), []).append((r["row"], r["cells"]))
    for i, t in enumerate(texts):
        for d in (",", ";", "|"):
            assert [cells for _, cells in sorted(got.get((i, d), []))] == read(t, d), (t, d)


def test_rows_of_long_quoted_cells(spark):
    cell = 'x"y\n,' * 20_000
    text = "a," + '"' + cell.replace('"', '""') + '"\r\nb,c\rd\t"e'
    df = spark.createDataFrame([(1, text, ","), (2, None, ","), (3, "a\tb\n\t\n", "\t")], "id int, text string, delimiter string")
    got = {(r["id"], r["row"]): r["cells"] for r in records.delimited_rows(df, "id", "text").collect()}
    assert got == {(1, 1): ["a", cell], (1, 2): ["b", "c"], (1, 3): ['d\t"e'], (3, 1): ["a", "b"], (3, 2): ["", ""]}


def test_an_index_is_published_after_its_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, ["w"]), ("b", 3, []), ("c", 2, None)], "folder string, exit_code int, warnings array<string>")
    path = str(tmp_path / "out")
    records.publish_manifest(rows, path)
    index = records.read_index(spark, path)
    assert sorted((r["folder"], r["exit_code"], r["batch_code"]) for r in index.collect()) == [("a", 0, 2), ("b", 3, 2), ("c", 2, 2)]
    assert "warnings" not in index.columns
    assert len([f for f in (tmp_path / "out" / "files").glob("_folder=*/*.json")]) == 3

    broken = rows.withColumn("exit_code", F.when(F.col("folder") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("exit_code")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        records.publish_manifest(broken, path)
    assert records.read_index(spark, path) is None  # the older index is gone, and no new one is there
    records.publish_manifest(rows.limit(1), path)
    assert records.read_index(spark, path).count() == 1


def test_broadcasts_are_held_to_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * 100, [1, 2]) for i in range(100)], "k int, t string, a array<int>")
    assert "ResolvedHint" in sized(rows)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in sized(rows, 5_000)._jdf.queryExecution().analyzed().toString()
