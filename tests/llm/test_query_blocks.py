"""The search holds one tree and one bounded block of queries in a task, however many queries there are."""

import numpy as np
from pyspark.sql import functions as F

from loamline.llm import mtree


def test_queries_are_dealt_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(0, [1.0] * 6)], "vec_id long, embedding array<double>")
    seen, real, dealt = [], mtree._blocks, mtree._dealt

    def spy(nodes, rows):
        trees, blocks = real(nodes, rows)
        seen.append((blocks.groupBy("shard", "sub", "block").count().agg(F.max("count")).first()[0], blocks.select("block").distinct().count()))
        return trees, blocks

    monkeypatch.setattr(mtree, "_blocks", spy)
    monkeypatch.setattr(mtree, "_dealt", lambda asked: dealt(asked, 10))
    got = sorted(tuple(r) for r in mtree.top_k(df, df.where("vec_id % 4 = 0")).select("query_id", "rank", "score", "vec_id").collect())
    assert len(seen) == 2 and all(most <= 25 and blocks >= 8 for most, blocks in seen)
    v = np.floor(256 * np.concatenate([x, np.ones((1, 6))]))
    ids = np.array([*range(400), 0])
    want = []
    for q in [*range(0, 400, 4), 400]:
        best = sorted((-int(s), int(i)) for s, i in zip(v @ v[q], ids) if i != ids[q])[:5]
        want += [(int(ids[q]), k + 1, -s, i) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_ids_with_a_coded_prefix_fill_buckets_alike(spark, monkeypatch):
    from pyspark.sql import functions as F

    from loamline.llm import sketches

    monkeypatch.setattr(sketches, "QUANTILES", 4)
    ids = [(shard << 40) + k for shard in (0, 1, 7, 900) for k in range(150)] + [10**18 + k * k for k in range(200)]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "null")], "doc_id long, text string").repartition(3)
    want = dict(zip([None, *sorted(ids)], [*(f"t{i}" for i in sorted(ids)), "null"]))
    for cuts in (0, 4_000_000):  # quantiles joined by shuffle, and broadcast
        monkeypatch.setattr(sketches, "BROADCAST_CUTS", cuts)
        paired = sketches.with_successor(docs, "doc_id", ["text"], "text", {"at": F.col("_bucket")}, bucket_rows=20)
        assert {r["doc_id"]: r["next_text"] for r in paired.collect()} == want
        sizes = [r["count"] for r in paired.groupBy("at").count().collect()]
        assert max(sizes) <= 2 * 20 + 2 and len(sizes) > 20
