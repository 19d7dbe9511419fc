"""Toxicity weights must not depend on how the input is dealt out."""

from loamline.llm import toxicity


def test_learned_weights_do_not_depend_on_partitions(spark):
    rows = []
    for i in range(1200):
        toxic = i % 4 == 0
        # "topic" is in as many toxic as clean texts; "slur" nearly only in toxic ones, with a few clean uses elsewhere.
        text = f"plain words here {'topic' if i % 8 < 2 else 'other'} {'slur' if toxic or i % 60 == 7 else 'calm'}"
        rows.append((i, text, int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    one = toxicity.train(docs.coalesce(1), labels).learned.weights
    many = toxicity.train(docs.repartition(50), labels).learned.weights
    assert "slur" in one and "topic" not in one
    assert one == many
