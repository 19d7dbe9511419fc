"""Connected components of chains, which a step to the smallest neighbour alone shortens by one vertex a round."""

from loamline.llm.components import components


def test_components_of_an_ascending_chain(spark):
    rows = [(i, i + 1) for i in range(1, 1000)] + [(i + 1, i) for i in range(5000, 5300)] + [(7, 7), (None, 3), (9000, 9002), (9002, 9001)]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long").repartition(7)).collect()}
    want = dict.fromkeys(range(1, 1001), 1) | dict.fromkeys(range(5000, 5301), 5000) | dict.fromkeys((9000, 9001, 9002), 9000)
    assert got == want
