"""Quote verification: normal forms, gaps, articles by number in any script, claims without a source."""

from pyspark.sql import functions as F

from loamline.operators import citations

SOURCE = "第一条、会社は従業員に対し「賃金」を毎月支払う。Total amount １２３ ＡＢＣ of the contribution payable by the insured person"
QUOTES = [
    "会社は従業員に対し賃金を毎月支払う", "Total amount 123 ABC of the contribution payable by the insured", "“Total amount” １２３ ＡＢＣ of the contribution payable by", "TOTAL AMOUNT 123 abc of the contribution payable",
    "会社は従業員に対し […] を毎月支払う。Total amount", "Total amount 123 [ … ] payable by the insured person", "payable by the insured ... Total amount 123 abc", "of the contribution never payable by anyone at all", "Total amount 123 … ABC", None, " ", "…",
]


def test_quotes_in_any_normal_form(spark):
    claims = spark.createDataFrame([(i, q, None) for i, q in enumerate(QUOTES)], "id int, quote string, article string")
    sources = spark.createDataFrame([("s", None, SOURCE), ("n", None, None), ("e", None, "")], "source string, article string, text string")
    found = citations.candidate_pairs(claims, sources, "id", "source", "quote", "text").withColumn("pos", F.lit(0))
    got = {r["id"]: (r["verdict"], r["source"]) for r in citations.verify_claims(claims, sources, found, "id", "source").collect()}
    assert got == dict.fromkeys(range(6), ("VERIFIED", "s")) | dict.fromkeys((6, 7), ("MISSING", None)) | dict.fromkeys((8, 9, 10, 11), ("INVALID", None))


def kanji(n):
    out = ""
    for value, unit in ((1000, "千"), (100, "百"), (10, "十")):
        q, n = divmod(n, value)
        out += ("" if q < 2 else "〇一二三四五六七八九"[q]) + (unit if q else "")
    return out + ("〇一二三四五六七八九"[n] if n else "")


def test_kanji_numbers_both_ways(spark):
    df = spark.createDataFrame([(n, kanji(n)) for n in range(1, 10000)], "n int, t string")
    assert df.where(citations.kanji_number(F.col("t")) != F.col("n")).count() == 0
    names = [("第六十七条", 67), ("Điều 67", 67), ("Ａｒｔ． ６７", 67), ("第〇条", 0), ("none", None), ("", None), (None, None), ("第千二十条", 1020)]
    got = spark.createDataFrame(names, "t string, n int").withColumn("got", citations.article_number(F.col("t"))).collect()
    assert [r["got"] for r in got] == [n for _, n in names]


def test_articles_of_a_text(spark):
    text = "intro\n**Điều 1.** one\nĐiều 2 . two\r\n第三条　three\n  \n> Điều ４: four\n第二条の二 two again\nĐiều 5 is named\n（第十二条 twelve"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(citations.text_articles(F.col("t")), citations.article_body(F.col("t"), F.lit(2)), citations.article_body(F.col("t"), F.lit(9))).collect()
    assert [r["number"] for r in got[0][0]] == [1, 2, 3, 4, 2, 12]
    assert got[0][1] == "Điều 2 . two\n\n第二条の二 two again\nĐiều 5 is named\n" and got[0][2] is None
    assert not got[1][0] and got[2][0] == [] and got[2][1] is None


def test_claims_under_articles_and_without_sources(spark):
    body = "Điều 1. {}\n第六十七条 {}\n"
    one, two = "the first rule is that nobody pays twice", "the second rule is that everybody pays once"
    sources = spark.createDataFrame([("a", None, body.format(one, two)), ("b", None, body.format(two, one)), ("c", "67", two)], "source string, article string, text string")
    claims = [
        (1, two, "Điều 67", "a"), (2, two, "第六十七条", "b"), (3, two, "67", "c"), (4, one, "Điều 67", "a"), (5, one, "no number", "a"), (6, one, "", "a"), (7, one, None, None), (8, one, None, "https://x.org"), (9, one, None, ""), (10, two, "Điều 67", "b"),
    ]
    c = spark.createDataFrame(claims, "id int, quote string, article string, declared string")
    pairs = c.where("declared is not null").select("id", F.col("declared").alias("source"), F.lit(0).alias("pos")).unionByName(spark.createDataFrame([(10, "a", 1)], "id int, source string, pos int"))
    got = {r["id"]: (r["verdict"], r["source"]) for r in citations.verify_claims(c, sources, pairs, "id", "source", "declared", defaults=False).collect()}
    invalid = ("INVALID", None)
    want = {1: ("VERIFIED", "a"), 2: ("WRONG_ARTICLE", "b"), 3: ("VERIFIED", "c"), 4: ("WRONG_ARTICLE", "a"), 5: ("WRONG_ARTICLE", "a"), 6: ("VERIFIED", "a"), 7: invalid, 8: invalid, 9: invalid, 10: ("VERIFIED", "a")}
    assert got == want
    assert {r["id"]: r["verdict"] for r in citations.verify_claims(c, sources, pairs, "id", "source", "declared").collect()}[7] == "MISSING"


def test_short_quotes_and_common_letters_meet_few_sources(spark):
    texts = [(i, f"the committee on trade and foreign affairs number {i} of the committee on trade") for i in range(50)]
    sources = spark.createDataFrame(texts, "source int, text string")
    claims = spark.createDataFrame([(1, "committee", None), (2, "the committee on trade and domestic affairs", None), (3, "foreign affairs number 7 of the committee on trade", 9), (4, "number", 5)], "id int, quote string, declared int")
    got = citations.candidate_pairs(claims, sources, "id", "source", "quote", "text", "declared")
    pairs = sorted((r["id"], r["source"], r["declared"]) for r in got.collect())
    assert [p for p in pairs if p[0] == 1] == [] and [p for p in pairs if p[0] == 4] == [(4, 5, True)]
    assert (3, 7, False) in pairs and (3, 9, True) in pairs
    checked = citations.verify_claims(claims.withColumn("article", F.lit(None).cast("string")), sources.withColumn("article", F.lit(None).cast("string")), got.withColumn("pos", F.col("source")), "id", "source")
    assert {r["id"]: (r["verdict"], r["source"]) for r in checked.collect()} == {1: ("INVALID", None), 2: ("MISSING", None), 3: ("VERIFIED", 7), 4: ("INVALID", None)}
