"""Citation verification: quotes of claims against source texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.functions.text import in_form, lines, run_id

#: Least weighted length of a quote and of each of its segments.
LEAST_QUOTE, LEAST_SEGMENT = 30, 8
#: What a quote leaves out, and the punctuation that the compact form drops.
GAP = r"\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|…|\.\.\."
PUNCTUATION = r",.;:!?\"'«»“”‘’「」『』、。・（）()\[\]"
#: Letters that count twice; kanji digits from 0, and units.
WIDE = "[\u3040-\u30ff\u3400-\u9fff]"
KANJI_DIGITS, KANJI_UNITS = "〇一二三四五六七八九", {"十": 10, "百": 100, "千": 1000}
#: Headings of articles; group 1 or 2 has the number.
HEADING = rf"(?md)^(?:[\s*#>“\"|]*Điều\s+(\d+)\s*[.:]|[\s*#>（(|]*第([{KANJI_DIGITS}十百千\d]+)条(?:の[{KANJI_DIGITS}十百千\d]+)?[\s\u3000])"

SPACE = r"(?U)[\s\x1C-\x1F]+"
MARK = "\ue000"


def norm_text(text: Column, normalize: bool = True) -> Column:
    """NFKC (unless ``normalize`` is off), white space of any kind collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(in_form("NFKC", text) if normalize else text, SPACE, " "))


def compact_text(text: Column, normalize: bool = True) -> Column:
    """Normal form in lower case, without white space and punctuation."""
    return _compact(F.lower(norm_text(text, normalize)))


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)[\s\x1C-\x1F{PUNCTUATION}]+", "")


def quote_segments(quote: Column, normalize: bool = True) -> Column:
    """The parts of a quote's normal form between its ellipses, trimmed, empty ones dropped."""
    return _segments(norm_text(F.coalesce(quote, F.lit("")), normalize))


def _segments(quote: Column) -> Column:
    return F.filter(F.transform(F.split(quote, GAP), lambda s: F.trim(s)), lambda s: s != "")


def weighted_length(text: Column) -> Column:
    """Length without white space and punctuation, where kana and kanji count twice."""
    compact = _compact(text)
    return F.length(compact) + F.regexp_count(compact, F.lit(WIDE))


def quote_long_enough(quote: Column) -> Column:
    """All segments together at least ``LEAST_QUOTE``, each at least ``LEAST_SEGMENT``."""
    return _long_enough(quote_segments(quote))


def _long_enough(segments: Column) -> Column:
    total = F.aggregate(segments, F.lit(0), lambda a, s: a + weighted_length(s))
    return (total >= LEAST_QUOTE) & ~F.exists(segments, lambda s: weighted_length(s) < LEAST_SEGMENT)


def match_quote(text: Column, segments: Column) -> Column:
    """1-based place of the first segment if all follow one another in the text, else 0."""
    start = F.struct(F.lit(1).alias("p"), F.lit(0).alias("first"), F.lit(True).alias("ok"))

    def step(a, s):
        at = F.call_function("locate", s, text, a["p"])
        return F.struct(
            F.when(at > 0, at + F.length(s)).otherwise(a["p"]).alias("p"), F.when(a["first"] > 0, a["first"]).otherwise(at).alias("first"), (a["ok"] & (at > 0)).alias("ok"),
        )

    return F.aggregate(segments, start, step, lambda a: F.when(a["ok"], a["first"]).otherwise(0))


def quote_place(text: Column, segments: Column) -> Column:
    """1-based place of a quote in a text, both in normal form, without regard to case; 0 if it is not there.

    The second pass drops white space and punctuation, and counts in the text
    that is left, as a quote may run over the breaks of lines and cells.
    """
    lower = F.transform(segments, lambda s: F.lower(s))
    exact = match_quote(F.lower(text), lower)
    loose = match_quote(_compact(F.lower(text)), F.transform(lower, lambda s: _compact(s)))
    return F.when(F.size(segments) == 0, 0).when(exact > 0, exact).otherwise(loose)


def kanji_number(text: Column) -> Column:
    """The value of a kanji numeral below 10,000, positional units and all (a unit without a digit counts once)."""

    def step(state: Column, letter: Column) -> Column:
        digit = F.call_function("locate", letter, F.lit(KANJI_DIGITS))
        unit = F.lit(0)
        for name, value in KANJI_UNITS.items():
            unit = F.when(letter == name, value).otherwise(unit)
        times = F.when(state["last"] == 0, 1).otherwise(state["last"])
        total = F.when(unit > 0, state["total"] + times * unit).otherwise(state["total"])
        last = F.when(unit > 0, 0).otherwise(digit - 1)
        return F.struct(total.alias("total"), last.alias("last"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    return F.aggregate(F.regexp_extract_all(text, F.lit("."), F.lit(0)), start, step, lambda s: s["total"] + s["last"])


def article_number(article: Column) -> Column:
    """The number that an article's name holds, in digits of any width or in kanji; null without one."""
    digits = F.regexp_extract(in_form("NFKC", article), r"(\d+)", 1)
    kanji = F.regexp_extract(article, f"第([{KANJI_DIGITS}十百千]+)条", 1)
    return F.when(digits != "", digits.cast("int")).when(kanji != "", kanji_number(kanji))


def text_articles(text: Column) -> Column:
    """Array of ``struct(number, body)``: a text's headed parts in their order, each from its heading to the next of any number."""
    ended = F.regexp_replace(F.translate(in_form("NFKC", text), MARK, " "), "\r\n|[\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\u2028\u2029]", "\n")
    plain = F.regexp_replace(ended, r"[ \t]+", " ")
    parts = F.split(F.regexp_replace(plain, HEADING, MARK + "$0"), MARK, -1)

    def headed(part: Column) -> Column:
        latin, wide = F.regexp_extract(part, HEADING, 1), F.regexp_extract(part, HEADING, 2)
        number = F.when(latin != "", latin.cast("int")).when(wide.rlike(r"^\d+$"), wide.cast("int")).otherwise(kanji_number(wide))
        return F.struct(number.alias("number"), part.alias("body"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), headed)


def article_body(text: Column, number: Column) -> Column:
    """The parts of a text under headings of one number, joined (an amendment may quote an article again); null if there are none."""
    own = F.filter(text_articles(text), lambda part: part["number"] == number)
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda part: part["body"]), "\n"))


#: Sizes of character blocks, largest first; a segment of 2 * size - 1 characters holds a whole block wherever it lies.
BLOCKS = (16, 8, 4, 2)


def candidate_pairs(claims: DataFrame, sources: DataFrame, claim: str, source: str, quote: str, text: str, declared: str | None = None) -> DataFrame:
    """``claim, source, declared``: sources that may hold a quote, the declared one included.

    Texts are compared in ``compact_text``, so in any script. A source is cut
    into consecutive blocks of characters; of a quote's longest segment every
    block of that size is taken that could be one of them. A source that holds
    the segment shares such a block, so no claim is lost and none meets every
    source. A quote without any segment of three compact characters, or one too
    short to be checked (``verify_claims`` calls it INVALID whatever a source
    holds; its few letters are in most of them), has no candidates but the
    declared one. Repeated pairs come once.
    """
    claims = claims.withColumn("_segments", quote_segments(F.col(quote)))
    checked = claims.where(_long_enough(F.col("_segments")))
    segments = F.filter(F.transform("_segments", lambda s: _compact(F.lower(s))), lambda s: F.length(s) >= 2 * BLOCKS[-1] - 1)
    longest = F.get(F.array_sort(segments, lambda x, y: F.length(y) - F.length(x)), F.lit(0))
    size = None
    for k in BLOCKS:
        size = F.when(F.length("_s") >= 2 * k - 1, k) if size is None else size.when(F.length("_s") >= 2 * k - 1, k)
    asked = checked.select(claim, longest.alias("_s")).where("_s is not null").withColumn("_k", size)
    asked = asked.select(claim, "_k", F.explode(F.transform(F.sequence(F.lit(1), F.col("_k")), lambda i: F.substring(F.col("_s"), i, F.col("_k")))).alias("_b")).distinct()
    had = None
    for k in sorted(r["_k"] for r in asked.select("_k").distinct().collect()):  # at most len(BLOCKS) rows
        blocks = F.array_distinct(F.regexp_extract_all(compact_text(F.col(text)), F.lit(f"(?s).{{{k}}}"), F.lit(0)))
        one = sources.select(source, F.lit(k).alias("_k"), F.explode(blocks).alias("_b"))
        had = one if had is None else had.unionAll(one)
    if had is None:
        found = claims.select(claim).limit(0).join(sources.select(source).limit(0), F.lit(True))
    else:
        found = asked.join(had, ["_k", "_b"]).select(claim, source).distinct()
    if declared is None:
        return found.withColumn("declared", F.lit(False))
    own = claims.where(F.col(declared).isNotNull()).select(claim, F.col(declared).alias(source), F.lit(True).alias("declared"))
    return own.unionByName(found.withColumn("declared", F.lit(False))).groupBy(claim, source).agg(F.max("declared").alias("declared"))


def article_blocks(sources: DataFrame, key: str, text: str, heading: str = r"^(?:Article|Section) ([0-9]+)\b") -> DataFrame:
    """``key, article, body``: the lines from a heading to the next; blocks of one number are joined."""
    ls = lines(sources, [key], text).withColumn("_n", F.regexp_extract("text", heading, 1))
    ls = ls.withColumn("_b", run_id(F.col("_n") != "", [key], "line")).where("_b > 0")
    ls = ls.withColumn("article", F.first("_n").over(Window.partitionBy(key, "_b").orderBy("line")))
    return ls.groupBy(key, "article").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("body"))


def verify_claims(claims: DataFrame, sources: DataFrame, candidates: DataFrame, claim: str, source: str, declared: str | None = None, defaults: bool = True) -> DataFrame:
    """``claim, verdict, source``: INVALID, VERIFIED (first candidate that has the quote), WRONG_ARTICLE or MISSING.

    ``claims(claim, quote, article)``, ``sources(source, article, text)``,
    ``candidates(claim, source, pos)``; the candidate of smallest ``pos``
    counts, so give a declared source the smallest. A row of ``sources`` with an
    article is that article; a row without one is a whole text, in which a
    claim's article is looked up by its headings. A claim is INVALID without a
    quote, with one that is too short, if its ``declared`` source is a web
    address, or if it declares none and no source is a default one. Of
    candidates under wrong articles the last one is returned.
    """
    origin = F.coalesce(F.col(declared), F.lit("")) if declared else F.lit("")
    claims = claims.withColumn("_segments", quote_segments(F.col("quote")))
    invalid = ~_long_enough(F.col("_segments")) | origin.rlike("^https?://")
    if not defaults:
        invalid = invalid | (origin == "")
    checked = claims.withColumn("_invalid", F.coalesce(invalid, F.lit(True)))
    asked = checked.where(~F.col("_invalid")).select(claim, "article", "_segments", article_number(F.col("article")).alias("_number"))
    texts = sources.withColumn("_text", norm_text(F.col("text"))).withColumnRenamed("article", "_a")
    hit = asked.join(candidates, claim).join(texts, source).where(quote_place(F.col("_text"), F.col("_segments")) > 0)
    hit = hit.withColumn("_under", norm_text(article_body(F.col("text"), F.col("_number"))))
    right = F.when(F.coalesce("article", F.lit("")) == "", True).when(F.col("_a").isNotNull(), F.col("article") == F.col("_a")).otherwise(F.coalesce(quote_place(F.col("_under"), F.col("_segments")) > 0, F.lit(False)))
    found = hit.select(claim, source, "pos", right.alias("_right"))
    first, last = F.min_by(F.col(source), F.when(F.col("_right"), F.col("pos"))), F.max_by(F.col(source), F.col("pos"))
    best = found.groupBy(F.col(claim).alias("_c")).agg(F.bool_or("_right").alias("_ok"), first.alias("_first"), last.alias("_last"))
    j = checked.join(best, F.col(claim) == F.col("_c"), "left")
    verdict = F.when(F.col("_invalid"), "INVALID").when(F.col("_ok"), "VERIFIED").when(~F.col("_ok"), "WRONG_ARTICLE").otherwise("MISSING")
    return j.select(claim, verdict.alias("verdict"), F.when(F.col("_ok"), F.col("_first")).otherwise(F.col("_last")).alias(source))


def evidence_score(batches: DataFrame, verdicts: DataFrame, batch: str, threshold: float = 1.0) -> DataFrame:
    """``batch, total, verified, confidence, passes``; a batch without claims fails."""
    per = verdicts.groupBy(batch).agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "VERIFIED").alias("verified"))
    j = batches.select(batch).join(per, batch, "left").withColumns({"total": F.coalesce("total", F.lit(0)), "verified": F.coalesce("verified", F.lit(0))})
    confidence = F.when(F.col("total") > 0, F.bround(F.col("verified") / F.col("total"), 3)).otherwise(0.0)
    return j.withColumn("confidence", confidence).withColumn("passes", (F.col("total") > 0) & (F.col("confidence") >= threshold))
