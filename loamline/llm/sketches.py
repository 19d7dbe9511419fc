"""Document fingerprints: threshold-scaled sketches of word-shingle hashes.

A sketch keeps every shingle hash below a fixed fraction of the hash range,
whatever the text's length, so sketches of texts of very different sizes are
comparable and can be merged: the sketch of a union is the union of the
sketches. Sketches of different fractions are compared below the lower
threshold. A sketch also holds a digest of all shingles: of two texts that are
so short that neither has a hash below the threshold, it tells whether they are
alike.

Everything here is DataFrame functions: one shuffle brings each text next to its
successor, and sketches are made after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.base import settle, text_or_empty

SHINGLE_WORDS = 5
FRACTION = 2  # one hash in two is below the threshold
LOWEST = -(1 << 63)
QUANTILES = 256
BUCKET_ROWS = 20_000
BROADCAST_HEADS = 1_000_000
BROADCAST_CUTS = 4_000_000  # ids


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, shingle_words: int = SHINGLE_WORDS, fraction: int = FRACTION) -> Column:
    """``struct(threshold, digest, hashes)`` of a text; hashes are sorted, distinct and at most the threshold.

    Words are runs without white space, in lower case. A text of fewer words
    than a shingle has the whole sequence as its one shingle; a text without
    words has none. Null counts as empty.
    """
    top = LOWEST + (1 << 64) // fraction - 1
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - shingle_words), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(shingle_words))))
        return F.when(F.size(h) >= shingle_words, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    def keep(s: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.filter(s, lambda x: x <= top)))
        return F.struct(F.lit(top).cast("long").alias("threshold"), F.xxhash64(s).alias("digest"), kept.alias("hashes"))

    return _let(hashed, lambda h: _let(shingles(h), keep))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches, 0 to 1. Two without hashes are alike (1) if their digests agree, else not (0)."""
    return _let(
        F.least(a["threshold"], b["threshold"]),
        lambda t: _let(
            F.struct(F.filter(a["hashes"], lambda x: x <= t).alias("a"), F.filter(b["hashes"], lambda x: x <= t).alias("b")),
            lambda p: _let(
                F.size(F.array_intersect(p["a"], p["b"])),
                lambda n: F.when(F.size(p["a"]) + F.size(p["b"]) == 0, a["digest"].eqNullSafe(b["digest"]).cast("double")).otherwise(n / (F.size(p["a"]) + F.size(p["b"]) - n)),
            ),
        ),
    )


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s shingles that ``b`` has, 0 to 1; null if ``a`` has no hashes."""
    return _let(
        F.least(a["threshold"], b["threshold"]),
        lambda t: _let(F.filter(a["hashes"], lambda x: x <= t), lambda p: F.size(F.array_intersect(p, b["hashes"])) / F.nullif(F.size(p), F.lit(0))),
    )


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts together (shingles across their border aside; its digest is unknown, null)."""
    return _let(
        F.least(a["threshold"], b["threshold"]),
        lambda t: F.struct(t.alias("threshold"), F.lit(None).cast("long").alias("digest"), F.array_sort(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda x: x <= t)).alias("hashes")),
    )


def rendered(s: Column) -> Column:
    """Lowercase hex: the threshold, the digest, then 16 digits for each hash, with colons between."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(digits(s["threshold"]), F.lit(":"), F.coalesce(digits(s["digest"]), F.lit("")), F.lit(":"), F.array_join(F.transform(s["hashes"], digits), ""))


def with_successor(docs: DataFrame, id_col: str, columns: list[str], ties: str, derive: dict[str, Column] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` plus ``next_<column>`` of the row with the next id; the last row's next is the first.

    Ids are dealt into buckets by rank: between each two of ``QUANTILES``
    quantiles by further quantiles of the ids there, so that ids with a coded
    prefix, or any other gaps, fill buckets alike. The smallest row of each bucket also goes, marked, to the
    end of the bucket before (that of the first to the last), so each bucket
    finds its rows' successors alone. Only the quantiles reach the driver. The
    table of bucket heads has one row for about ``bucket_rows`` documents: up to
    ``BROADCAST_HEADS`` rows it is broadcast, beyond that joined by shuffle.
    ``derive`` adds columns after the rows are dealt, so they are not shuffled. Rows with the same id
    follow one another in the order of ``ties``; null ids come first. Ids should
    be nearly unique: the rows of one id are in one bucket.
    """
    i = F.col(id_col).cast("long")
    stats = docs.select(i.alias("i")).agg(F.percentile_approx("i", [k / QUANTILES for k in range(QUANTILES + 1)], 10 * QUANTILES).alias("q"), F.count("*").alias("n")).first()
    cuts = sorted(set(stats["q"] or [0]))
    inner = max(1, -(-stats["n"] // (QUANTILES * bucket_rows)))
    q = F.array(*(F.lit(int(x)).cast("long") for x in cuts))
    coarse = F.size(F.filter(q, lambda x: x <= i))
    if inner == 1:
        dealt = docs.withColumn("_bucket", F.when(i.isNull(), F.lit(-1)).otherwise(coarse).cast("long"))
    else:
        share = [k / inner for k in range(1, inner)]
        finer = docs.where(i.isNotNull()).select(i.alias("i"), coarse.alias("_coarse")).groupBy("_coarse").agg(F.percentile_approx("i", share, 10 * inner).alias("_cuts"))
        finer = settle(finer.select("_coarse", F.array_distinct("_cuts").alias("_cuts")), "quantiles")
        near = docs.join(F.broadcast(finer) if (QUANTILES + 2) * inner <= BROADCAST_CUTS else finer, coarse == F.col("_coarse"), "left")
        fine = F.size(F.filter("_cuts", lambda x: x <= i))
        dealt = near.withColumn("_bucket", F.when(i.isNull(), F.lit(-1)).otherwise(coarse * inner + fine).cast("long")).select(*docs.columns, "_bucket")
    heads = dealt.select(i.alias("_head"), "_bucket").groupBy("_bucket").agg(F.min("_head").alias("_head"))
    whole = Window.orderBy("_bucket")  # one row for each bucket
    last = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_head", F.coalesce(F.lag("_bucket").over(whole), F.last("_bucket").over(last)).alias("_to"))
    if (len(cuts) + 1) * inner <= BROADCAST_HEADS:
        heads = F.broadcast(heads)
    ghosts = docs.join(heads, i.eqNullSafe(F.col("_head"))).select(*docs.columns, F.col("_to").alias("_bucket"), F.lit(1).alias("_ghost"))
    both = dealt.withColumn("_ghost", F.lit(0)).select(*docs.columns, "_bucket", "_ghost").unionAll(ghosts)
    both = both.repartition("_bucket").withColumns(derive or {})
    over = Window.partitionBy("_bucket").orderBy("_ghost", F.col(id_col).asc_nulls_first(), ties)
    return both.withColumns({f"next_{c}": F.lead(c).over(over) for c in columns}).where("_ghost = 0").drop("_bucket", "_ghost")


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has the last floor(n/2) code points replaced by the first
    as many (or all) of the next document's text in ascending id order.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``, one row for each row of ``docs``. Null texts count
    as empty. A null id comes before all others; rows with a repeated id follow
    one another in the order of their texts. A table of one row follows itself.
    Other columns of ``docs`` are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    paired = with_successor(source, "doc_id", ["text", "own"], "text", {"own": sketch(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    made = paired.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own").alias("next"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", sketch(F.col("edited")).alias("other"), "next")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", rendered(F.col("own")).alias("fingerprint"), rendered(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
