"""Audit of how far the vocabulary of each source is from the other sources of its language.

A task blanks separators and lowers letters of a whole text with one
``bytes.translate``, splits it and counts it in a ``Counter`` of its own, which
gives a term's occurrences and, by its keys, the texts that have the term. These
sparse rows are added up inside the task before anything is shuffled, once, by
language and term.

The divergence of two sources is a sum over all kept terms, most of which most
sources do not have. With ``p0`` the share of an absent term, the sum is taken
from the terms that occur::

    sum over A of f(p, q0) + sum over B of f(p0, q) + (V - |A| - |B|) * f(p0, q0)
        + sum over A and B of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

The first two sums run over the different counts of a source, not its terms; the
last one is taken in blocks of terms, and a block returns one row for each two
sources, whatever its number of terms. No row is made for two sources of a term.

Nulls in text, lang and source count as ''. Empty texts and texts without terms
add their (lang, source) group alone. A repeated row counts again. Ties go to
the smaller item in UTF-8 order. An empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.base import bounded, settle, small, text_or_empty

LEAST_DOCUMENTS = 10  # of a language that have a term
RANKS = 10
SCALE = 1_000_000_000
CHUNK_BYTES = 4_000_000  # of a text, split at a time
HELD_ROWS = 1_000_000  # of counts in a task
BLOCK_ROWS = 50_000
BLOCK_CELLS = 2_000_000

TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
COUNTS = "lang string, source string, term binary, n long, documents long"


def terms_of(text: bytes) -> Counter:
    """Occurrences of each term of a text, in chunks that end at a separator."""
    blank, counts, at = text.translate(TABLE), Counter(), 0
    while at < len(blank):
        end = blank.find(b" ", at + CHUNK_BYTES)
        end = len(blank) if end < 0 else end
        counts.update(blank[at:end].split())
        at = end
    return counts


def _added(parts: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("documents", "sum")])
    return both.rename_columns(["lang", "source", "term", "n", "documents"] if both.column_names[0] == "lang" else ["n", "documents", "lang", "source", "term"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``COUNTS``; each group also has a row with the empty term, so that it is known without terms."""
    held: list[pa.Table] = []
    for batch in batches:
        terms, n, sizes = [], [], []
        for text in batch.column(2).cast(pa.binary()):
            counts = terms_of(text.as_py())
            terms.append(b"")
            n.append(0)
            terms.extend(counts)
            n.extend(counts.values())
            sizes.append(len(counts) + 1)
        row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        n = np.array(n, np.int64)
        columns = {"lang": batch.column(0).take(row), "source": batch.column(1).take(row), "term": pa.array(terms, pa.binary()), "n": n, "documents": (n > 0).astype(np.int64)}
        held.append(_added([pa.table(columns)]))
        if sum(t.num_rows for t in held) > HELD_ROWS:
            held = [_added(held)]
            if held[0].num_rows > HELD_ROWS // 2:
                yield from _added(held).to_batches(100_000)
                held = []
    if held:
        yield from _added(held).to_batches(100_000)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, documents`` of every term, and a row with the empty term for every group."""
    texts = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().alias("text"))
    parts = bounded(texts).mapInArrow(_count, COUNTS).withColumn("term", F.col("term").cast("string"))
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / total), in decimals, as the product passes 64 bits; null where ``total`` is 0."""
    product = (count.cast("decimal(19,0)") + F.lit(2)) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", product, F.nullif(total.cast("decimal(20,0)"), F.lit(0))) + F.lit(1)


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over shared terms of rows ``lang, term, source, p, p0`` in order of lang and term."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = rows.slice(rows.num_rows - 1)
            same = pc.and_(pc.equal(rows["lang"], last["lang"][0]), pc.equal(rows["term"], last["term"][0]))
            cut = rows.num_rows - pc.sum(same).as_py()
            yield from _overlaps_of(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held:
        yield from _overlaps_of(pa.Table.from_batches(held))


def _overlaps_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    for lang in pc.unique(rows["lang"]):
        own = rows.filter(pc.equal(rows["lang"], lang)).combine_chunks()
        codes = own["source"].combine_chunks().dictionary_encode() if own.num_rows else None
        source = codes.indices.to_numpy().astype(np.int64)
        names = codes.dictionary
        term = np.cumsum(np.concatenate(([0], pc.not_equal(own["term"].slice(1), own["term"].slice(0, own.num_rows - 1)).to_numpy().astype(np.int64))))
        p, at_zero = own["p"].to_numpy(), np.zeros(len(names), np.int64)
        at_zero[source] = own["p0"].to_numpy()
        total = np.zeros((len(names), len(names)), np.int64)
        step = max(1, BLOCK_CELLS // len(names))
        for first in range(0, int(term[-1]) + 1, step):
            lo, hi = np.searchsorted(term, (first, first + step))
            share = np.zeros((int(term[hi - 1]) - first + 1, len(names)), np.int64)
            share[term[lo:hi] - first, source[lo:hi]] = p[lo:hi]
            for a in range(len(names) - 1):
                there = share[:, a] > 0
                x, y, x0, y0 = share[there, a][:, None], share[there, a + 1 :], at_zero[a], at_zero[a + 1 :]
                change = _distances(x, y) - _distances(x, y0) - _distances(x0, y) + _distances(x0, y0)
                total[a, a + 1 :] += np.where(y > 0, change, 0).sum(0)
        a, b = np.nonzero(total)
        out = [pa.array([lang.as_py()] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(total[a, b])]
        yield pa.RecordBatch.from_arrays(out, ["lang", "source", "item", "value"])


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """Divergence of each source from every other of its language (``pair``), and the terms it uses most above its language (``term``).

    Returns ``lang, source, part, item, value, rank``.
    """
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs)
    everywhere = {"lang_n": F.sum("n").over(of_term), "lang_documents": F.sum("documents").over(of_term), "head": F.col("source") == F.min("source").over(of_term)}
    kept = counted.withColumns(everywhere).where(((F.col("term") == "") | (F.col("lang_documents") >= least_documents)))
    kept = settle(kept.select("lang", "source", "term", "n", "lang_n", "head"), "kept-terms")
    is_term = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(is_term).alias("own"), F.count_if(is_term & F.col("head")).alias("heads"))
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"kept": F.sum("heads").over(of_lang), "lang_total": F.sum("total").over(of_lang)})
    room = F.col("kept") * 2
    groups = groups.select("lang", "source", "own", "kept", (F.col("total") + room).alias("size"), (F.col("lang_total") + room).alias("lang_size"))
    groups = settle(groups.withColumn("p0", _share(F.lit(0), F.col("size"))), "groups")
    terms = kept.where(is_term).join(small(groups), ["lang", "source"])
    terms = terms.select("lang", "source", "term", _share(F.col("n"), F.col("size")).alias("p"), _share(F.col("lang_n"), F.col("lang_size")).alias("q"), "p0")
    return _pairs(terms, groups).unionByName(_terms(terms, ranks))


def _pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("other_own"))
    absent = (F.col("kept") - F.col("own") - F.col("other_own")) * _distance(F.col("p0"), F.col("q0"))
    every = groups.join(small(others), "lang").where("source <> item").select("lang", "source", "item", F.coalesce(absent, F.lit(0)).alias("value"))
    counts = terms.groupBy("lang", "source", "p").count()
    alone = counts.join(small(others), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("count") * _distance(F.col("p"), F.col("q0"))).alias("value"))
    in_order = terms.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    shared = in_order.mapInArrow(_overlaps, "lang string, source string, item string, value long")
    turned = [F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item"), F.col("value")]
    parts = every.union(alone).union(alone.select(*turned)).union(shared).union(shared.select(*turned))
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(sums, "pair")


def _terms(terms: DataFrame, ranks: int) -> DataFrame:
    above = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(above, "term").where(F.col("rank") <= ranks)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))
