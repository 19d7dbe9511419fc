"""Collocations: phrases of two to five words that occur together more often than their parts suggest.

Phrases are counted level by level. A phrase of k words is counted only where
both phrases of k - 1 words inside it are frequent enough, as it cannot be
frequent otherwise; a bit map of fixed size says which are. Its rare false hits
cost a row and change nothing, since every count is exact and held against the
threshold afterwards. A task numbers the words of a batch and counts by sorting
its phrases, and Spark adds up what the tasks found.

The frequent phrases of all lengths are one table of counts. It is read as two
streams. In prefix order it is merged with the cuts of the candidates by their
first part, which gives the left counts; in suffix order with the same cuts by
their rest, for the right counts. Phrases without their first or last word are a
third stream, merged with the candidates for the extension counts (a longer
phrase holds a shorter one only through extensions by one word, and these are
the most frequent). These are Spark's sort-merge joins: both sides come in order
of language and phrase, and a part that very many phrases share may be split.

A null text is empty, a null lang ``und``. Empty texts and languages without
candidates give no rows. A repeated row counts again. Ties go to fewer words
before the cut, and in the ranking to the higher count, then the smaller phrase
in UTF-8 order. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.base import bounded, settle, small, text_or_empty

MAX_WORDS = 5
LEAST = 100  # occurrences of a candidate
PERCENT = 100  # of a candidate's occurrences that lie in a longer one: it is dropped
RANKS = 2000
MAP_BITS = 27  # of the bit map's size at most: 16 MB
CHUNK_BYTES = 4_000_000  # of a text, split into words at a time

BREAK = b"\xff"  # in place of what ends a piece; never in UTF-8
TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b in b" \t" else b + 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))
COUNTS = "lang string, phrase binary, f long"
MULTIPLIER, SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _numbered(text: bytes, numbers: defaultdict) -> Iterator[np.ndarray]:
    """The words of a text as numbers, with ``numbers[BREAK]`` at the end of a piece."""
    plain, at = text.translate(TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK_BYTES)
        end = len(plain) if end < 0 else end
        words = plain[at:end].replace(BREAK, b" \xff ").split()
        yield np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        at = end


def _numbered_texts(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """For each language of ``batch(lang, text)`` its different words (the first is BREAK) and its texts in their numbers."""
    numbers: dict[str, defaultdict] = {}
    arrays: dict[str, list[np.ndarray]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
        if lang not in numbers:
            numbers[lang] = own = defaultdict()
            own.default_factory = own.__len__
            arrays[lang] = []
        arrays[lang] += [np.array([numbers[lang][BREAK]]), *_numbered(text.as_py(), numbers[lang])]
    for lang, found in arrays.items():
        yield lang, list(numbers[lang]), np.concatenate([*found, np.zeros(1, np.int64)])


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * MULTIPLIER + hashes[k : k + n]
    return out


def _bits(hashes: np.ndarray, width: int) -> np.ndarray:
    return ((hashes ^ hashes >> np.uint64(29)) * SPREAD) >> np.uint64(64 - width)


def _rows(lang: str, phrases: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), phrases, pa.array(f, pa.int64())], ["lang", "phrase", "f"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words; the empty phrase has the number of all words."""
    for batch in batches:
        for lang, words, numbers in _numbered_texts(batch):
            f = np.bincount(numbers, minlength=len(words))
            f[0] = 0
            f[0] = f.sum()
            yield _rows(lang, pa.array([b"", *words[1:]], pa.binary()), f)


def _count_phrases(size: int, known: Callable[[], tuple[np.ndarray, int]]) -> Callable:
    """Counts of phrases of ``size`` words both of whose shorter phrases are in the bit map that ``known`` returns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, width = known()
        for batch in batches:
            for lang, words, numbers in _numbered_texts(batch):
                if len(numbers) < size:
                    continue
                bit = _bits(_windows(_hashes(lang, words)[numbers], size - 1), width)
                within = frequent[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) > 0
                for k in range(size - 1):
                    within &= numbers[k : k + len(within)] > 0
                starts = np.flatnonzero(within[:-1] & within[1:])
                if not len(starts):
                    continue
                first, group = np.arange(len(starts)), numbers[starts]
                for k in range(1, size):
                    _, first, group, f = np.unique(group * len(words) + numbers[starts + k], return_index=True, return_inverse=True, return_counts=True)
                spelled = pa.array(words, pa.binary())
                at = starts[first]
                yield _rows(lang, pc.binary_join_element_wise(*(spelled.take(pa.array(numbers[at + k])) for k in range(size)), b" "), f)

    return count


def _bit_map(phrases: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """Bits of the hashes of ``phrases(lang, phrase)``, in 64-bit words; at least 64 bits a phrase up to ``MAP_BITS``."""
    width = min(MAP_BITS, max(16, rows.bit_length() + 6))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_bits(_windows(_hashes(lang, words := phrase.split(b" ")), len(words)), width) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).astype(np.int64))], ["bit"])

    bits = phrases.select("lang", F.col("phrase").cast("binary")).mapInArrow(positions, "bit long")
    word = F.shiftright("bit", 6).alias("word")
    found = bits.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out, width


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """``lang, phrase, size, f`` of each phrase that occurs ``least`` times, and of each language's empty phrase (size 0), with all its words."""
    spark = docs.sparkSession
    texts = bounded(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text")))

    def level(count: Callable, size: int) -> DataFrame:
        rows = texts.mapInArrow(count, COUNTS).withColumn("phrase", F.col("phrase").cast("string")).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        rows = rows.where((F.col("f") >= least) | (F.col("phrase") == ""))
        return settle(rows.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(size).alias("size"), "f"), "phrases")

    levels = [level(_count_words, 1)]
    for size in range(2, max_words + 1):
        shorter = levels[-1].where("size > 0")
        rows = shorter.count()
        if not rows:
            break
        frequent = spark.sparkContext.broadcast(_bit_map(shorter, rows))
        levels.append(level(_count_phrases(size, lambda frequent=frequent: frequent.value), size))
        frequent.destroy()
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)); decimals, as the products pass 64 bits."""
    wide = [c.cast("decimal(18,0)") for c in (a, n, left, right)]
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide[0] * wide[1], wide[2] * wide[3])


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, percent: int = PERCENT, ranks: int = RANKS) -> DataFrame:
    """The first ``ranks`` phrases of each language by score: ``lang, rank, phrase, a, l, r, n, score``."""
    counts = phrase_counts(docs, max_words, least)
    words = counts.where("size > 0").select("lang", "phrase", "f")
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    longer = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    rest = F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _phrase(F.slice("words", F.lit(1), F.col("k"))).alias("first"), _phrase(rest).alias("rest"))
    in_prefix_order = words.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")).hint("merge")
    in_suffix_order = words.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")).hint("merge")
    scored = cuts.join(in_prefix_order, ["lang", "first"]).join(in_suffix_order, ["lang", "rest"]).join(small(totals), "lang")
    scored = scored.withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    shorter = F.array(_phrase(F.slice("words", F.lit(1), F.col("size") - 1)), _phrase(F.slice("words", F.lit(2), F.col("size") - 1)))
    extended = longer.where("size > 2").select("lang", F.explode(shorter).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = best.join(extended.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(F.col("longest") * 100 < F.col("a") * percent, F.lit(True)))
    found = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
