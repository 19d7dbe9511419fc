"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a seed lexicon and of one learned from labels, how
near second-person words stand to their hits, and rates of capitals,
punctuation and obfuscation. Labels, language, source and id are never features.

Training takes a bounded, documented sample: the ``SAMPLE_DOCS`` labelled rows
of lowest id hash among those allowed. It is split by hash in three: words and
stems are learned on the first part, trees on the second, the calibration on the third.
Scoring is one pass over all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.base import bounded, byte_slices, text_or_empty

SAMPLE_DOCS = 24_000
LEARNED_UNITS = 4000
LEAST_TOXIC_DOCS = 5
LEAST_LOG_ODDS = 2.0
STEM_LETTERS = range(4, 9)
MEMO_WORDS = 300_000  # of at most MEMO_LETTERS
MEMO_LETTERS = 40
SLICE_BYTES = 4_000_000
PREDICT_FROM = 0.7
TREES, DEPTH, RATE, BINS, LEAST_LEAF, L2 = 80, 3, 0.15, 32, 5, 1.0

#: Common insults in four languages, as a start; more are learned from labels.
SEED_WORDS = frozenset(
    """
    idiot idiots idiotic moron morons moronic stupid dumb dumbass fool imbecile loser losers scum clown clowns trash
    garbage pathetic worthless disgusting filthy vermin jerk creep freak ugly hateful degenerate retard bastard bitch
    asshole bullshit crap damn fuck fucking fucker shit shitty slut whore
    idiote crétin imbécile débile abruti abrutie ordure minable pathétique connard connasse salaud salope merde dégueulasse
    trottel depp dummkopf abschaum versager erbärmlich wertlos ekelhaft arschloch scheiße schlampe blödmann widerlich
    idiota imbécil estúpido estúpida payaso basura patético patética asqueroso asquerosa perdedor inútil mierda cabrón puta gilipollas
    """.split()
)
SECOND_PERSON = frozenset(
    """
    you your yours yourself yourselves u ur ya
    tu te toi ton ta tes vous votre vos
    du dich dir dein deine deinen deiner ihr euch euer eure
    tú ti tus vosotros vosotras vuestro vuestra usted ustedes
    """.split()
)
_WORD = re.compile(r"[^\W\d_]+")
#: A run with a sign or digit in it; the possessive parts and the look-behind make it one try a run.
_MIXED = re.compile(r"(?<![\w@$*!])(?=[^\W\d_]*+[0-9@$*!])[\w@$*!]++")
_SIGN_THEN_LETTER = re.compile(r"[0-9@$*!][A-Za-z]")
_PLAIN_LETTERS = str.maketrans("013457@$!", "oieastasi")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_PUNCT_RUN = re.compile(r"[!?.#$%&*]{2,}")
NEAR = 5

FEATURES = (
    "seed_density", "seed_hits", "learned_density", "learned_hits", "learned_distinct", "learned_sum", "learned_most", "near_share", "nearest",
    "second_person", "capitals", "capital_words", "exclamations", "punctuation", "punct_runs",
    "obfuscated", "obfuscated_hits", "stretched", "digits", "log_words", "word_length",
)


def units(word: str) -> list[str]:
    """What the learned lexicon holds of a word: itself and its stems (marked with a hyphen)."""
    return [word, *(word[:k] + "-" for k in STEM_LETTERS if len(word) > k)]


class Lexicon(dict):
    """Word -> the largest weight of its units; 0 for others. Words met are kept."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = max(map(self.weights.get, units(word), [0.0] * (len(STEM_LETTERS) + 1)))
        if len(word) <= MEMO_LETTERS:
            if len(self) > MEMO_WORDS:
                self.clear()
            self[word] = found
        return found

    def __reduce__(self):
        return Lexicon, (self.weights,)


def obfuscated(text: str) -> list[str]:
    """Words of three or more characters that begin with a letter, @ or $ and hold a sign or digit before a letter."""
    runs = (r.strip("!") for r in _MIXED.findall(text)) if any(c in text for c in "0134579@$*!") else ()
    return [r for r in runs if len(r) > 2 and (r[0] in "@$" or r[0].isascii() and r[0].isalpha()) and _SIGN_THEN_LETTER.search(r)]


def features(text: str, learned: Lexicon) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``."""
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    chars = max(1, len(text))
    seeds = [i for i, w in enumerate(words) if w in SEED_WORDS]
    found = [(w, x) for w, x in zip(words, map(learned.__getitem__, words)) if x]
    distinct = dict(found)
    total = sum(x for _, x in found)
    near, nearest = 0, 0.0
    hits = seeds or [i for i, w in enumerate(words) if w in distinct]
    persons = sum(w in SECOND_PERSON for w in words)
    if hits and persons:
        for i in hits:
            ds = [abs(j - i) for j in range(max(0, i - NEAR), min(len(words), i + NEAR + 1)) if words[j] in SECOND_PERSON]
            if ds:
                near += 1
                nearest = max(nearest, 1 / min(ds) if min(ds) else 1.0)
    odd = obfuscated(text)
    odd_hits = 0
    for o in odd:
        plain = o.lower().translate(_PLAIN_LETTERS)
        if plain in SEED_WORDS or learned[plain]:
            odd_hits += 1
        elif "*" in plain:
            shape = re.compile(re.escape(plain.rstrip("*!")).replace(r"\*", r"\w"))
            odd_hits += any(shape.fullmatch(w) for w in SEED_WORDS)
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    tokens = text.split()
    marks = sum(text.count(c) for c in "!?.,;:#$%&*|")
    return [
        len(seeds) / n, min(len(seeds), 50), total / n, min(len(found), 50), min(len(distinct), 50), min(sum(distinct.values()), 100.0), max(distinct.values(), default=0.0), near / max(1, len(hits)), nearest,
        persons / n, capitals / chars, sum(t.isupper() and len(t) > 1 for t in tokens) / max(1, len(tokens)), text.count("!") / n, marks / chars, len(_PUNCT_RUN.findall(text)) / n,
        len(odd) / n, odd_hits, len(_STRETCHED.findall(text)) / n, sum(text.count(c) for c in "0123456789") / chars, float(np.log1p(len(words))), chars / n,
    ]


# --- trees and calibration ----------------------------------------------------


class Trees:
    """Boosted complete trees of depth ``DEPTH``: node arrays ``feature, cut``, leaf values."""

    def __init__(self, base: float):
        self.base = base
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting on the logistic loss over features cut into ``BINS`` quantile bins."""
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(rate / (1 - rate))))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    # Rare events sit above the last quantile: also cut just above a feature's most common value.
    cuts = [np.unique(np.append(c, [np.median(col), (col[col > np.median(col)].min() + np.median(col)) / 2 if (col > np.median(col)).any() else np.median(col)])) for c, col in zip(cuts, x.T)]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    width = max(map(len, cuts)) + 1
    raw = np.full(len(y), model.base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            of = np.flatnonzero(at == node)
            best = (1e-6, None, None)
            if len(of) >= 2 * LEAST_LEAF:
                total_g, total_h = g[of].sum(), h[of].sum()
                for j in range(x.shape[1]):
                    b = binned[of, j]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[of], h[of], None))
                    gain = gs**2 / (hs + L2) + (total_g - gs) ** 2 / (total_h - hs + L2) - total_g**2 / (total_h + L2)
                    gain[(ns < LEAST_LEAF) | (len(of) - ns < LEAST_LEAF)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0] and k < len(cuts[j]):
                        best = (gain[k], j, k)
            if best[1] is not None:
                feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
            at[of] = 2 * node + 1 + (x[of, feature[node]] > cut[node])
        leaves = at - inner
        gs, hs = np.bincount(leaves, g, 2**DEPTH), np.bincount(leaves, h, 2**DEPTH)
        leaf = -RATE * gs / (hs + L2)
        raw += leaf[leaves]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending knots of the raw score and their calibrated values."""
    xs, group = np.unique(raw, return_inverse=True)
    weights = np.bincount(group)
    means = np.bincount(group, y) / weights  # rows of one raw score stay together
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for x, mean, weight in zip(xs.tolist(), means.tolist(), weights.tolist()):
        blocks.append([mean, weight, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, last
    knots = [(x, b[0]) for b in blocks for x in ((b[2],) if b[2] == b[3] else (b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    """Learned words and stems, trees and calibration; a constant where labels have one class or none."""

    def __init__(self, learned: Lexicon, trees: Trees | None, knots: tuple[np.ndarray, np.ndarray] | None, constant: float):
        self.learned, self.trees, self.knots, self.constant = learned, trees, knots, constant

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.constant)
        x = np.array([features(t, self.learned) for t in texts])
        raw = self.trees.raw(x)
        # A trace of the raw score keeps the order of texts with one calibrated value.
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 1 modulo 3."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` labelled documents outside the held-out third.

    Labels that are null, or whose document is missing, take no part; of
    contradicting labels of one document the larger counts. A null text counts
    as an empty one with its label.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Bounded by the parameter, so it may be broadcast.
    picked = spark.createDataFrame(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).collect(), "doc_id long, toxic int")
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        docs = [0, 0]
        for b in (part for b in batches for part in byte_slices(b, 0, SLICE_BYTES)):
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (toxic if y else clean).update({u for w in set(_WORD.findall(t.lower())) for u in units(w)})
                docs[bool(y)] += 1
        # All units go out: how often one is clean elsewhere, or toxic at all, only the sum over tasks tells.
        seen = list(toxic | clean)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", *seen], pa.string()), pa.array([docs[1], *(toxic[w] for w in seen)], pa.int64()), pa.array([docs[0], *(clean[w] for w in seen)], pa.int64())], names=["word", "toxic", "clean"]
        )

    counts = rows.where("part < 4").select("text", "toxic").mapInArrow(words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = counts.where("word = ''").first()
    weights: dict[str, float] = {}
    if total is not None and total["toxic"] and total["clean"]:
        odds = F.log((F.col("toxic") + 0.5) / (total["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (total["clean"] + 1.0))
        top = counts.where((F.col("word") != "") & (F.col("toxic") >= LEAST_TOXIC_DOCS)).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS)
        weights = {r["word"]: float(r["odds"]) for r in top.orderBy(F.col("odds").desc(), "word").limit(LEARNED_UNITS).collect()}
    learned = Lexicon(weights)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in byte_slices(b, 0, SLICE_BYTES)):
            x = [features(t, learned) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "part", "x"])

    seen = rows.where("part >= 4").select("text", "toxic", F.col("part").cast("int").alias("part")).mapInArrow(dense, "toxic int, part int, x array<double>").collect()
    y = np.array([bool(r["toxic"]) for r in seen], float)
    part = np.array([r["part"] for r in seen])
    x = np.array([r["x"] for r in seen]).reshape(len(seen), len(FEATURES))
    fit, tune = part < 8, part >= 8
    rate = float(y.mean()) if len(y) else 0.0
    if not fit.any() or not tune.any() or y[fit].min() == y[fit].max():
        return Model(learned, None, None, rate)
    trees = fit_trees(x[fit], y[fit])
    return Model(learned, trees, isotonic(trees.raw(x[tune]), y[tune]), rate)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row of ``docs``; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in byte_slices(b, 1, SLICE_BYTES):
                s = model.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= PREDICT_FROM).astype(np.int32))], names=["doc_id", "score", "predicted"])

    source = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(text_col)
            for part in byte_slices(b, i, SLICE_BYTES):
                s = model.scores([t or "" for t in part.column(i).to_pylist()])
                yield part.filter(pa.array(s < PREDICT_FROM))

    return bounded(docs).mapInArrow(run, docs.schema)
