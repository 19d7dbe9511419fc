"""The quality model against a plain Kneser-Ney, and what it accepts."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loamline.llm import quality

WORDS = "walking talking working reading writing running playing looking turning making taking coming going being having doing seeing finding giving telling asking feeling trying leaving calling keeping letting meaning putting moving living holding bringing happening sitting standing losing paying meeting setting learning leading speaking growing opening winning offering teaching building".split()


def _walk(rng, n=150):
    out = [int(rng.integers(len(WORDS)))]
    while len(out) < n:
        out.append((out[-1] * 7 + (3, 11, 20)[int(rng.integers(3))]) % len(WORDS))
    return [WORDS[i] for i in out]


def _plain(texts):
    """Interpolated modified Kneser-Ney over trigrams of symbols by dictionaries; returns p(last | first, middle)."""
    tri = Counter((b, a, c) for t in texts for a, b, c in zip([0, *t], t, t[1:]))
    pair = Counter((b, c) for b, _, c in tri)
    single = Counter(c for _, c in pair)
    d = [quality.discounts([sum(v == k for v in x.values()) for k in (1, 2, 3, 4)]) for x in (single, pair, tri)]

    def level(counts, context, d):
        total, left = defaultdict(int), defaultdict(float)
        for x, n in counts.items():
            total[context(x)] += n
            left[context(x)] += d[min(n, 3) - 1]
        return total, left

    t1, l1 = level(single, lambda x: (), d[0])
    t2, l2 = level(pair, lambda x: x[:1], d[1])
    t3, l3 = level(tri, lambda x: x[:2], d[2])

    def step(n, d, total, left, below):
        return below if not total else max(n - d[min(max(n, 1), 3) - 1], 0) / total + left / total * below

    def p(a, b, c):
        p1 = step(single[c], d[0], t1[()], l1[()], 1 / quality.SIZE)
        p2 = step(pair[b, c], d[1], t2[b,], l2[b,], p1)
        return step(tri[b, a, c], d[2], t3[b, a], l3[b, a], p2)

    return p


def test_perplexities_equal_a_plain_model(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(_walk(rng, int(n))) for n in rng.integers(2, 80, 60)] + ["", None, "one", "so so so so so", "日本語の text", " ".join(_walk(rng, 4000)), texts_repeated := "again and again"]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)] + [(66, texts_repeated, None, 1), (None, "no id here", "en", 1)], "doc_id long, text string, lang string, shard int").repartition(5)
    trusted = spark.createDataFrame([(i,) for i in range(0, 67, 2)], "doc_id long")
    rows = quality.perplexities(docs, trusted).join(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "mark").collect()
    assert len(rows) == len(texts) + 2
    symbols = quality._Symbols()
    models = [_plain([symbols.of(r["text"]).tolist() for r in rows if r["trusted"] and r["mark"] & 1 == h]) for h in (0, 1)]
    for r in rows:
        x = symbols.of(r["text"]).tolist()
        assert r["n_words"] == len(x) and r["trusted"] == (r["doc_id"] is not None and r["doc_id"] % 2 == 0)
        if len(x) < 2:
            assert r["perplexity"] is None
        else:
            p = models[1 - (r["mark"] & 1)]
            want = -np.mean([np.log(p(a, b, c)) for a, b, c in zip([0, *x], x, x[1:])])
            assert abs(np.log(r["perplexity"]) - want) < 0.01
    assert sum(len(quality.words(t or "")) for t in ("日本語の text",)) == 5


def test_probabilities_add_up_to_one():
    symbols = quality._Symbols()
    keys, _ = quality.trigrams([symbols.of(t) for t in ("a b r a c a d a b r a a b b a", "b a n a n a", "x")])
    keys, counts = np.unique(keys, return_counts=True)
    pairs, firsts = quality._pairs(keys)
    single = np.bincount((pairs & np.uint64(0xFFFF)).astype(np.int64), minlength=quality.SYMBOLS)
    model = quality.Model(keys, counts, single, quality._first_four(counts), quality._first_four(firsts))
    a, b = (int(symbols[w]) for w in "ab")
    for first, middle in ((a, b), (b, a), (0, a), (7, 9), (7, a)):
        every = np.uint64(middle << 32 | first << 16) + np.arange(1, quality.SYMBOLS, dtype=np.uint64)
        assert abs(np.exp(model.logs(every)).sum() - 1) < 1e-9


def test_hot_middle_words_are_split():
    counts = np.zeros(quality.SYMBOLS, np.int64)
    counts[5], counts[6:200] = 50_000, 100
    shards = quality.Shards(counts, shard_trigrams=10_000)
    keys = (np.uint64(5) << np.uint64(32)) | (np.arange(1, 60_000, dtype=np.uint64) << np.uint64(16)) | np.uint64(9)
    sizes = np.bincount(shards.of(keys), minlength=shards.n)
    assert (sizes > 0).sum() == shards.parts[5] == 10 and sizes.max() < 10_000


def test_shuffled_words_are_rejected(spark):
    rng = np.random.default_rng(6)
    prose = [" ".join(_walk(rng)) for _ in range(260)]
    shuffled = [" ".join(rng.permutation(_walk(rng))) for _ in range(40)]
    rows = [(i, t, "en", 0, 0, 0) for i, t in enumerate(prose + shuffled)] + [(500, "other tongue entirely", "xx", 0, 0, 0), (501, None, "en", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _bad_id int, _trusted int, n int")
    labels = spark.createDataFrame([(i, 1) for i in range(220)], "doc_id long, quality int")
    got = {r["doc_id"]: r["accepted"] for r in quality.assess(docs, labels, spread=1.0).collect()}
    assert sum(got[i] for i in range(220, 260)) >= 38
    assert sum(got[i] for i in range(260, 300)) == 0
    assert got[500] == got[501] == 1
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id >= 500").count() == 2
    assert quality.keep_accepted(docs.limit(0), labels).count() == 0


def test_labels_too_many_to_broadcast_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text number {i % 17} and more {i % 5}", "en") for i in range(300)], "doc_id long, text string, lang string").repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "doc_id long")

    def found():
        return sorted((r["doc_id"], round(r["perplexity"], 6), r["trusted"]) for r in quality.perplexities(docs, trusted).collect())

    want = found()
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 5)
    assert found() == want


def test_split_words_change_no_perplexity(spark):
    """Words dealt to many shards by the word before have the perplexities of one shard."""
    rng = np.random.default_rng(11)
    docs = spark.createDataFrame([(i, " ".join(_walk(rng, 120)), "en") for i in range(80)], "doc_id long, text string, lang string").repartition(3)
    trusted = spark.createDataFrame([(i,) for i in range(0, 80, 2)], "doc_id long")
    counts = quality.middle_counts(docs)
    assert (quality.Shards(counts, 200).parts > 1).any() and not (quality.Shards(counts).parts > 1).any()
    whole, split = ({r["doc_id"]: r["perplexity"] for r in quality.perplexities(docs, trusted, shard_trigrams=n).collect()} for n in (quality.SHARD_TRIGRAMS, 200))
    assert whole == split
