"""Line sequences against the standard library's matcher, and near copies of files against the rule they stand for."""

import difflib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamline.functions import sequences
from loamline.functions.text import split_lines
from loamline.operators import reuse


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25), st.sampled_from([0, 4_000_000]))
def test_ratio_is_that_of_the_standard_library(a, b, most):
    kept, sequences.MOST_PAIRS = sequences.MOST_PAIRS, most
    try:
        assert sequences.ratio(np.array(a, int), np.array(b, int)) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    finally:
        sequences.MOST_PAIRS = kept


def test_ratio_of_long_sequences():
    a = np.arange(30_000)
    b = np.where(a % 50 == 0, -1, a)
    assert sequences.ratio(a, b) == 0.98
    assert sequences.ratio(a, a[::-1]) == 2 / 60_000


def test_lines_end_at_any_boundary(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k\n", "\n\n", "x\r\n", "\r\n\r\n", "a\n\r"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(split_lines(F.col("t"))).collect()]
    assert got == [t.splitlines() for t in texts]


@pytest.mark.parametrize("seed", [4, 5])
def test_near_duplicates_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(110):
        family = random.Random(rng.randrange(6))
        ls = [f"l{family.randrange(12)}" for _ in range(family.randrange(3, 40))]
        for _ in range(rng.randrange(4)):
            ls[rng.randrange(len(ls))] = f"l{rng.randrange(15)}"
        if rng.random() < 0.2:
            rng.shuffle(ls)
        rows.append((i, rng.choice("uvw"), rng.choice("pq"), "\n".join(ls) + rng.choice(["", "\n"])))
    rows += [(900, "u", "p", None), (901, "v", "p", ""), (902, "u", "p", "same small"), (903, "v", "p", "same small"), (904, "w", "q", "same small"), (905, "u", "p", "same small")]
    owners, first = {}, {}
    for k, o, n, t in rows:
        if t:
            owners.setdefault(t, set()).add(o)
            first.setdefault((n, o, t), k)
    shared = {t for t, found in owners.items() if len(t.encode()) >= 60 and len(found) > 1}
    items, want = sorted((k, *g) for g, k in first.items()), set()
    for x, (k, n, o, t) in enumerate(items):
        for k2, n2, o2, t2 in items[x + 1 :]:
            ratio = difflib.SequenceMatcher(None, t.splitlines(), t2.splitlines(), autojunk=False).ratio()
            if n == n2 and o != o2 and not (t in shared and t2 in shared) and ratio >= 0.6:
                want.add((k, k2, round(ratio, 4)))
    df = spark.createDataFrame(rows, "k int, o string, name string, t string")
    assert shared and want
    assert {tuple(r) for r in reuse.near_duplicates(df, "k", "o", "t", 0.6, ["name"], least_bytes=60).collect()} == want
    assert reuse.near_duplicates(df.limit(0), "k", "o", "t").count() == 0


def test_agreement_is_that_of_matching_blocks():
    rng = np.random.default_rng(5)
    for n in range(400):
        a, b = (rng.integers(0, (4, 12, 60)[n % 3], rng.integers(1, 12)) for _ in "ab")
        b = (b, a[::-1], np.concatenate([b, a]))[n % 4 % 3]
        common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        want = (sequences.matched(a, b), sequences.matched(b, a)) if 2.0 * common / (len(a) + len(b)) >= 0.5 else None
        assert sequences.agreement(a, b, 0.5) == want
        assert sequences.agreement(a, b, 0.0, ordered=False) == (common, common)


def test_frequent_last_lines_propose_no_pairs(spark):
    """A line that all texts share, among others of their own, once brought every pair of them to the exact comparison."""
    rows = [(k, [k * 10 + i for i in range(1, 4)] + [-1]) for k in range(40)] + [(100, [11, 12, 13, 5])]
    lined = spark.createDataFrame(rows, "c int, lines array<long>")
    assert [tuple(r) for r in reuse._candidates(lined, [], 0.5).collect()] == [(1, 100)]
