"""Near copies of short texts that many share lines with: compared where they meet, in blocks, with the matches of all pairs."""

import difflib
import random

import pytest

from loamline.operators import reuse


def lined(spark, rows):
    return spark.createDataFrame([(k, 1, False, [(k, f"o{k}")], ls) for k, ls in rows], "c int, owners int, shared boolean, members array<struct<k:int,o:string>>, lines array<long>")


def test_short_texts_are_compared_where_they_meet(spark):
    """Pairs of texts of a few lines once were joined with their lines one by one; only large contents still are."""
    short = [(k, [k + 1000, -1]) for k in range(30)]
    long = [(k, [*range(40), k + 1000]) for k in (50, 51)]
    assert [tuple(r) for r in reuse._candidates(lined(spark, short + long), [], 0.5).collect()] == [(50, 51)]


@pytest.mark.parametrize("sequence", [True, False])
def test_blocks_and_lists_give_all_pairs(spark, monkeypatch, sequence):
    for name, value in (("RARE", 6), ("BLOCK", 3), ("LIGHT_LINES", 9), ("LIGHT_OWNERS", 2), ("MOST_KNOWN", 5)):
        monkeypatch.setattr(reuse, name, value)
    rng = random.Random(11)
    texts = ["\n".join(rng.choice("aabcdefgh") + "." * rng.randrange(2) for _ in range(rng.randrange(1, 13))) for _ in range(60)]
    rows = [(k, rng.choice("uvwx"), rng.choice("pq"), rng.choice(texts)) for k in rng.sample(range(1000), 130)] + [(2000, "u", None, texts[0]), (2001, "v", None, texts[0])]
    owners, first = {}, {}
    for k, o, n, t in sorted(rows):
        owners.setdefault(t, set()).add(o)
        if n:
            first.setdefault((n, o, t), k)
    shared = {t for t, found in owners.items() if len(t) >= 14 and len(found) > 1}
    items, want = sorted((k, *g) for g, k in first.items()), set()
    for at, (k, n, o, t) in enumerate(items):
        for k2, n2, o2, t2 in items[at + 1 :]:
            one, two = t.splitlines(), t2.splitlines()
            common = sum(min(one.count(l), two.count(l)) for l in set(one))
            ratio = difflib.SequenceMatcher(None, one, two, autojunk=False).ratio() if sequence else 2.0 * common / (len(one) + len(two))
            if n == n2 and o != o2 and not (t in shared and t2 in shared) and ratio >= 0.5:
                want.add((k, k2, round(ratio, 4)))
    df = spark.createDataFrame(rows, "k int, o string, name string, t string")
    got = [tuple(r) for r in reuse.near_duplicates(df, "k", "o", "t", 0.5, ["name"], sequence, least_bytes=14).collect()]
    assert shared and len(got) == len(set(got)) and set(got) == want
