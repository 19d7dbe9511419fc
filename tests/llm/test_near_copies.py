"""Near copies against a brute force over all pairs of shingle sets; nothing similar is lost, nothing else linked."""

from itertools import combinations

import numpy as np

from loamline.llm import simhash


def _texts(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for n in (*[3, 5, 8, 9, 10, 12, 20, 30, 45, 60] * 3, *[200] * 6, 1500):
        base = list(rng.choice(vocabulary, n))
        out.append(base)
        for k in range(4):  # chains of edits, alike and not so alike
            base = list(base)
            for _ in range(1 + k // 2 * n // 40):
                base[int(rng.integers(len(base)))] = str(rng.choice(vocabulary))
            out.append(base)
        out.append([*out[-1], "tail"])
    # A family that shares half of its text: alike in the fingerprints now and then, never in the shingles.
    shared = list(rng.choice(vocabulary, 150))
    out += [shared + list(rng.choice(vocabulary, 75)) for _ in range(40)]
    # Short texts that share all but their last word.
    out += [["please", "find", "the", "signed", "paper", "of", f"name{i}"] for i in range(30)]
    return [" ".join(t) for t in out]


def _components(sets):
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        both = len(a & b)
        if (a or b) and both >= simhash.SIMILARITY * (len(a) + len(b) - both) - 1e-9 or a == b:
            i, j = find(i), find(j)
            label[max(i, j)] = min(i, j)
    return [find(i) for i in range(len(sets))]


def test_components_equal_brute_force(spark):
    texts = [*_texts(np.random.default_rng(3)), "", None, "one", "one", " "]
    want = _components([set(simhash.shingle_hashes(t, 5).tolist()) for t in texts])
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, _keep int, node int, n int").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want))


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_copies(docs).collect()) == [(-1, -1), (-1, -1), (4, 4), (4, 4), (9, 4)]
    assert sorted(r["doc_id"] or -1 for r in simhash.keep_representatives(docs).collect()) == [-1, -1, 4]
    assert simhash.keep_representatives(docs.limit(0)).count() == 0


def test_fingerprint_equals_the_definition(spark):
    import xxhash

    text = "The QUICK brown fox\tjumps  over the lazy dog the quick brown fox jumps É"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    got = simhash.near_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["fingerprint"] == f"{want:016x}"


def test_links_are_found_beside_nearer_ones_that_fail(spark, monkeypatch):
    """Lists by single bytes, at any distance: their forests mostly run over texts that are not alike."""
    monkeypatch.setattr(simhash, "SIMILAR", simhash.Index(words=4, keys=tuple((p,) for p in range(8)), min_matches=1, max_bits=256, distinct=True))
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(300):
        base = [f"w{i}" for i in rng.integers(0, 5000, 100)]
        texts += [" ".join(base), " ".join([*base[:98], "other", "end"])]
    order = rng.permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert all(got[i] == i // 2 * 2 for i in range(len(texts)))


def test_a_group_that_is_nearly_alike_makes_no_rows_by_the_square(spark, monkeypatch):
    """240 texts that share three quarters of their shingles, a few of them alike, in one task and dealt out in blocks."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = list(rng.choice(vocabulary, 150))
    texts = [" ".join(shared + list(rng.choice(vocabulary, 25))) for _ in range(240)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[::60]] + [" ".join(shared[:16] + list(rng.choice(vocabulary, 4))) for _ in range(60)]
    want = _components([set(simhash.shingle_hashes(t, 5).tolist()) for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    verified, rows = simhash.verified, []
    monkeypatch.setattr(simhash, "verified", lambda pairs, sets: rows.append(pairs.count()) or verified(pairs, sets))
    for shingles in (simhash.LIST_SHINGLES, 15000):
        monkeypatch.setattr(simhash, "LIST_SHINGLES", shingles)
        rows.clear()
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert sum(rows) < 40 * len(texts) < 240 * 239 // 2


def test_a_group_sends_each_text_once_not_to_every_list(spark, monkeypatch):
    """240 long texts and 60 short ones that are nearly alike, compared whole, dealt out in blocks and in their lists."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = list(rng.choice(vocabulary, 150))
    texts = [" ".join(shared + list(rng.choice(vocabulary, 25))) for _ in range(240)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[::60]] + [" ".join(shared[:16] + list(rng.choice(vocabulary, 4))) for _ in range(60)]
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[250::10]]
    want = _components([set(simhash.shingle_hashes(t, 5).tolist()) for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bounded, rows = simhash.bounded, []

    def counted(df):
        if "shingles" in df.columns:
            rows.append(df.count())
        return bounded(df)

    monkeypatch.setattr(simhash, "bounded", counted)
    found = {}
    for part_rows, entry in ((1000, 2000), (20, 2000), (1000, -(10**9))):
        monkeypatch.setattr(simhash, "PART_ROWS", part_rows, raising=False)
        monkeypatch.setattr(simhash, "ENTRY", entry, raising=False)
        rows.clear()
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want
        found[part_rows, entry > 0] = sum(rows)
    assert 0 < found[1000, True] <= len(texts)
    assert found[1000, True] < found[20, True] <= simhash.PARTS * len(texts)
    assert found[1000, False] > 4 * len(texts)
