"""Collocations, source divergence and near-duplicate embeddings against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import collocations, divergence, neargraph, queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, size int"
WORDS = "the quick Brown fox l'été naïve ÉCOLE x1y zeta-omega \U0001f642 end".split()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(240):
        words = [WORDS[k] for k in np.minimum(rng.geometric(0.25, rng.integers(0, 60)) - 1, len(WORDS) - 1)]
        text = "".join(w + ("  ", " ", "\t", ". ", ",", "\n", " ; ", " 7 ")[rng.choice(8, p=[0.1, 0.6, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])] for w in words)
        out.append((i, text, ("en", "de", None, "")[i % 4], ("a", "b", "c", None, "")[i % 5], "clash", 1, 2))
    # repeated rows, a hot source, nulls, a group without terms, and a text past a chunk
    out += [out[7]] * 30 + [(900 + i, "the quick fox", "en", "hot", None, None, None) for i in range(150)]
    out += [(None, None, None, None, None, None, None), (991, "12 34 --", "en", "numbers", None, 0, 0), (992, "", "fr", "a", None, 0, 0), (993, "42", "fr", "b", None, 0, 0), (994, "only here", "it", "a", None, 0, 0)]
    return [*out, (995, "the quick Brown fox " * 300 + "L'" + "été" * 3000, "de", "a", "t", 5, 5)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def divergences(rows, least=10, ranks=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        group = (lang or "", source or "")
        groups.add(group)
        counts[group].update(found)
        docs[group[0]].update(set(found))
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    far = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(g[1] for g in groups if g[0] == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], total[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-far(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("block", [50_000, 7])
def test_divergence_against_brute_force(spark, rows, block):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert [dict(got.dtypes)[c] for c in ("value", "rank")] == ["bigint", "int"]
    if block == 7:
        # blocks of a few rows give the sums of one block
        import pyarrow as pa

        table = pa.table({"lang": ["x"] * 6, "term": list("aabbcc"), "source": ["s", "t"] * 3, "p": [5, 9, 4, 4, 10**9, 1], "p0": [1, 2] * 3})
        whole = next(divergence._overlaps_of(table))["value"][0].as_py()
        parts = [next(divergence._overlaps_of(table.slice(i, 2)), None) for i in (0, 2, 4)]
        assert whole == sum(b["value"][0].as_py() for b in parts if b.num_rows)
        return
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == divergences(rows)


def test_divergence_of_few_documents(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in divergence.audit(docs, least_documents=1, ranks=3).collect()} == divergences(rows, 1, 3)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_divergence_terms_of_chunks(monkeypatch):
    text = b"Ab, cd\x00ab-" * 50 + "É".encode() * 9
    whole = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 7)
    assert divergence.terms_of(text) == whole == Counter({b"ab": 100, b"cd": 50, "É".encode() * 9: 1})


def test_shares_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(999_999_999_999_999_998, 1_000_000_000_000_000_003), (0, 0)], "c long, n long")
    got = [r[0] for r in df.select(divergence._share(F.col("c"), F.col("n"))).collect()]
    assert got == [1 + 10**27 // 1_000_000_000_000_000_003, None]


def collocated(rows, least, ranks=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        found = []
        for p, a in candidates.items():
            inside = lambda g: any(g[i : i + len(p)] == p for i in range(len(g) - len(p) + 1))  # noqa: B023, E731
            if any(len(g) > len(p) and b >= a and inside(g) for g, b in candidates.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:ranks])}
    return out


@pytest.mark.parametrize("least, ranks", [(4, 2000), (15, 6)])
def test_collocations_against_brute_force(spark, rows, least, ranks):
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(6), least=least, ranks=ranks)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) > 10
    assert set(found) == collocated(rows, least, ranks)


def test_collocations_of_nothing(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, least=10**6).count() == 0
    assert collocations.collocations(docs.where("text is null")).count() == 0


def test_collocation_scores_are_exact(spark):
    cases = [(10**13, 10**14, 10**13 + 7, 10**13 + 3), (100, 10**14, 100, 100), (101, 999_999_999_999, 7001, 3)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    assert [r[0] for r in df.select(collocations.score(*map(F.col, "anlr"))).collect()] == [1000 * a * n // (x * y) for a, n, x, y in cases]


def test_phrases_pass_chunks_and_a_full_bit_map(spark, rows, monkeypatch):
    from collections import defaultdict as dd

    numbers = dd()
    numbers.default_factory = numbers.__len__
    numbers[collocations.BREAK]
    whole = np.concatenate(list(collocations._numbered("a b. C\td  e!f".encode(), numbers)))
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 2)
    assert np.concatenate(list(collocations._numbered("a b. C\td  e!f".encode(), numbers))).tolist() == whole.tolist()
    monkeypatch.setattr(collocations, "MAP_BITS", 6)  # nearly every bit is set: more rows, the same result
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=4)
    assert {tuple(r) for r in got.collect()} == collocated(rows, 4)


def vectors():
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = [unit(rng.normal(size=(700, 24)))]
    for size, spread in ((120, 0.05), (60, 0.09), (20, 0.02), (2, 0.01)):
        x.append(unit(unit(rng.normal(size=24)) + spread * rng.normal(size=(size, 24))))
    chain = [unit(rng.normal(size=24))]
    for _ in range(15):
        chain.append(unit(chain[-1] + 0.08 * rng.normal(size=24)))
    x.append(np.array(chain))
    x = np.concatenate(x).astype(np.float32)
    out = [(int(i) + 1, v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    out += [(5000 + i, x[3].tolist()) for i in range(200)] + [(6000, (x[3] * 2).tolist()), (6001, (-x[3]).tolist())]
    out += [out[5]] * 3  # a repeated row
    out += [(7000, None), (7001, [0.0] * 24), (7002, [float("nan")] * 24), (7003, [None, *[1.0] * 23]), (7004, [float("inf"), *[0.0] * 23]), (7005, []), (7006, [1.0, 0.0]), (7007, [2.0, 0.0]), (7008, [1.0, 0.0, 0.0]), (None, [0.5] * 24), (7009, [0.5] * 24), (7010, [3e38] * 24)]
    return out


def near(rows, least=0.9):
    links, good = [0] * len(rows), []
    for i, (_, e) in enumerate(rows):
        if e and all(v is not None and np.isfinite(v) for v in e) and any(e):
            v = np.array(e, np.float64) / max(map(abs, e))
            good.append((i, v / np.linalg.norm(v)))
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for a, (i, v) in enumerate(good):
        for j, w in good[a + 1 :]:
            if len(v) == len(w) and v @ w >= least:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least_id = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least_id[find(i)] = min(k, least_id.get(find(i), k))
    return Counter((k, links[i], least_id.get(find(i)), k == least_id.get(find(i))) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("shard, visitors", [(1500, 16384), (150, 100)])
def test_near_embeddings_against_brute_force(spark, monkeypatch, shard, visitors):
    monkeypatch.setattr(neargraph, "SHARD", shard)
    monkeypatch.setattr(neargraph, "VISITORS", visitors)
    rows = vectors()
    df = spark.createDataFrame([(i, e, "clash", 1) for i, e in rows], "vec_id long, embedding array<float>, node string, shard int")
    got = neargraph.near_duplicates(df.repartition(3), least_recall=1.0)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = Counter(tuple(r) for r in got.collect())
    want = near(rows)
    true, seen = (sum(r[1] * n for r, n in c.items()) for c in (want, found))
    assert sum((r[1] > 0) * n for r, n in want.items()) > 400
    assert seen >= 0.98 * true and sum((found & want).values()) >= 0.98 * len(rows)
    if shard == 1500:
        assert found == want


def test_near_embeddings_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in neargraph.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert neargraph.near_duplicates(df.limit(0)).count() == 0


def test_pruned_graph_is_reached_and_bounded():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 16)), rng.normal(size=16) + 0.01 * rng.normal(size=(300, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists, medoid = neargraph.build(x)
    assert neargraph._reached(lists, [medoid], np.zeros(len(x), bool)).all()
    assert max(map(len, lists)) <= neargraph.MAX_DEGREE + neargraph.LANDMARKS
    pruned = neargraph.robust_prune(x, np.array([0]), np.argsort(-(x @ x[0]))[None, :40])[0]
    kept = pruned[pruned >= 0]
    for i, a in enumerate(kept):  # no kept neighbour is far nearer to an earlier one than to the node
        for b in kept[i + 1 :]:
            assert neargraph.PRUNE**2 * (2 - 2 * x[a] @ x[b]) > 2 - 2 * x[0] @ x[b]


def test_audit_tells_missing_links(spark):
    rows = spark.createDataFrame([(i, e) for i, e in vectors() if e and len(e) == 24], "vec_id long, embedding array<float>")
    nodes = neargraph._nodes(rows)
    layouts = neargraph._layouts(nodes)
    found = neargraph._links(nodes, layouts, 4, 0.9)
    assert neargraph.audit(nodes, found) > 0.98
    assert neargraph.audit(nodes, found.where("node % 2 = 0")) < 0.8


def test_new_queries_are_registered():
    names = ["op11_collocations", "op12_embedding_near_dedup", "op13_source_divergence_audit"]
    assert set(names) <= set(queries.QUERIES) and set(names) <= set(queries.ORACLES)
