"""Very long texts, definitions written out, and limits that hold for every input."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loamline.llm import packing, rans, secrets, sketches, tokens, toxicity

def _encode(text):
    import pyarrow as pa

    return tokens.word_encoder(tokens.word_tokenizer_path()).encode(pa.array([text]))[0].tolist()


LONG = "lorem ipsum dolor sit amet consectetur password=Zx81kQ9vTT adipiscing " * 20_000


def test_packing_is_never_above_best_fit_decreasing():
    rng = np.random.default_rng(9)
    for _ in range(200):
        capacity = int(rng.integers(20, 90))
        lengths = rng.choice(np.arange(1, capacity + 1), int(rng.integers(1, 20)))
        h = {int(l): int(n) for l, n in zip(lengths, rng.integers(1, 200, len(lengths)))}
        rows = packing.plan(h, capacity)
        assert max(r[3] + r[2] - r[1] for r in rows) <= packing.rounded([], h, capacity)[1]
        for l, n in h.items():
            assert sorted(k for r in rows if r[0] == l for k in range(r[1], r[2])) == list(range(n))


def test_pieces_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.word_tokenizer_path())
    texts = ["a <|endoftext|> b", "", None, "words of a text " * 1500, "Ünïcode, 日本 & co."]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["piece"]): r for r in packing.pack(docs).collect()}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            r = got.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))
    assert not got


def test_files_hold_a_long_document_beside_short_ones(spark, monkeypatch):
    seen, real = [], rans.encode_blocks
    rng = np.random.default_rng(1)
    big = " ".join(rng.choice(["the", "river", "bank", "today", "fox"], 300_000))
    docs = spark.createDataFrame([(i, "short text here") for i in range(300)] + [(150, big), (301, None)], "doc_id long, text string").coalesce(1)
    rows = rans.read_corpus(spark, rans.write_corpus(docs)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted([*range(300), 150, 301])
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows[:-1])]).tolist()
    encode = _encode
    assert max(r["n_tokens"] for r in rows) == len(encode(big)) + 1 == 300_001
    lengths = []
    monkeypatch.setattr(rans, "encode_blocks", lambda blocks, table: lengths.append([len(b[2]) for b in blocks]) or real(blocks, table))
    assert not seen and len(real([(np.array([1]), np.array([0]), np.zeros(0, np.uint16))], rans.Table.of_counts(np.bincount([3], minlength=1 << 16)))) == 1


def test_base_spans_equal_the_definition():
    rng = np.random.default_rng(2)
    parts = ["password=", "api_key: \"", "TOKEN' = '", "apikey", "AKIA", "ABCDEF1234567890QRST", "deadbeef" * 3, "0123456789abcdef01234567", " ", "é", ".", "secret:secret=", "Kk", "ſecret=abcdefg", "x" * 5]
    for _ in range(300):
        text = "".join(rng.choice(parts, int(rng.integers(1, 12))))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secrets.base_spans(text) == sorted(want), text


def test_secret_digest_and_long_texts(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "api_key=abcdef123")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    assert got[1]["n_assign"] == 20_000
    assert got[2]["base_sha256"] == hashlib.sha256(b"assign:0:17").hexdigest()


def test_obfuscation_is_found_in_linear_time():
    began = time.time()
    for text in ("!" * 1_000_000, "a!" * 500_000, "@" * 1_000_000, "a1" * 500_000, "*a" * 500_000):
        toxicity.features(text, toxicity.Lexicon({}))
    assert time.time() - began < 10
    assert toxicity.obfuscated("you m0ron !!1d1ot @sshole p*ss plain 2nd !!! x1") == ["m0ron", "@sshole", "p*ss"]


def test_features_of_a_known_text():
    x = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT!! you stupid 1d10t", toxicity.Lexicon({"stupid": 3.0}))))
    assert x["seed_hits"] == 2 and x["seed_density"] == pytest.approx(2 / 6) and x["learned_sum"] == 3.0 and x["learned_density"] == pytest.approx(0.5)
    assert x["near_share"] == 1.0 and x["nearest"] == 1.0 and x["second_person"] == pytest.approx(2 / 6) and x["exclamations"] == pytest.approx(2 / 6)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(4)
    raw = rng.integers(0, 30, 300) / 10
    y = (rng.random(300) < raw / 3).astype(float)
    knots, values = toxicity.isotonic(raw, y)
    fitted = np.interp(raw, knots, values)
    # Min-max formula over distinct raw scores.
    u = np.unique(raw)
    s, n = np.array([y[raw == v].sum() for v in u]), np.array([(raw == v).sum() for v in u])
    mean = lambda i, j: s[i : j + 1].sum() / n[i : j + 1].sum()
    want = {v: max(min(mean(i, j) for j in range(k, len(u))) for i in range(k + 1)) for k, v in enumerate(u)}
    assert np.allclose(fitted, [want[v] for v in raw])


def test_trees_learn_and_each_leaf_is_a_newton_step():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.fit_trees(x, y)
    assert ((trees.raw(x) > 0) == y).mean() > 0.97
    base = y.mean()
    at = np.zeros(len(x), int)
    for _ in range(toxicity.DEPTH):
        at = 2 * at + 1 + (x[np.arange(len(x)), trees.feature[0][at]] > trees.cut[0][at])
    for leaf in range(2**toxicity.DEPTH):
        of = at == leaf + 2**toxicity.DEPTH - 1
        step = toxicity.RATE * (y[of] - base).sum() / (of.sum() * base * (1 - base) + toxicity.L2)
        assert trees.leaf[0][leaf] == pytest.approx(step, abs=1e-9)


def _xxh(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else int(v).to_bytes(8, "little", signed=True), seed)
        seed_signed = seed - (1 << 64) if seed >> 63 else seed
    return seed_signed


def test_sketches_equal_the_definition(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "eps"], n)) for n in (0, 1, 4, 5, 6, 40, 900)] + [None, LONG[:40_000]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r for r in rows.select("i", sketches.sketch(F.col("t")).alias("s")).collect()}
    top = -(1 << 63) + (1 << 64) // sketches.FRACTION - 1
    for i, t in enumerate(texts):
        w = [_xxh([x.encode()]) for x in (t or "").lower().split()]
        all_ = [_xxh(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [_xxh(w)] if w else []
        assert got[i]["s"]["hashes"] == sorted({h for h in all_ if h <= top}) and got[i]["s"]["threshold"] == top


def test_edited_texts_wrap_around(spark):
    texts = {3: "abcdefg", 7: "xy", 20: "", 11: "é\U0001f642zz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in sketches.fingerprints_with_edits(docs).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        want = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_sections_equal_a_count_by_spans(spark):
    encode, sizes = tokens.byte_encoder(__import__("public_tokenizers").path(tokens.BYTE_TOKENIZER))
    texts = ["one line\ntwo\n\nünï  line\n", "no end", "\n\n\n", "a\n" * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in tokens.section_token_counts(docs, rule="first").collect()}
    for i, t in enumerate(texts):
        raw, at, want = t.encode(), 0, {}
        for n in sizes[np.array(encode(t))].tolist():
            section = raw[:at].count(b"\n")
            want[section] = want.get(section, 0) + 1
            at += n
        lines = t.count("\n") + (not t.endswith("\n"))
        assert {s: n for (d, s), n in got.items() if d == i} == {s: want.get(s, 0) for s in range(lines)}


def test_vectors_keep_their_size(spark):
    from loamline.llm import mtree

    rows = spark.createDataFrame([(50, [1e17, -0.3]), (51, [2.0, 0.0]), (52, [])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["v"] for r in mtree._packed(rows, "vec_id", "embedding").collect()} == {50: [256e17, -77.0], 51: [512.0, 0.0], 52: []}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_rows_with_nulls_and_clashing_names(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{sf}/documents.parquet")
    names = ("_keep", "_rows", "_place", "_bad_id", "_bad_lang", "_bad_mark", "mark", "node", "label", "score", "trusted", "shard")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], base.schema)
    docs = base.limit(50).unionAll(odd).select("*", *(F.lit(7).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.where("text is null and doc_id is null").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).where("doc_id is null").count() == 1
