"""Quality: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts trigrams of words over all trusted texts. A word is a run
between white space, as written; a Han or kana character is a word of its own.
Words are 16-bit symbols (a hash), so the symbols are a closed set, a trigram
fills 48 bits exactly and probabilities add up to one. Trigrams have raw counts,
lower orders continuation counts (how many different symbols precede); each
order has three discounts, estimated from its counts of counts.

A text must not be scored by a model that has counted it, or all unlabelled text
would look strange beside trusted text. So texts are halved by hash, and each
half is scored by the model of the other half's trusted texts. The bounds come
from trusted texts scored in this way: held-out ones.

Everything is one sharded count join. Tasks encode their documents in batches
and send each shard the batch's trigrams there, sorted and packed, once. A shard
owns middle words with all their trigrams. It therefore counts the contexts
(first, middle), the pairs (middle, last) and the trigrams of trusted documents
by itself; only the counts of single words are exchanged, a table as large as
the set of symbols. The shard then scores all documents' trigrams, and their
sums return to the batch. What is shuffled grows with the text.

A middle word too frequent for one shard is split by a class of the word before
it. Each class then sends its pairs of that word, the sums over the classes come
back to them, and the model is the same as with one shard.

A document is rejected when its perplexity is above a high quantile of the
held-out trusted texts in its language.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.base import BROADCAST_ROWS, bounded, byte_slices, fresh, settle, small, text_or_empty

SYMBOLS = 1 << 16  # 0 stands before a text's first word
SIZE = SYMBOLS - 1
BATCH_WORDS = 1_000_000
BATCH_TEXTS = 1 << 16
SLICE_BYTES = 4_000_000
SHARD_TRIGRAMS = 4_000_000
LEAST_SHARDS = 24
WORD_CACHE = 400_000  # words of at most CACHED_LETTERS
CACHED_LETTERS = 40
FIXED_POINT = 1 << 12  # of log probabilities
HIGH = 0.998
LEVELS = 10_000  # of one unit of log perplexity, on which the quantiles are counted
SLACK = 0.01  # of log perplexity, beyond the quantile
SPREAD = 6.0  # room for short texts, whose means vary more: this over the square root of the words
MARGIN = 0.5  # room for languages with few trusted texts: this over the square root of the texts

_CHARACTER_WORDS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def words(text: str) -> list[str]:
    if not text.isascii() and _CHARACTER_WORDS.search(text):
        text = _CHARACTER_WORDS.sub(r" \g<0> ", text)
    return text.split()


class _Symbols(dict):
    """Word -> symbol, 1 to SIZE; keeps a bounded number of short words."""

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % SIZE + 1
        if len(word) <= CACHED_LETTERS:
            if len(self) >= WORD_CACHE:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), np.uint16, len(found))


def trigrams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``middle, first, last`` (16 bits each) of the trigrams that end in each but a text's first word, and each text's number of them."""
    sizes = np.fromiter((max(0, len(t) - 1) for t in texts), np.int64, len(texts))
    if not sizes.sum():
        return np.zeros(0, np.uint64), sizes
    x = np.concatenate(texts).astype(np.uint64)
    start = np.zeros(len(x), bool)
    start[(np.cumsum([len(t) for t in texts]) - [len(t) for t in texts])[[len(t) > 0 for t in texts]]] = True
    middle, first = np.zeros_like(x), np.zeros_like(x)
    middle[1:], first[2:] = x[:-1], x[:-2]
    first[1:][start[:-1]] = 0
    return ((middle << np.uint64(32)) | (first << np.uint64(16)) | x)[~start], sizes


def _planes(x: np.ndarray) -> bytes:
    """``x`` byte plane by byte plane, each compressed."""
    z = zstandard.ZstdCompressor(level=1)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize)
    parts = [z.compress(np.ascontiguousarray(planes[:, j]).tobytes()) for j in range(x.itemsize)]
    return struct.pack(f"<I{len(parts)}I", len(x), *map(len, parts)) + b"".join(parts)


def _from_planes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    n, *sizes = struct.unpack_from(f"<I{width}I", raw)
    out, at = np.empty((n, width), np.uint8), 4 + 4 * width
    z = zstandard.ZstdDecompressor()
    for j, size in enumerate(sizes):
        out[:, j] = np.frombuffer(z.decompress(raw[at : at + size], max_output_size=n), np.uint8)
        at += size
    return out.reshape(-1).view(kind)


class Shards:
    """Which shard owns a middle word, or a class of first words before it."""

    def __init__(self, counts: np.ndarray, shard_trigrams: int = SHARD_TRIGRAMS, least: int = LEAST_SHARDS):
        total = int(counts.sum())
        self.n = max(least, -(-2 * total // shard_trigrams))
        self.parts = np.clip(-(-2 * counts // shard_trigrams), 1, self.n).astype(np.int64)
        self.first = np.zeros(SYMBOLS, np.int64)
        loads = [(0, s) for s in range(self.n)]
        for b in np.argsort(-counts, kind="stable").tolist():
            if self.parts[b] > 1:  # its classes go to consecutive shards
                self.first[b] = loads[0][1]
                heapq.heapify(loads := [(load + (int(counts[b]) // int(self.parts[b]) if (s - self.first[b]) % self.n < self.parts[b] else 0), s) for load, s in loads])
            else:
                load, s = loads[0]
                self.first[b] = s
                heapq.heapreplace(loads, (load + int(counts[b]), s))

    def of(self, keys: np.ndarray) -> np.ndarray:
        middle = (keys >> np.uint64(32)).astype(np.int64)
        first = (keys >> np.uint64(16)).astype(np.int64) & 0xFFFF
        return (self.first[middle] + (first * 40503 >> 4) % self.parts[middle]) % self.n


def middle_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each symbol is a middle word; one row for each symbol at most reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, total = _Symbols(), np.zeros(SYMBOLS, np.int64)
        for b in batches:
            for part in byte_slices(b, 0, SLICE_BYTES):
                total += np.bincount(np.concatenate([symbols.of(t)[:-1] for t in part.column(0).to_pylist()]), minlength=SYMBOLS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["symbol", "n"])

    out = np.zeros(SYMBOLS, np.int64)
    for r in bounded(docs).select(text_or_empty(text_col).alias("text")).mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        out[r["symbol"]] = r["n"]
    return out


class _Batch:
    """Rows of some documents; equal texts share a slot."""

    def __init__(self):
        self.slots: dict[str, int] = {}
        self.texts: list[np.ndarray] = []
        self.half: list[int] = []
        self.trusted: list[int] = []
        self.rows: list[tuple] = []
        self.words = 0

    def add(self, text: str, mark: int, trusted: bool, symbols: _Symbols) -> int:
        slot = self.slots.get(text)
        if slot is None:
            slot = self.slots[text] = len(self.texts)
            self.texts.append(symbols.of(text))
            self.half.append(mark & 1)
            self.trusted.append(0)
            self.words += len(self.texts[-1])
        self.trusted[slot] += trusted
        return slot

    def packed(self, shards: Shards) -> list[tuple[int, bytes]]:
        """For each shard with trigrams of the batch: their sorted keys with slots, as packed differences, and how often each occurs in its text."""
        keys, sizes = trigrams(self.texts)
        x = np.sort((keys << np.uint64(16)) | np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes))
        change = np.ones(len(x), bool)
        change[1:] = x[1:] != x[:-1]
        at = np.flatnonzero(change)
        x, times = x[at], np.diff(np.append(at, len(x))).astype(np.uint32)
        shard = shards.of(x >> np.uint64(16))
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards.n + 1))
        out = []
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[s] : cuts[s + 1]]
            keys = _planes(np.diff(x[mine], prepend=np.uint64(0)))
            out.append((s, struct.pack("<I", len(keys)) + keys + _planes(times[mine])))
        return out


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram keys, slots and times."""
    n = struct.unpack_from("<I", raw)[0]
    x = np.cumsum(_from_planes(raw[4 : 4 + n], np.uint64), dtype=np.uint64)
    return x >> np.uint64(16), (x & np.uint64(0xFFFF)).astype(np.int64), _from_planes(raw[4 + n :], np.uint32).astype(np.int64)


def _counted(data: list[bytes], info: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For either half the trusted texts' trigrams, ascending, and their counts."""
    keys, times = ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    for d, i in zip(data, info):
        if d:
            x, slot, n = _unpacked(d)
            code = _from_planes(i, np.uint32).astype(np.int64)[slot]
            n = n * (code >> 1)
            for h in (0, 1):
                mine = (n > 0) & ((code & 1) == h)
                keys[h].append(x[mine])
                times[h].append(n[mine])
    out = []
    for h in (0, 1):
        x, n = np.concatenate(keys[h]), np.concatenate(times[h])
        order = np.argsort(x, kind="stable")
        out.append(_runs(x[order], n[order]))
    return out


def _runs(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ascending ``x`` and the sums of their ``n``."""
    if not len(x):
        return x, n
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[at], np.add.reduceat(n, at)


def _pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``middle, last`` of distinct trigrams, ascending, and how many first words each has."""
    x = np.sort(((keys >> np.uint64(32)) << np.uint64(16)) | (keys & np.uint64(0xFFFF)))
    return _runs(x, np.ones(len(x), np.int64))


def _counts_packed(x: np.ndarray, n: np.ndarray) -> bytes:
    keys = _planes(np.diff(x, prepend=np.uint64(0)))
    return struct.pack("<I", len(keys)) + keys + _planes(n)


def _counts_added(packed: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the sums of their counts, over what ``_counts_packed`` has packed."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for raw in packed:
        at = 4 + struct.unpack_from("<I", raw)[0]
        keys.append(np.cumsum(_from_planes(raw[4:at], np.uint64), dtype=np.uint64))
        counts.append(_from_planes(raw[at:], np.int64))
    x, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(x, kind="stable")
    return _runs(x[order], n[order])


def _first_four(counts: np.ndarray) -> list[int]:
    return [int((counts == c).sum()) for c in (1, 2, 3, 4)]


def discounts(n: list[int]) -> np.ndarray:
    """The discounts of counts 1, 2 and 3 or more, from the numbers of n-grams that occur once to four times."""
    if not all(n):  # too few to estimate from
        return np.array([0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return np.array([min(max(d, 0.05), c - 0.05) for c, d in enumerate(raw, 1)])


def _discounted(context: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``own`` share of each n-gram, place of its context, distinct contexts (``context`` is ascending) and the share each leaves to the lower order."""
    taken = d[np.minimum(counts, 3) - 1]
    contexts, total = _runs(context, counts)
    left = _runs(context, taken)[1] / total
    place = np.searchsorted(contexts, context)
    return np.maximum(counts - taken, 0) / total[place], place, contexts, left


def _find(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``x`` in ascending ``at``, and whether they are there."""
    if not len(at):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(at, x), len(at) - 1)
    return i, at[i] == x


class Model:
    """One half's model as far as a shard needs it: its trigrams, and the counts of counts and of single words of all shards."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, single: np.ndarray, ones3: list[int], ones2: list[int], shared: tuple[np.ndarray, np.ndarray] | None = None):
        total = int(single.sum())
        d = discounts(_first_four(single[single > 0]))
        taken = np.where(single > 0, d[np.clip(single, 1, 3) - 1], 0)
        self.p1 = (np.maximum(single - taken, 0) + (taken.sum() if total else 1) / SIZE) / max(1, total)
        self.pairs, n = _pairs(keys)
        if shared is not None:  # pairs of middle words that several shards count together
            mine = ~np.isin(self.pairs >> np.uint64(16), shared[0] >> np.uint64(16))
            self.pairs, n = np.concatenate([self.pairs[mine], shared[0]]), np.concatenate([n[mine], shared[1]])
            order = np.argsort(self.pairs)
            self.pairs, n = self.pairs[order], n[order]
        own, place, self.middles, self.left2 = _discounted(self.pairs >> np.uint64(16), n, discounts(ones2))
        self.p2 = own + self.left2[place] * self.p1[(self.pairs & np.uint64(0xFFFF)).astype(np.int64)]
        self.keys = keys
        own, place, self.contexts, self.left3 = _discounted(keys >> np.uint64(16), counts, discounts(ones3))
        pair = ((keys >> np.uint64(32)) << np.uint64(16)) | (keys & np.uint64(0xFFFF))
        self.p3 = own + self.left3[place] * self.p2[_find(pair, self.pairs)[0]] if len(keys) else own

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of each trigram's last word, given the two before."""
        i, seen = _find(keys, self.keys)
        out = np.empty(len(keys))
        out[seen] = self.p3[i[seen]]
        x = keys[~seen]
        p = self.p1[(x & np.uint64(0xFFFF)).astype(np.int64)]
        middle = x >> np.uint64(32)
        i, known = _find(middle, self.middles)
        p[known] *= self.left2[i[known]]
        i, known = _find((middle << np.uint64(16)) | (x & np.uint64(0xFFFF)), self.pairs)
        p[known] = self.p2[i[known]]
        i, known = _find(x >> np.uint64(16), self.contexts)
        p[known] *= self.left3[i[known]]
        out[~seen] = p
        return np.log(out)


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", shard_trigrams: int = SHARD_TRIGRAMS) -> DataFrame:
    """``doc_id, lang, mark, n_words, trusted, perplexity``, one row for each row of ``docs``.

    ``trusted`` has the distinct ``doc_id`` of the trusted rows. The perplexity
    is that of a word, over all words but the first; texts of fewer words have a
    null one (null texts count as empty). ``mark`` is a hash of the text.
    Rows of ``docs`` must come in a repeatable order, as from files, since
    batches are numbered by partition; settle other inputs first.
    """
    shards = Shards(middle_counts(docs, text_col), shard_trigrams)
    ids = trusted.select(F.col("doc_id").alias("_trusted"))
    source = bounded(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_or_empty(text_col)).alias("mark"), text_or_empty(text_col).alias("text")
    )
    few = ids.count() <= BROADCAST_ROWS
    source = source.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_trusted"), "left").select("doc_id", "lang", "mark", "text", F.col("_trusted").isNotNull().alias("trusted"))
    if not few:  # rows come out of a shuffle in any order: a task that is run again must fill its batches as before
        source = bounded(settle(source, "marked"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, batch, number = _Symbols(), _Batch(), TaskContext.get().partitionId() << 32

        def close():
            info = _planes(np.array(batch.trusted, np.uint32) * np.uint32(2) + np.array(batch.half, np.uint32))
            ids, langs, marks, slots, flags = zip(*batch.rows)
            slots = np.array(slots, np.int64)
            n_words = np.array([len(t) for t in batch.texts], np.int64)[slots]
            rows = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(marks, pa.int64()), pa.array(slots), pa.array(n_words), pa.array(flags, pa.bool_())], names=["doc_id", "lang", "mark", "slot", "n_words", "trusted"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(rows)
            # The rows travel with one of the shards and come back with its sums.
            home = number % shards.n
            sent = [(home, sink.getvalue().to_pybytes(), b""), *((s, None, data) for s, data in batch.packed(shards))]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in sent], pa.int32()), pa.array([number] * len(sent), pa.int64()), pa.array([r for _, r, _ in sent], pa.binary()), pa.array([info] * len(sent), pa.binary()), pa.array([d for _, _, d in sent], pa.binary())], names=["shard", "batch", "rows", "info", "data"])

        for b in batches:
            for part in byte_slices(b, 3, SLICE_BYTES):
                for doc_id, lang, mark, text, flag in zip(*(c.to_pylist() for c in part.columns)):
                    batch.rows.append((doc_id, lang, mark, batch.add(text, mark, flag, symbols), flag))
                    if batch.words >= BATCH_WORDS or len(batch.texts) >= BATCH_TEXTS or len(batch.rows) >= 4 * BATCH_TEXTS:
                        yield close()
                        batch, number = _Batch(), number + 1
        if batch.rows:
            yield close()

    shipped = source.mapInArrow(ship, "shard int, batch long, rows binary, info binary, data binary").repartition(shards.n, "shard")
    ranges = 16 * -(-shards.n // 256)
    width = -(-(SYMBOLS + 8) // ranges)

    split = shards.parts > 1

    def ranged(pairs: np.ndarray, firsts: np.ndarray, ones3: list[int]) -> list[bytes]:
        # Single words' continuation counts, then the numbers of trigrams and pairs that occur once to four times.
        vector = np.concatenate([np.bincount((pairs & np.uint64(0xFFFF)).astype(np.int64), minlength=SYMBOLS), ones3, _first_four(firsts)]).astype(np.int64)
        return [_planes(vector[r * width : (r + 1) * width]) for r in range(ranges)]

    def tally(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        # Part -1 - m: this shard's pairs of the split middle word m.
        out = []
        for h, (x, n) in enumerate(_counted(sent["data"], sent["info"])):
            pairs, firsts = _pairs(x)
            middle = (pairs >> np.uint64(16)).astype(np.int64)
            own = ~split[middle]
            out += [(h, r, data) for r, data in enumerate(ranged(pairs[own], firsts[own], _first_four(n)))]
            out += [(h, -1 - m, _counts_packed(pairs[middle == m], firsts[middle == m])) for m in np.unique(middle[~own]).tolist()]
        return pd.DataFrame(out, columns=["half", "part", "data"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        half, part = key
        if part >= 0:
            return pd.DataFrame({"half": [half], "part": [part], "data": [_planes(sum(_from_planes(x, np.int64) for x in rows["data"]))]})
        pairs, firsts = _counts_added(rows["data"])
        out = [(half, part, _counts_packed(pairs, firsts)), *((half, r, data) for r, data in enumerate(ranged(pairs, firsts, [0] * 4)))]
        return pd.DataFrame(out, columns=["half", "part", "data"])

    def finished(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        half, part = key
        if part >= 0:
            return add(key, rows).assign(shards=[list(range(shards.n))])
        first, parts = int(shards.first[-1 - part]), int(shards.parts[-1 - part])
        return rows[["half", "part", "data"]].assign(shards=[sorted({(first + j) % shards.n for j in range(parts)})])

    form = "half int, part int, data binary"
    tallied = shipped.groupBy("shard").applyInPandas(tally, form)
    total = tallied.groupBy("half", "part").applyInPandas(add, form)
    if split.any():  # the sums of split words' pairs enter the totals
        total = total.groupBy("half", "part").applyInPandas(finished, f"{form}, shards array<int>")
    else:
        total = total.withColumn("shards", F.sequence(F.lit(0), F.lit(shards.n - 1)))
    known = total.select(F.explode("shards").alias("shard"), "half", "part", F.col("data").alias("total"))

    def score(key: tuple, sent: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        models = []
        for h, (x, n) in enumerate(_counted(sent["data"], sent["info"])):
            own = known[known["half"] == h].sort_values("part")
            vector = np.concatenate([np.zeros(0, np.int64), *(_from_planes(d, np.int64) for d in own[own["part"] >= 0]["total"])])
            shared = _counts_added(own[own["part"] < 0]["total"])
            models.append(Model(x, n, vector[:SYMBOLS], vector[SYMBOLS : SYMBOLS + 4].tolist(), vector[SYMBOLS + 4 :].tolist(), shared))
        sums: list[bytes | None] = []
        for data, info in zip(sent["data"], sent["info"]):
            if not data:
                sums.append(None)
                continue
            x, slot, n = _unpacked(data)
            code = _from_planes(info, np.uint32)
            half, out = (code & 1)[slot], np.zeros(len(code))
            for h in (0, 1):
                mine = half == h
                # Whole numbers, so that sums do not depend on how trigrams are dealt.
                out += np.bincount(slot[mine], n[mine] * np.round(models[1 - h].logs(x[mine]) * FIXED_POINT), len(code))
            sums.append(_planes(out.astype(np.int64)))
        return pd.DataFrame({"batch": sent["batch"], "rows": sent["rows"], "data": sums})

    scored = shipped.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(score, "batch long, rows binary, data binary")

    def finish(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = sum((_from_planes(x, np.int64) for x in parts["data"].dropna()), np.zeros(1, np.int64))
        rows = pa.ipc.open_stream(parts["rows"].dropna().iloc[0]).read_all()
        slot, n = rows["slot"].to_numpy(), rows["n_words"].to_numpy()
        logs = (total if len(total) > 1 else np.full(slot.max() + 1, total[0]))[slot] / FIXED_POINT
        perplexity = np.exp(-logs / np.maximum(1, n - 1))
        out = rows.drop_columns("slot").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        out["perplexity"] = pd.array(np.where(n > 1, perplexity, np.nan), dtype="Float64")
        out.loc[n < 2, "perplexity"] = pd.NA
        return out

    return scored.groupBy("batch").applyInPandas(finish, "doc_id long, lang string, mark long, n_words long, trusted boolean, perplexity double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents labelled good; of contradicting labels the lower counts."""
    known = labels.where("doc_id is not null and quality is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def assess(docs: DataFrame, labels: DataFrame, high: float = HIGH, slack: float = SLACK, spread: float = SPREAD, margin: float = MARGIN) -> DataFrame:
    """``doc_id, lang, mark, perplexity, most, accepted``, one row for each row of ``docs``.

    Trusted text is that of the rows labelled good. The mean over few words
    varies more, so the log perplexity is first lowered by ``spread /
    sqrt(words)``. Of that, the bound is the ``high`` quantile of the language's
    trusted texts (a null language is one of its own), plus ``slack``, plus
    ``margin / sqrt(trusted texts)``. ``most`` is the bound as a perplexity. A
    language without any trusted text has no bound: its documents are accepted,
    as are texts of fewer than two words. An empty table gives no rows.
    """
    scored = settle(perplexities(docs, trusted_ids(labels)), "perplexity")
    room = F.lit(spread) / F.sqrt(F.greatest("n_words", F.lit(1)))
    # Counted on a grid: the same bound whatever the order in which tasks end.
    level = F.floor((F.log("perplexity") - room) * LEVELS)
    levels = scored.where("trusted and perplexity is not null").groupBy("lang", level.alias("level")).agg(F.count("*").alias("n"))
    each = Window.partitionBy("lang")
    levels = levels.select("lang", "level", F.sum("n").over(each.orderBy("level")).alias("below"), F.sum("n").over(each).alias("n")).where(F.col("below") >= F.ceil(F.col("n") * high))
    limits = levels.groupBy("lang").agg(((F.min("level") + 1) / LEVELS).alias("q"), F.first("n").alias("n"))
    limits = limits.select(F.col("lang").alias("_lang"), (F.col("q") + slack + margin / F.sqrt("n")).alias("high"))
    scored = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("most", F.exp(F.col("high") + room))
    return scored.select("doc_id", "lang", "mark", "perplexity", "most", F.coalesce(F.col("perplexity") <= F.col("most"), F.lit(True)).cast("int").alias("accepted"))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``assess`` accepts.

    Rows of equal id, language and text share their verdict, so rejected rows are
    found again by id, language and text hash.
    """
    assessed = assess(docs, labels).where("accepted = 0").select("doc_id", "lang", "mark").distinct()
    names = [fresh(docs, n) for n in ("_bad_id", "_bad_lang", "_bad_mark")]
    bad = settle(assessed.toDF(*names), "rejected")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & F.col("lang").cast("string").eqNullSafe(F.col(names[1])) & (F.xxhash64(text_or_empty()) == F.col(names[2]))
    return docs.join(small(bad), same, "left_anti")
