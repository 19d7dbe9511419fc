"""Token ids in blocks of interleaved static range asymmetric numeral systems (rANS).

One frequency table, counted over the whole corpus, is shared by all blocks. A
block is independent: it holds whole documents in order, their ids coded by
``LANES`` interleaved 64-bit states that share one stream of 32-bit words. Every
``CHECK_STEPS`` steps the block stores a checkpoint (all states, the place in
the stream and a CRC of the ids up to the next one), so a block's segments can
be decoded side by side, and a damaged segment is found.

Block layout (little-endian): ``HEAD``; the documents (id i8, ids u4); the
segments' word offsets (u4) and CRCs (u4); the segments' states (u8 x lanes);
the stream (u4); a CRC-32 of all that. Blocks are rows of a Parquet table
``part, block, n_tokens, payload``; parts follow one another in ascending
document order, and so do the blocks of a part. The shared table is a second
Parquet table ``symbol, freq``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.llm.base import bounded, byte_slices, discard, settle, shared_dir, text_or_empty
from loamline.llm.tokens import SLICE_BYTES, WORD_SLICE_BYTES, word_encoder, word_tokenizer_path

MAGIC = b"RANSBLK1"
HEAD = struct.Struct("<8sIIIIIII")  # magic, table CRC, documents, ids, lanes, steps between checkpoints, segments, words
LANES = 64
CHECK_STEPS = 256
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
BLOCK_TOKENS = LANES * CHECK_STEPS * 4
GROUP_BLOCKS = 64  # blocks encoded side by side
DECODE_BYTES = 3_000_000
PART_TOKENS = 1 << 22


class Table:
    """Frequencies scaled to ``2**SCALE_BITS``, every symbol that occurs at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        if int(self.freq.sum()) != 1 << SCALE_BITS:
            raise ValueError("frequencies do not add up to the scale")
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint16), self.freq.astype(np.int64))
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        scale = 1 << SCALE_BITS
        seen = np.flatnonzero(counts)
        if len(seen) > scale:
            raise ValueError("more symbols than the scale has slots")
        exact = counts[seen].astype(np.float64) * (scale / max(1, int(counts.sum())))
        freq = np.maximum(1, np.floor(exact)).astype(np.int64)
        order = np.argsort(-counts[seen], kind="stable")
        spare = scale - int(freq.sum())
        if spare > 0:
            freq[order[0]] += spare
        for i in order:  # rare symbols were raised to 1: the most frequent pay for it
            if spare >= 0:
                break
            take = min(-spare, max(0, int(freq[i]) - max(1, int(freq[i]) // 2)))
            freq[i] -= take
            spare += take
        out = np.zeros(len(counts), np.int64)
        out[seen] = freq
        return cls(out)


def encode_blocks(blocks: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], table: Table) -> list[bytes]:
    """Payloads of blocks ``(doc ids, ids of each document, ids)``, coded side by side."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i][2]))
    steps = [-(-len(blocks[i][2]) // LANES) for i in order]
    rows, most = len(order), max(steps, default=0)
    pad = int(table.freq.argmax())
    syms = np.full((rows, most * LANES), pad, np.uint16)
    for r, i in enumerate(order):
        syms[r, : len(blocks[i][2])] = blocks[i][2]
    syms = syms.reshape(rows, most, LANES)
    state = np.full((rows, LANES), LOW, np.uint64)
    room = most * LANES
    stream = np.empty((rows, room), np.uint32)
    at = np.full(rows, room, np.int64)
    marks: list[list[tuple[int, np.ndarray]]] = [[] for _ in order]
    bits = np.uint64(SCALE_BITS)
    active = 0
    for t in range(most - 1, -1, -1):
        while active < rows and steps[active] > t:
            active += 1
        s = syms[:active, t]
        f, x = table.freq[s], state[:active]
        full = x >= (f << np.uint64(43))
        count = full.sum(1)
        if count.any():
            at[:active] -= count
            place = (at[:active, None] + np.cumsum(full, 1) - 1)[full]
            row = np.repeat(np.arange(active), count)
            stream[row, place] = (x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:active] = (q << bits) + (x - q * f) + table.start[s]
        if t % CHECK_STEPS == 0:
            for r in range(active):
                marks[r].append((int(at[r]), state[r].copy()))
    out: list[bytes] = [b""] * rows
    for r, i in enumerate(order):
        docs, sizes, ids = blocks[i]
        segments = marks[r][::-1]
        begin = int(at[r])
        words = stream[r, begin:]
        raw = ids.astype("<u4")
        span = LANES * CHECK_STEPS
        body = b"".join(
            [
                HEAD.pack(MAGIC, table.crc, len(docs), len(ids), LANES, CHECK_STEPS, len(segments), len(words)),
                docs.astype("<i8").tobytes(),
                sizes.astype("<u4").tobytes(),
                np.array([p - begin for p, _ in segments], "<u4").tobytes(),
                np.array([zlib.crc32(raw[k * span : (k + 1) * span].tobytes()) for k in range(len(segments))], "<u4").tobytes(),
                *[x.astype("<u8").tobytes() for _, x in segments],
                words.astype("<u4").tobytes(),
            ]
        )
        out[i] = body + struct.pack("<I", zlib.crc32(body))
    return out


def decode_blocks(payloads: Sequence[bytes], table: Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of ``encode_blocks`` again; all segments of all payloads are decoded side by side.

    Raises ``ValueError`` on a wrong magic, table, checksum or segment.
    """
    parsed, states, places, words, lengths, base = [], [], [], [], [], 0
    for p in payloads:
        magic, crc, n_docs, n_ids, lanes, every, n_seg, n_words = HEAD.unpack_from(p)
        if magic != MAGIC or (lanes, every) != (LANES, CHECK_STEPS) or crc != table.crc:
            raise ValueError("not a block of this table")
        if struct.unpack_from("<I", p, len(p) - 4)[0] != zlib.crc32(memoryview(p)[:-4]):
            raise ValueError("a block's checksum differs")
        o = HEAD.size
        take = lambda kind, n: np.frombuffer(p, kind, n, o)  # noqa: B023, E731
        docs = take("<i8", n_docs)
        o += 8 * n_docs
        sizes = take("<u4", n_docs)
        o += 4 * n_docs
        offsets = take("<u4", n_seg)
        o += 4 * n_seg
        crcs = take("<u4", n_seg)
        o += 4 * n_seg
        states.append(take("<u8", n_seg * lanes).reshape(n_seg, lanes))
        o += 8 * n_seg * lanes
        words.append(take("<u4", n_words))
        places.append(offsets.astype(np.int64) + base)
        base += n_words
        span = lanes * every
        lengths += [min(every, -(-(n_ids - k * span) // lanes)) for k in range(n_seg)]
        parsed.append((docs, sizes, n_ids, crcs))
    if not lengths:
        return [(d, s, np.zeros(0, np.uint16)) for d, s, _, _ in parsed]
    steps = np.array(lengths)
    order = np.argsort(-steps, kind="stable")
    state = np.concatenate(states).astype(np.uint64)[order]
    place = np.concatenate(places)[order]
    stream = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
    out = np.zeros((len(steps), CHECK_STEPS, LANES), np.uint16)
    ahead = steps[order]
    mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for t in range(int(ahead[0])):
        n = int(np.searchsorted(-ahead, -t, side="left"))
        x = state[:n]
        slot = x & mask
        s = table.slots[slot]
        out[:n, t] = s
        x = table.freq[s] * (x >> bits) + slot - table.start[s]
        low = x < LOW
        count = low.sum(1)
        if count.any():
            got = stream[(place[:n, None] + np.cumsum(low, 1) - 1)[low]]
            x[low] = (x[low] << np.uint64(32)) | got
            place[:n] += count
        state[:n] = x
    back = np.empty_like(out)
    back[order] = out
    found, k = [], 0
    for docs, sizes, n_ids, crcs in parsed:
        ids = back[k : k + len(crcs)].reshape(-1)[:n_ids].copy()
        raw, span = ids.astype("<u4"), LANES * CHECK_STEPS
        for j, c in enumerate(crcs.tolist()):
            if zlib.crc32(raw[j * span : (j + 1) * span].tobytes()) != c:
                raise ValueError("a segment's checksum differs")
        k += len(crcs)
        found.append((docs, sizes, ids))
    return found


def tokenized(docs: DataFrame, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, tie, ids`` (little-endian unsigned 16-bit, ``end_id`` appended; ``tie`` is their CRC-32)."""
    path = path or word_tokenizer_path()
    end = end_id.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for b in (part for b in batches for part in byte_slices(b, 1, WORD_SLICE_BYTES)):
            raw, ends = encoder.encode(b.column(1))
            raw, at = raw.tobytes(), (2 * ends).tolist()
            ids = [raw[s:e] + end for s, e in zip([0, *at], at)]
            sizes = np.diff(ends, prepend=0) + 1
            tie = np.fromiter(map(zlib.crc32, ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(tie), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "tie", "ids"])

    source = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, tie long, ids binary")


def symbol_counts(tokens: DataFrame, size: int = 1 << 16) -> DataFrame:
    """``symbol, count`` over all ids; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                total += np.bincount(np.frombuffer(b"".join(b.column(0).slice(i, 512).to_pylist()), "<u2"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["symbol", "count"])

    return tokens.select("ids").mapInArrow(run, "symbol int, count long").groupBy("symbol").agg(F.sum("count").alias("count"))


def write_corpus(docs: DataFrame, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> str:
    """Encode every whole text, ascending by id, into files under ``path``; returns ``path``.

    Null texts count as empty (only the end id). Rows with a null id come
    first, as id -2**63. Rows with the same id keep one entry each, ordered by
    their token ids' CRC-32 and may lie in several parts. A document longer than
    a block makes one longer block. An empty table makes files without blocks.
    Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    tokens = settle(tokenized(docs, end_id, id_col, text_col, tokenizer), "tokens")
    # A bounded table: one row for each symbol of the vocabulary at most.
    rows = symbol_counts(tokens).collect()
    counts = np.zeros(1 << 16, np.int64)
    for r in rows:
        counts[r["symbol"]] = r["count"]
    if not rows:
        counts[end_id] = 1
    table = Table.of_counts(counts)
    seen = np.flatnonzero(table.freq)
    spark.createDataFrame([(int(s), int(table.freq[s])) for s in seen], "symbol int, freq int").coalesce(1).write.parquet(f"{path}/table")
    freq = table.freq.astype(np.int64)
    parts = max(1, -(-int(counts.sum()) // PART_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        part = TaskContext.get().partitionId()
        number = 0
        ready: list[tuple] = []
        docs: list[int] = []
        ids: list[bytes] = []
        held = 0

        def close():
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            ready.append((np.array(docs, np.int64), sizes, np.frombuffer(b"".join(ids), "<u2")))

        def flush():
            nonlocal number
            payloads = encode_blocks(ready, table)
            n = len(ready)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(number, number + n, dtype=np.int32)),
                    pa.array(np.array([len(x[2]) for x in ready], np.int64)),
                    pa.array(payloads, pa.binary()),
                ],
                names=["part", "block", "n_tokens", "payload"],
            )
            number += n
            ready.clear()
            return out

        for b in (part for b in batches for part in byte_slices(b, 1, SLICE_BYTES)):
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # Blocks side by side take the room of the longest: a long document is a block of its own, coded alone.
                long = len(x) // 2 >= BLOCK_TOKENS
                if long and docs:
                    close()
                    docs, ids, held = [], [], 0
                if long and ready:
                    yield flush()
                docs.append(-(1 << 63) if d is None else d)
                ids.append(x)
                held += len(x) // 2
                if held >= BLOCK_TOKENS:
                    close()
                    docs, ids, held = [], [], 0
                    if long or len(ready) >= GROUP_BLOCKS:
                        yield flush()
        if docs:
            close()
        if ready:
            yield flush()

    by = (F.col("doc_id").asc_nulls_first(), F.col("tie"))
    ordered = tokens.select("doc_id", "tie", "ids").repartitionByRange(parts, *by).sortWithinPartitions(*by, "ids").select("doc_id", "ids")
    ordered.mapInArrow(run, "part int, block int, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    discard(tokens)
    return path


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """The shared frequencies; at most one row for each symbol of the vocabulary."""
    freq = np.zeros(1 << 16, np.int64)
    for r in spark.read.parquet(f"{path}/table").collect():
        freq[r["symbol"]] = r["freq"]
    return freq


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` for each document in the files.

    ``start`` counts the ids of all documents before it; ``ids`` are
    little-endian unsigned 32-bit integers, and ``ids_crc32`` their CRC-32.
    Blocks are decoded wherever they lie; only the counts of blocks, not their
    ids, are shuffled.
    """
    freq = read_table(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for b in batches:
            for part in byte_slices(b, 2, DECODE_BYTES):
                docs, starts, sizes, crcs, raws, owner = [], [], [], [], [], []
                for k, (d, n, ids) in enumerate(decode_blocks(part.column(2).to_pylist(), table)):
                    raw = ids.astype("<u4").tobytes()
                    ends = np.cumsum(n.astype(np.int64))
                    at = ends - n
                    docs.append(d)
                    starts.append(at)
                    sizes.append(n.astype(np.int64))
                    owner.append(np.full(len(d), k))
                    each = [raw[4 * s : 4 * e] for s, e in zip(at.tolist(), ends.tolist())]
                    crcs += map(zlib.crc32, each)
                    raws += each
                if docs:
                    own = pa.array(np.concatenate(owner))
                    ids = np.concatenate(docs)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(own), part.column(1).take(own), pa.array(ids, mask=ids == -(1 << 63)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes)), pa.array(np.array(crcs, np.int64)), pa.array(raws, pa.binary())],
                        names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32", "ids"],
                    )

    decoded = blocks.select("part", "block", "payload").mapInArrow(run, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long, ids binary")
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file part
    parts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("part", "block", "n_tokens").join(parts, "part").select("part", "block", (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("block_start"))
    return decoded.join(offsets, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")
