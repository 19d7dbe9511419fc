"""Best-fit packing by a configuration linear program over the length histogram.

The program has one variable for each configuration (a multiset of lengths that
fits into a sequence) and one covering constraint for each length. Best-fit
decreasing gives its first solution. Multiplicative weights then price the
lengths: a weight falls exponentially with the share by which the round's
configurations cover its length; the pricing step is a knapsack by dynamic
programming over the capacity, on the weights alone, which gives the best
configuration of every length at once. Weights divided by the best knapsack
value are a dual solution, so every round also gives a lower bound. Where the
first solution is not within ``TOLERANCE`` of the best bound, the program over
the configurations found is finished by exchanging one configuration at a time
for the best priced one, and the knapsack adds configurations at the prices that
this gives, until value and bound meet. (Multiplicative weights alone stay 5 to
20 per cent above the bound on irregular histograms.)

The solution is rounded in several ways: its fractions are taken along their
running sum, or become whole copies from a least fraction on, or not at all;
what is left is placed best-fit decreasing. The plan of fewest sequences counts,
the program's first solution among them.

Only the histogram (at most one row for each length up to the capacity) reaches
the driver. The plan goes back as a table of rank intervals; its size depends
on the capacity, not on the corpus. Pieces get their ranks within a length by a
window that is split into buckets.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.base import bounded, byte_slices, settle, text_or_empty
from loamline.llm.tokens import WORD_SLICE_BYTES, word_encoder, word_tokenizer_path

CAPACITY = 2048
TOLERANCE = 0.001  # of the fractional value above its lower bound
ROUNDS = 20  # of multiplicative weights
RATE = 0.1
NEAR_BEST = 0.98  # of the best configuration's value: configurations that a round keeps
ROUND_UP = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)  # least fractions that become whole copies
WORK = 4_000_000_000  # exchanges times squared lengths, at most
BUCKET_ROWS = 250_000


Configuration = dict[int, int]  # copies of each length


@dataclass
class Solution:
    """Fractional ``copies`` of configurations that cover every length's pieces, and a lower bound of any solution's sum."""

    copies: list[tuple[Configuration, float]]
    bound: float

    @property
    def value(self) -> float:
        return sum(x for _, x in self.copies)


def knapsack(weight: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Most weight within each capacity, and the index of the length taken last there (-1: one less is as good)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = fitting[c]
        value = weight[:k] + best[c - lengths[:k]]
        j = int(value.argmax())
        if value[j] > best[c - 1]:
            best[c], took[c] = value[j], j
        else:
            best[c] = best[c - 1]
    return best, took


class _Program:
    """The covering program: its configurations as sparse columns over the index of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.lengths = np.array(sorted(histogram))
        self.need = np.array([histogram[l] for l in self.lengths.tolist()], float)
        self.capacity, self.bound = capacity, 0.0
        self.known: dict[tuple[tuple[int, int], ...], int] = {}
        self.at, self.item, self.count = [0], [], []

    def add(self, config: Configuration) -> bool:
        key = tuple(sorted(config.items()))
        if key in self.known:
            return False
        self.known[key] = len(self.known)
        self.item += [k for k, _ in key]
        self.count += [n for _, n in key]
        self.at.append(len(self.item))
        return True

    def price(self, weight: np.ndarray, least: float) -> tuple[float, bool]:
        """The best configuration's weight, and whether some of at least ``least`` of it, the best of their lengths, are new."""
        best, took = knapsack(weight, self.lengths, self.capacity)
        top = float(best[self.capacity])
        self.bound = max(self.bound, float((self.need * weight).sum()) / top)
        new = False
        for j in np.flatnonzero(weight + best[self.capacity - self.lengths] >= least * top).tolist():
            config, room = defaultdict(int, {j: 1}), self.capacity - int(self.lengths[j])
            while room > 0:
                k = int(took[room])
                if k < 0:
                    room -= 1
                    continue
                config[k] += 1
                room -= int(self.lengths[k])
            new |= self.add(config)
        return top, new

    def weigh(self) -> None:
        """Rounds of multiplicative weights, from the lengths' shares of a sequence."""
        weight = self.lengths / self.capacity
        for _ in range(ROUNDS):
            first = self.at[-1]
            if not self.price(weight, NEAR_BEST)[1]:
                return
            covered = np.bincount(self.item[first:], self.count[first:], len(self.lengths)) / self.need
            weight = weight * np.exp(-RATE * np.clip(covered / covered.mean() - 1, -1, 1))

    def finish(self, start: list[tuple[Configuration, float]]) -> list[tuple[Configuration, float]]:
        """Exchange configurations until the value is within ``TOLERANCE`` of the bound, or ``WORK`` is done.

        The first basis has for each length, from the longest, a configuration
        of ``start`` that it leads, or a column for what is covered too much.
        """
        m = len(self.lengths)
        need = self.need * (1 + 1e-9 * np.arange(1, m + 1) / m)  # no ties
        leads: dict[int, tuple[float, Configuration]] = {}
        for config, x in start:
            if x > leads.get(max(config), (0.0, {}))[0]:
                leads[max(config)] = (x, config)
        basis, columns, left = [], np.zeros((m, m)), need.copy()
        for j in range(m - 1, -1, -1):
            if left[j] > 0:
                config = leads[j][1] if j in leads else {j: self.capacity // int(self.lengths[j])}
                self.add(config)
                basis.append(config)
                times = left[j] / config[j]
                for k, n in config.items():
                    columns[k, m - 1 - j] = n
                    left[k] -= n * times
            else:
                basis.append(None)
                columns[j, m - 1 - j] = -1
        inverse = np.linalg.inv(columns)
        for _ in range(WORK // (m * m)):
            amount = inverse @ need
            paid = np.array([c is not None for c in basis], float)
            price = paid @ inverse
            low = int(price.argmin())
            if price[low] < -1e-9:
                column, entering = np.zeros(m), None
                column[low] = -1
            else:
                value = np.add.reduceat(np.array(self.count) * price[self.item], self.at[:-1])
                k = int(value.argmax())
                if value[k] < 1 + 1e-7:
                    top, new = self.price(np.maximum(price, 0), 0.995)
                    if top < 1 + 1e-7 or not new or paid @ amount <= self.bound * (1 + TOLERANCE):
                        break
                    continue
                part = slice(self.at[k], self.at[k + 1])
                column, entering = np.zeros(m), dict(zip(self.item[part], self.count[part]))
                column[self.item[part]] = self.count[part]
            step = inverse @ column
            limits = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
            out = int(limits.argmin())
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
            basis[out] = entering
        amount = inverse @ need
        return [(c, float(x)) for c, x in zip(basis, amount) if c is not None and x > 1e-12]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Solution:
    """The configuration program of ``histogram`` (pieces of each length)."""
    if not histogram:
        return Solution([], 0.0)
    program = _Program(histogram, capacity)
    index = {l: j for j, l in enumerate(program.lengths.tolist())}
    start = [({index[l]: n for l, n in c.items()}, float(x)) for c, x in configurations(rounded([], histogram, capacity)[0])]
    program.weigh()
    copies = start
    if sum(x for _, x in start) > program.bound * (1 + TOLERANCE):
        copies = min(start, program.finish(start), key=lambda found: sum(x for _, x in found))
    return Solution([({int(program.lengths[j]): n for j, n in c.items()}, x) for c, x in copies], program.bound)


def configurations(rows: list[tuple[int, int, int, int, int]]) -> list[tuple[Configuration, int]]:
    """The configurations of a plan's rows and their copies: runs of sequences that the same rows reach."""
    change: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for length, first_rank, end_rank, first, _ in rows:
        change[first][length] += 1
        change[first + end_rank - first_rank][length] -= 1
    found: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    held: dict[int, int] = {}
    edges = sorted(change)
    for at, following in zip(edges, edges[1:]):
        for length, n in change[at].items():
            held[length] = held.get(length, 0) + n
            if not held[length]:
                del held[length]
        if held:
            found[tuple(sorted(held.items()))] += following - at
    return [(dict(c), n) for c, n in found.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows ``length, first rank, end rank, first sequence, offset`` that place every rank once.

    Rank r of a row goes to sequence ``first sequence + r - first rank``.
    """
    need = {l: n for l, n in histogram.items() if n > 0}
    copies = solve(need, capacity).copies
    plans = [rounded(copies, need, capacity)]
    for up in ROUND_UP:
        plans.append(rounded([(c, float(int(x + 1 - up + 1e-9))) for c, x in copies], need, capacity))
    plans.append(rounded([], need, capacity))  # the program's first solution, which is whole
    return min(plans, key=lambda found: found[1])[0]


def rounded(configurations: list[tuple[dict[int, int], float]], histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The rows of ``plan`` from whole copies of ``configurations`` and best-fit decreasing for the rest, and their number of sequences."""
    left = dict(histogram)
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> runs of sequences (first, count)
    rooms: list[int] = []
    sequences = 0

    def give(room: int, first: int, count: int) -> None:
        if room and count:
            if not free[room]:
                insort(rooms, room)
            free[room].append((first, count))

    def place(l: int, first: int, count: int, offset: int) -> None:
        rows.append((l, used[l], used[l] + count, first, offset))
        used[l] += count
        left[l] -= count

    running = 0.0
    for config, x in sorted(configurations, key=lambda c: (-c[1], sorted(c[0].items()))):
        copies = int(running + x + 1e-9) - int(running + 1e-9)
        running += x
        items = [l for l, a in sorted(config.items(), reverse=True) for _ in range(a)]
        copies = min([copies, *(left[l] // config[l] for l in config)])
        if copies <= 0:
            continue
        offset = 0
        for l in items:
            place(l, sequences, copies, offset)
            offset += l
        give(capacity - offset, sequences, copies)
        sequences += copies
    for l in sorted(left, reverse=True):
        while left[l]:
            i = bisect_left(rooms, l)
            if i < len(rooms):
                room = rooms[i]
                first, count = free[room].pop()
                if not free[room]:
                    rooms.pop(i)
                n = min(count, left[l])
                place(l, first, n, capacity - room)
                give(room - l, first, n)
                give(room, first + n, count - n)
            else:
                fit = capacity // l
                full, rest = divmod(left[l], fit)
                for copies, each in ((full, fit), (1 if rest else 0, rest)):
                    for k in range(each if copies else 0):
                        place(l, sequences, copies, k * l)
                    give(capacity - each * l, sequences, copies)
                    sequences += copies
    return rows, sequences


def pieces(docs: DataFrame, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``; only documents over the capacity have several."""
    path = tokenizer or word_tokenizer_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for b in (part for b in batches for part in byte_slices(b, 1, WORD_SLICE_BYTES)):
            row, piece, start, length, crc = [], [], [], [], []
            ids, ends = encoder.encode(b.column(1))
            ids, at = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            for i, (first, last) in enumerate(zip([0, *at], at)):
                raw = ids[first:last] + end
                for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[s : s + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Pieces with their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are documents of the end id alone. Rows with a null or
    repeated doc_id are packed like any other. Full pieces fill a sequence of
    their own; an empty table packs into none. Other columns are not read.
    """
    cut = settle(pieces(docs, end_id, capacity, id_col, text_col, tokenizer), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    buckets = max(16, -(-sum(histogram.values()) // BUCKET_ROWS))
    slots = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)

    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    dealt = cut.withColumn("bucket", bucket)
    sizes = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("inside", F.row_number().over(order) - 1).join(bases, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("inside")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
        for b in batches:
            length = b.column(3).to_numpy(zero_copy_only=False)
            rank = b.column(5).to_numpy(zero_copy_only=False)
            row = np.empty(len(length), np.int64)
            for l in np.unique(length).tolist():
                of = np.flatnonzero(length == l)
                lo, hi = first_of[l], first_of[l + 1]
                row[of] = lo + np.searchsorted(slots[lo:hi, 1], rank[of], side="right") - 1
            found = slots[row]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
