"""SimHash near-duplicates by a byte-position inverted index with count filtering.

``EXACT``: 64-bit fingerprints at four or fewer differing bits. They differ in
at most four of eight byte positions, so they agree on at least four: that is
the guaranteed minimum of matches.

One posting list for each (position, byte) would hold a 256th of all
fingerprints, and joining it with itself would be quadratic. The index keys are
therefore triples of positions with their three bytes. The twenty triples are a
Turan system: any four of the eight positions contain one of them, so a pair
with the guaranteed matches always meets in some list, and a list holds a
2**24th of the fingerprints on average.

``SIMILAR``: 256-bit fingerprints that propose pairs for a shingle similarity
(Jaccard) of 0.8 or more. Such pairs differ in about 39 bits, 62 or fewer nearly
always; that many bits guarantee no byte, so the index takes pairs of positions
within each 64-bit word, which 99 of 100 pairs at 0.8 share somewhere, and more
above. Texts of few shingles have noisy fingerprints; their pairs are proposed
by an exact prefix filter as well. ``near_copies`` verifies every proposed pair
on the shingles themselves.

Within a list, shared positional bytes are tallied for each pair, pairs under
the minimum are left out, and the rest are verified on all bits. A pair counts
in the first list only that it shares. A list writes a spanning forest of its
links, the nearest first, never all its pairs; ``near_copies`` then compares all
pairs that verified links have not brought together and writes a forest again.
Texts that such pairs connect are a group, which meets once, with its shingles,
and not in every list that they share. So a large group of texts that are nearly
but not alike costs comparisons, but no rows. Only where a group is so sparse
that its lists have far fewer pairs do its texts stay in them.
Lists longer than ``LIST_ROWS`` are dealt
out as pairs of blocks, so that one task never holds more than two blocks of a
hot list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.base import bounded, byte_slices, discard, fresh, settle, small, text_or_empty
from loamline.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
LIST_ROWS = 8192
LIST_SHINGLES = 1_000_000  # of all texts in a block of a list whose texts are compared
PORTION = 200_000  # pairs compared at once
ENTRY = 2000  # pairs of fingerprints that cost about as much as one more row with its shingles
PART_ROWS = 64  # of a group, which is dealt out in blocks of this size, but at most PARTS of them for this reason
PARTS = 32
SLICE_BYTES = 4_000_000
SIMILARITY = 0.8
SHORT = 50  # shingles; texts of up to SIMILARITY of this are linked through the prefix filter without loss


def _turan_triples() -> tuple[tuple[int, ...], ...]:
    """Triples inside a group, or with two members in one group and one in the next."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [t for g in groups for t in combinations(g, 3)]
    for i, g in enumerate(groups):
        out += [(*two, one) for two in combinations(g, 2) for one in groups[(i + 1) % 3]]
    return tuple(tuple(sorted(t)) for t in out)


@dataclass(frozen=True)
class Index:
    """``words`` of 64 bits a fingerprint; ``keys``: the sets of byte positions, alike in each word, that make the lists."""

    words: int
    keys: tuple[tuple[int, ...], ...]
    min_matches: int
    max_bits: int
    distinct: bool = False  # repeats of a shingle count once
    nearer: tuple[int, ...] = ()  # fewer bits, ascending, that a forest takes its links at first

    def first_key(self) -> np.ndarray:
        """For each set of equal positions of a word (as eight bits) the first key inside it, or 255."""
        out = np.full(256, 255, np.uint8)
        for m in range(256):
            inside = [j for j, t in enumerate(self.keys) if all(m >> p & 1 for p in t)]
            if inside:
                out[m] = inside[0]
        return out


EXACT = Index(words=1, keys=_turan_triples(), min_matches=4, max_bits=4)
SIMILAR = Index(words=4, keys=tuple(combinations(range(8), 2)), min_matches=2, max_bits=62, distinct=True, nearer=(48,))


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further hash words of a shingle from its first (the SplitMix64 finaliser); word 0 is the hash itself."""
    if not word:
        return h
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, words_in_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included; a text of fewer words is one shingle, one without words has none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words_in_shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1, out=starts[1:])
    at = starts.tolist()
    return np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(at, at[words_in_shingle:])), np.uint64, n)


def simhash(h: np.ndarray, words: int = 1) -> list[int]:
    """The SimHash of shingle hashes in ``words`` 64-bit words; all 0 without shingles."""
    out = []
    for word in range(words):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 16):
            part = _mixed(h[i : i + (1 << 16)], word)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little"))
    return out


def _names(words: int) -> list[str]:
    return [f"fp{w}" for w in range(words)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = SHINGLE_WORDS, words: int = 1, distinct: bool = False) -> DataFrame:
    """``doc_id, fp0, ..., n, mark``, one row per row of ``docs``.

    The fingerprints are longs; ``n`` counts the different shingles, and
    ``mark`` is a hash of their set (both 0 unless ``distinct``).
    """
    names = _names(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in byte_slices(b, 1, SLICE_BYTES)):
            fps, sizes, marks = [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, words_in_shingle)
                if distinct:
                    h = np.unique(h)
                fps.append(simhash(h, words))
                sizes.append(len(h) if distinct else 0)
                marks.append(xxhash.xxh64_intdigest(h.tobytes()) if distinct else 0)
            fps = np.array(fps, np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(fps[:, w]) for w in range(words)), pa.array(sizes, pa.int32()), pa.array(np.array(marks, np.uint64).view(np.int64))], names=["doc_id", *names, "n", "mark"]
            )

    source = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names), "n int, mark long"]))


def _postings(nodes: DataFrame, index: Index) -> DataFrame:
    """``key, fp0, ..., node``: one row for each key of each word."""

    def key(word: int, j: int, positions: tuple[int, ...]):
        out = F.lit(word * len(index.keys) + j)
        for p in positions:
            out = out * 256 + F.shiftrightunsigned(f"fp{word}", 8 * p).bitwiseAND(F.lit(255)).cast("int")
        return out

    keys = [key(w, j, t) for w in range(index.words) for j, t in enumerate(index.keys)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), *_names(index.words), "node", *(c for c in nodes.columns if c == "label"))


def _close(at: np.ndarray, lag: int, key: np.ndarray | None, fp: np.ndarray, index: Index, first: np.ndarray, bits: int) -> np.ndarray:
    """Those of places ``at`` that are within ``bits`` of the place ``lag`` further on and share no list before this one; ``key`` numbers the index's keys.

    Without ``key`` they may share any list.
    """
    x = fp[at] ^ fp[at + lag]
    keep = np.flatnonzero(np.bitwise_count(x).sum(1) <= bits)
    equal = np.packbits(x[keep].view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").reshape(-1, index.words)
    enough = np.bitwise_count(equal).sum(1) >= index.min_matches
    keep, equal = keep[enough], equal[enough]
    inside = first[equal]
    if key is None:
        return at[keep[(inside != 255).any(1)]]
    word = (inside != 255).argmax(1)
    shared = word * len(index.keys) + inside[np.arange(len(keep)), word]
    return at[keep[shared == key[at[keep]]]]


def _forest(key: np.ndarray, group: np.ndarray, fp: np.ndarray, index: Index, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal ``group``, those of fewer bits first: pairs of places, and the smallest place of each one's tree.

    With ``label`` only links between different labels count, in any order.
    """
    first = index.first_key()
    root = np.arange(len(fp))
    found: list[tuple[int, int]] = []
    for bits in (*(index.nearer if label is None else ()), index.max_bits):
        for at, lag in _pairs_of(group):
            near = at[root[at] != root[at + lag]]
            if label is not None:
                near = near[label[near] != label[near + lag]]
            for i in _close(near, lag, key, fp, index, first, bits).tolist() if len(near) else ():
                a, b = i, i + lag
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                while root[b] != b:
                    root[b] = root[root[b]]
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((i, i + lag))
            while ((up := root[root]) != root).any():
                root = up
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], root


def _pairs_of(group: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places and lags that together make every pair of places inside a run of equal ``group``."""
    at, lag = np.arange(len(group)), 0
    while True:
        lag += 1
        at = at[at + lag < len(group)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            return
        yield at, lag


def _across(pairs: Iterator[tuple[np.ndarray, np.ndarray]], label: np.ndarray, at: np.ndarray, shingles: np.ndarray) -> Iterator[tuple[int, int]]:
    """Of ``pairs`` of places those that are alike, a spanning forest over the labels; place i has ``shingles[at[i]:at[i + 1]]``."""
    n = np.diff(at)
    label = np.unique(label, return_inverse=True)[1]
    values, ids = np.unique(shingles, return_inverse=True)
    root, inside = np.arange(len(label)), np.zeros(len(values), bool)
    for a, b in pairs:
        fit = (np.minimum(n[a], n[b]) >= SIMILARITY * np.maximum(n[a], n[b]) - 1e-9) & (n[a] > 0) & (n[b] > 0)
        a, b = a[fit], b[fit]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        ends = [*np.flatnonzero(a[1:] != a[:-1]) + 1, len(a)] if len(a) else []
        for begin, end in zip([0, *ends], ends):
            i, others = a[begin], b[begin:end]
            others = others[root[label[others]] != root[label[i]]]
            if not len(others):
                continue
            own = ids[at[i] : at[i + 1]]
            inside[own] = True
            starts = np.cumsum(n[others]) - n[others]
            places = np.repeat(at[others] - starts, n[others]) + np.arange(n[others].sum())
            both = np.add.reduceat(inside[ids[places]], starts, dtype=np.int64)
            inside[own] = False
            for j in others[both >= SIMILARITY * (n[i] + n[others] - both) - 1e-9].tolist():
                x, y = root[label[i]], root[label[j]]
                if x != y:
                    root[root == y] = x
                    yield i, j


def _in_portions(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    found, n = [], 0
    for a, b in pairs:
        found.append((a, b))
        n += len(a)
        if n > PORTION:
            yield tuple(map(np.concatenate, zip(*found)))
            found, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*found)))


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches, in tables that hold whole runs of equal values in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        other = held and any(held[-1].column(i)[-1].as_py() != columns[i][0] for i in range(keys))
        if cut or other:
            yield pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks()
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _compared(key: list[str], index: Index | None, whole: bool):
    """Verified links of lists: of rows ``*key, block, side, node, label, n, [fp0, ...], shingles`` that are sorted by list and block."""

    def pairs(columns: dict[str, np.ndarray], group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        label, side, n = columns["label"], columns["side"], columns["n"]
        if index:
            numbers, first = None if whole else columns[key[0]] >> 8 * len(index.keys[0]), index.first_key()
            fp = np.ascontiguousarray(np.stack([columns[name] for name in _names(index.words)], 1)).view(np.uint64)
        for at, lag in _pairs_of(group):
            near = at[(label[at] != label[at + lag]) & ((side[at] != side[at + lag]) | (side[at] == 0))]
            if index:
                close = _close(near, lag, numbers, fp, index, first, index.max_bits) if len(near) else near
                near = np.union1d(close, near[(n[near] <= SHORT) & (n[near + lag] <= SHORT)]) if whole else close
            else:  # others meet in another list
                x, y = n[near], n[near + lag]
                near = near[(np.minimum(x, y) == columns["small"][near]) & (np.maximum(x, y) == columns["large"][near])]
            if len(near):
                yield near, near + lag

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches, len(key) + 1):
            columns = {name: rows.column(name).to_numpy() for name in rows.column_names if name != "shingles"}
            sets = rows.column("shingles").chunk(0)
            columns["n"] = np.diff(sets.offsets.to_numpy())
            change = np.ones(rows.num_rows, bool)
            change[1:] = np.logical_or.reduce([columns[k][1:] != columns[k][:-1] for k in (*key, "block")])
            found = list(_across(_in_portions(pairs(columns, np.cumsum(change))), columns["label"], sets.offsets.to_numpy(), sets.values.to_numpy()))
            found = np.array(found, np.int64).reshape(-1, 2)
            node = columns["node"]
            yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], names=["a", "b"])

    return run


def _links(index: Index, across: bool = False):
    shift = 8 * len(index.keys[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(key, block, node, *more):
            label, fps = (more[0], more[1:]) if across else (None, more)
            change = np.ones(len(key), bool)
            change[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            lists = key >> shift, np.cumsum(change), np.ascontiguousarray(np.stack(fps, 1)).view(np.uint64), index
            a, b, root = _forest(*lists, label)
            if across:
                at = np.unique(np.concatenate([a, b]))
                tree, size = root[at], np.bincount(root[at], minlength=1)
                head = node.copy()  # the smallest node, so that lists share their heads
                np.minimum.at(head, tree, node[at])
                return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(node[at]), pa.array(head[tree]), pa.array(size[tree])], names=["key", "node", "head", "c"])
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

        for b in batches:
            now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield out(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield out(*held)

    return run


def near_links(nodes: DataFrame, index: Index = EXACT, list_rows: int = LIST_ROWS) -> DataFrame:
    """Links ``a, b`` between nodes that keep every component of the full link graph.

    ``nodes(fp0, ..., node)`` holds each fingerprint once. Under ``EXACT`` every
    pair within its bits is in one component of the result. How long lists are
    is counted on a sixteenth of the nodes: this only decides how they are dealt.

    Where nodes have a ``label``, the result is ``key, node, head, c`` instead:
    the nodes of each list that have a link in it to a node of another label, a
    node that such links connect them with, and how many these connect.
    """
    across = [c for c in nodes.columns if c == "label"]
    lists = _postings(nodes, index)
    share = 16 if list_rows >= 1024 else 1
    some = _postings(nodes.where(F.pmod(F.hash("node"), F.lit(share)) == 0), index).groupBy("key").count()
    hot = some.where(F.col("count") * share > list_rows).select("key", F.ceil(F.col("count") * share / list_rows).cast("int").alias("blocks"))
    dealt = lists.join(small(settle(hot, "hot")), "key", "left")
    own = F.pmod(F.hash(*_names(index.words)), F.col("blocks"))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(own, o) * F.col("blocks") + F.greatest(own, o))
    )
    dealt = dealt.select("key", F.explode(pairs).alias("block"), "node", *across, *_names(index.words))
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(_links(index, bool(across)), "key int, node long, head long, c long" if across else "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index = EXACT, words_in_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for each row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits a word; ``component_id`` is the
    smallest doc_id that links of at most ``index.max_bits`` bits reach, the own
    one included. Null texts count as empty: fingerprint zero, linked like any
    other. Rows with a null or repeated doc_id keep one row each; a fingerprint
    that only rows with null ids have gets a null component. Other columns of
    ``docs`` are not read.
    """
    names = _names(index.words)
    marks = settle(fingerprints(docs, id_col, text_col, words_in_shingle, index.words, index.distinct), "simhash")
    nodes = marks.select("doc_id", *names).groupBy(*names).agg(F.min("doc_id").alias("node"))
    roots = components(near_links(nodes.where("node is not null"), index))
    named = nodes.join(roots.withColumnRenamed("vertex", "node"), "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    digits = F.concat(*(F.lower(F.lpad(F.hex(n), 16, "0")) for n in names))
    return marks.join(named, names).select("doc_id", digits.alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 5) -> DataFrame:
    """``node, shingles``: the different shingles (32 bits of their hashes) of the rows of ``docs`` whose id is a ``node`` of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in byte_slices(b, 1, SLICE_BYTES)):
            sets = [np.unique(shingle_hashes(t, words_in_shingle).astype(np.uint32)).view(np.int32) for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    source = bounded(docs).select(F.col(id_col).cast("long").alias("node"), text_or_empty(text_col).alias("text"))
    return source.join(small(wanted), "node", "left_semi").mapInArrow(run, "node long, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, alike``: whether each pair of nodes has ``SIMILARITY`` or more of its shingles in common (any two sets, where a node has several)."""
    found = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return found.select("a", "b", (both >= SIMILARITY * (F.size("x") + F.size("y") - both) - 1e-9).alias("alike")).groupBy("a", "b").agg(F.max("alike").alias("alike"))


def prefix_lists(sets: DataFrame) -> DataFrame:
    """``h, small, large, node``: lists in one of which any two sets of ``SIMILARITY`` or more meet.

    With shingles ordered from the rarest, two sets of ``small`` and ``large``
    shingles that have enough in common share a shingle so early that enough
    may still follow in either. Sets hold at most ``SHORT`` shingles.
    """
    one = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    rare = one.groupBy("h").agg(F.count("*").alias("f"))
    ordered = one.join(rare, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("s"))
    n, m = F.col("n"), F.col("m")
    least = F.ceil(n * SIMILARITY - 1e-9).cast("int")
    at = ordered.select("node", "n", F.posexplode(F.slice("s", F.lit(1), n - least + 1)).alias("i", "s"))
    sized = at.select("node", "n", "i", "s.h", F.explode(F.sequence(least, F.floor(n / SIMILARITY + 1e-9).cast("int"))).alias("m"))
    needed = F.ceil((n + m) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    return sized.where(needed <= n - F.col("i")).select("h", F.least(n, m).alias("small"), F.greatest(n, m).alias("large"), "node")


def links_across(lists: DataFrame, key: list[str], sets: DataFrame, index: Index | None = None, whole: bool = False) -> DataFrame:
    """``a, b``: links between nodes of different labels that every component of all such links inside the lists keeps.

    ``lists(*key, node, label, n)`` hold the nodes of each list, with their
    fingerprints under ``index``; ``n`` is about the size of their sets. A
    ``whole`` list stands for all lists that its nodes share, of both kinds.
    Nodes are compared on their ``sets`` inside the task that holds the list;
    long lists are dealt out as pairs of blocks, whole ones for many tasks.
    """
    rows = F.count("*")
    blocks = F.greatest(F.sum("n") / LIST_SHINGLES, rows / LIST_ROWS, *((F.least(rows / PART_ROWS, F.lit(float(PARTS))),) if whole else ()))
    size = lists.groupBy(*key).agg(F.ceil(blocks).cast("int").alias("blocks"))
    dealt = lists.join(small(settle(size.where("blocks > 1"), "hot")), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, count = F.pmod(F.hash("node"), F.col("blocks")), F.col("blocks")
    # Nodes of one block are compared where it is paired with itself (side 0).
    units = F.transform(
        F.sequence(F.lit(0), count - 1), lambda o: F.struct((F.least(own, o) * count + F.greatest(own, o)).alias("block"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side"))
    )
    once = dealt.join(sets.select("node", "shingles"), "node").select("*", F.explode(units).alias("unit"))
    dealt = bounded(once.select(*key, "unit.block", "unit.side", "node", "label", "n", *(_names(index.words) if index else ()), "shingles"))
    return dealt.repartition(*key, "block").sortWithinPartitions(*key, "block").mapInArrow(_compared(key, index, whole), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 5) -> DataFrame:
    """``doc_id, component_id``: one row for each row of ``docs``.

    Links are pairs of texts that have ``SIMILARITY`` or more of their different
    shingles in common; ``component_id`` is the smallest doc_id that links
    reach. Equal sets of shingles are one node, so texts without words are
    linked. Every link is verified on the shingles. Fingerprints propose a
    spanning forest of each list, nearest pairs first, and for short texts the
    heads of the prefix lists are tried; then all pairs of a list that have not
    come together: so no link between texts that share a list is lost. The texts
    that such pairs connect are compared as one group, unless its lists have far
    fewer pairs. Rows with a null id have a null component.
    """
    index = SIMILAR
    names = _names(index.words)
    marks = settle(fingerprints(docs, id_col, text_col, words_in_shingle, index.words, True), "marks")
    nodes = settle(marks.where("doc_id is not null").groupBy(*names, "n", "mark").agg(F.min("doc_id").alias("node")), "nodes")
    proposed = settle(near_links(nodes, index).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "proposed")
    wanted = proposed.select(F.col("a").alias("node")).union(proposed.select("b")).union(nodes.where(f"n between 1 and {SHORT}").select("node")).distinct()
    sets = settle(shingle_sets(docs.where(F.col(id_col).isNotNull()), settle(wanted, "wanted"), id_col, text_col, words_in_shingle), "sets")
    key = ["h", "small", "large"]
    lists = prefix_lists(sets.where(F.size("shingles").between(1, SHORT)))
    heads = lists.groupBy(*key).agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1")
    lists = settle(lists.join(heads, key).select(*key, "a", "c", "node"), "lists")
    stars = lists.where("a <> node").select("a", F.col("node").alias("b"))
    first = settle(verified(proposed.union(stars).distinct(), sets), "verified")
    alike = first.where("alike").select("a", "b")
    label = components(alike).select(F.col("vertex").alias("node"), F.col("component").alias("label"))
    x = settle(lists.join(label, "node", "left").select(*key, "node", "a", "c", F.coalesce("label", "node").alias("label")), "labels")
    apart = x.join(x.groupBy(*key).agg((F.min("label") != F.max("label")).alias("apart")).where("apart").drop("apart"), key, "left_semi")
    near = nodes.join(proposed.select(F.col("a").alias("node")).union(proposed.select("b")).distinct(), "node", "left_semi").join(label, "node", "left")
    near = settle(near.select("node", *names, F.coalesce("label", "node").alias("label")), "apart")
    none = [F.lit(0).alias(k) for k in key]
    entries = near_links(near, index).select("key", *none, "node", "head", "c").union(apart.select(F.lit(-1).alias("key"), *key, "node", F.col("a").alias("head"), "c"))
    entries = settle(entries, "entries")
    cost = entries.groupBy("node").agg(F.sum(F.col("c") + ENTRY).alias("cost"))
    group = components(entries.select(F.col("head").alias("a"), F.col("node").alias("b"))).select(F.col("vertex").alias("node"), F.col("component").alias("together"))
    group = settle(cost.join(group, "node"), "groups")
    dense = group.groupBy("together").agg((F.count("*") * F.count("*") <= F.sum("cost")).alias("dense"))
    opened = group.join(dense, "together").join(nodes, "node").join(label, "node", "left")
    opened = settle(opened.select("node", "together", "dense", *names, "n", F.coalesce("label", "node").alias("label")), "opened")
    second = links_across(opened.where("dense"), ["together"], sets, index, True)
    sparse = opened.where("not dense")
    if not sparse.isEmpty():
        second = second.union(links_across(entries.where("key >= 0").select("key", "node").distinct().join(sparse, "node"), ["key"], sets, index))
        short = entries.where("key < 0").select(*key, "node").distinct().join(sparse.drop("n"), "node")
        second = second.union(links_across(short.withColumn("n", F.col("large")), key, sets))
    second = settle(second, "second")
    roots = components(alike.union(second))
    named = nodes.join(roots.withColumnRenamed("vertex", "node"), "node", "left").select(*names, "n", "mark", F.coalesce("component", "node").alias("component_id"))
    found = settle(marks.join(named, [*names, "n", "mark"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "copies")
    discard(marks, nodes, proposed, sets, lists, first, x, near, entries, group, opened, second)
    return found


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 5) -> DataFrame:
    """One row of ``docs``, with all their columns, for each component of ``near_copies``.

    It is the row whose id names the component; of rows that repeat this id, the
    one of smallest text hash. Rows with a null id are all kept.
    """
    key, place = fresh(docs, "_key"), fresh(docs, "_place")
    found = near_copies(docs, id_col, text_col, words_in_shingle).where("doc_id is not null")
    ids = settle(found.groupBy(F.col("doc_id").alias(key)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("n")), "ids")
    dropped, repeated = small(ids.where("not kept").select(key)), small(ids.where("kept and n > 1").select(key))
    same = F.col(id_col).cast("long") == F.col(key)
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), F.xxhash64(*[c for c, kind in docs.dtypes if "map" not in kind]))
    # Ids are unique in most tables, so only repeated ones are put in order.
    once = docs.join(dropped, same, "left_anti").join(repeated, same, "left_anti")
    again = docs.join(repeated, same, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*docs.columns)
    return once.unionAll(again)
