"""Near-duplicate embeddings by range search on a robust-pruned flat graph.

Equal vectors are one node with a number of copies. Nodes are dealt to the
clusters of a bounded sample's centroids, each to its two nearest, so shards
overlap; a cluster of too many members is dealt out over several shards. In each
shard a node's nearest members and the nearest of some landmarks are pruned: a
neighbour goes if a kept one is nearer to it, by a factor, than the node is.
Reverse edges are added, and what the medoid does not reach is hooked to its
nearest reached node. The lists that a node has in its shards are united, and a
few neighbouring shards make a search unit with one graph.

A node searches the units of its nearest clusters, greedily from the medoids of
the shards, with a beam; every node found in range is expanded as well, however
many there are. Hits count at a cosine of at least ``least`` in double precision
only. A unit returns a row for each node, with its number of links and a root
inside the unit, never its pairs: of the units that see a pair, the smallest one
counts it. Links found from either side count for both.

An audit compares a bounded sample of nodes with all rows by brute force, and
the search is done again over twice the clusters until the audit finds
``least_recall`` of the links, or all clusters are searched.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing, nor do vectors of different length. Rows of a repeated id are
compared as any others. A null id is no other row's component. An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.base import bounded, discard, settle, small
from loamline.llm.components import components

LEAST = 0.9
SAMPLE = 16_384  # nodes that fit the centroids
AUDITED = 2_048  # nodes that are compared with all rows
LEAST_RECALL = 0.98
MAX_CLUSTERS = 4_096
SHARD = 1_500  # members
UNIT_SHARDS = 8
VISITORS = 16_384  # of a unit in one task
OVERLAP = 2
PROBES = 4  # clusters that a node searches at first

CANDIDATES, LANDMARKS, FAR = 32, 64, 8
PRUNE = 1.2
DEGREE, MAX_DEGREE = 24, 40
BEAM, EXPANDED = 48, 4
BLOCK = 256
SLACK = 1e-4  # of single precision below ``least``


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector has a direction."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def units_of(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length, at length 1, in double precision; scaled first, so that no square overflows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nodes(rows: DataFrame) -> DataFrame:
    classes = rows.where(usable()).groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return settle(classes.select(F.monotonically_increasing_id().alias("node"), "copies", "least", "embedding", F.size("embedding").alias("length")), "nodes")


@dataclass
class Layout:
    """Clusters of one vector length: ``centroids`` in the order of their regions, and the shards each is dealt to."""

    centroids: np.ndarray
    shards: np.ndarray | None = None  # of each cluster
    first: np.ndarray | None = None  # number of each cluster's first shard, over all lengths

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        return np.argsort(-(x @ self.centroids.T), axis=1, kind="stable")[:, :probes]


def _lloyd(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


def _layouts(nodes: DataFrame) -> dict[int, Layout]:
    """Centroids of each vector length from the sample (in order of a hash of the vectors), near ones beside each other."""
    sizes = {r["length"]: r["count"] for r in nodes.groupBy("length").count().orderBy(F.desc("count"), "length").limit(MAX_CLUSTERS).collect()}
    sample = nodes.select("length", "embedding", F.xxhash64("embedding").alias("h")).orderBy("h", "embedding").limit(SAMPLE).toArrow()
    out = {}
    for length, rows in sizes.items():
        own = sample.filter(pa.array(sample["length"].to_numpy() == length))
        if not own.num_rows:
            continue
        x = units_of(own["embedding"].combine_chunks())
        k = min(MAX_CLUSTERS, len(x), -(-rows * OVERLAP // SHARD))
        centroids = _lloyd(x, k)
        regions = (centroids @ _lloyd(centroids, -(-k // UNIT_SHARDS)).T).argmax(1)
        out[length] = Layout(centroids[np.argsort(regions, kind="stable")])
    return out


def _assigned(nodes: DataFrame, layouts: dict[int, Layout], probes: int) -> DataFrame:
    """``nodes`` with ``clusters``, the nearest first; a length without a sampled vector is one cluster."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            clusters: list[list[int]] = [[0]] * len(lengths)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                if length in layouts:
                    for row, found in zip(rows.tolist(), layouts[length].nearest(units_of(batch.column(1).take(pa.array(rows))), probes).tolist()):
                        clusters[row] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clusters, pa.list_(pa.int32()))], ["node", "clusters"])

    return bounded(nodes.select("node", "embedding", "length")).mapInArrow(assign, "node long, clusters array<int>")


def _number_shards(layouts: dict[int, Layout], members: dict[tuple[int, int], int]) -> None:
    at = 0
    for length, layout in sorted(layouts.items()):
        count = np.array([members.get((length, c), 0) for c in range(len(layout.centroids))])
        layout.shards = np.maximum(1, -(-count // SHARD))
        layout.first = at + np.concatenate(([0], np.cumsum(layout.shards)[:-1]))
        at += int(layout.shards.sum()) + UNIT_SHARDS
        at -= at % UNIT_SHARDS  # lengths never share a unit


def _placed(assigned: DataFrame, layouts: dict[int, Layout]) -> DataFrame:
    """``node, shards`` that the node is a member of, ``homes`` (their units) and ``visits`` (units it searches, its own too)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, homes, visits = [], [], []
            for node, length, clusters, mixed in zip(*(c.to_pylist() for c in batch.columns)):
                if length not in layouts:
                    shards.append([]), homes.append([]), visits.append([])
                    continue
                layout = layouts[length]
                own = [int(layout.first[c] + mixed % int(layout.shards[c])) for c in clusters[:OVERLAP]]
                units = {u for c in clusters for u in range(int(layout.first[c]) // UNIT_SHARDS, int(layout.first[c] + layout.shards[c] - 1) // UNIT_SHARDS + 1)}
                shards.append(own)
                homes.append(sorted({s // UNIT_SHARDS for s in own}))
                visits.append(sorted(units))
            arrays = [batch.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in (shards, homes, visits))]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "shards", "homes", "visits"])

    mixed = F.pmod(F.xxhash64("node"), F.lit(1 << 40)).alias("mixed")
    return assigned.select("node", "length", "clusters", mixed).mapInArrow(place, "node long, shards array<long>, homes array<long>, visits array<long>")


def robust_prune(x: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each node the candidates (best first) that no kept one makes superfluous; -1 fills up."""
    vectors = x[candidates]
    to_node = 2 - 2 * np.einsum("bd,bcd->bc", x[node], vectors)
    between = 2 - 2 * np.einsum("bcd,bed->bce", vectors, vectors)
    alive = candidates != node[:, None]
    kept = np.zeros_like(alive)
    for j in range(candidates.shape[1]):
        take = alive[:, j] & (kept.sum(1) < degree)
        kept[:, j] = take
        alive &= ~(take[:, None] & (PRUNE * PRUNE * between[:, j] <= to_node))
    out = np.full((len(node), degree), -1)
    row, column = np.nonzero(kept)
    out[row, (np.cumsum(kept, axis=1) - 1)[row, column]] = candidates[row, column]
    return out


def build(x: np.ndarray) -> tuple[list[list[int]], int]:
    """Neighbours of each row of ``x`` (of length 1), all reached from the medoid, which is the other result."""
    m = len(x)
    medoid = int((x @ x.sum(0)).argmax())
    landmarks = np.unique(np.append(np.linspace(0, m - 1, min(m, LANDMARKS)).astype(int), medoid))
    lists: list[list[int]] = []
    for first in range(0, m, BLOCK):
        node = np.arange(first, min(m, first + BLOCK))
        near = x[node] @ x.T
        k = min(m, CANDIDATES + 1)
        close = np.argpartition(-near, k - 1, axis=1)[:, :k]
        far = landmarks[np.argsort(-near[:, landmarks], axis=1)[:, :FAR]]
        candidates = np.concatenate([close, far], axis=1)
        candidates = np.take_along_axis(candidates, np.argsort(-np.take_along_axis(near, candidates, 1), axis=1), 1)
        lists += [[n for n in row if n >= 0] for row in robust_prune(x, node, candidates).tolist()]
    for node, found in enumerate([list(f) for f in lists]):
        for other in found:
            if len(lists[other]) < MAX_DEGREE and node not in lists[other]:
                lists[other].append(node)
    reached = _reached(lists, [medoid], np.zeros(m, bool))
    while not reached.all():
        lost = np.flatnonzero(~reached)
        there = np.flatnonzero(reached)
        near = x[lost[:BLOCK]] @ x[there].T
        best = int(near.max(1).argmax())
        lists[int(there[near[best].argmax()])].append(int(lost[best]))
        _reached(lists, [int(lost[best])], reached)
    return lists, medoid


def _reached(lists: list[list[int]], start: list[int], reached: np.ndarray) -> np.ndarray:
    reached[start] = True
    while start:
        start = [n for n in {n for s in start for n in lists[s]} if not reached[n]]
        reached[start] = True
    return reached


def _graph(shard: pa.Table) -> pa.Table:
    ids = shard["node"].to_numpy()
    lists, medoid = build(units_of(shard["embedding"].combine_chunks()))
    entry = np.arange(len(ids)) == medoid
    return pa.table({"node": ids, "near": pa.array([ids[n].tolist() for n in lists], pa.list_(pa.int64())), "entry": entry})


class Search:
    """Range search on one graph: ``x`` (rows of length 1), ``lists`` padded with the row itself, ``entries`` to start from."""

    def __init__(self, x: np.ndarray, lists: np.ndarray, entries: np.ndarray, least: float):
        self.x, self.single, self.lists, self.entries, self.least = x, x.astype(np.float32), lists, entries, least

    def hits(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) found at a cosine of ``least`` or more."""
        q = queries.astype(np.float32)
        seen = np.zeros((len(q), len(self.x)), bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        beam = np.full((len(q), BEAM), -1)
        worth = np.full((len(q), BEAM), -2, np.float32)
        open_ = np.zeros((len(q), BEAM), bool)
        row, node, cosine = self._visit(q, seen, np.repeat(np.arange(len(q)), len(self.entries)), np.tile(self.entries, len(q)))
        self._offer(beam, worth, open_, row, node, cosine)
        spread = np.zeros_like(seen)  # nodes whose neighbours have been visited
        while open_.any():
            best = np.argsort(-np.where(open_, worth, -3), axis=1)[:, :EXPANDED]
            row, column = np.nonzero(np.take_along_axis(open_, best, 1))
            at = best[row, column]
            open_[row, at] = False
            spread[row, beam[row, at]] = True
            row, node, cosine = self._visit(q, seen, np.repeat(row, self.lists.shape[1]), self.lists[beam[row, at]].ravel())
            self._offer(beam, worth, open_, row, node, cosine)
        done = 0
        while done < len(self.found):  # everything in range, in or out of the beam
            row, node = self.found[done]
            done += 1
            fresh = ~spread[row, node]
            row, node = row[fresh], node[fresh]
            spread[row, node] = True
            for i in range(0, len(row), 20_000):
                part = slice(i, i + 20_000)
                self._visit(q, seen, np.repeat(row[part], self.lists.shape[1]), self.lists[node[part]].ravel())
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, node = (np.concatenate(c) for c in zip(*self.found))
        good = np.concatenate([np.einsum("ij,ij->i", queries[row[i : i + 50_000]], self.x[node[i : i + 50_000]]) >= self.least for i in range(0, len(row), 50_000)])
        return row[good], node[good]

    def _visit(self, q: np.ndarray, seen: np.ndarray, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = ~seen[row, node]
        key = np.unique(row[new] * len(self.x) + node[new])
        row, node = key // len(self.x), key % len(self.x)
        seen[row, node] = True
        cosine = np.einsum("ij,ij->i", q[row], self.single[node])
        inside = cosine >= self.least - SLACK
        if inside.any():
            self.found.append((row[inside], node[inside]))
        return row, node, cosine

    @staticmethod
    def _offer(beam: np.ndarray, worth: np.ndarray, open_: np.ndarray, row: np.ndarray, node: np.ndarray, cosine: np.ndarray) -> None:
        """Put visited nodes into the beams, the best of which stay."""
        if not len(row):
            return
        place = np.arange(len(row)) - np.searchsorted(row, row)
        width = int(place.max()) + 1
        more = [np.full((len(beam), width), fill, kind) for fill, kind in ((-1, beam.dtype), (-2, worth.dtype), (False, bool))]
        for target, value in zip(more, (node, cosine, True)):
            target[row, place] = value
        all_worth = np.concatenate([worth, more[1]], axis=1)
        best = np.argpartition(-all_worth, BEAM - 1, axis=1)[:, :BEAM]
        worth[:] = np.take_along_axis(all_worth, best, 1)
        beam[:] = np.take_along_axis(np.concatenate([beam, more[0]], axis=1), best, 1)
        open_[:] = np.take_along_axis(np.concatenate([open_, more[2]], axis=1), best, 1)


def _padded(lists: pa.ListArray, fill: int) -> np.ndarray:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), fill)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _merge_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        apart = root[a] != root[b]
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root[:] = root[root]


def _search(least: float) -> Callable:
    def search(unit: pa.Table) -> pa.Table:
        """Rows of one unit and chunk; members (with ``near``) are in each chunk, and are queries in chunk 0 only."""
        here, chunk = unit["unit"][0].as_py(), unit["chunk"][0].as_py()
        member = unit["member"].to_numpy()
        order = np.argsort(~member, kind="stable")
        unit, m = unit.take(pa.array(order)), int(member.sum())
        ids, copies = unit["node"].to_numpy(), unit["copies"].to_numpy()
        x = units_of(unit["embedding"].combine_chunks())
        near = _padded(unit["near"].combine_chunks().slice(0, m), -1)
        by_id = np.argsort(ids[:m])
        at = np.minimum(np.searchsorted(ids[:m], near, sorter=by_id), m - 1)
        inside = ids[:m][by_id[at]] == near
        lists = np.where(inside, by_id[at], np.arange(m)[:, None])
        homes, visits = (_padded(unit[c].combine_chunks(), -1) for c in ("homes", "visits"))
        graph = Search(x[:m], lists, np.flatnonzero(unit["entry"].to_numpy(zero_copy_only=False)[:m].astype(bool)), least)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def owned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Whether no smaller unit sees these pairs: one end is a member there and the other is there too."""
            smallest = np.full(len(a), np.iinfo(np.int64).max)
            for one, other in ((a, b), (b, a)):
                for column in homes.T:
                    unit_ = column[one]
                    there = (visits[other] == unit_[:, None]).any(1) & (unit_ >= 0)
                    smallest = np.where(there, np.minimum(smallest, unit_), smallest)
            return smallest == here

        def credit(a: np.ndarray, b: np.ndarray) -> None:
            for i in range(0, len(a), 100_000):
                p, q = a[i : i + 100_000], b[i : i + 100_000]
                _merge_roots(root, p, q)
                mine = owned(p, q)
                np.add.at(links, p[mine], copies[q[mine]])
                np.add.at(links, q[mine], copies[p[mine]])

        if chunk == 0:
            bits = np.zeros((m, -(-m // 8)), np.uint8)
            for first in range(0, m, BLOCK):
                row, node = graph.hits(x[first : min(m, first + BLOCK)])
                for p, q in ((row + first, node), (node, row + first)):
                    np.bitwise_or.at(bits, (p, q >> 3), (1 << (q & 7)).astype(np.uint8))
            for first in range(0, m, BLOCK):
                p, q = np.nonzero(np.unpackbits(bits[first : first + BLOCK], axis=1, count=m, bitorder="little"))
                p += first
                credit(p[p < q], q[p < q])
        else:
            for first in range(m, len(ids), BLOCK):
                row, node = graph.hits(x[first : first + BLOCK])
                credit(row + first, node)
        linked = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"node": ids[linked], "links": links[linked], "root": ids[root[linked]]})

    return search


def _links(nodes: DataFrame, layouts: dict[int, Layout], probes: int, least: float) -> DataFrame:
    """``node, links, root`` of each unit, for nodes that have links there."""
    assigned = settle(nodes.join(_assigned(nodes, layouts, max(probes, OVERLAP)), "node"), "assigned")
    members = assigned.select("length", F.explode(F.slice("clusters", 1, OVERLAP)).alias("cluster")).groupBy("length", "cluster").count()
    _number_shards(layouts, {(r["length"], r["cluster"]): r["count"] for r in members.collect()})
    placed = settle(assigned.join(_placed(assigned, layouts), "node").drop("clusters", "length", "least"), "placed")
    shards = placed.select("node", "embedding", F.explode("shards").alias("shard"))
    graphs = shards.groupBy("shard").applyInArrow(_graph, "node long, near array<long>, entry boolean")
    united = graphs.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.bool_or("entry").alias("entry"))
    united = settle(united, "graph")
    rows = placed.withColumn("unit", F.explode("visits")).withColumn("member", F.array_contains("homes", F.col("unit")))
    rows = rows.drop("shards")
    chunks = rows.groupBy("unit").agg(F.count_if(~F.col("member")).alias("visitors"))
    chunks = settle(chunks.select("unit", F.ceil(F.col("visitors") / VISITORS).cast("int").alias("chunks")), "chunks")
    rows = rows.join(small(chunks), "unit").join(united, "node")
    dealt = F.when(F.col("member"), F.sequence(F.lit(0), F.col("chunks"))).otherwise(F.array(1 + F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")))
    own = F.when(F.col("member"), F.col("near"))
    rows = rows.select("unit", F.explode(dealt).alias("chunk"), "node", "copies", "embedding", "member", own.alias("near"), "entry", "homes", "visits")
    found = settle(rows.groupBy("unit", "chunk").applyInArrow(_search(least), "node long, links long, root long"), "found")
    discard(assigned, placed, united, chunks)
    return found


def audit(nodes: DataFrame, found: DataFrame, least: float = LEAST, sample: int = AUDITED) -> float:
    """Share of the links of a sample of nodes that ``found`` has, by comparing them with all nodes."""
    picked = nodes.select("node", "embedding", "length").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toArrow()
    asked = {}
    for length in set(picked["length"].to_pylist()):
        own = picked.filter(pa.array(picked["length"].to_numpy() == length))
        asked[length] = (own["node"].to_numpy(), units_of(own["embedding"].combine_chunks()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for length in np.unique(lengths).tolist():
                if length not in asked:
                    continue
                rows = np.flatnonzero(lengths == length)
                ids, vectors = asked[length]
                near = (units_of(batch.column(1).take(pa.array(rows))) @ vectors.T >= least) & (batch.column(0).to_numpy()[rows][:, None] != ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near * batch.column(3).to_numpy()[rows][:, None]).sum(0))], ["node", "links"])

    true = bounded(nodes.select("node", "embedding", "length", "copies")).mapInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    both = true.join(found.groupBy("node").agg(F.sum("links").alias("seen")), "node", "left")
    r = both.agg(F.sum("links"), F.sum(F.least("links", F.coalesce("seen", F.lit(0))))).first()
    return r[1] / r[0] if r[0] else 1.0


def near_duplicates(rows: DataFrame, least: float = LEAST, probes: int = PROBES, least_recall: float = LEAST_RECALL) -> DataFrame:
    """Links at a cosine of ``least`` or more, and the components they make.

    Returns one row per row of ``rows``: ``vec_id, n_links, component_id, kept``.
    """
    rows = rows.select("vec_id", "embedding")
    nodes = _nodes(rows)
    layouts = _layouts(nodes)
    clusters = max([1, *(len(x.centroids) for x in layouts.values())])
    while True:
        found = _links(nodes, layouts, probes, least)
        if probes >= clusters or audit(nodes, found, least) >= least_recall:
            break
        discard(found)
        probes *= 2
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).select(F.col("vertex").alias("node"), "component")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = nodes.select("node", "copies", "least", "embedding").join(linked, "node", "left").join(roots, "node", "left")
    labelled = settle(labelled.withColumn("component", F.coalesce("component", "node")), "labelled")
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = labelled.join(smallest, "component").select("embedding", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = F.col("n_links").isNull()
    out = rows.withColumn("usable", usable()).join(classes.withColumn("usable", F.lit(True)), ["embedding", "usable"], "left")
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
