"""Exact top-k inner products by best-first search in M-trees.

An inner product is no metric. With M the largest norm in the table, a vector x
gets one more component sqrt(M^2 - |x|^2) and a query one of zero; then
d(q, x)^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors are those of highest
score and the triangle inequality bounds scores. Bounds are taken with a margin
for rounding; scores themselves are exact integers.

The index is a forest. A bounded sample gives the routing objects of its
shards; every vector goes to the nearest, and a shard with more than
``SHARD_ROWS`` vectors (a hot one) is cut into several by hash. Each shard is an
M-tree whose nodes are rows of a table: leaf pages hold vectors with their
distances to the page's routing object; inner nodes hold the routing objects
below them; all have a covering radius and a distance to the parent.

A query first visits its nearest shard, which gives a score that its results
must reach, then every shard whose bound still reaches it. Queries are dealt by
hash into blocks of about ``QUERY_ROWS``; a task holds one tree and one block,
so a tree's rows are copied to each block that asks it. Results name a query by
its id and the hash of its vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.base import settle

SAMPLE_ROWS = 2048
MAX_SHARDS = 1024
SHARD_ROWS = 50_000
QUERY_ROWS = 20_000
PAGE_ROWS = 256
FANOUT = 32
NODE = "shard int, sub int, node int, parent int, leaf boolean, radius double, parent_distance double, ids binary, vectors binary, distances binary, radii binary"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def _far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` rows of ``x``, each farthest from those taken before; equal rows are taken once."""
    taken = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(taken) < min(k, len(x)):
        i = int(near.argmax())
        if near[i] <= 0:
            break
        taken.append(i)
        near = np.minimum(near, _distances(x, x[i : i + 1])[:, 0])
    return np.array(taken)


def _pages(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Split ``x`` into groups of at most ``rows`` near one another; equal rows are cut by count."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        of = todo.pop()
        if len(of) <= rows:
            done.append(of)
            continue
        k = min(FANOUT, -(-len(of) // rows) + 1)
        seeds = x[of[_far_apart(x[of[:: max(1, len(of) // 1024)]], k) * max(1, len(of) // 1024)]]
        nearest = _distances(x[of], seeds).argmin(1)
        parts = [of[nearest == j] for j in range(len(seeds))]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(of):
            parts = [of[i : i + rows] for i in range(0, len(of), rows)]
        todo += parts
    return done


def build_nodes(ids: np.ndarray, x: np.ndarray, top: float) -> list[dict]:
    """The nodes of one M-tree over integer vectors ``x``, the root last; children have lower numbers."""
    lifted = _lift(x, top)
    nodes: list[dict] = []
    level: list[tuple[int, np.ndarray, float]] = []  # node, routing object, covering radius
    for of in _pages(lifted, PAGE_ROWS):
        centre = lifted[of].mean(0)
        pivot = lifted[of[int(_distances(lifted[of], centre[None])[:, 0].argmin())]]
        d = _distances(lifted[of], pivot[None])[:, 0]
        nodes.append({"leaf": True, "ids": ids[of], "vectors": x[of], "distances": d, "radii": np.zeros(0), "radius": float(d.max()), "parent": -1, "parent_distance": 0.0})
        level.append((len(nodes) - 1, pivot, float(d.max())))
    while len(level) > 1 or nodes[level[0][0]]["leaf"]:
        pivots = np.stack([p for _, p, _ in level])
        radii = np.array([r for _, _, r in level])
        above = []
        for of in _pages(pivots, FANOUT):
            centre = pivots[of].mean(0)
            pivot = pivots[of[int(_distances(pivots[of], centre[None])[:, 0].argmin())]]
            d = _distances(pivots[of], pivot[None])[:, 0]
            me = len(nodes)
            children = np.array([level[i][0] for i in of], np.int64)
            for i, dist in zip(of.tolist(), d.tolist()):
                nodes[level[i][0]] |= {"parent": me, "parent_distance": dist}
            radius = float((d + radii[of]).max())
            nodes.append({"leaf": False, "ids": children, "vectors": pivots[of], "distances": d, "radii": radii[of], "radius": radius, "parent": -1, "parent_distance": 0.0})
            above.append((me, pivot, radius))
        level = above
    return nodes


def search(nodes: list[dict], query: np.ndarray, own: int, k: int, top: float, floor: float) -> list[tuple[int, int]]:
    """Best ``(score, id)`` of one M-tree, ties to smaller ids, that are at least ``floor``.

    Best first by the highest score that a node can hold. The parent distances
    stored with children and vectors rule most of them out before any distance
    to them is computed.
    """
    norm = float(query @ query)
    lifted = np.append(query, 0.0)
    margin = 1e-7 * (norm + top) + 1e-3
    best: list[tuple[int, int]] = []  # heap of (score, -id), the worst on top

    def needed() -> float:
        return max(floor, best[0][0]) if len(best) == k else floor

    def bound(distance):
        return (norm + top - np.maximum(distance, 0) ** 2) / 2 + margin

    # (minus the node's bound, node, distance of the query to its routing object)
    queue: list[tuple[float, int, float]] = [(-np.inf, len(nodes) - 1, float("nan"))]
    while queue:
        negative, number, at = heapq.heappop(queue)
        if -negative < needed():
            break
        node = nodes[number]
        d, radii = node["distances"], node["radii"]
        if node["leaf"]:
            keep = np.flatnonzero(bound(np.abs(at - d)) >= needed())
            scores = np.rint(node["vectors"][keep] @ query).astype(np.int64)
            of = node["ids"][keep]
            fine = np.flatnonzero((of != own) & (scores >= needed()))
            if len(fine) > k:  # only the best can enter, with all that tie with the last of them
                cut = np.partition(scores[fine], len(fine) - k)[len(fine) - k]
                fine = fine[scores[fine] >= cut]
            for s, i in sorted(zip(scores[fine].tolist(), of[fine].tolist()), key=lambda p: (-p[0], p[1])):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
                else:
                    break
            continue
        keep = np.arange(len(d)) if at != at else np.flatnonzero(bound(np.abs(at - d) - radii) >= needed())
        if len(keep):
            to = _distances(node["vectors"][keep], lifted[None])[:, 0]
            for j, dist, b in zip(keep.tolist(), to.tolist(), bound(to - radii[keep]).tolist()):
                if b >= needed():
                    heapq.heappush(queue, (-b, int(node["ids"][j]), dist))
    return sorted(((s, -i) for s, i in best), key=lambda p: (-p[0], p[1]))


def _packed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (components floor(256 x) as doubles) of the vectors that take part."""
    c = F.col(vector_col)
    fine = c.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x):  # doubles from 2**52 on are whole, and may be too large for a long
        y = F.lit(256.0) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(c, whole).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    """A matrix of list column ``column``; shorter vectors are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _blocks(nodes: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` once for each block of routed queries ``rows(shard, sub, block, ...)`` that asks their tree, and ``rows``, both to be grouped by tree and block (``asked_by`` in the trees)."""
    asking = rows.select(F.col("shard").alias("_shard"), F.col("sub").alias("_sub"), F.col("block").alias("asked_by")).distinct()
    return nodes.join(asking, (F.col("shard") == F.col("_shard")) & (F.col("sub") == F.col("_sub"))).drop("_shard", "_sub"), rows


def _dealt(asked: DataFrame, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``vec_id, v, mark, block``: queries with the hash of their vector, in blocks of about ``query_rows``."""
    blocks = max(1, -(-asked.count() // query_rows))
    return asked.select("vec_id", "v", F.xxhash64("v").alias("mark"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query.

    Components count as floor(256 x). Candidates are all rows of ``vectors``
    whose vec_id is not the query's; ties go to the smaller vec_id. Vectors
    that are null, hold a null or non-finite component or have a null id take no
    part, as queries neither. Shorter (also empty) vectors count as padded with
    zeros. Repeated rows are each a candidate; a query repeated with the same
    id and vector is answered once. With no vectors or no queries the result is
    empty. Other columns are not read.
    """
    spark = vectors.sparkSession
    base = settle(_packed(vectors, id_col, vector_col), "vectors")
    asked = settle(_packed(queries, id_col, vector_col).distinct(), "queries")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    stats = base.agg(F.count("*").alias("n"), F.max(square).alias("top"), F.max(F.size("v")).alias("dim")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = float(stats["top"])
    dim = max(1, int(stats["dim"]), int(asked.agg(F.max(F.size("v"))).first()[0] or 0))
    # A bounded sample: the rows of lowest hash, at most SAMPLE_ROWS.
    sample = np.zeros((0, dim))
    rows = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").collect()
    sample = np.array([[*r["v"], *[0.0] * (dim - len(r["v"]))] for r in rows])
    lifted = _lift(sample, top)
    shards = min(MAX_SHARDS, max(4, -(-int(stats["n"]) // SHARD_ROWS)))
    pivots = lifted[_far_apart(lifted, shards)]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_lift(_matrix(b.column(1), dim), top), pivots)
            shard = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shard.astype(np.int32)), pa.array(d[np.arange(len(d)), shard])], names=["vec_id", "v", "shard", "d"])

    dealt = base.mapInArrow(nearest, "vec_id long, v array<double>, shard int, d double")
    # At most MAX_SHARDS rows.
    extents = {r["shard"]: (r["radius"], -(-r["n"] // SHARD_ROWS)) for r in dealt.groupBy("shard").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()}
    subs = F.element_at(F.create_map(*(F.lit(x).cast("int") for s, (_, n) in sorted(extents.items()) for x in (s, n))), F.col("shard"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pa.array(rows["v"]), dim)
        out = build_nodes(rows["vec_id"].to_numpy(), x, top)
        raw = lambda a: np.ascontiguousarray(a).tobytes()
        return pd.DataFrame(
            {
                "shard": key[0], "sub": key[1], "node": range(len(out)), "parent": [n["parent"] for n in out], "leaf": [n["leaf"] for n in out],
                "radius": [n["radius"] for n in out], "parent_distance": [n["parent_distance"] for n in out], "ids": [raw(n["ids"]) for n in out],
                "vectors": [raw(n["vectors"]) for n in out], "distances": [raw(n["distances"]) for n in out], "radii": [raw(n["radii"]) for n in out],
            }
        )

    nodes = settle(dealt.withColumn("sub", F.pmod(F.xxhash64("vec_id"), subs).cast("int")).groupBy("shard", "sub").applyInPandas(build, NODE), "mtree")

    def visit(key: tuple, tree: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(tree) and len(block):
            made: list[dict] = []
            for r in tree.sort_values("node").itertuples():
                ids, d = np.frombuffer(r.ids, np.int64), np.frombuffer(r.distances)
                made.append({"leaf": r.leaf, "ids": ids, "vectors": np.frombuffer(r.vectors).reshape(len(ids), -1), "distances": d, "radii": np.frombuffer(r.radii)})
            x = _matrix(pa.array(block["v"]), dim)
            for i, (own, mark, floor) in enumerate(zip(block["vec_id"].tolist(), block["mark"].tolist(), block["floor"].tolist())):
                found += [(own, mark, i_, s) for s, i_ in search(made, x[i], own, k, top, floor)]
        return pd.DataFrame(found, columns=["query_id", "mark", "vec_id", "score"])

    result = "query_id long, mark long, vec_id long, score long"
    nowhere = float("-inf")

    def route(first: bool):
        """Rows ``shard, sub, vec_id, v, floor, mark, block``: the nearest shard's first tree, or all others within the bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), dim)
                floor = b.column(2).to_numpy(zero_copy_only=False)
                d = _distances(np.concatenate([x, np.zeros((len(x), 1))], 1), pivots)
                d[:, [j for j in range(len(pivots)) if j not in extents]] = np.inf
                home = d.argmin(1)
                norm = (x * x).sum(1)
                row, shard, sub = [], [], []
                for j, (radius, n) in extents.items():
                    reach = (norm + top - np.maximum(d[:, j] - radius, 0) ** 2) / 2 + 1e-7 * (norm + top) + 1e-3
                    for s in range(n):
                        at_home = (home == j) & (s == 0)
                        of = np.flatnonzero(at_home if first else ~at_home & (reach >= floor))
                        row.append(of)
                        shard += [j] * len(of)
                        sub += [s] * len(of)
                of = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(sub, pa.int32()), *(b.column(i).take(of) for i in range(5))], names=["shard", "sub", "vec_id", "v", "floor", "mark", "block"])

        return run

    def ask(rows: DataFrame) -> DataFrame:
        trees, blocks = _blocks(nodes, rows)
        return trees.groupBy("shard", "sub", "asked_by").cogroup(blocks.groupBy("shard", "sub", "block")).applyInPandas(visit, result)

    routed = "shard int, sub int, vec_id long, v array<double>, floor double, mark long, block int"
    asked = _dealt(asked)
    home = settle(ask(asked.select("vec_id", "v", F.lit(nowhere).alias("floor"), "mark", "block").mapInArrow(route(True), routed)), "home")
    worst = home.groupBy(F.col("query_id").alias("vec_id"), "mark").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    bounded = asked.join(worst, ["vec_id", "mark"], "left").select("vec_id", "v", F.coalesce(F.col("floor").cast("double"), F.lit(nowhere)).alias("floor"), "mark", "block")
    others = ask(bounded.mapInArrow(route(False), routed))
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id")
    ranked = home.unionAll(others).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
