"""Nearest vectors with queries that grow with the table: exact blocks, cells, and graphs of neighbours.

Vectors and queries meet as blocks: both sides get a block's key, and a task multiplies one block of vectors with
one block of queries, or walks one graph for them. A task answers with k rows a query; nothing is collected.

Cases: null vectors, vectors of another length than the first one and, for cosine, vectors of zeros are never found
and find nothing; equal distances (to 9 places) go by id; equal vectors are all found; a query id that repeats
is one query; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the vectors of one block and queries of one block.
BLOCK_BYTES, QUERIES = 8 << 20, 4096
#: Bytes of the distances that a worker holds at once; one query's may be more.
HELD_BYTES = 16 << 20
FOUND = "query_id long, id long, distance double"


def _dimensions(vectors: DataFrame) -> int:
    row = vectors.where(F.size("vector") > 0).select(F.size("vector")).first()
    return row[0] if row else 0


def _matrix(column, dimensions: int) -> np.ndarray:
    """float64 matrix of an Arrow list column whose lists all have the given length."""
    import pyarrow as pa

    flat = pa.chunked_array([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy().astype(np.float64).reshape(-1, dimensions)


def _usable(df: DataFrame, dimensions: int, metric: str) -> DataFrame:
    rows = df.where(F.size("vector") == dimensions)
    return rows.where(F.exists("vector", lambda x: x != 0)) if metric == "cosine" else rows


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Matrix of the distances of every row of x to every row of q."""
    if metric == "cosine":
        return 1 - (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ q.T + (q**2).sum(1)[None], 0))


def _top(ids: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """For each column of distances, the rows of the k least; equal ones by id, to 9 places."""
    rounded = np.round(distance, 9)
    if len(ids) > 8 * k:  # all rows up to the k-th distance, then in order
        bound = np.partition(rounded, k - 1, axis=0)[k - 1]
        held = [np.flatnonzero(rounded[:, j] <= bound[j]) for j in range(rounded.shape[1])]
    else:
        held = [np.arange(len(ids))] * rounded.shape[1]
    return [h[np.lexsort((ids[h], rounded[h, j]))[:k]] for j, h in enumerate(held)]


def _answers(query_ids, ids, picked, distance):
    import pyarrow as pa

    sizes = [len(p) for p in picked]
    rows = np.concatenate(picked) if picked else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(picked)), sizes)
    return pa.table([pa.array(np.asarray(query_ids)[of], pa.int64()), pa.array(np.asarray(ids)[rows], pa.int64()), pa.array(distance[rows, of] if len(rows) else np.zeros(0))], names=["query_id", "id", "distance"])


def _block_product(k: int, dimensions: int, metric: str):
    def run(vectors, queries):
        if not len(vectors) or not len(queries):
            return _answers([], [], [], np.zeros((0, 0)))
        import pyarrow as pa

        ids, query_ids = vectors["id"].to_numpy(), queries["query_id"].to_numpy()
        x, q = _matrix(vectors["vector"], dimensions), _matrix(queries["vector"], dimensions)
        step, done = max(1, HELD_BYTES // (8 * len(x))), []
        for at in range(0, len(q), step):
            distance = distances(x, q[at : at + step], metric)
            done.append(_answers(query_ids[at : at + step], ids, _top(ids, distance, k), distance))
        return pa.concat_tables(done)

    return run


def first_k(found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest of each query, from the k nearest of each block."""
    rank = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def _dealt(rows: DataFrame, parts: Column, name: str, *by: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64(*by), parts).cast("int"))


def _everywhere(rows: DataFrame, parts: Column, name: str) -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest of ``vectors`` (id, vector) for each of ``queries`` (query_id, vector), exact.

    Every block of vectors meets every block of queries once, as exact search asks.
    """
    dimensions = _dimensions(vectors)
    lean = _usable(vectors.select(F.col("id").cast("long").alias("id"), "vector"), dimensions, metric)
    asked = _usable(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector"), dimensions, metric).dropDuplicates(["query_id"])
    n_blocks = max(-(-lean.count() * dimensions * 8 // BLOCK_BYTES), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2, 1)
    n_chunks = max(-(-asked.count() // QUERIES), 1)
    left = _everywhere(_dealt(lean, F.lit(n_blocks), "block", "id", "vector"), F.lit(n_chunks), "chunk")
    right = _everywhere(_dealt(asked, F.lit(n_chunks), "chunk", "query_id"), F.lit(n_blocks), "block")
    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(_block_product(k, dimensions, metric), FOUND)
    return first_k(found, k)


def cells_for(n: int) -> int:
    """Cells of an inverted file of n vectors: their root, so cells and their rows grow alike."""
    return max(1, round(n**0.5))


def _nearest_cells(centres: np.ndarray, probes: int):
    def run(batches):
        import pyarrow as pa

        for rows in batches:
            if not rows.num_rows:
                continue
            order = np.argsort(distances(centres, _matrix(rows["vector"], centres.shape[1]), "l2"), axis=0, kind="stable")[:probes]
            at = np.repeat(np.arange(rows.num_rows), len(order))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in rows.columns), pa.array(order.T.ravel(), pa.int32())], [*rows.schema.names, "cell"])

    return run


def probe(index: DataFrame, centres: Sequence[Sequence[float]], queries: DataFrame, k: int, probes: int, metric: str = "cosine", cell_rows: int = 1 << 14) -> DataFrame:
    """Approximate ``nearest`` over the cells nearest to each query; ``index`` is (id, vector, cell).

    The centres go to all workers: their number is the root of the table's rows (``cells_for``) or less. A cell of very many rows is cut into
    parts, and a cell that very many queries want gets them in blocks.
    """
    middle = np.array(centres, np.float64)
    dimensions = middle.shape[1]
    kind = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vector", queries.schema["vector"].dataType), T.StructField("cell", T.IntegerType())])
    asked = _usable(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector"), dimensions, metric).dropDuplicates(["query_id"]).mapInArrow(_nearest_cells(middle, probes), kind)
    lean = _usable(index.select(F.col("id").cast("long").alias("id"), "vector", "cell"), dimensions, metric)
    sizes = lean.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("parts"))
    wanted = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks"))
    both = F.broadcast(sizes.join(wanted, "cell"))  # a row a cell
    left = _everywhere(_dealt(lean.join(both, "cell"), F.col("parts"), "part", "id", "vector"), F.col("chunks"), "chunk")
    right = _everywhere(_dealt(asked.join(both, "cell"), F.col("chunks"), "chunk", "query_id"), F.col("parts"), "part")
    key = ("cell", "part", "chunk")
    found = left.select(*key, "id", "vector").groupBy(*key).cogroup(right.select(*key, "query_id", "vector").groupBy(*key)).applyInArrow(_block_product(k, dimensions, metric), FOUND)
    return first_k(found, k)


# graphs of neighbours -------------------------------------------------------------------------------------------------------


def _diverse(near: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """Marks the neighbours to keep of candidates in falling likeness: one that is closer to the node than to any kept one, then the nearest others."""
    n, c = near.shape
    kept = np.zeros((n, c), bool)
    for j in range(c):
        rival = np.where(kept, between[:, j], -np.inf).max(axis=1)
        kept[:, j] = (near[:, j] > rival) & (kept.sum(axis=1) < most)
    spare = most - kept.sum(axis=1)
    others = ~kept
    kept |= others & (np.cumsum(others, axis=1) <= spare[:, None])
    return kept


def _neighbours(x: np.ndarray, m: int, candidates: int) -> np.ndarray:
    """Matrix of the neighbours of each row (-1: none): m of its own choice, up to m that chose it, and the rows before and after it.

    The last two make a ring, so a search that is wide enough reaches every row.
    """
    n = len(x)
    own = np.full((n, m), -1, np.int32)
    take = min(candidates, n - 1)
    for at in range(0, n, 256):
        some = np.arange(at, min(at + 256, n))
        like = x[some] @ x.T
        like[np.arange(len(some)), some] = -np.inf
        near = np.argpartition(-like, take - 1, axis=1)[:, :take] if take < n - 1 else np.argsort(-like, axis=1)[:, :take]
        value = np.take_along_axis(like, near, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)
        kept = _diverse(value, np.einsum("rad,rbd->rab", x[near], x[near]), m)
        place = np.cumsum(kept, axis=1) - 1
        row, col = np.nonzero(kept)
        own[some[row], place[row, col]] = near[row, col]
    row, col = np.nonzero(own >= 0)
    source, target = own[row, col], row  # those that chose a row, the nearest first
    like = np.einsum("rd,rd->r", x[source], x[target])
    order = np.lexsort((-like, source))
    source, target = source[order], target[order]
    begin = np.searchsorted(source, source)
    back = np.full((n, m), -1, np.int32)
    place = np.arange(len(source)) - begin
    fits = place < m
    back[source[fits], place[fits]] = target[fits]
    ring = np.arange(n, dtype=np.int32)
    return np.concatenate([own, back, np.roll(ring, 1)[:, None], np.roll(ring, -1)[:, None]], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _build(dimensions: int, m: int, candidates: int, names: list[str]):
    """Worker: one shard's rows with their level and their neighbours on each level."""

    def run(rows):
        import pyarrow as pa

        x = _unit(_matrix(rows["vector"], dimensions))
        n = len(x)
        rng = np.random.default_rng(n)
        level = np.minimum(np.floor(-np.log(1 - rng.random(n)) / np.log(m)), 8).astype(np.int64)
        level[0] = max(level.max(), 1)  # where a search begins
        lists: list[list[np.ndarray]] = [[] for _ in range(n)]
        for at in range(int(level.max()) + 1):
            nodes = np.flatnonzero(level >= at)
            found = _neighbours(x[nodes], m, candidates) if len(nodes) > 1 else np.zeros((len(nodes), 0), np.int32)
            for i, near in zip(nodes.tolist(), found, strict=True):
                lists[i].append(nodes[np.unique(near[near >= 0])])
        return rows.select(["shard", *names, "vector"]).append_column("node", pa.array(np.arange(n), pa.int32())).append_column("neighbours", pa.array([[part.tolist() for part in each] for each in lists], pa.list_(pa.list_(pa.int32()))))

    return run


def graph_index(vectors: DataFrame, keep: Sequence[str] = (), shard_rows: int = 1 << 13, m: int = 16, candidates: int = 64) -> DataFrame:
    """Hierarchical navigable graphs of neighbours for cosine: (shard, id, ``keep``, vector, node, neighbours by level).

    The rows are dealt by a hash over shards of about ``shard_rows``, each with a graph of its own: a node links to ``m`` diverse ones among
    its ``candidates`` nearest, to those that chose it, and on each level up to a share of 1 / m of the nodes goes on. Adjacency
    rows are a table, so an index is stored and opened like one (``store_graph``, ``open_graph``).
    """
    dimensions = _dimensions(vectors)
    lean = _usable(vectors.select(F.col("id").cast("long").alias("id"), *keep, "vector"), dimensions, "cosine")
    n_shards = max(1, -(-lean.count() // shard_rows))
    dealt = _dealt(lean, F.lit(n_shards), "shard", "id", "vector").select("shard", "id", *keep, "vector")
    schema = T.StructType([*dealt.schema.fields, T.StructField("node", T.IntegerType()), T.StructField("neighbours", T.ArrayType(T.ArrayType(T.IntegerType())))])
    return dealt.groupBy("shard").applyInArrow(_build(dimensions, m, candidates, ["id", *keep]), schema)


def store_graph(index: DataFrame, path: str) -> None:
    """Keep a graph index, a folder a shard."""
    index.write.mode("overwrite").partitionBy("shard").parquet(path)


def open_graph(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


class _Graph:
    """The levels of one shard as matrices of neighbours."""

    def __init__(self, rows, dimensions: int):
        order = np.argsort(rows["node"].to_numpy(), kind="stable")
        rows = rows.take(order)
        self.x = _unit(_matrix(rows["vector"], dimensions))
        self.rows = rows
        lists = rows["neighbours"].to_pylist()
        self.levels = []
        for at in range(max(map(len, lists))):
            nodes = [i for i, each in enumerate(lists) if len(each) > at]
            wide = max(len(lists[i][at]) for i in nodes)
            table = np.full((len(lists), wide), -1, np.int32)
            for i in nodes:
                table[i, : len(lists[i][at])] = lists[i][at]
            self.levels.append(table)

    def descend(self, q: np.ndarray) -> np.ndarray:
        """Where each query enters the lowest level: greedy steps on the levels above."""
        at = np.zeros(len(q), np.int64)
        best = q @ self.x[0]
        for table in self.levels[:0:-1]:
            moving = np.arange(len(q))
            while len(moving):
                near = table[at[moving]]
                like = np.where(near >= 0, np.einsum("qcd,qd->qc", self.x[near], q[moving]), -np.inf)
                pick = like.argmax(axis=1) if like.shape[1] else np.zeros(len(moving), np.int64)
                value = like[np.arange(len(moving)), pick] if like.shape[1] else np.full(len(moving), -np.inf)
                better = value > best[moving]
                at[moving[better]] = near[better, pick[better]]
                best[moving[better]] = value[better]
                moving = moving[better]
        return at

    def beam(self, q: np.ndarray, width: int, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, likeness) of the ``width`` best that a best-first walk meets, for all queries at once; -1 fills up."""
        n, table = len(self.x), self.levels[0]
        start = self.descend(q)
        seen = np.zeros((len(q), n), bool)
        seen[np.arange(len(q)), start] = True
        node = np.full((len(q), width), -1, np.int64)
        like = np.full((len(q), width), -np.inf, np.float32)
        fresh = np.zeros((len(q), width), bool)
        node[:, 0], like[:, 0], fresh[:, 0] = start, np.einsum("qd,qd->q", self.x[start], q), True
        active = np.arange(len(q))
        while len(active):
            waiting = np.where(fresh[active], like[active], -np.inf)
            s = min(steps, width)
            pick = np.argpartition(-waiting, s - 1, axis=1)[:, :s]
            opened = np.take_along_axis(fresh[active], pick, axis=1)
            row = np.arange(len(active))[:, None]
            fresh[active[:, None], pick] = False
            near = np.where(opened[:, :, None], table[np.take_along_axis(node[active], pick, axis=1)], -1).reshape(len(active), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[active[:, None], near]
            a, b = np.nonzero(new)
            seen[active[a], near[a, b]] = True
            value = np.full(near.shape, -np.inf, np.float32)
            value[a, b] = np.einsum("rd,rd->r", self.x[near[a, b]], q[active[a]])
            all_like = np.concatenate([like[active], value], axis=1)
            best = np.argpartition(-all_like, width - 1, axis=1)[:, :width]
            node[active] = np.concatenate([node[active], np.where(new, near, -1)], axis=1)[row, best]
            like[active] = all_like[row, best]
            fresh[active] = np.concatenate([fresh[active], new], axis=1)[row, best]
            active = active[fresh[active].any(axis=1)]
        return node, like


def _walk(k: int, dimensions: int, width: int, passing: bool, spare: int):
    """Worker: the k best rows of one shard that pass, for each query."""

    def run(rows, queries):
        if not len(rows) or not len(queries):
            return _answers([], [], [], np.zeros((0, 0)))
        graph = _Graph(rows, dimensions)
        ids = graph.rows["id"].to_numpy()
        passes = graph.rows["passes"].to_numpy().astype(bool) if passing else np.ones(len(ids), bool)
        exact = _matrix(graph.rows["vector"], dimensions)
        wanted = min(spare * k, int(passes.sum()))
        names, vectors = queries["query_id"].to_numpy(), _matrix(queries["vector"], dimensions)
        out_query, out_id, out_distance = [], [], []
        for at in range(0, len(names), 128):
            todo, wide = np.arange(at, min(at + 128, len(names))), min(max(width, k), len(ids))
            while len(todo) and wanted:
                node, _ = graph.beam(_unit(vectors[todo]), wide)
                good = (node >= 0) & passes[node]
                done = (good.sum(axis=1) >= wanted) | (wide == len(ids))  # all rows are reached at the full width
                for i, these, these_good in zip(todo[done], node[done], good[done], strict=True):
                    held = these[these_good]
                    distance = distances(exact[held], vectors[i : i + 1], "cosine")
                    pick = _top(ids[held], distance, k)[0]
                    out_query.append(np.full(len(pick), names[i]))
                    out_id.append(ids[held[pick]])
                    out_distance.append(distance[pick, 0])
                todo, wide = todo[~done], min(2 * wide, len(ids))
        import pyarrow as pa

        one = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table([one(out_query, pa.int64()), one(out_id, pa.int64()), one(out_distance, pa.float64())], names=["query_id", "id", "distance"])

    return run


def graph_nearest(index: DataFrame, queries: DataFrame, k: int, width: int = 128, passes: Column | None = None, spare: int = 4) -> DataFrame:
    """Approximate (query_id, id, distance, rank) of the k nearest by cosine, from a graph index.

    ``width`` is the number of rows that a walk keeps in view. With ``passes``, a condition on the columns of the index, the walk widens
    by twice until ``spare`` * k rows in view pass, at last to the whole shard: k rows come whenever k pass, nearest first, and a walk of
    full width is the exact search.
    """
    dimensions = _dimensions(queries)
    asked = _usable(queries.select(F.col("query_id").cast("long").alias("query_id"), "vector"), dimensions, "cosine").dropDuplicates(["query_id"])
    n_chunks = max(-(-asked.count() // QUERIES), 1)
    lean = index.select("shard", "id", "vector", "node", "neighbours", *([F.coalesce(passes, F.lit(False)).alias("passes")] if passes is not None else []))
    left = _everywhere(lean, F.lit(n_chunks), "chunk")
    shards = index.select("shard").distinct().agg(F.collect_list("shard").alias("shards"))  # a number for some thousands of vectors
    right = _dealt(asked, F.lit(n_chunks), "chunk", "query_id").crossJoin(F.broadcast(shards)).withColumn("shard", F.explode("shards")).drop("shards")  # one row
    found = left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(_walk(k, dimensions, width, passes is not None, spare), FOUND)
    return first_k(found, k)
