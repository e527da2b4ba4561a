"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search.

Equal vectors are one node.  The graph starts from exact neighbours inside small random
blocks; each round joins a node's neighbours with one another and keeps the nearest.
Graph and search use vectors shortened to 16 bits a component; the distances returned
are of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import cut_lineage

NEIGHBOURS = 32
#: Reverse neighbours that take part, drawn anew each round.
REVERSE = 32
BLOCK = 128
BLOCK_ROUNDS = 3
MAX_ROUNDS = 7
#: Rounds end when the summed distance falls by less than this share.
LEAST_GAIN = 0.002
BEAM = 160
EXPAND = 20
ENTRIES = 8


def pack(values: np.ndarray) -> np.ndarray:
    """float32 rounded to its upper 16 bits, as uint16."""
    bits = np.clip(values, -1e18, 1e18).astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16)


def unpack(packed: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(packed), np.uint16).reshape(len(packed), -1)
    return (data.astype(np.uint32) << np.uint32(16)).view(np.float32)


def usable(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, v): vectors of finite numbers, not all zero, and their ids."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def nodes_of(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, dim, vec) and members (node, vec_id) of a table from ``usable``.

    A node is named by the smallest id of its equal vectors; of these the ``keep`` smallest
    ids are members, which is all that a search for fewer can return.
    """
    key = ["h1", "h2"]
    marked = vectors.select("vec_id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).distinct()
    ranked = marked.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("k") <= keep)
    first = ranked.where("k = 1").select(*key, F.col("vec_id").alias("node"))
    members = cut_lineage(ranked.join(first, key).select("node", "vec_id"), "members")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(x.values.to_numpy()).tobytes() for x in batch.column("v")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("dim"), pa.array(packed, pa.binary())], names=["node", "dim", "vec"])

    firsts = vectors.join(members.where("node = vec_id").select("node").distinct(), F.col("vec_id") == F.col("node"), "left_semi")
    rows = firsts.dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("node"), F.size("v").alias("dim"), "v")
    return cut_lineage(rows.mapInArrow(shorten, "node bigint, dim int, vec binary"), "nodes"), members


def nearest(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest different neighbours of each node."""
    once = edges.groupBy("node", "nbr").agg(F.min("d").alias("d"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("d", "nbr"))).where(F.col("k") <= most).drop("k")


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T)


def _block_neighbours(table: pa.Table) -> pa.Table:
    ids = table.column("node").to_numpy()
    d = _square_distances(*[unpack(table.column("vec").to_pylist())] * 2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :NEIGHBOURS]
    a = np.repeat(np.arange(len(ids)), near.shape[1])
    b = near.ravel()
    ok = np.isfinite(d[a, b])
    return pa.table({"node": ids[a[ok]], "nbr": ids[b[ok]], "d": d[a, b][ok].astype(np.float32)})


def _adjacent(graph: DataFrame, seed: int) -> DataFrame:
    """(c, v): neighbours of c, and up to REVERSE nodes that have c as neighbour."""
    back = graph.select(F.col("nbr").alias("c"), F.col("node").alias("v"))
    drawn = Window.partitionBy("c").orderBy(F.xxhash64("v", F.lit(seed)), "v")
    back = back.withColumn("k", F.row_number().over(drawn)).where(F.col("k") <= REVERSE).drop("k")
    return graph.select(F.col("node").alias("c"), F.col("nbr").alias("v")).union(back)


def _join_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of members of one list that are nearer than a member's farthest neighbour."""
    for batch in batches:
        parts = []
        for members in batch.column("members"):
            flat = members.values
            ids, at = np.unique(flat.field("v").to_numpy(), return_index=True)
            most = flat.field("most").to_numpy()[at]
            d = _square_distances(*[unpack(flat.field("vec").take(pa.array(at)).to_pylist())] * 2)
            np.fill_diagonal(d, np.inf)
            i, j = np.nonzero(d < most[:, None])
            parts.append((ids[i], ids[j], d[i, j].astype(np.float32)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["node", "nbr", "d"])


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """(node, nbr, d) with up to NEIGHBOURS neighbours a node; d is the squared distance.

    Only vectors of one length are neighbours.  Each round is one join per neighbour of a
    neighbour; its result is stored, so a lost executor costs part of one round.
    """
    edges = "node bigint, nbr bigint, d float"
    n = max(1, nodes.count())
    blocks = -(-n // BLOCK)
    starts = nodes.select("*", F.explode(F.array(*map(F.lit, range(BLOCK_ROUNDS)))).alias("r"))
    starts = starts.withColumn("block", F.pmod(F.xxhash64("node", "r"), F.lit(blocks)))
    graph = cut_lineage(nearest(starts.groupBy("dim", "r", "block").applyInArrow(_block_neighbours, edges), NEIGHBOURS), "graph")
    total = None
    for step in range(MAX_ROUNDS if blocks > 1 else 0):
        most = graph.groupBy("node").agg(F.when(F.count("*") < NEIGHBOURS, float("inf")).otherwise(F.max("d")).cast("float").alias("most"))
        points = nodes.join(most, "node").select(F.col("node").alias("v"), "most", "vec")
        lists = _adjacent(graph, step).join(points, "v").groupBy("c").agg(F.collect_list(F.struct("v", "most", "vec")).alias("members"))
        found = lists.select("members").mapInArrow(_join_members, edges)
        graph = cut_lineage(nearest(graph.union(found), NEIGHBOURS), "graph")
        now = graph.agg(F.sum("d"), F.count("*")).first()
        if total and total[1] == now[1] and now[0] > total[0] * (1 - LEAST_GAIN):
            break
        total = now
    return graph


def _search_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge found candidates into each query's beam and name the next nodes to expand."""
    for batch in batches:
        out: dict[str, list] = {"ids": [], "d": [], "done": [], "todo": []}
        rows = zip(batch.column("vec"), batch.column("ids"), batch.column("d"), batch.column("done"), batch.column("todo"), batch.column("found"))
        for vec, ids, d, done, todo, found in rows:
            ids, d = ids.values.to_numpy(), d.values.to_numpy()
            done = np.isin(ids, todo.values.to_numpy()) | np.array(done.as_py(), bool)
            if found.is_valid:
                new = found.values.field("v").to_numpy()
                fresh = ~np.isin(new, ids)
                if fresh.any():
                    near = _square_distances(unpack([vec.as_py()]), unpack(found.values.field("vec").filter(pa.array(fresh)).to_pylist()))[0]
                    ids, d = np.concatenate([ids, new[fresh]]), np.concatenate([d, near.astype(np.float32)])
                    done = np.concatenate([done, np.zeros(int(fresh.sum()), bool)])
            best = np.lexsort((ids, d))[:BEAM]
            ids, d, done = ids[best], d[best], done[best]
            for name, value in (("ids", ids), ("d", d), ("done", done), ("todo", ids[~done][:EXPAND])):
                out[name].append(value)
        types = {"ids": pa.int64(), "d": pa.float32(), "done": pa.bool_(), "todo": pa.int64()}
        columns = [pa.array([list(x) for x in out[k]], pa.list_(t)) for k, t in types.items()]
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("vec"), *columns], names=["q", "vec", *types])


STATE = "q bigint, vec binary, ids array<bigint>, d array<float>, done array<boolean>, todo array<bigint>"


def greedy_search(queries: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(q, node): the beam of each query (q, start, vec) when no node of it is left to expand.

    All queries advance together: a round joins the nodes to expand with the graph and the
    vectors of what they lead to.  Searches start at ``start`` and at a few fixed nodes.
    """
    links = cut_lineage(_adjacent(graph, -1).groupBy("c").agg(F.collect_set("v").alias("nbrs")), "adjacent")
    entries = [r["node"] for r in nodes.orderBy(F.xxhash64("node")).limit(ENTRIES).select("node").collect()]
    none = F.array()
    first = F.array_distinct(F.concat(F.array("start"), F.array(*map(F.lit, entries)).cast("array<bigint>")))
    found = queries.select("q", F.explode(first).alias("v"))
    state = queries.select("q", "vec", none.cast("array<bigint>").alias("ids"), none.cast("array<float>").alias("d"), none.cast("array<boolean>").alias("done"), none.cast("array<bigint>").alias("todo"))
    while True:
        at = found.join(nodes.select(F.col("node").alias("v"), F.col("vec").alias("nvec"), "dim"), "v")
        at = at.join(queries.select("q", F.col("dim").alias("qdim")), "q").where("dim = qdim")
        at = at.groupBy("q").agg(F.collect_list(F.struct("v", F.col("nvec").alias("vec"))).alias("found"))
        state = cut_lineage(state.join(at, "q", "left").mapInArrow(_search_step, STATE), "beams")
        if not state.where(F.size("todo") > 0).limit(1).count():
            return state.select("q", F.explode("ids").alias("node"))
        open_nodes = state.select("q", F.explode("todo").alias("c"))
        found = open_nodes.join(links, "c").select("q", F.explode("nbrs").alias("v")).distinct()


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def search_table(vectors: DataFrame, every: int = 100, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The ``k`` nearest other rows of each row whose id is divisible by ``every``.

    Returns query_id, rank, vec_id, score (Euclidean distance).  Rows with a null id, and
    vectors that are null, empty, zero or hold null or non-finite parts take no part; only
    vectors of the query's length are candidates.  Ties go to the smaller id; a repeated
    row counts once.
    """
    rows = cut_lineage(usable(vectors, vector, vec_id), "vectors")
    nodes, members = nodes_of(rows, k + 1)
    graph = neighbour_graph(nodes)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"]).select(
        F.col("vec_id").alias("q"), F.col("v").alias("qv"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    firsts = rows.join(members.where("node = vec_id").select("node").distinct(), F.col("vec_id") == F.col("node"), "left_semi").dropDuplicates(["vec_id"])
    named = firsts.select(F.col("vec_id").alias("start"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    queries = asked.join(named, ["h1", "h2"]).join(nodes.withColumnRenamed("node", "start"), "start")
    queries = cut_lineage(queries.select("q", "start", "vec", "dim", "qv"), "queries")
    beams = greedy_search(queries, nodes, graph)
    exact = beams.join(firsts.select(F.col("vec_id").alias("node"), "v"), "node").join(queries.select("q", "qv"), "q")
    exact = exact.select("q", "node", euclidean(F.col("v"), F.col("qv")).alias("score"))
    hits = exact.join(members, "node").where("vec_id <> q")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
