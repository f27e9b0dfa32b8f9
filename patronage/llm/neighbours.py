"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node.  Vectors get one more component, so that all are of the
largest length and nearness by inner product is nearness by angle; queries get a 0 there.

*Graph*: nodes are sorted into cells by the signs of random projections and see their
cell once, which gives a first list of ``DEGREE`` neighbours each.  Then, ``ROUNDS`` times,
NN-descent: a node's neighbours, and the nodes that it is a neighbour of, meet at the node
by Spark joins, are compared with one another, and each keeps the nearest it has met.  Of
the nodes that it is a neighbour of a node takes ``REVERSE``, those with the least hash,
so a hub is bounded; this is what makes the graph approximate.

*Search*: a query walks the graph.  It holds the ``BEAM`` best nodes it has seen; in each
step the best ``WIDTH`` whose neighbours it has not seen are opened by joins.  It stops
when no opened node gave a better beam, or after ``STEPS``.

Graph and walk compare codes, a byte per given component, their scale, and what the added
component lacks of the largest length; only codes are shipped to where nodes meet.  The
added component has no part in the scale, in the cells or in a query's score, so one very
long vector does not blur the others.  The nodes of the last beam are scored anew: inner
products in double precision on the vectors as given.

Defined results: a vector that is NULL, zero, or holds NULL, NaN or infinite components
takes no part; nor does one with another length than most (the smaller of equals); rows
with NULL id take no part; of rows that share an id and a vector one counts; with too few
candidates all of them come; no rows give none.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.llm.common import stage

DEGREE = 32
REVERSE = 32
CELL = 512
PROJECTIONS = 4
ROUNDS = 3
BEAM = 192
WIDTH = 32
STEPS = 9
SEED = 23


def valid_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, ``v`` as doubles."""
    v = F.col(vector).cast("array<double>")
    huge = float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < huge)) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(key).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def _digest(vector: str) -> Column:
    return F.sha2(F.to_json(F.struct(F.col(vector).alias("v"))), 256)


def members_all(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, digest), a row for each id: of several vectors the one with the least digest."""
    marked = valid_vectors(rows, key, vector).withColumn("digest", _digest("v"))
    return marked.groupBy("id").agg(F.min(F.struct("digest", "v")).alias("m")).select("id", "m.v", "m.digest")


def nodes_of(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors as nodes, and the ``keep`` smallest ids of each node.

    A node's number is its smallest id.
    """
    marked = stage(vectors.select("id", "v", _digest("v").alias("digest")).dropDuplicates(["id", "digest"]), "vectors")
    place = Window.partitionBy("digest").orderBy("id")
    few = marked.withColumn("place", F.row_number().over(place)).where(F.col("place") <= keep)
    few = stage(few.withColumn("node", F.min("id").over(Window.partitionBy("digest"))), "members")
    return few.where("place = 1").select("node", "v"), few.select("node", "id")


def _augment(nodes: DataFrame) -> DataFrame:
    """(node, v, lacks): ``v`` in units of the largest length, and 1 less the added component.

    The added component of short vectors is so near 1 that only what it lacks tells them apart.
    """
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = nodes.agg(F.max(square)).first()[0] or 1.0
    unit = F.lit(float(np.sqrt(longest)))
    part = F.least(square / F.lit(longest), F.lit(1.0))
    lacks = part / (F.lit(1.0) + F.sqrt(F.lit(1.0) - part))
    return nodes.select("node", F.transform("v", lambda x: (x / unit).cast("float")).alias("v"), lacks.cast("float").alias("lacks"))


def encode(v: np.ndarray, lacks: np.ndarray) -> list[bytes]:
    """What the added component lacks, a scale and a byte per given component of each row."""
    scale = np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-30).astype("<f4")
    small = np.rint(v / scale * 127).astype(np.int8)
    heads = np.column_stack([lacks.astype("<f4"), scale])
    return [a.tobytes() + b.tobytes() for a, b in zip(heads, small, strict=True)]


def decode(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The given components, and what the added one lacks."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    heads = raw[:, :8].copy().view("<f4")
    return raw[:, 8:].view(np.int8).astype(np.float32) * (heads[:, 1:] / 127), heads[:, 0]


def _near(codes: list[bytes]) -> np.ndarray:
    """Inner products of the longer vectors, less 1; -inf for a row with itself."""
    v, lacks = decode(codes)
    near = v @ v.T - lacks[:, None] - lacks[None, :] + lacks[:, None] * lacks[None, :]
    np.fill_diagonal(near, -np.inf)
    return near


def _codes(nodes: DataFrame) -> DataFrame:
    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"node": frame["node"], "code": encode(_matrix(frame["v"]), frame["lacks"].to_numpy())})

    return nodes.mapInPandas(make, "node long, code binary")


def _best(candidates: DataFrame) -> DataFrame:
    """(node, list) from (node, other, near): the nearest ``DEGREE`` others of each node."""
    distinct = candidates.groupBy("node", "other").agg(F.max("near").alias("near"))
    order = Window.partitionBy("node").orderBy(F.desc("near"), "other")
    return distinct.withColumn("place", F.row_number().over(order)).where(F.col("place") <= DEGREE).drop("place")


def _all_pairs_near(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    k = min(DEGREE, len(ids) - 1)
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(near, at, 1).ravel()


def first_lists(codes: DataFrame, n_nodes: int, dimensions: int) -> DataFrame:
    """Neighbours within cells of at most about ``CELL`` nodes, for each projection."""
    bits = max(0, int(np.ceil(np.log2(max(n_nodes, 1) / CELL))) + 1)
    planes = np.random.default_rng(SEED).normal(size=(PROJECTIONS, bits, dimensions)).astype(np.float32)

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            v, _ = decode(list(frame["code"]))
            for p in range(PROJECTIONS):
                code = (v @ planes[p].T > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(v), np.int64)
                yield pd.DataFrame({"node": frame["node"], "code": frame["code"], "cell": code * PROJECTIONS + p})

    split = codes.mapInPandas(cells, "node long, code binary, cell long")
    # a crowded cell is dealt out by hash: later rounds join what this parts
    counts = split.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / (2 * CELL))
    split = split.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(SEED)), parts))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["node"].to_numpy()
        if len(ids) < 2:
            return pd.DataFrame({"node": ids[:0], "other": ids[:0], "near": np.zeros(0)})
        node, other, near = _all_pairs_near(ids, _near(list(frame["code"])))
        return pd.DataFrame({"node": node, "other": other, "near": near.astype(float)})

    return split.groupBy("cell", "part").applyInPandas(compare, "node long, other long, near double")


def descend(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """One round: neighbours meet at the node they share and are compared."""
    mix = F.xxhash64("node", "other", F.lit(SEED))
    back = Window.partitionBy("other").orderBy(mix)
    reverse = (
        graph.withColumn("place", F.row_number().over(back))
        .where(F.col("place") <= REVERSE)
        .select(F.col("other").alias("at"), F.col("node").alias("member"))
    )
    forward = graph.select(F.col("node").alias("at"), F.col("other").alias("member"))
    met = forward.unionByName(reverse).distinct()
    # what a pair has to beat to be of use to its first node
    worst = graph.groupBy("node").agg(F.min("near").alias("worst"), F.count(F.lit(1)).alias("n"))
    known = codes.join(worst, "node", "left").select(
        F.col("node").alias("member"),
        "code",
        F.when(F.col("n") >= DEGREE, F.col("worst")).otherwise(-4.0).alias("worst"),
    )
    groups = (
        met.join(known, "member")
        .groupBy("at")
        .agg(F.collect_list(F.struct("member", "code", "worst")).alias("met"))
        .select("met.member", "met.code", "met.worst")
    )

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[np.ndarray, ...]] = []
            for ids, code, worst in zip(frame["member"], frame["code"], frame["worst"], strict=True):
                near = _near(list(code))
                a, b = np.nonzero(near > worst.astype(np.float32)[:, None])
                out.append((ids[a], ids[b], near[a, b].astype(float)))
            if out:
                node, other, value = (np.concatenate(c) for c in zip(*out, strict=True))
                found = pd.DataFrame({"node": node, "other": other, "near": value})
                yield found.drop_duplicates(["node", "other"])

    found = groups.mapInPandas(compare, "node long, other long, near double")
    return stage(_best(graph.unionByName(found)), "graph")


def build_graph(codes: DataFrame, dimensions: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, other, near): for each node of (node, code) its nearest others, about."""
    graph = stage(_best(first_lists(codes, codes.count(), dimensions)), "graph")
    for _ in range(rounds):
        graph = descend(graph, codes)
    return graph


def search(queries: DataFrame, graph: DataFrame, codes: DataFrame, steps: int = STEPS) -> DataFrame:
    """(query, node) of the best ``BEAM`` nodes found for (query, q, entry) rows.

    ``entry`` is an array of nodes to start at.
    """
    lists = stage(graph.groupBy("node").agg(F.collect_list("other").alias("others")), "lists")
    beam = "nodes array<long>, scores array<float>, open array<boolean>, ask array<long>, seen array<long>"
    state = queries.select(
        "query", "q",
        *[F.array().cast(f"array<{t}>").alias(n) for n, t in (("nodes", "bigint"), ("scores", "float"), ("open", "boolean"))],
        F.col("entry").alias("ask"), F.array().cast("array<bigint>").alias("seen"),
    )

    def advance(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                nodes, scores, open_ = r.nodes, r.scores, r.open.astype(bool)
                new = r.met if r.met is not None else np.zeros(0, np.int64)
                if len(new):
                    near = decode(list(r.code))[0] @ np.asarray(r.q, np.float32)
                    nodes, scores = np.append(nodes, new), np.append(scores, near)
                    open_ = np.append(open_, np.ones(len(new), bool))
                best = np.lexsort((nodes, -scores))[:BEAM]
                nodes, scores, open_ = nodes[best], scores[best], open_[best]
                chosen = np.flatnonzero(open_)[:WIDTH]
                open_[chosen] = False
                rows.append((r.query, r.q, nodes, scores, open_, nodes[chosen], np.append(r.seen, new)))
            yield pd.DataFrame(rows, columns=["query", "q", "nodes", "scores", "open", "ask", "seen"])

    for step in range(steps + 1):
        asked = state.select("query", F.explode("ask").alias("node"))
        if step:
            opened = asked.join(lists, "node").groupBy("query").agg(
                F.array_distinct(F.flatten(F.collect_list("others"))).alias("near")
            )
            asked = opened.join(state.select("query", "seen"), "query").select(
                "query", F.explode(F.array_except("near", "seen")).alias("node")
            )
        met = (
            asked.select("query", "node").distinct()
            .join(codes, "node")
            .groupBy("query")
            .agg(F.collect_list(F.struct("node", "code")).alias("m"))
            .select("query", F.col("m.node").alias("met"), "m.code")
        )
        state = stage(state.join(met, "query", "left").mapInPandas(advance, f"query long, q array<float>, {beam}"), "beams")
        if state.where(F.size("ask") > 0).isEmpty():
            break
    return state.select("query", F.explode("nodes").alias("node"))


def nearest_neighbours(
    rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that ``is_query`` holds for, the nearest others.

    ``is_query`` is over the column ``id``.  A query starts at its own node.
    """
    nodes, members = nodes_of(valid_vectors(rows, key, vector), k + 1)
    nodes = stage(nodes, "nodes")
    longer = stage(_augment(nodes), "longer")
    codes = stage(_codes(longer), "codes")
    dimensions = longer.agg(F.max(F.size("v"))).first()[0] or 1
    graph = build_graph(codes, dimensions)
    asking = members_all(rows, key, vector).where(is_query)
    own = stage(asking.join(nodes.select("node", _digest("v").alias("digest")), "digest"), "queries")
    queries = own.select(
        F.col("id").alias("query"), F.col("v").cast("array<float>").alias("q"), F.array("node").alias("entry")
    )
    found = search(queries, graph, codes)
    product = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = (
        found.join(nodes.withColumnRenamed("v", "w"), "node")
        .join(own.select(F.col("id").alias("query"), "v"), "query")
        .select("query", "node", product.alias("score"))
    )
    named = scored.join(members, "node").where(F.col("id") != F.col("query"))
    named = named.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (
        named.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
    )
