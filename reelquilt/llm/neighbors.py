"""The k most similar vectors of every vector: vantage-point trees per shard, with relaxed pruning.

Vectors are compared by cosine; trees use the Euclidean distance of the unit vectors, which has the same order.  The
first levels of the tree are fitted on a bounded sample; where that makes too few shards of the wanted size, each of its
leaves is divided further by a sample of its own, fitted in a task, so that the number of shards grows with the collection
(up to the square of a sample's leaves).  Every row goes to its shard, and every shard (in chunks of bounded size, should
it be larger) builds the rest of its tree.  A query visits the shards and subtrees
that the triangle inequality can't rule out.  ``factor`` scales the radius in that test: at 1 the search is exact, below
1 it visits less and may miss neighbours near a boundary.

Of many copies of one vector only the first ``k + 1`` ids are ever anyone's neighbours, as ties go to the smaller id, so
only those are indexed and searched; further copies take over what follows from their vector alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from reelquilt.llm.vectors import common_size, lists, matrix, unit_rows, usable
from reelquilt.plans.materialize import cut

FAR = 2.0  # the largest distance of unit vectors


@dataclass
class Node:
    point: np.ndarray | None = None
    split: float = 0.0
    ranges: tuple = ()
    near: "Node | None" = None
    far: "Node | None" = None
    rows: np.ndarray | None = None
    leaf: int = -1


@dataclass
class VpTree:
    """Vantage-point tree over unit vectors; ``leaves`` counts its leaves."""

    root: Node = field(default_factory=Node)
    leaves: int = 0


def distance(a: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ point), 0))


def build(vectors: np.ndarray, leaf_rows: int, seed: int = 1234) -> VpTree:
    """Split at the median distance to a vantage point until ``leaf_rows`` are left, or until nothing can be told apart."""
    tree, rng = VpTree(), np.random.default_rng(seed)

    def grow(rows: np.ndarray) -> Node:
        if len(rows) > leaf_rows:
            tries = rows[rng.integers(len(rows), size=4)]
            probe = vectors[rows[rng.integers(len(rows), size=min(len(rows), 64))]]
            point = vectors[max(tries, key=lambda i: float(np.var(distance(probe, vectors[i]))))]
            d = distance(vectors[rows], point)
            split = float(np.median(d))
            inside = d <= split
            if inside.all():
                inside = d < split
            if inside.any() and not inside.all():
                a, b = d[inside], d[~inside]
                return Node(point, split, ((a.min(), a.max()), (b.min(), b.max())), grow(rows[inside]), grow(rows[~inside]))
        tree.leaves += 1
        return Node(rows=rows, leaf=tree.leaves - 1)

    tree.root = grow(np.arange(len(vectors)))
    return tree


def route(tree: VpTree, vectors: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the one leaf each vector falls into (reach None), or of all leaves within its reach."""
    rows, leaves = [], []

    def go(node: Node, active: np.ndarray) -> None:
        if not len(active):
            return
        if node.rows is not None:
            rows.append(active), leaves.append(np.full(len(active), node.leaf))
            return
        d = distance(vectors[active], node.point)
        margin = 0.0 if reach is None else reach[active]
        # The sample's ranges don't bound the rows, so only the split does.
        go(node.near, active[d - margin <= node.split])
        go(node.far, active[d + margin > node.split])

    go(tree.root, np.arange(len(vectors)))
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, dtype=np.int64),) * 2


def grafted(top: VpTree, below: dict[int, VpTree]) -> VpTree:
    """A tree whose leaves are divided further by the trees that ``below`` has for them; leaves are numbered anew."""
    out = VpTree()

    def copied(node: Node, divide: bool) -> Node:
        if node.rows is None:
            return Node(node.point, node.split, node.ranges, copied(node.near, divide), copied(node.far, divide))
        if divide and node.leaf in below:
            return copied(below[node.leaf].root, False)
        out.leaves += 1
        return Node(rows=np.zeros(0, dtype=np.int64), leaf=out.leaves - 1)

    out.root = copied(top.root, True)
    return out


def fit_router(index: DataFrame, n: int, d: int, *, chunk_rows: int, sample_rows: int, seed: int) -> VpTree:
    """Vantage-point tree with about a leaf for each ``chunk_rows`` of the ``n`` rows (``id``, ``z``).

    Two levels of samples of at most twice ``sample_rows`` rows, each of which makes leaves of 64 sampled rows at least;
    the tree is sent to the executors, of which the square of a sample's leaves is the bound.
    """
    spark, scale, least = index.sparkSession, 1 << 30, 64
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(scale))
    sample = index.where(drawn < int(min(1.0, sample_rows / max(n, 1)) * scale)).select("id", "z").limit(2 * sample_rows).toArrow().sort_by("id")
    points = unit_rows(matrix(sample.column("z"), d))
    wanted = max(1, -(-n // chunk_rows))
    tree = build(points, max(least, -(-len(points) // wanted)), seed)
    if wanted <= tree.leaves or -(-len(points) // wanted) >= least:
        return tree
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                r, leaf = route(shared.value, unit_rows(matrix(part.column(1), d)), None)
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), part.column(0).take(take), part.column(1).take(take)], names=["leaf", "id", "z"])

    placed = cut(index.select("id", "z").mapInArrow(place, T.StructType([T.StructField("leaf", T.IntegerType()), index.schema["id"], index.schema["z"]])))
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") > chunk_rows)  # a row for each of the top's leaves
    some = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(scale))

    def divide(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = unit_rows(matrix(table.column("z"), d))
        below = build(x, max(least, -(-len(x) * chunk_rows // table.column("m")[0].as_py())), seed)
        return pa.table([table.column("leaf").slice(0, 1), pa.array([pickle.dumps(below)])], names=["leaf", "tree"])

    chosen = placed.join(F.broadcast(sizes), "leaf").where(some < F.floor(F.lit(float(scale * sample_rows)) / F.col("m")))
    found = chosen.groupBy("leaf").applyInArrow(divide, "leaf int, tree binary").collect()
    return grafted(tree, {r["leaf"]: pickle.loads(r["tree"]) for r in found})


#: Pairs of a query and a row that are compared one by one in double precision; more of them are compared as matrices.
PAIRS = 50_000


class ShardSearch:
    """Best ``k`` of one chunk's rows for batches of queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float, max_distance: float, leaf_rows: int = 512):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.k, self.factor, self.max_distance = ids[order], vectors[order], k, factor, max_distance
        self.tree = build(self.vectors, leaf_rows)
        self.single = self.vectors.astype(np.float32)

    def search(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, cosine) of the best k other ids of each query, at most ``max_distance`` (or ``bound``) away."""
        n, k, single = len(queries), self.k, queries.astype(np.float32)
        limit = np.full(n, self.max_distance) if bound is None else np.minimum(bound, self.max_distance)
        top = np.full((n, k), -2.0)
        who = np.full((n, k), len(self.ids), dtype=np.int64)
        reach = limit.copy()

        def leaf(node: Node, active: np.ndarray) -> None:
            for at in range(0, len(active), 2048):
                rows = active[at : at + 2048]
                least = np.maximum(1 - limit[rows] ** 2 / 2 - 1e-12, top[rows, -1])
                # single precision tells which pairs are worth a look, double precision decides
                q, j = np.nonzero(single[rows] @ self.single[node.rows].T >= (least - 1e-5).astype(np.float32)[:, None])
                hit = node.rows[j]
                keep = self.ids[hit] != own[rows[q]]
                q, hit = q[keep], hit[keep]
                if len(q) > PAIRS:
                    c = (queries[rows] @ self.vectors[node.rows].T)[q, j[keep]]
                else:
                    c = np.einsum("ij,ij->i", queries[rows[q]], self.vectors[hit])
                good = c >= least[q]
                q, hit, c = q[good], hit[good], np.round(c[good], 12)
                if not len(q):
                    continue
                touched = np.unique(q)
                # old and new candidates in one list, best first, ties by the smaller id (rows are in order of ids)
                cand_q = np.concatenate([q, np.repeat(touched, k)])
                cand_c = np.concatenate([c, top[rows[touched]].ravel()])
                cand_w = np.concatenate([hit, who[rows[touched]].ravel()])
                order = np.lexsort((cand_w, -cand_c, cand_q))
                cand_q, cand_c, cand_w = cand_q[order], cand_c[order], cand_w[order]
                rank = np.arange(len(cand_q)) - np.searchsorted(cand_q, cand_q)
                good = rank < k
                top[rows[cand_q[good]], rank[good]] = cand_c[good]
                who[rows[cand_q[good]], rank[good]] = cand_w[good]
                full = top[rows, -1] > -2
                reach[rows] = np.where(full, np.minimum(limit[rows], np.sqrt(np.maximum(2 - 2 * top[rows, -1], 0))), limit[rows])

        def go(node: Node, active: np.ndarray) -> None:
            if not len(active):
                return
            if node.rows is not None:
                leaf(node, active)
                return
            d = distance(queries[active], node.point)
            (a0, a1), (b0, b1) = node.ranges
            near_first = d <= node.split
            slack = 1e-9

            def within(part: np.ndarray, dist: np.ndarray, low: float, high: float) -> np.ndarray:
                r = self.factor * reach[part] + slack
                return part[(dist + r >= low) & (dist - r <= high)]

            first, second = active[near_first], active[~near_first]
            go(node.near, within(first, d[near_first], a0, a1))
            go(node.far, within(second, d[~near_first], b0, b1))
            go(node.far, within(first, d[near_first], b0, b1))
            go(node.near, within(second, d[~near_first], a0, a1))

        go(self.tree.root, np.arange(n))
        q, j = np.nonzero(top > -2)
        return q, self.ids[who[q, j]], np.minimum(top[q, j], 1.0)


@dataclass
class Prepared:
    """Vectors ready to be searched: ``id``, ``z`` (as given), ``u`` (at length 1)."""

    rows: DataFrame
    size: int | None


def prepare(df: DataFrame, *, item: str, vector: str, size: int | None = None) -> Prepared:
    """One unit vector per id; null ids and vectors that aren't usable take no part, of several the smallest counts."""
    own = df.select(F.col(item).alias("id"), F.col(vector).alias("z"))
    size = size if size is not None else common_size(own, "z")
    kept = own.where(F.col("id").isNotNull() & usable(F.col("z"), size)).select("id", F.col("z").cast("array<double>").alias("z"))
    rows = kept.groupBy("id").agg(F.min("z").alias("z"))
    schema = T.StructType([*rows.schema.fields, T.StructField("u", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(unit_rows(matrix(batch.column(1), size)))], names=schema.names)

    return Prepared(rows.mapInArrow(run, schema), size)


def nearest(
    df: DataFrame,
    k: int,
    *,
    item: str,
    vector: str,
    size: int | None = None,
    queries=None,
    min_cosine: float | None = None,
    factor: float = 0.5,
    chunk_rows: int = 32_768,
    sample_rows: int = 16_384,
    all_copies: bool = True,
    seed: int = 1234,
) -> DataFrame:
    """Neighbours of each query: ``<item>_a`` (query), ``<item>_b``, ``cosine``, ``rank`` from 1; ties by the smaller id.

    Every id is indexed; ``queries`` is a condition on ``id`` (all, if None).  Only neighbours of at least ``min_cosine``
    come out, if given, which also bounds the search.  Ids are whole numbers; null ids, and vectors that are null, of
    another ``size`` (by default the most frequent), all zero or hold a null, NaN or infinite value, take no part.  An id
    counts once however often it is repeated (with its smallest vector, should they differ).  ``all_copies`` False leaves
    out the queries that are further copies of a vector with ``k`` + 1 smaller ids.  An empty table gives no rows.
    """
    spark = df.sparkSession
    key = df.schema[item].dataType
    ready = prepare(df, item=item, vector=vector, size=size)
    copies = W.partitionBy("h", "g").orderBy("id")
    d = ready.size
    out_cols = lambda x: x.select(F.col("a").cast(key).alias(f"{item}_a"), F.col("b").cast(key).alias(f"{item}_b"), "cosine", "rank")
    if d is None:
        return spark.createDataFrame([], T.StructType([T.StructField(f"{item}_a", key), T.StructField(f"{item}_b", key), T.StructField("cosine", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    # Copies are told by 128 bits of hash of the unit vector.  What is shuffled is the vector as given, which has fewer
    # digits as a rule; it is brought to length 1 where it is used.
    base = ready.rows.select("id", "z", F.xxhash64("u").alias("h"), F.xxhash64(F.lit(seed), "u").alias("g"))
    base = cut(base) if all_copies else base
    index = cut(base.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select(F.col("id").cast("long").alias("id"), "z"))
    n = index.count()
    tree = fit_router(index, n, d, chunk_rows=chunk_rows, sample_rows=sample_rows, seed=seed)
    shared = spark.sparkContext.broadcast(tree)
    limit = FAR if min_cosine is None else float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    asked = index.where(queries) if queries is not None else index

    def sharded(rows: DataFrame, bounded: bool, home: bool) -> DataFrame:
        fields = [T.StructField("shard", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("bound", T.DoubleType())]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    bound = part.column(2).to_numpy(zero_copy_only=False)
                    r, leaf = route(shared.value, unit_rows(matrix(part.column(1), d)), None if home else factor * bound)
                    for b in range(0, len(r), 4096):
                        take = pa.array(r[b : b + 4096])
                        yield pa.RecordBatch.from_arrays([pa.array(leaf[b : b + 4096].astype(np.int32)), part.column(0).take(take), part.column(1).take(take), part.column(2).take(take)], names=["shard", "id", "z", "bound"])

        held = rows if bounded else rows.withColumn("bound", F.lit(limit))
        return held.select("id", "z", "bound").mapInArrow(run, T.StructType(fields))

    def searched(at: DataFrame) -> DataFrame:
        """(a, b, cosine) found in the shards that the rows of ``at`` were sent to."""
        own = sharded(index, False, True)
        if tree.leaves > 1:
            own = cut(own)
            at = cut(at)
        held = {r["shard"]: r["n"] for r in own.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        asks = {r["shard"]: r["n"] for r in at.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        plan = [(s, -(-m // chunk_rows), -(-asks.get(s, 0) // chunk_rows) or 1) for s, m in held.items()]
        plan = spark.createDataFrame(plan or [(0, 1, 1)], "shard int, chunks int, salts int")
        chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
        salt = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("salts"))
        series = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        rows = own.join(F.broadcast(plan), "shard").select("shard", chunk.cast("int").alias("chunk"), series("salts").alias("salt"), F.lit(0).alias("asks"), "id", "z", "bound")
        asked_rows = at.join(F.broadcast(plan), "shard").select("shard", series("chunks").alias("chunk"), salt.cast("int").alias("salt"), F.lit(1).alias("asks"), "id", "z", "bound")
        both = rows.unionByName(asked_rows).repartition("shard", "chunk", "salt").sortWithinPartitions("shard", "chunk", "salt", "asks")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, ids, vectors, engine = None, [], [], None
            for batch in batches:
                places = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
                heads = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]).any(axis=1)])) if len(places) else []
                for a, b in zip(heads, [*heads[1:], len(places)]):
                    part = batch.slice(a, b - a)
                    if (now := tuple(places[a, :3])) != place:
                        place, ids, vectors, engine = now, [], [], None
                    own_ids = part.column(4).to_numpy(zero_copy_only=False)
                    if not places[a, 3]:
                        ids.append(own_ids), vectors.append(unit_rows(matrix(part.column(5), d)))
                        continue
                    if engine is None:
                        if not ids:
                            continue
                        # with a bound few pairs are kept, and comparing more of them at once costs less than telling them apart
                        engine = ShardSearch(np.concatenate(ids), np.concatenate(vectors), k, factor, limit, 512 if min_cosine is None else 2048)
                        ids, vectors = [], []
                    for at in range(0, part.num_rows, 4096):
                        piece = part.slice(at, 4096)
                        mine = piece.column(4).to_numpy(zero_copy_only=False)
                        q, other, cos = engine.search(unit_rows(matrix(piece.column(5), d)), mine, piece.column(6).to_numpy(zero_copy_only=False) + 1e-9)
                        yield pa.RecordBatch.from_arrays([pa.array(mine[q]), pa.array(other), pa.array(cos)], names=["a", "b", "cosine"])

        return both.mapInArrow(run, "a long, b long, cosine double")

    best = W.partitionBy("a").orderBy(F.desc("cosine"), "b")
    top = lambda x: x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if min_cosine is not None or tree.leaves == 1:
        found = searched(sharded(asked, False, tree.leaves == 1))
    else:
        home = cut(top(searched(sharded(asked, False, True))))
        radius = home.where(F.col("rank") == k).select(F.col("a").alias("id"), F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))).alias("bound"))
        bounded = asked.join(radius, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(limit)))
        found = searched(sharded(bounded, True, False)).unionByName(home.select("a", "b", "cosine")).distinct()
    out = top(found)
    if all_copies:
        marked = base.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
        heads = marked.groupBy("h", "g").agg(F.max("copy").alias("m"), F.sort_array(F.collect_list(F.struct("copy", F.col("id").cast("long").alias("b")))).alias("first")).where(F.col("m") == k + 1)
        salts = max(32, spark.sparkContext.defaultParallelism * 4)
        heads = heads.select("h", "g", F.element_at("first", k + 1)["b"].alias("last"), F.slice("first", 1, k).alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        others = (base.where(queries) if queries is not None else base).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        more = others.join(heads, ["h", "g", "salt"]).where(F.col("id") > F.col("last")).select(F.col("id").cast("long").alias("a"), F.explode("first").alias("x"))
        more = more.select("a", F.col("x.b").alias("b"), F.lit(1.0).alias("cosine"), F.col("x.copy").alias("rank")).where(F.lit(min_cosine is None or min_cosine <= 1))
        out = out.unionByName(more)
    return out_cols(out)


def mutual_pairs(df: DataFrame, k: int, *, item: str, vector: str, min_cosine: float, factor: float = 0.5, size: int | None = None, **options) -> DataFrame:
    """Pairs of at least ``min_cosine`` where each is among the other's ``k`` nearest: ``<item>_a`` < ``<item>_b``."""
    found = nearest(df, k, item=item, vector=vector, min_cosine=min_cosine, factor=factor, size=size, all_copies=False, **options)
    a, b = f"{item}_a", f"{item}_b"
    pair = found.where(F.col("cosine") >= min_cosine).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b))
    return pair.groupBy(a, b).agg(F.count("*").alias("n")).where("n = 2").select(a, b)
