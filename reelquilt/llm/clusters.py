"""Similarity clusters of records: hashed weighted features, distributed k-means, links within a radius.

Features (long rows of record, feature, value) are hashed into vectors of fixed size.  k-means with parallel oversampled
seeding divides the records into cells.  :func:`describe` reports cells with their size and most typical members;
:func:`linked_groups` finds the groups of records that are linked by distances of at most a radius, using the cells to
compare each record only with those that can be near it: hashing is linear, so records within the radius stay within the
radius times the hashing's norm, and a record is also sent to every other cell whose border is that close.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from reelquilt.llm import kmeans
from reelquilt.llm.batches import codes, glued, groups
from reelquilt.llm.components import components
from reelquilt.llm.vectors import lists, matrix, square_distances
from reelquilt.operators import linalg
from reelquilt.plans.materialize import cut


class FeatureHash:
    """Signed hashing of named features into ``size`` buckets, each feature with a weight."""

    def __init__(self, features: list, weights: list[float] | None = None, size: int = 64, seed: int = 1234):
        self.features, self.size = features, size
        self.matrix = np.zeros((len(features), size))
        for i, f in enumerate(features):
            h = xxhash.xxh64_intdigest(repr(f), seed=seed)
            self.matrix[i, h % size] = (1 if h >> 63 else -1) * (1.0 if weights is None else weights[i])
        #: How much longer than the features' distance a hashed distance can be.
        self.norm = float(np.linalg.norm(self.matrix, 2)) if features else 1.0


def _numbers(column: pa.Array) -> np.ndarray:
    """Versions as numbers that compare like them, null below all others."""
    if pa.types.is_temporal(column.type):
        column = column.cast(pa.int64())
    if pa.types.is_floating(column.type):
        return np.nan_to_num(pc.fill_null(column, -np.inf).to_numpy(zero_copy_only=False), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _newest(record: np.ndarray, feature: np.ndarray, version: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rows that count: of each record and feature the one with the greatest version, then the greatest value (NaN last)."""
    order = np.lexsort([np.nan_to_num(value, nan=-np.inf), version, feature, record])
    last = np.ones(len(order), dtype=bool)
    r, f = record[order], feature[order]
    last[:-1] = (r[1:] != r[:-1]) | (f[1:] != f[:-1])
    return order[last]


def feature_vectors(rows: DataFrame, features: list, *, record: str, feature: str, value: str, version: str | None = None, complete: bool = True) -> DataFrame:
    """``id`` and ``x``, the values of ``features`` in their order, for records that have a value for every one of them.

    Without ``complete`` for all records that have any value; for one that is missing stands the feature's mean over all
    records that have it (0 if none has).

    Of several rows of a record and feature the one with the greatest ``version`` (a number or a time) counts, then the
    greatest value; if its value is null or NaN the record has none.  Null records and features, and features not listed,
    are ignored.  Rows are reduced to those that may count before they are shuffled, so a record that is repeated very
    often is no hot spot.
    """
    place = F.array_position(F.array(*map(F.lit, features)), F.col(feature)) if features else F.lit(0)
    own = rows.select(F.col(record).alias("id"), (place - 1).cast("int").alias("f"), (F.col(version) if version else F.lit(0)).alias("t"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("v"))
    own = own.where(F.col("id").isNotNull() & (F.col("f") >= 0))
    lists_of = T.StructType([own.schema["id"], *(T.StructField(c, T.ArrayType(own.schema[c].dataType)) for c in ("f", "t", "v"))])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = codes(batch.column(0))
            order = _newest(k, batch.column(1).to_numpy(zero_copy_only=False), _numbers(batch.column(2)), pc.fill_null(batch.column(3), np.nan).to_numpy(zero_copy_only=False))
            heads = np.flatnonzero(np.diff(k[order], prepend=-1))
            offsets, take = pa.array(np.append(heads, len(order)).astype(np.int32)), pa.array(order)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take.take(pa.array(heads))), *(pa.ListArray.from_arrays(offsets, batch.column(i).take(take)) for i in (1, 2, 3))], names=lists_of.names)

    m = len(features)
    kind = T.StructType([own.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def vectors(part: pa.RecordBatch) -> pa.RecordBatch:
        heads, group = groups(part, 1)
        owner = group[np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False))]
        f, t, v = (pc.list_flatten(part.column(i)) for i in (1, 2, 3))
        f, v = f.to_numpy(zero_copy_only=False), pc.fill_null(v, np.nan).to_numpy(zero_copy_only=False)
        order = _newest(owner, f, _numbers(t), v)
        x = np.full((len(heads), m), np.nan)
        x[owner[order], f[order]] = v[order]
        there = ~np.isnan(x)
        some = np.flatnonzero(there.all(axis=1) if complete else there.any(axis=1))
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(heads[some])), lists(x[some])], names=kind.names)

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None  # the last record, which may go on
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                both = batch.slice(at, 1024) if waiting is None else glued(waiting, batch.slice(at, 1024))
                last = int(groups(both, 1)[0][-1])
                if last:
                    yield vectors(both.slice(0, last))
                waiting = both.slice(last)
        if waiting is not None:
            yield vectors(waiting)

    held = own.mapInArrow(pack, lists_of).repartition("id").sortWithinPartitions("id").mapInArrow(unpack, kind)
    if complete:
        return held
    held = cut(held)
    means = {r["j"]: r["v"] for r in held.select(F.posexplode("x").alias("j", "v")).where(~F.isnan("v")).groupBy("j").agg(F.avg("v").alias("v")).collect()}
    return held.select("id", F.zip_with("x", F.array(*(F.lit(means.get(j, 0.0)) for j in range(m))), lambda a, b: F.nanvl(a, b)).alias("x"))


def inverse_deviations(rows: DataFrame, size: int) -> list[float]:
    """A weight per feature of ``x``, so that squared differences count by their inverse variance; 1 without variance."""
    variances = np.diag(linalg.moments(rows, "x", size).covariance)
    return [float(v**-0.5) if v > 1e-24 else 1.0 for v in np.where(variances > 1e-13 * (1 + variances), variances, 0.0)]


def hashed(rows: DataFrame, hashing: FeatureHash) -> DataFrame:
    """Adds ``h``, the hashed weighted vector of ``x``."""
    shared = rows.sparkSession.sparkContext.broadcast(hashing.matrix)
    at = rows.columns.index("x")
    schema = T.StructType([*rows.schema.fields, T.StructField("h", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(matrix(batch.column(at), len(shared.value)) @ shared.value)], names=schema.names)

    return rows.mapInArrow(run, schema)


def fit_cells(rows: DataFrame, size: int, k: int, *, rounds: int = 4, seed: int = 1234) -> np.ndarray:
    """Centres of k-means over ``h``: k-means|| seeds, then distributed Lloyd rounds."""
    return kmeans.refine(rows, "h", size, kmeans.seeds(rows, "h", size, k, seed=seed), rounds)


def describe(rows: DataFrame, size: int, centres: np.ndarray, *, typical: int = 5) -> DataFrame:
    """``cluster``, ``n_members``, ``radius`` (greatest distance) and ``typical``, the ids nearest to the centre, nearest first.

    ``h`` decides on the cluster; distances are those of ``x`` from the members' mean, so that features which share a
    bucket still count apart.
    """
    placed = cut(kmeans.assign(rows.select("id", "x", "h"), "h", size, centres).select("id", "x", "cluster"))
    means = placed.select("cluster", F.posexplode("x").alias("j", "v")).groupBy("cluster", "j").agg(F.avg("v").alias("v"))
    means = means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("mean"))
    square = F.aggregate(F.zip_with("x", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e)
    own = cut(placed.join(F.broadcast(means), "cluster").select("id", "cluster", F.sqrt(square).alias("distance")))
    near = own.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy("distance", "id"))).where(F.col("r") <= typical)
    tops = near.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda e: e["id"]).alias("typical"))
    return own.groupBy("cluster").agg(F.count("*").alias("n_members"), F.max("distance").alias("radius")).join(tops, "cluster")


def labelled_clusters(vectors: DataFrame, hashing: FeatureHash, labels: DataFrame, *, k: int, rounds: int = 4, typical: int = 5, seed: int = 1234) -> DataFrame:
    """Clusters of ``vectors`` (``id``, ``x``) beside the ``label`` of their members (``id``, ``label``).

    Adds to :func:`describe` the most frequent label (``top_label``, on a tie the smallest; null without any) and the
    share of the members that carry it.  A member with several labels counts for each of them; null labels don't count.
    """
    rows = cut(hashed(vectors, hashing))
    centres = fit_cells(rows, hashing.size, k, rounds=rounds, seed=seed)
    if not len(centres):
        centres = np.zeros((1, hashing.size))
    placed = kmeans.assign(rows.select("id", "h"), "h", hashing.size, centres).select("id", "cluster")
    votes = placed.join(labels.where("label is not null").select("id", "label"), "id").groupBy("cluster", "label").agg(F.count("*").alias("votes"))
    tops = votes.groupBy("cluster").agg(F.max(F.struct("votes", (-F.col("label")).alias("minus"))).alias("s"))
    tops = tops.select("cluster", (-F.col("s.minus")).alias("top_label"), F.col("s.votes").alias("votes"))
    return describe(rows, hashing.size, centres, typical=typical).join(tops, "cluster", "left").withColumn("top_share", F.coalesce(F.col("votes") / F.col("n_members"), F.lit(0.0))).drop("votes")


class _Forest:
    """Union-find over a numpy array; the root of a tree is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flatten(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite a[i] with b[i]; only pairs of different trees cost more than a numpy pass."""
        root = self.flatten()
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        pairs = np.unique(np.minimum(ra[apart], rb[apart]) * len(root) + np.maximum(ra[apart], rb[apart]))
        parent = self.parent
        for low, high in zip((pairs // len(root)).tolist(), (pairs % len(root)).tolist()):
            while parent[low] != low:
                low = parent[low]
            while parent[high] != high:
                high = parent[high]
            if low != high:
                parent[max(low, high)] = min(low, high)


def local_groups(x: np.ndarray, radius: float, block: int = 2048) -> np.ndarray:
    """Component label of each point, linked at distances of at most ``radius``; the label is a point of the component.

    Points are first covered by balls of half the radius around some of them; a ball's points are all linked, so a crowd
    costs one pass however large it is.  A point that reaches another ball's centre is linked to that ball; only where
    a point lies between one and one and a half radii from a centre does it have to be compared with the ball's members.
    """
    n = len(x)
    forest = _Forest(n)
    half, limit, unsure_limit = (radius / 2) ** 2, radius * radius * (1 + 1e-9) + 1e-15, (1.5 * radius) ** 2 * (1 + 1e-9)
    ball = np.full(n, -1)
    heads: list[int] = []
    left = np.arange(n)
    while len(left) and len(heads) < 256:  # balls while they pay, crowds first
        probe = left[np.unique(np.linspace(0, len(left) - 1, 32).astype(np.int64))]
        counts = (square_distances(x[probe], x[left]) <= half).sum(axis=1)
        if counts.max() < 16:
            break
        head = int(probe[counts.argmax()])
        inside = square_distances(x[left], x[head : head + 1])[:, 0] <= half
        forest.join(left[inside], np.full(int(inside.sum()), head))
        ball[left[inside]] = len(heads)
        heads.append(head)
        left = left[~inside]
    for at in range(0, len(left), 64):
        rows = left[at : at + 64]
        for other in range(at, len(left), block):
            cols = left[other : other + block]
            i, j = np.nonzero(square_distances(x[rows], x[cols]) <= limit)
            forest.join(rows[i], cols[j])
    for b, head in enumerate(heads):
        own, rest = np.flatnonzero(ball == b), np.flatnonzero(ball != b)
        d = square_distances(x[rest], x[head : head + 1])[:, 0]
        linked = rest[d <= limit]
        forest.join(linked, np.full(len(linked), head))
        unsure = rest[(d > limit) & (d <= unsure_limit)]
        reach = np.sqrt(square_distances(x[own], x[head : head + 1])[:, 0])
        for at in range(0, len(unsure), 256):
            rows = unsure[at : at + 256]
            root = forest.flatten()
            rows = rows[root[rows] != root[head]]
            if not len(rows):
                continue
            gap = np.sqrt(square_distances(x[rows], x[head : head + 1])[:, 0]).min() - radius
            outer = own[reach >= gap - 1e-9]
            hit = np.zeros(len(rows), dtype=bool)
            for start in range(0, len(outer), block):
                hit |= (square_distances(x[rows], x[outer[start : start + block]]) <= limit).any(axis=1)
            forest.join(rows[hit], np.full(int(hit.sum()), head))
    return forest.flatten()


def _borders(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far each row is from the border between its own (nearest) centre's cell and each other's; 0 for its own.

    Two rows of different cells lie on different sides of the border between them, so the sum of their distances from it
    is at most their own distance, and one of the two at most half of that: it is enough to send rows to the cells whose
    border is within half the radius.
    """
    d = square_distances(x, centres)
    home = d.argmin(axis=1)
    apart = np.sqrt(square_distances(centres, centres))
    border = (d - d[np.arange(len(d)), home][:, None]) / (2 * np.maximum(apart[home], 1e-12))
    border[np.arange(len(d)), home] = 0
    return border


def _crowds(x: np.ndarray, radius: float, least: int, most: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Points around which at least ``least`` others lie within half the radius, densest first; what none of them covers."""
    half, left, heads = (radius / 2) ** 2, np.arange(len(x)), []
    while len(left) >= least and len(heads) < most:
        inside = square_distances(x[left], x[left]) <= half
        at = int(inside.sum(axis=1).argmax())
        if inside[at].sum() < least:
            break
        heads.append(left[at])
        left = left[~inside[at]]
    return np.array(heads, dtype=np.int64), left


def _fit_division(points: np.ndarray, ids: np.ndarray, n: int, radius: float, max_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a cell of ``n`` rows is divided, by a sample of it: ids and vectors of its crowds' heads, centres for the rest."""
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order]
    heads, rest = _crowds(points, radius, max(16, len(ids) // 50))
    parts = int(np.clip(-(-4 * n * len(rest) // max(len(ids), 1) // max_rows), 1, 256))
    return ids[heads], points[heads], kmeans.mini_batch(points[rest], parts, seed=seed) if len(rest) else np.zeros((1, points.shape[1]))


def _roles(x: np.ndarray, who: np.ndarray, head_ids: np.ndarray, heads: np.ndarray, sub: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """(rows, part, role) of some rows of a cell that is divided around ``heads`` and into the cells of ``sub``."""
    reach = radius * (1 + 1e-9)
    loose = np.ones(len(x), dtype=bool)
    if len(heads):
        d = np.sqrt(square_distances(x, heads))
        home = d.argmin(axis=1)
        member = d[np.arange(len(x)), home] <= radius / 2
        loose = ~member
        is_head = np.isin(who, head_ids)
        # a head sits at rounding distance 0 from itself, so it is a member of its own crowd
        yield np.flatnonzero(member & ~is_head), home[member & ~is_head], "member"
        yield np.flatnonzero(member & is_head), home[member & is_head], "head"
        elsewhere = (home[:, None] != np.arange(len(heads))[None, :]) | loose[:, None]
        yield *np.nonzero(elsewhere & (d <= reach)), "near"
        yield *np.nonzero(elsewhere & (d > reach) & (d <= 1.5 * reach)), "ring"
    rows = np.flatnonzero(loose)
    if len(rows):
        r, c = np.nonzero(_borders(x[rows], sub) <= reach / 2 + 1e-9)
        yield rows[r], c, "loose"


def _bounded_groups(placed: DataFrame, n_features: int, radius: float, max_rows: int, seed: int, sample_rows: int = 2048, chunk_rows: int = 65_536) -> DataFrame:
    """``cell`` (a name), ``id``, ``x``: the rows of each cell, cells of more than ``max_rows`` rows divided into smaller groups.

    Two linked rows of a cell still share a group, or each is linked within its group to a row that both groups have.
    A large cell is divided on the evidence of a sample of about ``sample_rows`` of its rows, fitted in a task of its own:
    around the heads of its crowds, and into smaller cells (a second level of k-means) for the rest.  A crowd's rows
    (within half the radius of its head) are all linked to the head, which stands in every group of the crowd, so they can
    be divided at will; other rows within the radius of the head join one of those groups, rows within one and a half
    radii meet all of the crowd.  What is still too large is compared in pairs of parts.  Plans stay in the cluster: a
    cell's own goes to the tasks that divide its rows, ``chunk_rows`` in each.
    """
    named = lambda df: df.select(F.col("cell").cast("string").alias("cell"), "id", "x")
    counts = cut(placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > max_rows))
    if counts.isEmpty():
        return named(placed)
    counts = F.broadcast(counts)  # one row per cell, of which there are at most rows / max_rows
    scale = 1 << 30
    large = placed.join(counts, "cell")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(scale)) <= F.floor(F.lit(float(scale * sample_rows)) / F.col("n"))
    key = placed.schema["id"]
    numbers = T.ArrayType(T.DoubleType())
    plan_kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("head_ids", T.ArrayType(key.dataType)), T.StructField("heads", numbers), T.StructField("sub", numbers)])

    def fit(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        n = table.column("n")[0].as_py()
        head_ids, heads, sub = _fit_division(matrix(table.column("x"), n_features), ids.to_numpy(zero_copy_only=False), n, radius, max_rows, seed)
        return pa.table([table.column("cell").slice(0, 1), pa.array([n]), pa.array([head_ids], pa.list_(ids.type)), pa.array([heads.ravel()]), pa.array([sub.ravel()])], names=plan_kind.names)

    plans = large.where(drawn).groupBy("cell").applyInArrow(fit, plan_kind)
    chunks = F.ceil(F.col("n") / F.lit(chunk_rows)).cast("int")
    plans = plans.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("n")
    spread = large.select("cell", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), chunks).cast("int").alias("chunk"), "id", "x")
    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("role", T.StringType()), key, placed.schema["x"]])

    def divide(rows: pa.Table, plan: pa.Table) -> pa.Table:
        head_ids, heads, sub = np.zeros(0), np.zeros((0, n_features)), np.zeros((1, n_features))
        if plan.num_rows:
            head_ids, heads, sub = (np.array(plan.column(c)[0].as_py() or [], dtype=None if c == "head_ids" else np.float64) for c in ("head_ids", "heads", "sub"))
            heads, sub = heads.reshape(-1, n_features), sub.reshape(-1, n_features)
        out = []
        own = pa.table([rows.column(c) for c in ("cell", "id", "x")], names=["cell", "id", "x"]).combine_chunks()
        for start in range(0, own.num_rows, 2048):
            piece = own.slice(start, 2048)
            for r, part, role in _roles(matrix(piece.column("x"), n_features), piece.column("id").to_numpy(), head_ids, heads, sub, radius):
                take = pa.array(r)
                out.append(pa.table([piece.column("cell").take(take), pa.array(np.asarray(part, dtype=np.int32)), pa.array([role] * len(r), pa.string()), piece.column("id").take(take), piece.column("x").take(take)], names=kind.names))
        return pa.concat_tables(out)

    roles = cut(spread.groupBy("cell", "chunk").cogroup(plans.groupBy("cell", "chunk")).applyInArrow(divide, kind))
    # only parts with more than max_rows rows of a role, so at most rows / max_rows of them, are divided further
    held = roles.groupBy("cell", "part").agg(*(F.count_if(F.col("role") == role).alias(role) for role in ("loose", "member", "ring")))
    parts_of = lambda c: F.ceil(F.col(c) / F.lit(max_rows)).cast("int")
    crowded = held.where(F.greatest("loose", "member", "ring") > max_rows).select("cell", "part", *(parts_of(c).alias(f"n_{c}") for c in ("loose", "member", "ring")))
    sized = roles.join(F.broadcast(cut(crowded)), ["cell", "part"], "left")
    count = lambda c: F.greatest(F.coalesce(F.col(f"n_{c}"), F.lit(1)), F.lit(1))
    one = lambda c: F.array(F.pmod(F.xxhash64(F.lit(seed), "id"), count(c)).cast("int"))
    every = lambda c: F.sequence(F.lit(0), count(c) - 1)
    # crowds: groups (chunk of members, chunk of the ring); loose rows: pairs of chunks i <= j
    first = F.when(F.col("role").isin("member", "near"), one("member")).otherwise(every("member"))
    second = F.when(F.col("role").isin("ring", "near"), one("ring")).otherwise(every("ring"))
    crowd = sized.where("role != 'loose'").withColumn("i", F.explode(first)).withColumn("j", F.explode(second))
    pairs = sized.where("role = 'loose'").withColumn("mine", one("loose")[0]).withColumn("other", F.explode(every("loose")))
    pairs = pairs.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    named_group = lambda df, mark: df.select(F.concat_ws("-", F.lit(mark), "cell", "part", "i", "j").alias("cell"), "id", "x")
    rest = named(placed.join(counts, "cell", "left_anti"))
    return rest.unionByName(named_group(crowd, "c")).unionByName(named_group(pairs, "l"))


def linked_groups(
    vectors: DataFrame,
    n_features: int,
    radius: float,
    *,
    hashing: FeatureHash | Callable[[DataFrame], FeatureHash],
    cell_rows: int = 400,
    max_cells: int = 1024,
    max_rows: int = 20_000,
    seed: int = 1234,
) -> DataFrame:
    """``id``, ``group_id`` (the smallest id of its group) and ``group_size`` of every record of ``id``, ``x``.

    Two records are linked when their distance is at most ``radius``, a group is everything linked directly or through
    others.  ``hashing`` (or what it makes of the kept rows) decides on the cells alone, exact distances of ``x`` on the
    links.  Copies of one vector are compared once; no task compares more than about twice ``max_rows`` records, however
    many of them crowd together.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    key = vectors.schema["id"].dataType
    # copies of a vector are told by 128 bits of hash, so that vectors are shuffled once
    all_rows = cut(vectors.select("id", "x", F.xxhash64("x").alias("one"), F.xxhash64(F.lit(seed), "x").alias("two")))
    hashing = hashing if isinstance(hashing, FeatureHash) else hashing(all_rows)
    heads = all_rows.groupBy("one", "two").agg(F.min(F.struct("id", "x")).alias("s")).select("one", "two", F.col("s.id").alias("id"), F.col("s.x").alias("x"))
    reps = cut(hashed(heads, hashing))
    n = reps.count()
    if not n:
        return spark.createDataFrame([], T.StructType([T.StructField("id", key), T.StructField("group_id", key), T.StructField("group_size", T.LongType())]))
    k = int(np.clip(n // cell_rows, 1, max_cells))
    centres = fit_cells(reps, hashing.size, k, rounds=2, seed=seed)
    shared = spark.sparkContext.broadcast(centres)
    reach = radius * hashing.norm * (1 + 1e-9) + 1e-9
    kind = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", key), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def to_cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, cell = np.nonzero(_borders(matrix(part.column(2), hashing.size), shared.value) <= reach / 2)
                for b in range(0, len(row), 4096):
                    take = pa.array(row[b : b + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[b : b + 4096].astype(np.int32)), part.column(0).take(take), part.column(1).take(take)], names=kind.names)

    placed = _bounded_groups(cut(reps.select("id", "x", "h").mapInArrow(to_cells, kind)), n_features, radius, max_rows, seed)

    def link(table: pa.Table) -> pa.Table:
        ids = table.column("id").combine_chunks()
        root = local_groups(matrix(table.column("x"), n_features), radius)
        # the smallest id of each local group stands for it
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        least: dict[int, int] = {}
        for i in order:
            least.setdefault(int(root[i]), int(i))
        return pa.table([ids, ids.take(pa.array([least[int(r)] for r in root], pa.int64()))], names=["id", "rep"])

    local = cut(placed.groupBy("cell").applyInArrow(link, T.StructType([T.StructField("id", key), T.StructField("rep", key)])).distinct())
    # A record in several cells joins their local groups; only those have to be followed through the graph.
    joint = local.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps"))
    edges = joint.select("a", F.explode("reps").alias("b"))
    roots = components(edges.where("a != b"))
    grouped = joint.select("id", "a").join(roots, F.col("a") == F.col("node"), "left").select("id", F.coalesce("root", "a").alias("root"))
    by_vector = reps.select("id", "one", "two").join(grouped, "id").select("one", "two", "root")
    members = cut(all_rows.select("id", "one", "two").join(by_vector, ["one", "two"]).select("id", "root"))
    sizes = members.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return members.join(sizes, "root").select("id", "group_id", "group_size")
