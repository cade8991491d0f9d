"""Are compilations interchangeable?  Representativeness metrics and an omnibus permutation test.

Everything a metric needs is a mean over the members of a set, or over pairs of them, of numbers that depend on the pool
alone.  So samples are a table (slot, rep, idx), the pool's numbers are joined to it and one aggregation gives all four
metrics of all replicates.  Each replicate draws with a generator of its own, seeded by (seed, replicate): the same on any
number of partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquilt.functions.vectors import distance, squared_distance
from reelquilt.operators.linalg import matrix_of
from reelquilt.plans.materialize import cut
from reelquilt.plans.ranking import number_from_zero

#: Rows of the pool that are sent to the executors at once, and the largest pool that is sent whole.
BLOCK_ROWS = 16_384
LOCAL_POOL_BYTES = 64 << 20
METRICS = ("variance_capture", "mean_pairwise_distance", "centroid_shift", "mmd")


def member_pool(members: DataFrame, embedding: DataFrame, pool: str = "members") -> DataFrame:
    """``idx`` and ``z`` of the distinct videos in any compilation (or of the whole ``library``)."""
    if pool not in ("members", "library"):
        raise ValueError("pool must be 'members' or 'library'")
    rows = embedding.select(F.col("video_idx").alias("idx"), "z")
    return rows if pool == "library" else rows.join(members.select(F.col("video_idx").alias("idx")).distinct(), "idx", "left_semi")


def pool_reference(pool: DataFrame) -> DataFrame:
    """One row: ``n_videos, n_dimensions, mu`` (array) and ``var_global``, the mean squared distance to ``mu``."""
    cells = pool.select("idx", F.posexplode("z").alias("j", "v"))
    by_dim = cells.groupBy("j").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"), F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda e: e["m"])
    return by_dim.agg(F.max("n").alias("n_videos"), F.count("*").alias("n_dimensions"), ordered.alias("mu"), F.sum("s").alias("var_global"))


def hash_rank(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *parts))


def draw(rng: np.random.Generator, total: int, n: int, m: int) -> np.ndarray:
    """``m`` rows of ``n`` distinct places below ``total`` (all of them, if there are fewer than ``n``)."""
    n = min(n, total)
    if n * n > total:
        return rng.random((m, total)).argsort(axis=1)[:, :n]
    out = rng.integers(total, size=(m, n))
    while True:  # draws with a repeat are thrown away whole, which keeps all sets equally likely
        ordered = np.sort(out, axis=1)
        again = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
        if not len(again):
            return out
        out[again] = rng.integers(total, size=(len(again), n))


def draws(sizes: list[tuple[int, int]], total: int, rep: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and places of one replicate, a matrix for each size."""
    rng = np.random.default_rng([seed, rep])
    by_size: dict[int, list[int]] = {}
    for slot, n in sorted(sizes):
        by_size.setdefault(n, []).append(slot)
    for n in sorted(by_size):
        yield np.array(by_size[n]), draw(rng, total, n, len(by_size[n]))


def _replicates(spark, reps: int) -> DataFrame:
    return spark.range(reps).repartition(max(1, min(reps, spark.sparkContext.defaultParallelism * 4)))


def sampled(numbers: "PoolNumbers", sizes: list[tuple[int, int]], reps: int, seed: int) -> DataFrame:
    """``slot, rep, idx``: for each (slot, n) and replicate ``n`` distinct rows of the pool, all of it if it has fewer."""
    total = numbers.n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                for slots, places in draws(sizes, total, rep, seed):
                    columns = np.repeat(slots, places.shape[1]), np.full(places.size, rep), places.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "rep", "place"])

    drawn = _replicates(numbers.pool.sparkSession, reps).mapInArrow(run, "slot long, rep long, place long")
    return drawn.join(numbers.pool.select("place", "idx"), "place").select("slot", "rep", "idx")


def drawn_metrics(numbers: "PoolNumbers", sizes: list[tuple[int, int]], reps: int, seed: int, local_bytes: int | None = None) -> DataFrame:
    """:func:`set_metrics` of random sets.

    A pool of up to ``local_bytes`` is sent to the executors and each replicate is drawn and measured there, without any
    shuffle; a larger one is joined to the draws.  Both draw the same sets.
    """
    spark = numbers.pool.sparkSession
    local_bytes = LOCAL_POOL_BYTES if local_bytes is None else local_bytes
    if numbers.n * (numbers.dimensions + 2) * 8 > local_bytes:
        return set_metrics(sampled(numbers, sizes, reps, seed), numbers)
    held = numbers.pool.select("place", "idx", "z").join(numbers.rows.select("idx", "a", "r"), "idx").orderBy("place").toArrow()
    z = np.array(held.column("z").to_pylist(), dtype=float).reshape(numbers.n, -1)
    shared = spark.sparkContext.broadcast((z, held.column("a").to_numpy(), held.column("r").to_numpy()))
    total, var, sigma, kernel_mean = numbers.n, numbers.var, numbers.sigma, numbers.kernel_mean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, a, r = shared.value
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                for slots, places in draws(sizes, total, rep, seed):
                    m, n = places.shape
                    x = z[places]
                    squares = (x * x).sum(axis=2)
                    i, j = np.triu_indices(n, 1)
                    d2 = np.maximum(squares[:, i] + squares[:, j] - 2 * np.matmul(x, x.transpose(0, 2, 1))[:, i, j], 0)
                    mean_a = a[places].mean(axis=1)
                    kss = (n + 2 * np.exp(-d2 / (2 * sigma * sigma)).sum(axis=1)) / (n * n)
                    columns = (
                        slots,
                        np.full(m, rep),
                        np.full(m, n),
                        mean_a / var if var > 0 else np.zeros(m),
                        np.sqrt(d2).mean(axis=1) if n > 1 else np.zeros(m),
                        np.sqrt(np.maximum(mean_a - d2.sum(axis=1) / (n * n), 0)),
                        np.sqrt(np.maximum(kss - 2 * r[places].mean(axis=1) + kernel_mean, 0)),
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "rep", "size", *METRICS])

    return _replicates(spark, reps).mapInArrow(run, "slot long, rep long, size long, " + ", ".join(f"{m} double" for m in METRICS))


def median_sigma(pool: DataFrame, seed: int, sample: int = 100) -> float:
    """Median distance of pairs among at most ``sample`` hashed rows of the pool; 1 without pairs or if they coincide."""
    some = pool.orderBy(hash_rank(seed, F.lit("sigma"), F.col("idx").cast("string")), "idx").limit(sample)
    some = cut(some)
    pairs = some.alias("a").join(some.alias("b"), F.col("a.idx") < F.col("b.idx"))
    value = pairs.agg(F.median(distance(F.col("a.z"), F.col("b.z")))).first()[0]
    return float(value) if value else 1.0


class PoolNumbers:
    """What the metrics need of a pool: squared deviation and mean kernel of each row, and pair numbers on demand.

    Exact kernel means over the pool are the only quadratic step; they take one pass over the pool per block of its rows.
    ``kernel_features`` replaces them by means over so many random Fourier features, which take two passes in all; a
    row's mean is then off by about 1 / sqrt(2 * ``kernel_features``) at most, in the same way for all sets.
    """

    def __init__(self, pool: DataFrame, sigma: float, kernel_features: int | None = None, seed: int = 1234):
        self.pool, self.sigma = cut(number_from_zero(pool.select("idx", "z"), "idx", "place")), sigma
        ref = pool_reference(self.pool).first()
        self.n, self.dimensions, self.var = ref["n_videos"] or 0, ref["n_dimensions"], ref["var_global"] or 0.0
        self.mu = F.array(*(F.lit(float(x)) for x in (ref["mu"] or [])))
        row_means = self._kernel_means() if kernel_features is None else self._feature_means(kernel_features, seed)
        own = self.pool.select("idx", "z", squared_distance(F.col("z"), self.mu).alias("a"))
        self.rows = cut(own.join(row_means, "idx"))
        self.kernel_mean = self.rows.agg(F.avg("r")).first()[0] or 0.0

    def _kernel_means(self) -> DataFrame:
        """``idx, r``: mean kernel of each row with all rows, block of rows by block, each a matrix product in numpy."""
        spark, sigma = self.pool.sparkSession, self.sigma
        total = None
        for low in range(0, self.n, BLOCK_ROWS):
            block = self.pool.where(F.col("place").between(low, low + BLOCK_ROWS - 1)).select("z").toArrow()
            held = np.array(block.column("z").to_pylist(), dtype=float)
            shared = spark.sparkContext.broadcast(held)

            def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                other = shared.value
                squares = (other**2).sum(axis=1)
                for batch in batches:
                    for at in range(0, batch.num_rows, 512):
                        part = batch.slice(at, 512)
                        x = matrix_of(part.column(1), other.shape[1])
                        d2 = np.maximum((x**2).sum(axis=1)[:, None] + squares[None, :] - 2 * x @ other.T, 0)
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.exp(-d2 / (2 * sigma * sigma)).sum(axis=1))], names=["idx", "r"])

            part = self.pool.select(F.col("idx").cast("long").alias("idx"), "z").mapInArrow(run, "idx long, r double")
            total = part if total is None else total.unionByName(part)
        if total is None:
            return self.pool.select(F.col("idx").cast("long").alias("idx"), F.lit(0.0).alias("r"))
        return total.groupBy("idx").agg((F.sum("r") / self.n).alias("r"))


    def _feature_means(self, n_features: int, seed: int) -> DataFrame:
        """``idx, r`` by random Fourier features of the Gaussian kernel: a mean feature, then its product with each row's."""
        size, n = self.dimensions or 1, max(self.n, 1)
        rng = np.random.default_rng(seed)
        weights = rng.normal(scale=1 / self.sigma, size=(size, n_features))
        phase = rng.uniform(0, 2 * np.pi, size=n_features)

        def features(part: pa.RecordBatch, column: int) -> np.ndarray:
            return np.sqrt(2 / n_features) * np.cos(matrix_of(part.column(column), size) @ weights + phase)

        def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n_features)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    out += features(batch.slice(at, 1024), 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_features)), pa.array(out)], names=["j", "v"])

        sums = self.pool.select("z").mapInArrow(total, "j long, v double").groupBy("j").agg(F.sum("v").alias("v")).toArrow()
        mean = np.zeros(n_features)
        mean[sums.column("j").to_numpy()] = sums.column("v").to_numpy() / n

        def means(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(features(part, 1) @ mean)], names=["idx", "r"])

        return self.pool.select(F.col("idx").cast("long").alias("idx"), "z").mapInArrow(means, "idx long, r double")


def set_metrics(sets: DataFrame, numbers: PoolNumbers) -> DataFrame:
    """Metrics of every set: ``slot, rep``, ``size`` and the four of METRICS; ``sets`` has ``slot, rep, idx``.

    Pairs exist only within a set, of which each has a compilation's size.
    """
    rows = sets.join(numbers.rows, "idx").select("slot", "rep", "idx", "z", "a", "r")
    single = rows.groupBy("slot", "rep").agg(F.count("*").alias("size"), F.avg("a").alias("a"), F.avg("r").alias("r"))
    left = rows.select("slot", "rep", F.col("idx").alias("i"), F.col("z").alias("x"))
    right = rows.select("slot", "rep", F.col("idx").alias("j"), F.col("z").alias("y"))
    pairs = left.join(right, ["slot", "rep"]).where("i < j").select("slot", "rep", squared_distance(F.col("x"), F.col("y")).alias("d2"))
    kernel = F.exp(-F.col("d2") / (2.0 * numbers.sigma * numbers.sigma))
    double = pairs.groupBy("slot", "rep").agg(F.sum(F.sqrt("d2")).alias("e"), F.sum(kernel).alias("k"), F.sum("d2").alias("d2"), F.count("*").alias("m"))
    both = single.join(double, ["slot", "rep"], "left").na.fill(0, ["e", "k", "d2", "m"])
    n = F.col("size")
    # mean of all g_ij over a set, from squared distances: mean a - sum of d2 over pairs / n^2
    shift = F.sqrt(F.greatest(F.col("a") - F.col("d2") / (n * n), F.lit(0.0)))
    kss = (n + 2 * F.col("k")) / (n * n)
    return both.select(
        "slot",
        "rep",
        "size",
        (F.col("a") / F.lit(numbers.var) if numbers.var > 0 else F.lit(0.0)).alias("variance_capture"),
        F.when(F.col("m") > 0, F.col("e") / F.greatest(F.col("m"), F.lit(1))).otherwise(0.0).alias("mean_pairwise_distance"),
        shift.alias("centroid_shift"),
        F.sqrt(F.greatest(kss - 2 * F.col("r") + F.lit(numbers.kernel_mean), F.lit(0.0))).alias("mmd"),
    )


def _long(metrics: DataFrame) -> DataFrame:
    return metrics.select("slot", "rep", "size", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("m")) for m in METRICS))).alias("s")).select("slot", "rep", "size", "s.metric", "s.m")


def null_parameters(numbers: PoolNumbers, sizes: list[tuple[int, int]], reps: int, seed: int, eps: float = 1e-8) -> DataFrame:
    """``size, metric, mu0, sd0`` of random sets; ``sizes`` has a (slot, n) for each size."""
    return _long(drawn_metrics(numbers, sizes, reps, seed)).groupBy("size", "metric").agg(F.avg("m").alias("mu0"), (F.stddev_pop("m") + eps).alias("sd0"))


def interchangeability(members: DataFrame, embedding: DataFrame, *, null_draws: int = 2000, permutations: int = 3000, seed: int = 1234, eps: float = 1e-8, alpha: float = 0.05, pool: str = "members", sigma: float | None = None, kernel_features: int | None = None) -> DataFrame:
    """``metric, p_max, p_rms, T_max_obs, T_rms_obs, z_obs, m_obs, verdict``, one row per metric.

    ``members`` has ``comp_id, video_idx``.  z compares a compilation with random sets of its size; T_max and T_rms are the
    greatest absolute and the root mean square z over the compilations; p is (1 + replicates at least as extreme) /
    (permutations + 1).  All metrics share their draws, which is valid for each of them.  For a large ``library`` pool,
    whose exact kernel means are quadratic, see ``kernel_features`` of :class:`PoolNumbers`.
    """
    sets = members.select(F.col("comp_id").cast("long").alias("slot"), F.lit(0).cast("long").alias("rep"), F.col("video_idx").alias("idx")).distinct()
    rows = member_pool(members, embedding, pool)
    numbers = PoolNumbers(rows, sigma if sigma is not None else median_sigma(rows, seed), kernel_features, seed)
    observed = cut(_long(set_metrics(sets.join(numbers.pool.select("idx"), "idx", "left_semi"), numbers)))
    counts = sorted((r["slot"], r["size"]) for r in observed.select("slot", "size").distinct().collect())
    nulls = cut(null_parameters(numbers, sorted({(n, n) for _, n in counts}), null_draws, seed, eps))
    drawn = _long(drawn_metrics(numbers, counts, permutations, seed + 1))
    z = lambda df: df.join(F.broadcast(nulls), ["size", "metric"]).withColumn("z", (F.col("m") - F.col("mu0")) / F.col("sd0"))
    # A replicate that draws a compilation itself ties with it; nine digits keep summation order out of the comparison.
    t = [F.round(F.max(F.abs("z")), 9).alias("t_max"), F.round(F.sqrt(F.avg(F.col("z") * F.col("z"))), 9).alias("t_rms")]
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("slot", c))), lambda e: e[c])
    seen = z(observed).groupBy("metric").agg(*t, ordered("z").alias("z_obs"), ordered("m").alias("m_obs"))
    null_t = z(drawn).groupBy("metric", "rep").agg(t[0].alias("n_max"), t[1].alias("n_rms"))
    joined = null_t.join(F.broadcast(seen), "metric").groupBy("metric").agg(
        F.first("t_max").alias("T_max_obs"),
        F.first("t_rms").alias("T_rms_obs"),
        F.first("z_obs").alias("z_obs"),
        F.first("m_obs").alias("m_obs"),
        ((1 + F.count_if(F.col("n_max") >= F.col("t_max"))) / F.lit(permutations + 1.0)).alias("p_max"),
        ((1 + F.count_if(F.col("n_rms") >= F.col("t_rms"))) / F.lit(permutations + 1.0)).alias("p_rms"),
    )
    return joined.withColumn("verdict", F.when(F.col("p_max") >= alpha, "fail to reject").otherwise("reject"))
