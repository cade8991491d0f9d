"""Queries of the pipeline's operators over the project's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from reelquilt.functions.names import sanitize_name, stem
from reelquilt.functions.vectors import l2_normalize
from reelquilt.operators import interchange, linalg, pooling, report, reweight, scoring, selection, strata
from reelquilt.operators.compaction import frame_of_path
from reelquilt.plans import pipeline
from reelquilt.plans.materialize import cut
from reelquilt.plans.ranking import number_from_zero
from reelquilt.sources import media, statements as statement_source
from reelquilt.sources.tables import table

DIGITS, NUDGE = 6, 3.7e-9
SWEEP_K, STRATA_K, KCENTER_K = 20, 9, 8
EMBEDDING_SIZE = 32


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six digits (and no negative zero): engines add in different orders.

    The nudge keeps means of decimal scores, which often end in a 5 at the seventh digit, off the rounding edge.
    """
    return df.select(*((F.round(F.col(c) + NUDGE, DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- cleaned tables ---------------------------------------------------------------------------------------------------


def frame_scores(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """Distinct frame scores that aren't null; undecodable frames' zeros are scores like any others.

    ``by`` names the columns that the rows are grouped by next, so that one shuffle serves both.
    """
    rows = table(spark, d, "frame_scores").select("video_id", "frame_idx", "statement_index", "score").where("score is not null")
    return (rows.repartition(*by) if by else rows).distinct()


def video_scores(spark: SparkSession, d: str) -> DataFrame:
    """The newest score of each video and statement, where that isn't null; of several as new the greatest.

    Both aggregates run in hash tables after one shuffle by video.
    """
    keys = ["video_id", "video_idx", "statement_index"]
    rows = table(spark, d, "video_scores").select(*keys, "computed_at", "score").repartition("video_id", "video_idx")
    by_time = rows.groupBy(*keys, "computed_at").agg(F.max("score").alias("score"))
    return by_time.groupBy(*keys).agg(F.max_by("score", "computed_at").alias("score")).where("score is not null")


def complete_scores(spark: SparkSession, d: str) -> DataFrame:
    """:func:`video_scores` of the videos that have all statements, which the given SQL (CTE ``cs``) is limited to; kept, as what follows reads it more than once."""
    n = table(spark, d, "statements").select(F.countDistinct("statement_index")).first()[0]
    counted = video_scores(spark, d).withColumn("n", F.count("*").over(W.partitionBy("video_id", "video_idx")))
    return cut(counted.where(F.col("n") == n).drop("n"))


def all_scores(spark: SparkSession, d: str) -> DataFrame:
    """:func:`video_scores` of all videos, kept; a missing score counts as 0 where vectors are made (``linalg.packed``)."""
    return cut(video_scores(spark, d))


def embedding(spark: SparkSession, d: str) -> DataFrame:
    """Usable vectors: of full size, not all zero, each once."""
    rows = table(spark, d, "embedding").select("video_idx", "z").where((F.size("z") == EMBEDDING_SIZE) & F.exists("z", lambda x: x != 0))
    return rows.distinct()


def members(spark: SparkSession, d: str) -> DataFrame:
    """Distinct members of the stored compilations: ``comp_id, video_idx, secs``."""
    return table(spark, d, "compilations").select("comp_id", F.explode("members").alias("m")).select("comp_id", F.col("m.idx").alias("video_idx"), F.col("m.secs").alias("secs")).distinct()


def durations(spark: SparkSession, d: str) -> DataFrame:
    """Newest valid duration of each video; of several as new the greatest.  The stem of the path is the video where the id is missing."""
    rows = table(spark, d, "media_probe").select(F.coalesce("video_id", stem(F.col("path"))).alias("video_id"), "probed_at", "duration_s")
    valid = rows.where((F.col("duration_s") > 0) & (F.col("duration_s") < float("inf")) & F.col("video_id").isNotNull()).repartition("video_id")
    by_time = valid.groupBy("video_id", "probed_at").agg(F.max("duration_s").alias("duration_s"))
    return by_time.groupBy("video_id").agg(F.max_by("duration_s", "probed_at").alias("duration_s"))


CTE = {
    "fs": "fs AS (SELECT DISTINCT video_id, frame_idx, statement_index, score FROM frame_scores WHERE score IS NOT NULL)",
    "vs": "vs AS (SELECT video_id, video_idx, statement_index, s[1] AS score FROM (SELECT video_id, video_idx, statement_index, arg_max(row(score), computed_at) AS s FROM video_scores GROUP BY ALL) WHERE s[1] IS NOT NULL)",
    "cs": "cs AS (SELECT * FROM vs WHERE video_idx IN (SELECT video_idx FROM vs GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT statement_index) FROM statements)))",
    "e": "e AS (SELECT DISTINCT video_idx, z FROM embedding WHERE len(z) = 32 AND list_max(list_transform(z, lambda x: abs(x))) > 0)",
    "dims": "dims AS (SELECT video_idx, unnest(range(32)) AS j, unnest(z) AS v FROM e)",
    "mu": "mu AS (SELECT list(m ORDER BY j) AS z FROM (SELECT j, avg(v) AS m FROM dims GROUP BY j))",
    "m": "m AS (SELECT DISTINCT comp_id, x.idx AS video_idx, x.secs AS secs FROM (SELECT comp_id, unnest(members) AS x FROM compilations))",
}
#: Farthest-first traversal: one row per pick and video with the distance to the nearest pick so far.
FF = (
    "ff AS (SELECT 0 AS k, e.video_idx, e.z, list_distance(e.z, s.z) AS dmin, list_distance(e.z, s.z) AS d, s.video_idx AS pick, s.z AS pz "
    "FROM e, (SELECT e.video_idx, e.z FROM e, mu ORDER BY list_distance(e.z, mu.z), e.video_idx LIMIT 1) s "
    "UNION ALL SELECT f.k + 1, f.video_idx, f.z, least(f.dmin, list_distance(f.z, p.z)), list_distance(f.z, p.z), p.video_idx, p.z "
    "FROM ff f, (SELECT video_idx, z FROM ff ORDER BY dmin DESC, video_idx LIMIT 1) p WHERE f.k < 19)"
)
FF_CTE = f"WITH RECURSIVE {CTE['e']}, {CTE['dims']}, {CTE['mu']}, {FF}"
ASSIGN = f"{FF_CTE}, a AS (SELECT video_idx, arg_min(k, (d, k)) AS stratum_id, min(d) AS dist, any_value(z) AS z FROM ff WHERE k < {STRATA_K} GROUP BY video_idx)"


def _prototypes(rows: DataFrame, k: int):
    return strata.farthest_first(rows, k)


def _kept_embedding(spark: SparkSession, d: str) -> DataFrame:
    return cut(embedding(spark, d))


# --- sources ----------------------------------------------------------------------------------------------------------


def statements_flatten(spark, d):
    return statement_source.from_table(table(spark, d, "statements"))


def statements_category_filter(spark, d):
    rows = table(spark, d, "statements")
    return statement_source.in_category(rows, rows.agg(F.min("category")).first()[0])


def sanitize_names(spark, d):
    return table(spark, d, "documents").select("court").where("court is not null").distinct().select("court", sanitize_name(F.col("court")).alias("name"))


def media_plan(spark, d):
    rows = table(spark, d, "media_probe").groupBy("path").agg(F.max(F.struct("probed_at", "height")).alias("s")).select("path", F.col("s.height").alias("height"))
    return media.normalization_plan(rows, "out", target_resolution=1080)


def media_plan_uniform(spark, d):
    rows = table(spark, d, "media_probe").groupBy("path").agg(F.max(F.struct("probed_at", "height")).alias("s")).select("path", F.col("s.height").alias("height"))
    return media.normalization_plan(rows, "out", uniform_resolution=True).select("path", "encode_height", "scale", "resolution")


def _frames(spark, d):
    return table(spark, d, "frames").select("video_id", "frame_path").where("video_id is not null").distinct()


def _all_frames(spark, d):
    """Frames with the video that the file name gives where the id is missing."""
    video, _ = frame_of_path(F.col("frame_path"))
    return table(spark, d, "frames").select(F.coalesce("video_id", video).alias("video_id"), "frame_path").where("video_id is not null").distinct()


def frame_index(spark, d, frames=_frames):
    return media.frame_index(frames(spark, d))


def frames_summary(spark, d, frames=_frames):
    return rounded(pooling.frames_per_video(frames(spark, d)))


def video_index(spark, d):
    return pooling.video_index(frame_scores(spark, d))


# --- scoring and pooling ----------------------------------------------------------------------------------------------


def l2_normalized(spark, d):
    rows = embedding(spark, d).select("video_idx", l2_normalize(F.col("z")).alias("z"))
    return rounded(rows.select("video_idx", F.posexplode("z").alias("j", "v")))


def score_frames(spark, d):
    """Every vector of ``embeddings`` as a frame, scored against the unit mean vectors of the labels as statements."""
    rows = table(spark, d, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("j", "v")).groupBy("label", "j").agg(F.avg(F.col("v").cast("double")).alias("v"))
    texts = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("feature"))
    texts = texts.select(F.col("label").alias("statement_index"), l2_normalize(F.col("feature")).alias("feature"))
    frames = rows.select(F.concat(F.lit("v"), F.col("label").cast("string")).alias("video_id"), F.col("vec_id").cast("int").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("feature"))
    return rounded(scoring.score_frames(scoring.normalized_features(frames), texts))


def _pool(method):
    return lambda spark, d: rounded(pooling.pool_scores(frame_scores(spark, d, "video_id", "statement_index"), method, keys=table(spark, d, "frame_scores")))


def pool_events(spark, d):
    return rounded(pooling.pool_scores(table(spark, d, "events"), group="user_id", feature="event_type", value="value"))


def pool_lineitem(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("flag"), "l_extendedprice")
    return rounded(pooling.pool_scores(rows, group="l_suppkey", feature="flag", value="l_extendedprice"))


def encoding_summary(spark, d):
    return rounded(pooling.score_statistics(frame_scores(spark, d)))


def top_frames(spark, d):
    return rounded(pooling.top_frames(frame_scores(spark, d)))


def top_statements(spark, d):
    return rounded(pooling.top_statements(frame_scores(spark, d), 5, table(spark, d, "statements")))


def top_videos(spark, d):
    return rounded(pooling.top_videos(video_scores(spark, d)))


def statement_preference(spark, d):
    return pooling.statement_preference(video_scores(spark, d), None)


def pooled_best(spark, d):
    """The engine's flagship: frames pooled to videos by their 95th percentile, each video with its best statement."""
    return rounded(pooling.best_statements(pooling.pool_scores(frame_scores(spark, d, "video_id", "statement_index"), keys=table(spark, d, "frame_scores"))))


# --- reweighting ------------------------------------------------------------------------------------------------------


def _center(mode):
    return lambda spark, d, scores=complete_scores: rounded(reweight.center_scores(scores(spark, d).select("video_idx", "statement_index", "score"), mode))


def _moments(spark, d, scores):
    vectors, columns = linalg.packed(scores(spark, d))
    return linalg.moments(vectors, "x", len(columns)), columns


def gram_matrix(spark, d, scores=complete_scores):
    got, columns = _moments(spark, d, scores)
    return rounded(linalg.long_matrix(spark, got.gram, columns, columns, ("i", "j", "value")))


def covariance_matrix(spark, d, scores=complete_scores):
    got, columns = _moments(spark, d, scores)
    return rounded(linalg.long_matrix(spark, got.covariance, columns, columns, ("i", "j", "value")))


def weights_full_rank(spark, d, scores=complete_scores):
    """With both means taken out and all components kept, communality is each column's variance (of complete videos)."""
    centered = cut(reweight.center_scores(scores(spark, d), "both"))
    return rounded(reweight.statement_weights(centered, variance_threshold=2.0, component_cap=10_000).table(spark))


def _weights(spark, d):
    return reweight.statement_weights(cut(reweight.center_scores(all_scores(spark, d), "col")))


def weights_default(spark, d):
    return rounded(_weights(spark, d).table(spark))


def spectrum(spark, d):
    return rounded(_weights(spark, d).spectrum(spark))


def spectrum_moments(spark, d):
    """Norms of the explained shares, which are those of the covariance's powers over its trace.

    Eighth and twelfth powers, in which the one component that is left out of a full set doesn't show.
    """
    shares = _weights(spark, d).spectrum(spark)
    return rounded(shares.agg(*(F.pow(F.sum(F.pow("evr", F.lit(k))), F.lit(1 / k)).alias(f"m{k}") for k in (8, 12))))


def weighted_scores(spark, d, scores=complete_scores):
    centered = cut(reweight.center_scores(scores(spark, d), "both"))
    weights = reweight.statement_weights(centered, variance_threshold=2.0, component_cap=10_000).table(spark)
    return rounded(reweight.apply_weights(centered.select("video_idx", "statement_index", "score"), weights))


# --- embedding and strata ---------------------------------------------------------------------------------------------


def built_embedding(spark, d):
    centered = cut(reweight.center_scores(all_scores(spark, d), "col"))
    z, _ = strata.build_embedding(centered)
    return rounded(report.components(z))


def farthest_first_order(spark, d):
    return strata.prototype_table(spark, _prototypes(_kept_embedding(spark, d), SWEEP_K))


def assign_strata(spark, d):
    rows = _kept_embedding(spark, d)
    return rounded(strata.assign_strata(rows, _prototypes(rows, STRATA_K)))


def stratum_sizes(spark, d):
    rows = _kept_embedding(spark, d)
    return strata.stratum_sizes(strata.assign_strata(rows, _prototypes(rows, STRATA_K)))


def coverage_metrics(spark, d):
    rows = _kept_embedding(spark, d)
    return rounded(strata.coverage_metrics(strata.assign_strata(rows, _prototypes(rows, STRATA_K))))


def k_sweep(spark, d):
    rows = _kept_embedding(spark, d)
    return rounded(strata.k_sweep(rows, _prototypes(rows, SWEEP_K)))


def choose_k(spark, d):
    rows = _kept_embedding(spark, d)
    sweep = cut(strata.k_sweep(rows, _prototypes(rows, SWEEP_K)))
    return spark.createDataFrame([(strata.choose_k(sweep, 0),)], "K int")


def _kcenter(metric):
    def run(spark, d):
        rows = _kept_embedding(spark, d)
        start = rows.agg(F.min("video_idx")).first()[0]
        return strata.prototype_table(spark, strata.kcenter_greedy(rows, KCENTER_K, metric=metric, start=start)).withColumnRenamed("prototype_id", "pick")

    return run


def zscored(spark, d):
    return rounded(report.components(selection.zscore_columns(_kept_embedding(spark, d))))


def prototype_cosine(spark, d):
    rows = _kept_embedding(spark, d)
    far = strata.prototype_distances(rows, _prototypes(rows, STRATA_K), metric="cosine")
    return rounded(far.select("video_idx", F.posexplode("d").alias("k", "dist")))


def prototype_coverage(spark, d):
    rows = _kept_embedding(spark, d)
    heads = _prototypes(rows, STRATA_K)
    return rounded(strata.prototype_coverage(rows, strata.assign_strata(rows, heads), heads))


def stratum_centroids(spark, d):
    rows = _kept_embedding(spark, d)
    return rounded(strata.stratum_centroids(rows, strata.assign_strata(rows, _prototypes(rows, STRATA_K))))


def component_statistics(spark, d):
    return rounded(report.component_statistics(embedding(spark, d), None))


def component_correlation(spark, d):
    return rounded(report.component_correlation(video_scores(spark, d), embedding(spark, d)))


def top_loadings(spark, d):
    return rounded(report.top_loadings(report.component_correlation(video_scores(spark, d), embedding(spark, d))))


# --- selection and test -----------------------------------------------------------------------------------------------


def compilation_members(spark, d):
    """New compilations of all videos with an embedding and a valid duration, over nine strata."""
    rows = _kept_embedding(spark, d)
    ranked = cut(numbered_videos(spark, d, rows))
    labels = strata.assign_strata(ranked, _prototypes(ranked, STRATA_K))
    return selection.select_compilations(ranked.join(labels.select("video_idx", "stratum_id"), "video_idx"))


def numbered_videos(spark, d, rows):
    """Embedding with durations, ``video_idx`` counted from 0 without gaps (the old one as ``source_idx``)."""
    names = table(spark, d, "embedding").select("video_id", F.col("video_idx").alias("source_idx")).distinct()
    numbered = number_from_zero(rows.select(F.col("video_idx").alias("source_idx"), "z"), "source_idx", "video_idx")
    return numbered.join(names, "source_idx").join(durations(spark, d), "video_id", "left")


def compilation_durations(spark, d):
    return rounded(selection.duration_summary(members(spark, d)))


def usage_counts(spark, d):
    return selection.usage_counts(members(spark, d))


def pool_reference(spark, d):
    pool = interchange.member_pool(members(spark, d), embedding(spark, d))
    return rounded(interchange.pool_reference(pool).drop("mu"))


def compilation_metrics(spark, d):
    """The four metrics of every stored compilation against the pool of all their members (kernel width 1)."""
    z = embedding(spark, d)
    numbers = interchange.PoolNumbers(interchange.member_pool(members(spark, d), z), 1.0)
    sets = members(spark, d).select(F.col("comp_id").cast("long").alias("slot"), F.lit(0).alias("rep"), F.col("video_idx").alias("idx")).distinct()
    return rounded(interchange.set_metrics(sets, numbers).drop("rep").withColumnRenamed("slot", "comp_id"))


def interchangeability(spark, d):
    return rounded(interchange.interchangeability(members(spark, d), embedding(spark, d)).select("metric", "p_max", "p_rms", "T_max_obs", "T_rms_obs", "verdict"))


def pipeline_run(spark, d):
    """All steps from frame scores to compilations with default settings: the members of the new compilations."""
    return pipeline.from_frame_scores(spark, frame_scores(spark, d), durations(spark, d)).tables["compilation_members"]


QUERIES = {
    **{f.__name__: f for f in (statements_flatten, statements_category_filter, sanitize_names, media_plan, media_plan_uniform, frame_index, frames_summary, video_index, l2_normalized, score_frames)},
    **{f"pool_{m}": _pool(m) for m in ("percentile", "mean", "median", "max", "min")},
    **{f.__name__: f for f in (pool_events, pool_lineitem, encoding_summary, top_frames, top_statements, top_videos, statement_preference, pooled_best)},
    **{f"center_{m}": _center(m) for m in ("none", "col", "row", "both")},
    **{f.__name__: f for f in (gram_matrix, covariance_matrix, weights_full_rank, weights_default, spectrum, spectrum_moments, weighted_scores, built_embedding)},
    **{f.__name__: f for f in (farthest_first_order, assign_strata, stratum_sizes, coverage_metrics, k_sweep, choose_k)},
    **{f"kcenter_{m}": _kcenter(m) for m in ("euclidean", "cosine")},
    **{f.__name__: f for f in (zscored, prototype_cosine, prototype_coverage, stratum_centroids, component_statistics, component_correlation, top_loadings)},
    **{f.__name__: f for f in (compilation_members, compilation_durations, usage_counts, pool_reference, compilation_metrics, interchangeability, pipeline_run)},
}
#: Given SQL limits these to complete videos; each has a twin over all videos.
COMPLETE_ONLY = (*(f"center_{m}" for m in ("none", "col", "row", "both")), "gram_matrix", "covariance_matrix", "weights_full_rank", "weighted_scores")
QUERIES |= {f"{name}_all": partial(QUERIES[name], scores=all_scores) for name in COMPLETE_ONLY}
#: Given SQL limits these to rows with a video id; the twins also take the video from the file name.
QUERIES |= {f"{f.__name__}_all": partial(f, frames=_all_frames) for f in (frame_index, frames_summary)}

R = lambda x: f"round({x} + {NUDGE!r}, {DIGITS}) + 0.0"
_POOL = lambda agg: f"WITH {CTE['fs']} SELECT video_id, statement_index, {R(agg)} AS score FROM fs GROUP BY ALL"
_CENTER = lambda x: f"WITH {CTE['vs']}, {CTE['cs']} SELECT video_idx, statement_index, {R(x)} AS score FROM cs"
_CENTER_ALL = lambda x: f"WITH {CTE['vs']} SELECT video_idx, statement_index, {R(x)} AS score FROM vs"
_ROW, _COL, _ALL = "avg(score) OVER (PARTITION BY video_idx)", "avg(score) OVER (PARTITION BY statement_index)", "avg(score) OVER ()"
_FULL = f"WITH {CTE['vs']}, {CTE['cs']}, b AS (SELECT video_idx, statement_index, score - {_ROW} - {_COL} + {_ALL} AS score FROM cs), c AS (SELECT statement_index, var_pop(score) AS communality FROM b GROUP BY 1), w AS (SELECT *, sqrt(sqrt(communality + 1e-8)) AS raw FROM c), ww AS (SELECT statement_index, raw / (avg(raw) OVER () + 1e-8) AS weight, communality FROM w)"
_DENSE = f"WITH {CTE['vs']}, dense AS (SELECT v.video_idx, s.statement_index, coalesce(vs.score, 0) AS score FROM (SELECT DISTINCT video_idx FROM vs) v CROSS JOIN (SELECT DISTINCT statement_index FROM vs) s LEFT JOIN vs ON vs.video_idx = v.video_idx AND vs.statement_index = s.statement_index)"
_COSD = "greatest(0.0, least(2.0, 1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))))"


def _kcenter_sql(distance: str) -> str:
    d = lambda a, b: distance.format(a=a, b=b)
    return (
        f"WITH RECURSIVE {CTE['e']}, kc AS (SELECT 0 AS k, e.video_idx, e.z, {d('e.z', 's.z')} AS dmin, s.video_idx AS pick FROM e, (SELECT video_idx, z FROM e ORDER BY video_idx LIMIT 1) s "
        f"UNION ALL SELECT f.k + 1, f.video_idx, f.z, least(f.dmin, {d('f.z', 'p.z')}), p.video_idx FROM kc f, (SELECT video_idx, z FROM kc ORDER BY dmin DESC, video_idx LIMIT 1) p WHERE f.k < {KCENTER_K - 1}) "
        "SELECT DISTINCT CAST(k AS INTEGER) AS pick, CAST(kc.pick AS BIGINT) AS video_idx FROM kc"
    )


_SWEEP = (
    f"{FF_CTE}, l AS (SELECT f.k + 1 AS K, g.video_idx, arg_min(g.k, (g.d, g.k)) AS s, min(g.d) AS dist FROM (SELECT DISTINCT k FROM ff) f JOIN ff g ON g.k <= f.k GROUP BY ALL), "
    "sz AS (SELECT K, s, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT K, avg(dist) AS mean_dist, max(dist) AS max_dist, quantile_cont(dist, 0.95) AS p95_dist FROM l GROUP BY K), "
    "b AS (SELECT K, min(n) AS min_size, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS singleton_frac FROM sz GROUP BY K)"
)
_CORR = f"WITH {CTE['vs']}, {CTE['e']}, {CTE['dims']}, c AS (SELECT statement_index, CAST(j AS INTEGER) AS component, covar_pop(score, v) / nullif(stddev_pop(score) * stddev_pop(v), 0) AS correlation FROM vs JOIN dims USING (video_idx) GROUP BY ALL)"
_PLAN = "WITH p AS (SELECT path, nullif(arg_max(row(height), probed_at)[1], 0) AS h FROM media_probe GROUP BY path)"
_POOLSQL = f"WITH {CTE['e']}, {CTE['m']}, pool AS (SELECT * FROM e WHERE video_idx IN (SELECT video_idx FROM m)), pd AS (SELECT video_idx, unnest(range(32)) AS j, unnest(z) AS v FROM pool), ref AS (SELECT list(a ORDER BY j) AS mu, sum(s) AS var FROM (SELECT j, avg(v) AS a, var_pop(v) AS s FROM pd GROUP BY j))"
_NAMED = r"""WITH named AS (SELECT DISTINCT coalesce(video_id, nullif(regexp_extract(lower(regexp_replace(regexp_replace(regexp_extract(frame_path, '([^/\\]*)$', 1), '\.[A-Za-z0-9]+\s*$', ''), '\s*\(\d+\)$', '')), '^(.+)_\d+$', 1), '')) AS video_id, frame_path FROM frames)"""

ORACLE = {
    "spectrum_moments": f"""WITH {CTE['vs']}, ctr AS (SELECT video_idx, statement_index, score - {_COL} AS score FROM vs),
        n AS (SELECT count(DISTINCT video_idx) AS n FROM ctr),
        c1 AS (SELECT a.statement_index AS i, b.statement_index AS j, sum(a.score * b.score) / any_value(n.n) AS v FROM ctr a JOIN ctr b USING (video_idx), n GROUP BY ALL),
        tr AS (SELECT sum(v) AS t FROM c1 WHERE i = j),
        c AS (SELECT i, j, v / t AS v FROM c1, tr),
        c2 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.i GROUP BY ALL),
        c3 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c2 a JOIN c b ON a.j = b.i GROUP BY ALL),
        c4 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c2 a JOIN c2 b ON a.j = b.i GROUP BY ALL),
        c6 AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c3 a JOIN c3 b ON a.j = b.i GROUP BY ALL)
        SELECT (SELECT {R('pow(sum(v * v), 1 / 8.0)')} FROM c4) AS m8, (SELECT {R('pow(sum(v * v), 1 / 12.0)')} FROM c6) AS m12""",
    "statements_flatten": "SELECT CAST(row_number() OVER (ORDER BY seen, statement_index) - 1 AS INTEGER) AS statement_index, category, statement FROM (SELECT *, min(statement_index) OVER (PARTITION BY category) AS seen FROM statements)",
    "statements_category_filter": "SELECT CAST(row_number() OVER (ORDER BY statement_index) - 1 AS INTEGER) AS statement_index, category, statement FROM statements WHERE category = (SELECT min(category) FROM statements)",
    "sanitize_names": r"SELECT DISTINCT court, regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(court), '[^\x00-\x7f]', '', 'g'), '[''\"`,]', '', 'g'), '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g') AS name FROM documents WHERE court IS NOT NULL".replace('\\"', '"'),
    "media_plan": rf"""{_PLAN}, q AS (SELECT path, h, CASE WHEN 1080 < coalesce(h, 99999) THEN 1080 ELSE h END AS encode_height, 'out/' || regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', '') || '.mp4' AS dst FROM p)
        SELECT path, dst, CAST(encode_height AS INTEGER) AS encode_height, encode_height IS NOT NULL AND encode_height IS DISTINCT FROM h AS scale, CASE WHEN encode_height IS NULL THEN 'original' ELSE encode_height || 'p' END AS resolution, count(*) OVER (PARTITION BY dst) > 1 AS collides FROM q""",
    "media_plan_uniform": f"{_PLAN}, t AS (SELECT max(h) AS h FROM p) SELECT path, CAST(t.h AS INTEGER) AS encode_height, t.h IS NOT NULL AND t.h IS DISTINCT FROM p.h AS scale, t.h || 'p' AS resolution FROM p, t",
    "frame_index": "SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_path) - 1 AS INTEGER) AS frame_idx, frame_path FROM (SELECT DISTINCT video_id, frame_path FROM frames WHERE video_id IS NOT NULL)",
    "frames_summary": f"WITH s AS (SELECT video_id, count(DISTINCT frame_path) AS n FROM frames WHERE video_id IS NOT NULL GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_frames, count(*) AS n_videos, {R('avg(n)')} AS mean_frames, {R('median(n)')} AS median_frames, min(n) AS min_frames, max(n) AS max_frames, {R('quantile_cont(n, 0.25)')} AS p25_frames, {R('quantile_cont(n, 0.5)')} AS p50_frames, {R('quantile_cont(n, 0.75)')} AS p75_frames FROM s",
    "frame_index_all": f"{_NAMED} SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_path) - 1 AS INTEGER) AS frame_idx, frame_path FROM named WHERE video_id IS NOT NULL",
    "frames_summary_all": f"{_NAMED}, s AS (SELECT video_id, count(DISTINCT frame_path) AS n FROM named WHERE video_id IS NOT NULL GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_frames, count(*) AS n_videos, {R('avg(n)')} AS mean_frames, {R('median(n)')} AS median_frames, min(n) AS min_frames, max(n) AS max_frames, {R('quantile_cont(n, 0.25)')} AS p25_frames, {R('quantile_cont(n, 0.5)')} AS p50_frames, {R('quantile_cont(n, 0.75)')} AS p75_frames FROM s",
    "video_index": "SELECT video_id, CAST(row_number() OVER (ORDER BY video_id) - 1 AS INTEGER) AS video_idx FROM (SELECT DISTINCT video_id FROM frame_scores WHERE score IS NOT NULL AND video_id IS NOT NULL)",
    "l2_normalized": f"WITH {CTE['e']} SELECT video_idx, CAST(unnest(range(32)) AS INTEGER) AS j, {R('unnest(list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))))')} AS v FROM e",
    "score_frames": f"""WITH r AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), u AS (SELECT label, unnest(range(len(x))) AS j, unnest(x) AS v FROM r),
        c AS (SELECT label, list(v ORDER BY j) AS f FROM (SELECT label, j, avg(v) AS v FROM u GROUP BY ALL) GROUP BY label)
        SELECT 'v' || r.label AS video_id, CAST(vec_id AS INTEGER) AS frame_idx, c.label AS statement_index, {R('list_dot_product(x, f) / (sqrt(list_dot_product(x, x)) + 1e-12) / sqrt(list_dot_product(f, f))')} AS score FROM r, c""",
    "pool_percentile": _POOL("quantile_cont(score, 0.95)"),
    "pool_mean": _POOL("avg(score)"),
    "pool_median": _POOL("median(score)"),
    "pool_max": _POOL("max(score)"),
    "pool_min": _POOL("min(score)"),
    "pool_events": f"SELECT user_id, event_type, {R('quantile_cont(value, 0.95)')} AS score FROM events GROUP BY ALL",
    "pool_lineitem": f"SELECT l_suppkey, l_returnflag || l_linestatus AS flag, {R('quantile_cont(l_extendedprice, 0.95)')} AS score FROM lineitem GROUP BY ALL",
    "encoding_summary": f"WITH {CTE['fs']} SELECT {R('avg(score)')} AS mean_score, {R('stddev_pop(score)')} AS std_score, {R('min(score)')} AS min_score, {R('max(score)')} AS max_score FROM fs",
    "top_frames": f"WITH {CTE['fs']} SELECT video_id, frame_idx, {R('max(score)')} AS max_score FROM fs GROUP BY ALL ORDER BY max(score) DESC, video_id, frame_idx LIMIT 5",
    "top_statements": f"WITH {CTE['fs']}, t AS (SELECT statement_index, avg(score) AS m FROM fs GROUP BY 1 ORDER BY m DESC, statement_index LIMIT 5) SELECT statement_index, substr(coalesce(statement, 'Scene ' || statement_index), 1, 50) AS statement, {R('m')} AS mean_score FROM t LEFT JOIN statements USING (statement_index)",
    "top_videos": f"WITH {CTE['vs']} SELECT video_id, {R('max(score)')} AS max_score, arg_max(statement_index, (score, -statement_index)) AS best_statement FROM vs GROUP BY 1 ORDER BY max(score) DESC, video_id LIMIT 5",
    "statement_preference": f"WITH {CTE['vs']}, b AS (SELECT video_id, arg_max(statement_index, (score, -statement_index)) AS best_statement FROM vs GROUP BY 1) SELECT best_statement, count(*) AS n_videos FROM b GROUP BY 1",
    "pooled_best": f"WITH {CTE['fs']}, p AS (SELECT video_id, statement_index, quantile_cont(score, 0.95) AS score FROM fs GROUP BY ALL) SELECT video_id, {R('max(score)')} AS max_score, arg_max(statement_index, (score, -statement_index)) AS best_statement FROM p GROUP BY 1",
    "center_none": _CENTER("score"),
    "center_col": _CENTER(f"score - {_COL}"),
    "center_row": _CENTER(f"score - {_ROW}"),
    "center_both": _CENTER(f"score - {_ROW} - {_COL} + {_ALL}"),
    "gram_matrix": f"WITH {CTE['vs']}, {CTE['cs']} SELECT a.statement_index AS i, b.statement_index AS j, {R('sum(a.score * b.score)')} AS value FROM cs a JOIN cs b USING (video_idx) GROUP BY ALL",
    "covariance_matrix": f"WITH {CTE['vs']}, {CTE['cs']} SELECT a.statement_index AS i, b.statement_index AS j, {R('covar_pop(a.score, b.score)')} AS value FROM cs a JOIN cs b USING (video_idx) GROUP BY ALL",
    "center_none_all": _CENTER_ALL("score"),
    "center_col_all": _CENTER_ALL(f"score - {_COL}"),
    "center_row_all": _CENTER_ALL(f"score - {_ROW}"),
    "center_both_all": _CENTER_ALL(f"score - {_ROW} - {_COL} + {_ALL}"),
    "gram_matrix_all": f"{_DENSE} SELECT a.statement_index AS i, b.statement_index AS j, {R('sum(a.score * b.score)')} AS value FROM dense a JOIN dense b USING (video_idx) GROUP BY ALL",
    "covariance_matrix_all": f"{_DENSE} SELECT a.statement_index AS i, b.statement_index AS j, {R('covar_pop(a.score, b.score)')} AS value FROM dense a JOIN dense b USING (video_idx) GROUP BY ALL",
    "weights_full_rank": f"{_FULL} SELECT statement_index, {R('weight')} AS weight, {R('communality')} AS communality FROM ww",
    "weighted_scores": f"{_FULL} SELECT video_idx, statement_index, {R('score * weight')} AS score FROM b JOIN ww USING (statement_index)",
    "farthest_first_order": f"{FF_CTE} SELECT DISTINCT CAST(k AS INTEGER) AS prototype_id, CAST(pick AS BIGINT) AS video_idx FROM ff",
    "assign_strata": f"{ASSIGN} SELECT video_idx, CAST(stratum_id AS INTEGER) AS stratum_id, CAST(video_idx IN (SELECT pick FROM ff WHERE k < {STRATA_K}) AS INTEGER) AS is_prototype, {R('dist')} AS dist_to_prototype FROM a",
    "stratum_sizes": f"{ASSIGN} SELECT CAST(stratum_id AS INTEGER) AS stratum_id, count(*) AS n_videos FROM a GROUP BY ALL",
    "coverage_metrics": f"{ASSIGN}, s AS (SELECT stratum_id, count(*) AS n FROM a GROUP BY 1), t AS (SELECT min(n) AS min_size, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS singleton_frac, count(*) AS n_strata FROM s), u AS (SELECT avg(dist) AS m, max(dist) AS x, quantile_cont(dist, 0.95) AS p FROM a) SELECT {R('m')} AS mean_dist, {R('x')} AS max_dist, {R('p')} AS p95_dist, min_size, {R('singleton_frac')} AS singleton_frac, n_strata FROM t, u",
    "k_sweep": f"{_SWEEP} SELECT CAST(K AS INTEGER) AS K, {R('mean_dist')} AS mean_dist, {R('max_dist')} AS max_dist, {R('p95_dist')} AS p95_dist, min_size, {R('singleton_frac')} AS singleton_frac FROM a JOIN b USING (K)",
    "choose_k": f"{_SWEEP}, f AS (SELECT K, max_dist FROM a JOIN b USING (K) WHERE min_size >= 3) SELECT CAST(coalesce((SELECT min(K) FROM f WHERE max_dist <= 0.35), (SELECT arg_min(K, (max_dist, K)) FROM f), 1) AS INTEGER) AS K",
    "kcenter_euclidean": _kcenter_sql("list_distance({a}, {b})"),
    "kcenter_cosine": _kcenter_sql(_COSD),
    "zscored": f"WITH {CTE['e']}, {CTE['dims']}, s AS (SELECT j, avg(v) AS m, stddev_pop(v) AS d FROM dims GROUP BY j) SELECT video_idx, CAST(j AS INTEGER) AS component, {R('(v - m) / (d + 1e-8)')} AS value FROM dims JOIN s USING (j)",
    "prototype_cosine": f"{FF_CTE} SELECT video_idx, CAST(k AS INTEGER) AS k, {R(_COSD.format(a='z', b='pz'))} AS dist FROM ff WHERE k < {STRATA_K}",
    "prototype_coverage": f"{ASSIGN}, c AS (SELECT a.stratum_id, {_COSD.format(a='a.z', b='p.pz')} AS c FROM a JOIN (SELECT DISTINCT k, pz FROM ff) p ON p.k = a.stratum_id) SELECT CAST(stratum_id AS INTEGER) AS stratum_id, count(*) AS n_videos, {R('avg(c)')} AS mean_dist, {R('max(c)')} AS max_dist, {R('min(c)')} AS min_dist FROM c GROUP BY 1",
    "stratum_centroids": f"{ASSIGN}, c AS (SELECT stratum_id, j, avg(v) AS v, count(*) AS n FROM (SELECT stratum_id, unnest(range(32)) AS j, unnest(z) AS v FROM a) GROUP BY ALL) SELECT CAST(stratum_id AS INTEGER) AS stratum_id, max(n) AS n_videos, {R('sqrt(sum(v * v))')} AS centroid_norm FROM c GROUP BY 1",
    "component_statistics": f"WITH {CTE['e']}, {CTE['dims']} SELECT CAST(j AS INTEGER) AS component, {R('avg(v)')} AS mean_value, {R('stddev_pop(v)')} AS std_value FROM dims GROUP BY j",
    "component_correlation": f"{_CORR} SELECT statement_index, component, {R('correlation')} AS correlation FROM c",
    "top_loadings": f"{_CORR}, r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(correlation) DESC, statement_index) AS rank FROM c) SELECT statement_index, component, {R('correlation')} AS correlation, CAST(rank AS INTEGER) AS rank, CASE WHEN correlation >= 0 THEN '+' ELSE '-' END AS sign FROM r WHERE rank <= 5",
    "compilation_durations": f"WITH {CTE['m']}, t AS (SELECT comp_id, sum(secs) AS t FROM m GROUP BY 1) SELECT count(*) AS n_compilations, {R('avg(t)')} AS mean_seconds, {R('min(t)')} AS min_seconds, {R('max(t)')} AS max_seconds FROM t",
    "usage_counts": f"WITH {CTE['m']} SELECT video_idx, count(*) AS usage FROM m GROUP BY 1",
    "pool_reference": f"{_POOLSQL} SELECT (SELECT count(*) FROM pool) AS n_videos, CAST(32 AS BIGINT) AS n_dimensions, {R('var')} AS var_global FROM ref",
    "compilation_metrics": f"""{_POOLSQL}, rm AS (SELECT a.video_idx, avg(exp(-power(list_distance(a.z, b.z), 2) / 2)) AS r FROM pool a, pool b GROUP BY 1),
        km AS (SELECT avg(r) AS k FROM rm), s AS (SELECT DISTINCT comp_id, video_idx, z FROM m JOIN pool USING (video_idx)),
        o AS (SELECT comp_id, count(*) AS n, avg(power(list_distance(z, mu), 2)) AS a, avg(r) AS r FROM s JOIN rm USING (video_idx), ref GROUP BY 1),
        sd AS (SELECT comp_id, j, avg(v) AS v FROM (SELECT comp_id, unnest(range(32)) AS j, unnest(z) AS v FROM s) GROUP BY ALL), sc AS (SELECT comp_id, list_distance(list(v ORDER BY j), any_value(mu)) AS shift FROM sd, ref GROUP BY 1),
        p AS (SELECT x.comp_id, avg(list_distance(x.z, y.z)) FILTER (x.video_idx < y.video_idx) AS e, avg(exp(-power(list_distance(x.z, y.z), 2) / 2)) AS k FROM s x JOIN s y USING (comp_id) GROUP BY 1)
        SELECT CAST(comp_id AS BIGINT) AS comp_id, n AS size, {R('a / var')} AS variance_capture, {R('coalesce(e, 0)')} AS mean_pairwise_distance, {R('shift')} AS centroid_shift, {R('sqrt(greatest(0, p.k - 2 * r + km.k))')} AS mmd
        FROM o JOIN sc USING (comp_id) JOIN p USING (comp_id), ref, km""",
}
