"""Queries of the training-data operators over the project's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelquilt.llm import clusters, langid, leakage, mixing, neighbors, packing, quantiles, runs, subset
from reelquilt.llm.vectors import usable
from reelquilt.plans.materialize import cut
from reelquilt.sources.tables import table

EMBEDDING_SIZE = 32
LINK_RADIUS = 0.06
SCORE_SHAPE = quantiles.DyadicSketch(low=-1.0, high=1.0, bits=16, top=64, width=1024, depth=5)


def _embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embedding").select("video_idx", "z")


def p1_subset(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of all videos, spread over the kinds of video by square-root quotas, with their weight in compilations."""
    videos = _embedding(spark, d)
    wanted = videos.where(usable(F.col("z"), EMBEDDING_SIZE)).select("video_idx").distinct().count() // 10
    chosen = subset.varied_subset(videos, wanted, item="video_idx", vector="z", size=EMBEDDING_SIZE)
    used = table(spark, d, "compilations").select("comp_id", F.explode("members").alias("m")).select("comp_id", F.col("m.idx").alias("video_idx")).distinct().groupBy("video_idx").agg(F.count("*").alias("in_compilations"))
    return chosen.join(used, "video_idx", "left").na.fill(0, ["in_compilations"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.mutual_pairs(_embedding(spark, d), 5, item="video_idx", vector="z", min_cosine=0.97, size=EMBEDDING_SIZE)


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest of every twentieth video, among all videos."""
    return neighbors.nearest(_embedding(spark, d), 5, item="video_idx", vector="z", size=EMBEDDING_SIZE, queries=F.col("id") % 20 == 0, factor=0.6)


def _score_vectors(spark: SparkSession, d: str, *, complete: bool = True) -> tuple[DataFrame, list[int]]:
    statements = sorted(r[0] for r in table(spark, d, "statements").select("statement_index").distinct().collect())
    rows = table(spark, d, "video_scores").select("video_idx", "statement_index", "score", "computed_at")  # the newest row counts, repeated or not
    return clusters.feature_vectors(rows, statements, record="video_idx", feature="statement_index", value="score", version="computed_at", complete=complete), statements


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    vectors, statements = _score_vectors(spark, d)
    weighted = lambda rows: clusters.FeatureHash(statements, clusters.inverse_deviations(rows, len(statements)))
    groups = clusters.linked_groups(vectors, len(statements), LINK_RADIUS, hashing=weighted)
    return groups.where("group_size >= 5").select(F.col("id").alias("video_idx"), F.col("group_id").alias("group_video_idx"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile of every group's non-null scores, from mergeable sketches."""
    keys = ["video_id", "statement_index"]
    rows = table(spark, d, "frame_scores")
    parts = quantiles.sketch_sequences(rows, sequence="video_id", position="frame_idx", feature="statement_index", value="score", shape=SCORE_SHAPE)
    found = quantiles.quantiles(parts, keys, [0.5, 0.95], shape=SCORE_SHAPE)
    return found.select(*keys, F.col("n").alias("n_scores"), F.col("quantiles")[0].alias("median"), F.col("quantiles")[1].alias("p95"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_percentiles(spark, d).where("n_scores >= 20 and p95 >= 0.30 and median <= 0.20").select("video_id", "statement_index")


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    """Sketched percentiles against exact ones, as one row: groups, groups with scores, those beyond the stated error.

    Groups of at most ``SCORE_SHAPE.raw`` scores may be off by half a cell of the finest resolution, larger ones by the
    value that is half a hundredth of their ranks away.
    """
    keys = ["video_id", "statement_index"]
    rows = table(spark, d, "frame_scores").select("video_id", "frame_idx", "statement_index", "score").repartition(*keys).distinct()
    at = [0.495, 0.5, 0.505, 0.945, 0.95, 0.955]
    exact = rows.groupBy(*keys).agg(F.percentile("score", F.array(*map(F.lit, at))).alias("e"))
    both = p4_percentiles(spark, d).join(exact.select(F.struct(*keys).alias("key"), "e"), F.struct(*keys).eqNullSafe(F.col("key")))
    cell = (SCORE_SHAPE.high - SCORE_SHAPE.low) / SCORE_SHAPE.values
    kept = F.col("n_scores") <= SCORE_SHAPE.raw
    e = lambda i: F.col("e")[i]
    off = lambda x, i: F.when(kept, F.abs(F.col(x) - e(i)) > 0.51 * cell).otherwise(~F.col(x).between(e(i - 1) - cell, e(i + 1) + cell))
    return both.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n_scores") > 0).alias("n_with_scores"), F.count_if(F.coalesce(off("median", 1) | off("p95", 4), F.lit(False))).alias("n_beyond"))


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "frame_scores"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_runs(spark, d).where("n_events >= 2").select("video_id", "first_frame_idx", "last_frame_idx")


def _durations(spark: SparkSession, d: str) -> DataFrame:
    """Newest valid duration of each video; the stem of the path where the id is missing."""
    rows = table(spark, d, "media_probe")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    rows = rows.select(F.coalesce("video_id", stem).alias("video_id"), "duration_s", "probed_at").where((F.col("duration_s") > 0) & (F.col("duration_s") < float("inf")))
    return rows.groupBy("video_id").agg(F.max(F.struct("probed_at", "duration_s")).alias("s")).select("video_id", F.col("s.duration_s").alias("duration_s"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every video with its compilation; pieces of one video never share one, as all but the last fill one each.  No conflict arises."""
    return packing.pack(_durations(spark, d), 65.0, item="video_id", size="duration_s", cluster="video_id")


def p7_apart(spark: SparkSession, d: str) -> DataFrame:
    """:func:`p7_packed` so that no compilation holds two videos of one source or two that are nearly the same.

    A video's source is its id without the number; videos are nearly the same if they are linked in ``p3_found``.  Both
    come with each piece (``duplicate_of`` is null for a video that is like no other).
    """
    vectors, statements = _score_vectors(spark, d)
    weighted = lambda rows: clusters.FeatureHash(statements, clusters.inverse_deviations(rows, len(statements)))
    groups = clusters.linked_groups(vectors, len(statements), LINK_RADIUS, hashing=weighted).where("group_size > 1")
    names = table(spark, d, "video_scores").select("video_id", "video_idx").distinct()
    alike = groups.join(names, groups["id"] == names["video_idx"]).groupBy("video_id").agg(F.min("group_id").alias("duplicate_of"))
    source = F.regexp_replace("video_id", r"_\d+$", "").alias("source")
    videos = cut(_durations(spark, d).join(alike, "video_id", "left").select("video_id", "duration_s", source, "duplicate_of"))
    packed = packing.pack(videos, 65.0, item="video_id", size="duration_s", source="source", cluster="duplicate_of")
    return packed.join(videos.select("video_id", "source", "duplicate_of"), "video_id")


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """What :func:`p7_packed` comes to, as one row; ``tight``: at most 2 % (and one) more compilations than seconds ask for."""
    packed = cut(p7_packed(spark, d))
    bins = packed.groupBy("bin_id").agg(F.sum("secs").alias("s"), F.max("bin_total").alias("t")).agg(F.count("*").alias("n_bins"), F.max("s").alias("longest"), F.count_if(F.abs(F.col("s") - F.col("t")) > 1e-6).alias("n_wrong"))
    own = packed.agg(F.countDistinct("video_id").alias("n_videos"), F.count("*").alias("n_pieces"), F.sum("secs").alias("s"))
    tight = F.col("n_bins") <= 1.02 * F.ceil(F.col("s") / 65) + 1
    return own.crossJoin(bins).select("n_videos", "n_pieces", F.round(F.col("s"), 3).alias("total_seconds"), (F.coalesce(F.col("longest"), F.lit(0.0)) <= 65 + 1e-6).alias("within"), "n_wrong", F.coalesce(tight, F.lit(True)).alias("tight"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_packed(spark, d).where("n_pieces > 1 and piece = 0").select("video_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every document and test item that share twelve words in a row, give or take one word."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_words=12, max_edits=1)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where("matched_words >= 12").select("doc_id", "item_id")


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.Mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).unreachable()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).selection()


def _language_model(docs: DataFrame) -> langid.NgramModel:
    return langid.fit_calibrated(docs)


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.detect_languages(docs, _language_model(docs))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return langid.unnamed_languages(docs, _language_model(docs))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means clusters of all videos by their scores: size, most typical members and how the strata label them.

    A missing score counts as the statement's mean.  Statements are weighted by their inverse variance where clusters are
    formed; radius and typical members are measured on the scores themselves.
    """
    vectors, statements = _score_vectors(spark, d, complete=False)
    vectors = cut(vectors)
    weights = clusters.inverse_deviations(vectors, len(statements))
    names = table(spark, d, "video_scores").select("video_id", F.col("video_idx").alias("id")).distinct()
    labels = table(spark, d, "strata").select("video_id", F.col("stratum_id").alias("label")).distinct().join(names, "video_id").select("id", "label")
    return clusters.labelled_clusters(vectors, clusters.FeatureHash(statements, weights), labels, k=64)


#: Runs of frames as ``g`` (a row per frame): what :data:`p5_found` has, without the frames and keys that have no place.
_RUNS = """
            WITH c AS (SELECT video_id, frame_idx, statement_index, min(score) AS score FROM frame_scores WHERE video_id IS NOT NULL AND frame_idx IS NOT NULL AND statement_index IS NOT NULL GROUP BY ALL),
            f AS (SELECT video_id, frame_idx, lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev FROM (SELECT DISTINCT video_id, frame_idx FROM c)),
            l AS (SELECT f.video_id, f.frame_idx, coalesce(f.frame_idx - f.prev <= 3, false) AND NOT EXISTS (
                    SELECT 1 FROM c x JOIN c y ON x.statement_index = y.statement_index
                    WHERE x.video_id = f.video_id AND x.frame_idx = f.frame_idx AND y.video_id = f.video_id AND y.frame_idx = f.prev AND abs(x.score - y.score) > 0.005 + 1e-9) AS linked FROM f),
            g AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS run FROM l)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_subset, p2_found, p2_nearest, p3_found, p3_clusters, p4_found, p4_percentiles, p4_errors, p5_found, p5_runs, p7_found, p7_packed, p7_apart, p7_totals, p8_found, p8_leaks, p9_found, p9_report, p9_selection, p10_found, p10_languages)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
            WITH v AS (SELECT video_idx, min(z) AS z FROM embedding WHERE len(z) = 32 AND list_max(list_transform(z, lambda x: abs(x))) > 0 AND video_idx IS NOT NULL GROUP BY video_idx),
            u AS (SELECT video_idx, list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) AS z FROM v),
            c AS (SELECT a.video_idx AS a, b.video_idx AS b, list_dot_product(a.z, b.z) AS c FROM u a JOIN u b ON a.video_idx <> b.video_idx),
            r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY round(c, 12) DESC, b) AS k FROM c)
            SELECT x.a AS video_idx_a, x.b AS video_idx_b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a
            WHERE x.a < x.b AND x.k <= 5 AND y.k <= 5 AND x.c >= 0.97""",
        "p3_found": """
            WITH RECURSIVE newest AS (SELECT video_idx, statement_index, arg_max(row(score), computed_at) AS s FROM video_scores GROUP BY ALL),
            v AS (SELECT video_idx, list(s[1] ORDER BY statement_index) AS x FROM newest WHERE s[1] IS NOT NULL GROUP BY video_idx HAVING count(*) = (SELECT count(DISTINCT statement_index) FROM statements)),
            e AS (SELECT a.video_idx AS a, b.video_idx AS b FROM v a JOIN v b ON list_distance(a.x, b.x) <= 0.06),
            reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
            g AS (SELECT a AS video_idx, min(b) AS group_video_idx FROM reach GROUP BY a)
            SELECT video_idx, group_video_idx FROM g WHERE group_video_idx IN (SELECT group_video_idx FROM g GROUP BY 1 HAVING count(*) >= 5)""",
        "p4_found": """
            SELECT video_id, statement_index FROM (SELECT DISTINCT video_id, frame_idx, statement_index, score FROM frame_scores WHERE score IS NOT NULL)
            GROUP BY ALL HAVING count(*) >= 20 AND quantile_cont(score, 0.95) >= 0.30 AND median(score) <= 0.20""",
        "p4_errors": """
            SELECT count(*) AS n_groups, count(*) FILTER (n > 0) AS n_with_scores, CAST(0 AS BIGINT) AS n_beyond
            FROM (SELECT video_id, statement_index, count(score) AS n FROM frame_scores GROUP BY ALL)""",
        "p5_runs": _RUNS + """
            SELECT video_id, min(frame_idx) AS first_frame_idx, max(frame_idx) AS last_frame_idx, count(*) AS n_events, CAST((max(frame_idx) - min(frame_idx) + 1) / 3.0 AS DOUBLE) AS duration_s FROM g GROUP BY video_id, run""",
        "p5_found": """
            WITH c AS (SELECT video_id, frame_idx, statement_index, min(score) AS score FROM frame_scores GROUP BY ALL),
            f AS (SELECT video_id, frame_idx, lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) AS prev FROM (SELECT DISTINCT video_id, frame_idx FROM c)),
            l AS (SELECT f.video_id, f.frame_idx, coalesce(f.frame_idx - f.prev <= 3, false) AND NOT EXISTS (
                    SELECT 1 FROM c x JOIN c y ON x.statement_index = y.statement_index
                    WHERE x.video_id = f.video_id AND x.frame_idx = f.frame_idx AND y.video_id = f.video_id AND y.frame_idx = f.prev AND abs(x.score - y.score) > 0.005 + 1e-9) AS linked FROM f),
            g AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY frame_idx) AS run FROM l)
            SELECT video_id, min(frame_idx) AS first_frame_idx, max(frame_idx) AS last_frame_idx FROM g GROUP BY video_id, run HAVING count(*) >= 2""",
        "p7_found": """
            WITH m AS (SELECT coalesce(video_id, regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '')) AS video_id, duration_s, probed_at FROM media_probe WHERE duration_s > 0 AND isfinite(duration_s))
            SELECT video_id FROM m GROUP BY video_id HAVING arg_max(duration_s, probed_at) > 65.0""",
        "p7_totals": """
            WITH m AS (SELECT coalesce(video_id, regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '\\.[^.]*$', '')) AS video_id, duration_s, probed_at FROM media_probe WHERE duration_s > 0 AND isfinite(duration_s)),
            v AS (SELECT video_id, arg_max(duration_s, probed_at) AS s FROM m GROUP BY video_id)
            SELECT count(*) AS n_videos, CAST(sum(ceil(s / 65)) AS BIGINT) AS n_pieces, round(sum(s), 3) AS total_seconds, true AS within, CAST(0 AS BIGINT) AS n_wrong, true AS tight FROM v""",
        "p8_found": r"""
            WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM eval_items),
            w AS (SELECT kind, id, regexp_extract_all(lower(strip_accents(regexp_replace(text, '([\p{L}\p{N}])[-\x{00AD}\x{2010}\x{2011}][ \t\r]*\n\s*([\p{L}\p{N}])', '\1\2', 'g'))), '[\p{L}\p{N}]+') AS w FROM t WHERE text IS NOT NULL),
            g AS (SELECT kind, id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT kind, id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12))
            SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g AND d.kind = 0 AND i.kind = 1""",
        # sizes in characters stand for tokens: no source is near the limit
        "p9_found": r"""
            WITH t AS (SELECT source, target_share, max_repeats, regexp_replace(lower(source), '[^\p{L}\p{N}]', '', 'g') AS k FROM source_targets),
            d AS (SELECT regexp_replace(lower(source), '[^\p{L}\p{N}]', '', 'g') AS k, sum(coalesce(length(text), 0)) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
            j AS (SELECT t.*, coalesce(d.n, 0) AS n FROM t LEFT JOIN d USING (k))
            SELECT source FROM j WHERE n * max_repeats < target_share * (SELECT sum(n) FROM j)""",
    }
