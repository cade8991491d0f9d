"""The steps from frame scores to tested compilations, as functions from tables to tables."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquilt.config import PipelineConfig
from reelquilt.operators import interchange, pooling, report, reweight, scoring, selection, strata
from reelquilt.plans import sinks
from reelquilt.plans.materialize import cut
from reelquilt.schemas import require_columns, require_frames
from reelquilt.sources import encoders, media


@dataclass
class Run:
    """Tables and numbers that the steps of one run have made so far."""

    spark: SparkSession
    config: PipelineConfig = field(default_factory=PipelineConfig)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    numbers: dict[str, object] = field(default_factory=dict)

    def need(self, *names: str) -> list[DataFrame]:
        missing = [n for n in names if n not in self.tables]
        if missing:
            raise ValueError(f"earlier steps haven't made: {', '.join(missing)}")
        return [self.tables[n] for n in names]

    def summary(self, step: str, top_n: int = 5) -> dict[str, DataFrame]:
        return report.summary(self.tables, step, top_n)

    def save(self, folder: str) -> Mapping[str, str]:
        return {name: sinks.write(df, folder, name, single=name in ("statement_weights", "prototypes", "k_sweep", "reweight_report", "strata_report", "selection_metrics")) for name, df in self.tables.items() if name in sinks.ARTIFACTS}


def import_step(run: Run, folder: str, out: str, provider: media.MediaProvider) -> Run:
    """Makes ``manifest`` (``path, dst, resolution, error``; with reused outputs ``dst`` alone) and the number of videos."""
    c = run.config
    options = {"sanitize": c.sanitize_names}
    if c.normalize:
        options |= {"target_resolution": c.target_resolution, "uniform_resolution": c.uniform_resolution}
    done, told = media.import_videos(run.spark, folder, out, provider, force=c.force_reimport, normalize=c.normalize, **options)
    done = cut(done)
    run.tables.update(imported=done, manifest=done.select("*", F.lit(json.dumps(told, sort_keys=True)).alias("settings")))
    run.numbers["n_imported"] = done.count()
    return run


def frames_step(run: Run, folder: str, provider: media.MediaProvider) -> Run:
    """Makes ``frames`` of the imported videos that could be probed."""
    (done,) = run.need("imported")
    c = run.config
    good = done.where("error is null") if "error" in done.columns else done
    probed = media.probe_media(good.select(F.col("dst").alias("path")), provider)
    run.tables["frames"] = cut(media.extract_frames(media.extraction_plan(probed, folder), provider, c.fps, overwrite=c.overwrite_frames))
    media.require_some_frames(run.tables["frames"])
    return run


def encode_and_score(run: Run, frames: DataFrame, statements: DataFrame, factory=None) -> Run:
    """Makes ``frame_features, statement_features, frame_scores``.

    Without a ``factory`` of an encoder the configuration's ``model`` is the folder of one (:mod:`reelquilt.sources.encoders`).
    """
    factory = factory or encoders.from_folder(run.config.model)
    require_frames(frames)
    features = cut(scoring.encode_frames(frames, factory))
    texts = cut(scoring.encode_statements(statements, factory))
    run.tables.update(frames=frames, statements=statements, frame_features=features, statement_features=texts, frame_scores=cut(scoring.score_frames(features, texts)))
    counted = features.agg(F.count_if("ok").alias("ok"), F.count("*").alias("n")).first()
    run.numbers.update(n_frames_encoded=counted["ok"], n_frames=counted["n"])
    return run


def aggregate(run: Run) -> Run:
    """Makes ``video_scores_raw`` and ``video_index``; videos without frames aren't among them."""
    (scores,) = run.need("frame_scores")
    c = run.config
    pooled = cut(pooling.pool_scores(scores, c.aggregation, c.percentile))
    index = cut(pooling.video_index(pooled))
    run.tables.update(video_index=index, video_scores_raw=cut(pooled.join(index, "video_id").select("video_id", "video_idx", "statement_index", "score")))
    run.numbers["n_videos"] = index.count()
    return run


def reweight_step(run: Run) -> Run:
    """Makes ``video_scores_centered, video_scores, statement_weights, spectrum, reweight_report``."""
    (raw,) = run.need("video_scores_raw")
    c = run.config
    centered = cut(reweight.center_scores(raw, c.centering))
    weights = reweight.statement_weights(centered, variance_threshold=c.variance_threshold, component_cap=c.component_cap, beta=c.beta)
    table = weights.table(run.spark)
    run.tables.update(
        video_scores_centered=centered,
        statement_weights=table,
        spectrum=weights.spectrum(run.spark),
        video_scores=cut(reweight.apply_weights(centered, table)),
        reweight_report=reweight.reweight_report(weights, run.spark, centering=c.centering, variance_threshold=c.variance_threshold, component_cap=c.component_cap, beta=c.beta),
    )
    run.numbers.update(k95=weights.k95, k_selected=weights.k_selected)
    return run


def strata_step(run: Run) -> Run:
    """Makes ``embedding, prototypes, strata, strata_report`` and, with an automatic number, ``k_sweep``."""
    scores, index = run.need("video_scores", "video_index")
    c = run.config
    z, k_used = strata.build_embedding(scores, c.k_embed, normalize=c.normalize_embedding)
    z = cut(z)
    made = strata.make_strata(z, n_strata=c.n_strata, init=c.init, min_stratum_size=c.min_stratum_size, target_max_dist=c.target_max_dist, cap=c.strata_cap, seed=c.seed)
    labels = cut(made.strata.join(index, "video_idx").select("video_id", "video_idx", "stratum_id", "is_prototype", "dist_to_prototype"))
    heads = strata.prototype_table(run.spark, made.prototypes).join(index, "video_idx").select("prototype_id", "video_id", "video_idx")
    coverage = strata.coverage_metrics(labels).crossJoin(strata.size_histogram(labels))
    auto = made.sweep is not None
    told = {
        "n_videos": labels.count(), "n_statements": scores.select("statement_index").distinct().count(),
        "k_embed_asked": c.k_embed, "k_embed_used": k_used, "mode": "auto" if auto else "manual", "n_strata_asked": made.n_strata,
        "init_mode": c.init, "normalize": c.normalize_embedding, "min_stratum_size": c.min_stratum_size, "seed": c.seed,
    }
    if auto:
        told |= {"target_max_dist": c.target_max_dist, "k_cap": min(told["n_videos"], c.strata_cap or 20)}
    told_of = [F.lit(v).cast("int").alias(k) if v is None else F.lit(v).alias(k) for k, v in told.items()]
    rows = coverage.select("*", *told_of)
    if auto:
        chosen = made.sweep.where(F.col("K") == made.n_strata).select(F.struct("K", "mean_dist", "max_dist", "p95_dist", "min_size").alias("selected_k_metrics"))
        rows = rows.join(chosen, how="left")  # one row each
        run.tables["k_sweep"] = made.sweep
    run.tables.update(embedding=z.join(index, "video_idx").select("video_id", "video_idx", "z"), prototypes=heads, strata=labels, strata_report=rows)
    run.numbers.update(n_strata=made.n_strata, k_embed=k_used)
    return run


def select_step(run: Run, videos: DataFrame) -> Run:
    """Needs ``videos`` with ``video_id`` and ``duration_s``; a video without a duration is never picked."""
    require_columns(videos, ["video_id", "duration_s"], "videos")
    z, labels = run.need("embedding", "strata")
    c = run.config
    rows = z.join(labels.select("video_idx", "stratum_id"), "video_idx").join(videos.select("video_id", "duration_s"), "video_id", "left")
    members = cut(
        selection.select_compilations(
            rows, n_compilations=c.n_compilations, min_seconds=c.comp_min_seconds, max_seconds=c.comp_max_seconds, anchor_metric=c.anchor_metric, coherence_power=c.coherence_power, diversity_power=c.diversity_power, seed=c.seed
        )
    )
    run.tables.update(compilation_members=members, compilations=selection.nested_compilations(members), selection_metrics=selection.compilation_headers(members))
    return run


def test_step(run: Run, pool: str = "members") -> Run:
    members, z = run.need("compilation_members", "embedding")
    c = run.config
    run.tables["interchangeability"] = interchange.interchangeability(members, z, null_draws=c.null_draws, permutations=c.permutations, seed=c.effective_seed, eps=c.eps_std, alpha=c.alpha, pool=pool)
    return run


def from_frame_scores(spark: SparkSession, frame_scores: DataFrame, videos: DataFrame, config: PipelineConfig = PipelineConfig()) -> Run:
    """All steps that need no encoder."""
    run = Run(spark, config, {"frame_scores": frame_scores})
    return select_step(strata_step(reweight_step(aggregate(run))), videos)
