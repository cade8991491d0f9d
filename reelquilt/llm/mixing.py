"""Mixing sources to target shares of a total size in tokens.

The mix is apportioned in blocks of equal token count by Sainte-Laguë's highest quotients: first to the sources, each
capped at what it holds times its repeats, then within a source to its shards (as many as its size asks for) by what they
hold.  Each shard then fills its quota alone: whole passes over its documents first, the rest from the head of a seeded order.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from reelquilt.llm.texts import slices
from reelquilt.plans.materialize import cut

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the published split pattern of the 50k byte-level vocabularies.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict[str, object] = {}


def load_encoding(path: str):
    """Byte-level BPE of a rank file, loaded once per process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(docs: DataFrame, keep: Sequence[str], *, text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the length of the whole text in tokens of a public vocabulary (0 for null)."""
    own = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*(own.schema[k] for k in keep), T.StructField("tokens", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for _, texts in slices(batch, len(keep)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return own.mapInArrow(run, schema)


def sainte_lague(weights: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 * seats so far + 1), none beyond its cap; ties go to the earlier entry.

    Bisection over the quotient finds all but the last few seats, so the cost doesn't grow with the number of seats.
    Entries without weight get none; if the caps leave no room, fewer seats are given.
    """
    w = np.array([max(0.0, float(x or 0)) for x in weights])
    cap = np.where(w > 0, np.maximum(np.asarray(caps, dtype=np.int64), 0), 0) if len(w) else np.zeros(0, dtype=np.int64)
    seats = min(int(seats), int(cap.sum()))
    if seats <= 0:
        return [0] * len(w)

    def given(quotient: float) -> np.ndarray:  # seats whose quotient is above this one
        return np.minimum(np.maximum(np.ceil((w / quotient - 1) / 2), 0), cap).astype(np.int64)

    low, high = float(w[w > 0].min()) / (2.0 * float(cap.max()) + 3), float(w.max()) * 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
        if high / low < 1 + 1e-12:
            break
    out = given(high)
    heap = [(-w[i] / (2 * int(out[i]) + 1), i) for i in range(len(w)) if out[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * int(out[i]) + 1), i))
    return out.tolist()


def source_key(name: Column) -> Column:
    """Letters and digits of a source's name, in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


class Mix:
    """A planned mix of documents.

    ``docs`` need an id, a source and a text; ``targets`` have ``source``, ``target_share`` and ``max_repeats``.  Names
    agree when their letters and digits do, ignoring case; target rows whose names agree are one source with the sum of
    their shares and the most repeats.  Documents without a listed source take no part; null and empty texts have no
    tokens and are repeated like the rest of their shard.  Null shares and repeats count as 0 and 1.  Ids may be null or
    repeated.  Other columns are ignored, whatever their names.

    The mix is as large as all documents of listed sources together, unless ``mix_tokens`` says otherwise.
    """

    def __init__(
        self,
        docs: DataFrame,
        targets: DataFrame,
        *,
        doc_id: str = "doc_id",
        source: str = "source",
        text: str = "text",
        vocabulary: str = DEFAULT_VOCABULARY,
        mix_tokens: int | None = None,
        block_tokens: int = 1024,
        shard_tokens: int = 20_000_000,
        max_sources: int = 100_000,
        seed: int = 1234,
    ):
        spark = docs.sparkSession
        listed = (
            targets.select(F.col("source").alias("s"), F.col("target_share").alias("p"), F.col("max_repeats").alias("r"))
            .where(F.length(source_key(F.col("s"))) > 0)
            .distinct()
            .groupBy(source_key(F.col("s")).alias("key"))
            .agg(F.min("s").alias("source"), F.sum(F.coalesce("p", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("r", F.lit(1))).cast("long").alias("max_repeats"))
        )
        rows = listed.limit(max_sources + 1).collect()
        if len(rows) > max_sources:
            raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold them")
        self.sources = sorted(({**r.asDict()} for r in rows), key=lambda r: r["source"])
        names = spark.createDataFrame([(r["key"],) for r in self.sources], "key string")
        own = docs.select(F.col(doc_id).alias("id"), source_key(F.col(source)).alias("key"), F.xxhash64(F.lit(seed + 1), F.col(doc_id), F.col(text)).alias("h"), F.col(text).alias("text"))
        own = own.join(F.broadcast(names), "key", "left_semi")  # max_sources names at most
        self.sized = cut(count_tokens(own, ["id", "key", "h"], vocabulary=vocabulary))
        held = {r["key"]: (r["t"], r["n"]) for r in self.sized.groupBy("key").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
        for r in self.sources:
            r["held_tokens"], r["documents"] = held.get(r["key"], (0, 0))
        self.total = sum(r["held_tokens"] for r in self.sources)
        self.mix_tokens = self.total if mix_tokens is None else mix_tokens
        self.block, self.seed, self.doc_id = block_tokens, seed, doc_id
        shares = [max(0.0, r["target_share"]) for r in self.sources]
        caps = [r["held_tokens"] * r["max_repeats"] // block_tokens for r in self.sources]
        quota = sainte_lague(shares, caps, -(-self.mix_tokens // block_tokens))
        # what the same apportionment gives to each source if nothing limits it
        blocks = -(-int(self.mix_tokens * sum(shares)) // block_tokens)
        asked = sainte_lague(shares, [blocks] * len(shares), blocks)
        for r, q, a, cap in zip(self.sources, quota, asked, caps):
            r["blocks"] = q
            r["shards"] = max(1, -(-r["held_tokens"] // shard_tokens))
            # blocks tell the sources that fall short; what is within two blocks of its share is decided by tokens
            r["reachable"] = a + 2 <= cap or r["held_tokens"] * r["max_repeats"] >= r["target_share"] * self.mix_tokens

        self.shards = max((r["shards"] for r in self.sources), default=1)

    def unreachable(self) -> DataFrame:
        """Sources that can't reach their share even with all their repeats: ``source``.

        They are those that get fewer blocks than the same apportionment without limits would give them, by tokens too.
        """
        spark = self.sized.sparkSession
        return spark.createDataFrame([(r["source"],) for r in self.sources if not r["reachable"]], "source string")

    def shard_quotas(self, rows: DataFrame) -> DataFrame:
        """``key, shard, source, whole, rest`` of the shards that give anything: passes over all documents, tokens on top.

        ``rows`` have ``key``, ``shard`` and ``tokens``.  Each source's shards are apportioned in a task of their own.
        """
        spark, block = rows.sparkSession, self.block
        plan = spark.createDataFrame([(r["key"], r["source"], r["blocks"], r["max_repeats"]) for r in self.sources], "key string, source string, blocks long, max_repeats long")
        held = rows.groupBy("key", "shard").agg(F.sum("tokens").alias("t")).join(F.broadcast(plan), "key")

        def apportion(table: pa.Table) -> pa.Table:
            table = table.sort_by("shard")
            t = table.column("t").to_numpy()
            blocks, repeats = table.column("blocks")[0].as_py(), table.column("max_repeats")[0].as_py()
            given = sainte_lague(t, -(-t * repeats // block), blocks)
            want = np.minimum(np.asarray(given, dtype=np.int64) * block, t * repeats)
            some = np.flatnonzero((want > 0) & (t > 0))
            own = table.take(pa.array(some))
            return pa.table([own.column("key"), own.column("shard"), own.column("source"), pa.array(want[some] // t[some]), pa.array(want[some] % t[some])], names=["key", "shard", "source", "whole", "rest"])

        return held.groupBy("key").applyInArrow(apportion, "key string, shard long, source string, whole long, rest long")

    def selection(self) -> DataFrame:
        """Documents of the mix: the id, ``source``, ``tokens`` and ``repeats`` (at least 1, at most the source's cap)."""
        spark = self.sized.sparkSession
        counts = spark.createDataFrame([(r["key"], r["shards"]) for r in self.sources], "key string, shards long")
        rows = self.sized.join(F.broadcast(counts), "key").withColumn("shard", F.pmod("h", "shards")).drop("shards")
        ahead = W.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(self.seed), "id", "h"), "id", "tokens").rowsBetween(W.unboundedPreceding, 0)
        middle = F.sum("tokens").over(ahead) - F.col("tokens") / 2
        return (
            rows.join(self.shard_quotas(rows), ["key", "shard"])
            .withColumn("repeats", (F.col("whole") + F.when(middle < F.col("rest"), 1).otherwise(0)).cast("int"))
            .where("repeats > 0")
            .select(F.col("id").alias(self.doc_id), "source", "tokens", "repeats")
        )

    def report(self) -> DataFrame:
        """One row per listed source: what it holds, what was asked and what its share of the mix came to."""
        spark = self.sized.sparkSession
        plan = spark.createDataFrame(
            [(r["source"], float(r["target_share"]), r["max_repeats"], r["documents"], r["held_tokens"], r["blocks"], r["reachable"]) for r in self.sources],
            "source string, target_share double, max_repeats long, documents long, held_tokens long, blocks long, reachable boolean",
        )
        drawn = self.selection().groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
        joined = plan.join(drawn, "source", "left").na.fill(0, ["mixed_tokens", "most_repeats"])
        share = F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(W.partitionBy()), F.lit(1))
        return joined.withColumn("actual_share", share)
