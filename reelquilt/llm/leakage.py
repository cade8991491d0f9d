"""Held-out test passages inside a corpus: pigeonhole pieces, exact piece hits, Myers verification.

A window of ``min_words`` words of a test item with at most ``max_edits`` word edits, cut into ``max_edits + 1`` pieces,
has at least one piece without an edit.  So every text that holds such a window holds one of the pieces exactly.  The
pieces of all windows of all items go into one Aho-Corasick automaton, each text is read once, and hits are verified: a
run of hits on one diagonal is a run of equal words, and what falls short of a whole window goes through Myers'
bit-parallel edit distance (over words).

An automaton is sent to the executors as long as the items are few enough.  Beyond that nothing that grows with them is
sent: pieces become hashes, a bitmap of bounded size tells which stretches of a text may hold one, and only those
stretches are joined to the pieces by hash and verified in the same way.  Either way the corpus is read once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reelquilt.llm.texts import slices
from reelquilt.plans.materialize import cut

_COMBINING = re.compile("[̀-ͯ]+")
_LINE_HYPHEN = re.compile(r"(?<=[^\W_])[-­‐‑][ \t\r]*\n\s*(?=[^\W_])")
_FOREIGN_GAP = re.compile(r"[^\x00-\x7f\w]+")
_WORD = re.compile(r"[^\W_]+")
_ASCII = bytes(i if chr(i).isalnum() and i < 128 else 32 for i in range(256))


#: Windows of items whose sets of words are kept.
MAX_BAGS = 20_000


def normal_words(text: str) -> str:
    """The words of a text joined by single spaces: runs of letters and digits, without case, accents and line hyphens."""
    if "-" in text or "­" in text or "‐" in text or "‑" in text:
        text = _LINE_HYPHEN.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text))
        if not text.isascii():
            text = _FOREIGN_GAP.sub(" ", text)
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split()).decode()
    return " ".join(_WORD.findall(text))


def myers_best(pattern: list[str], words: list[str]) -> int:
    """Least edits (words put in, left out or replaced) that turn the pattern into some stretch of the words."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for w in words:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & mask
        mv = ph & xv & mask
        best = min(best, score)
    return best


class LeakIndex:
    """Automaton over the pieces of test items; items of fewer than ``min_words`` words are one window of their own."""

    def __init__(self, items: list[tuple[object, str]], min_words: int, max_edits: int):
        import ahocorasick

        self.max_edits = max_edits
        self.bags: dict[tuple[int, int], frozenset[str]] = {}
        self.ids, self.words, self.window, self.piece = [], [], [], []
        at: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            words = normal_words(text).split()
            if not words:
                continue
            k, window = len(self.ids), min(min_words, len(words))
            piece = max(1, window // (max_edits + 1))
            self.ids.append(key), self.words.append(words), self.window.append(window), self.piece.append(piece)
            for s in range(len(words) - piece + 1):
                at.setdefault(" " + " ".join(words[s : s + piece]) + " ", []).append((k, s))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def search(self, text: str | None, *, every: bool = False) -> list[tuple[object, int, int]]:
        """(item, longest run of equal words, edits) of each item that the text leaks; ``every`` also tells the others met."""
        if not text or not self.ids:
            return []
        return self.search_words(" " + normal_words(text) + " ", every)

    def search_words(self, flat: str, every: bool = False) -> list[tuple[object, int, int]]:
        hits = list(self.automaton.iter(flat))
        if not hits:
            return []
        gaps = np.fromiter((i for i, c in enumerate(flat) if c == " "), dtype=np.int64) if not flat.isascii() else np.flatnonzero(np.frombuffer(flat.encode(), dtype=np.uint8) == 32)
        starts = np.searchsorted(gaps, [end + 1 - n for end, (n, _) in hits])
        lines: dict[tuple[int, int], list[int]] = {}
        for word, (_, (_, places)) in zip(starts.tolist(), hits):
            for k, s in places:
                lines.setdefault((k, word - s), []).append(s)
        best: dict[int, int] = {}
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for (k, shift), where in lines.items():
            first = last = where[0]
            for s in [*where[1:], -9]:
                if s != last + 1:
                    n = last - first + self.piece[k]
                    best[k] = max(best.get(k, 0), n)
                    runs.setdefault(k, []).append((n, first, shift))
                    first = s
                last = s
        found, words = [], None
        for k, n in best.items():
            edits = 0
            if n < self.window[k]:
                if not self.max_edits and not every:
                    continue
                words = words if words is not None else flat.split()
                edits = min(self._verify(k, run, words) for run in set(runs[k]))
            if edits <= self.max_edits or every:
                found.append((self.ids[k], n, edits))
        return found

    def _bag(self, k: int, a: int) -> frozenset[str]:
        if (k, a) not in self.bags:
            if len(self.bags) >= MAX_BAGS:
                self.bags.clear()
            self.bags[k, a] = frozenset(self.words[k][a : a + self.window[k]])
        return self.bags[k, a]

    def _verify(self, k: int, run: tuple[int, int, int], words: list[str]) -> int:
        n, first, shift = run
        item, size, e = self.words[k], self.window[k], self.max_edits
        best = e + 1
        low, high = max(0, first + n - size), min(first, len(item) - size)
        near = set(words[max(0, shift + low - e) : shift + high + size + e])
        for a in range(low, high + 1):
            if len(self._bag(k, a) - near) > e:  # each word type that isn't near costs an edit
                continue
            best = min(best, myers_best(item[a : a + size], words[max(0, shift + a - e) : shift + a + size + e]))
            if best <= 1:  # 0 would have been a run of its own
                break
        return best


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    max_edits: int = 1,
    block_chars: int = 2_000_000,
) -> DataFrame:
    """Pairs of a document and a test item it leaks: the two ids, ``matched_words``, ``edits``.

    A document leaks an item if it holds a window of ``min_words`` consecutive words of it (all of a shorter item) with at
    most ``max_edits`` word edits.  ``matched_words`` is the longest run of equal words, ``edits`` is 0 if that run is a
    whole window.  Null, empty and wordless texts leak nothing; an item without words is never leaked.  Ids may be null or
    repeated: a row comes out per input row and item row (exact repeats of an item row count once).  Other columns are
    ignored, whatever their names.  ``block_chars`` bounds the item text in the automaton that is sent to the executors; of
    more items the pieces are joined by hash, with the same result.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("t")).where("t is not null").distinct()
    total = own.agg(F.sum(F.length("t"))).first()[0] or 0
    schema = T.StructType(
        [T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("matched_words", T.IntegerType()), T.StructField("edits", T.IntegerType())]
    )
    if total > block_chars:
        return _find_by_hash(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")), own, min_words, max_edits, schema)
    shared = spark.sparkContext.broadcast(sorted(((r["id"], r["t"]) for r in own.collect()), key=lambda x: (x[1], str(x[0]))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LeakIndex(shared.value, min_words, max_edits)
        kind = None
        for batch in batches:
            kind = kind or _arrow_type(schema[item_id].dataType)
            for part, texts in slices(batch, 1):
                rows, keys, runs, edits = [], [], [], []
                for i, t in enumerate(texts):
                    for key, n, e in index.search(t):
                        rows.append(i), keys.append(key), runs.append(n), edits.append(e)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, kind), pa.array(runs, pa.int32()), pa.array(edits, pa.int32())], names=[doc_id, item_id, "matched_words", "edits"]
                )

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def piece_hashes(flat: str, piece: int) -> np.ndarray:
    """Hashes of all runs of ``piece`` words of words between single spaces (and one at either end), as signed numbers.

    A polynomial over the bytes: sums of bytes times powers give every stretch's hash from two of them.
    """
    raw = np.frombuffer(flat.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    gaps = np.flatnonzero(raw == 32)
    if len(gaps) <= piece:
        return np.zeros(0, dtype=np.int64)
    powers = np.full(len(raw), _BASE, dtype=np.uint64)
    inverse = np.full(len(raw), _BASE_INVERSE, dtype=np.uint64)
    powers[0] = inverse[0] = 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers))])
    start, end = gaps[:-piece], gaps[piece:]
    h = (sums[end + 1] - sums[start]) * np.cumprod(inverse)[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _bitmap(pieces: DataFrame, bits: int) -> np.ndarray:
    """Which of 2^bits values the upper bits of the pieces' hashes have; 2^bits / 8 bytes in all, whatever the pieces."""
    low = min(bits, 16)
    place = F.shiftrightunsigned("h", 64 - bits)
    used = pieces.select(F.shiftrightunsigned(place, low).cast("int").alias("part"), F.pmod(place, F.lit(1 << low)).cast("int").alias("at")).distinct()

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << low, dtype=bool)
        flags[table.column("at").to_numpy()] = True
        return pa.table([table.column("part").slice(0, 1), pa.array([np.packbits(flags).tobytes()])], names=["part", "flags"])

    out = np.zeros((1 << (bits - low), (1 << low) // 8), dtype=np.uint8)
    for r in used.groupBy("part").applyInArrow(pack, "part int, flags binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(r["flags"], dtype=np.uint8)
    return out.ravel()


def _find_by_hash(docs: DataFrame, items: DataFrame, min_words: int, max_edits: int, schema: T.StructType, *, most_bits: int = 28) -> DataFrame:
    """:func:`find_leaks` for any number of items; ``most_bits`` bounds the bitmap (32 MB)."""
    spark = docs.sparkSession
    numbered = cut(items.withColumn("no", F.monotonically_increasing_id()))

    def shapes(words: list[str]) -> tuple[int, int]:
        window = min(min_words, len(words))
        return window, max(1, window // (max_edits + 1))

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                numbers, hashes, sizes = [], [], []
                for no, t in zip(part.column(0).to_pylist(), texts):
                    flat = normal_words(t)
                    if flat:
                        size = shapes(flat.split())[1]
                        h = np.unique(piece_hashes(f" {flat} ", size))
                        numbers.append(np.full(len(h), no)), hashes.append(h), sizes.append(np.full(len(h), size, dtype=np.int32))
                if hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (numbers, hashes, sizes)], names=["no", "h", "size"])

    pieces = cut(numbered.select("no", "t").mapInArrow(cut_up, "no long, h long, size int"))
    counted = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a few sizes
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, sum(counted.values())))), 10, most_bits))
    shared = spark.sparkContext.broadcast((_bitmap(pieces, bits), sorted(counted)))
    around = min_words + max_edits
    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc", docs.schema["doc"].dataType), T.StructField("words", T.StringType()), T.StructField("hs", T.ArrayType(T.LongType()))])

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, sizes = shared.value
        for batch in batches:
            for part, texts in slices(batch, 2):
                rows, snippets, found = [], [], []
                for i, t in enumerate(texts):
                    flat = normal_words(t) if t else ""
                    if not flat:
                        continue
                    at, hs, ends = [], [], []
                    for size in sizes:
                        h = piece_hashes(f" {flat} ", size)
                        place = h.view(np.uint64) >> np.uint64(64 - bits)
                        hit = np.flatnonzero(flags[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8) & 1)
                        at.append(hit), hs.append(h[hit]), ends.append(hit + size)
                    start, hashed, end = (np.concatenate(x) for x in (at, hs, ends))
                    if not len(start):
                        continue
                    words, order = flat.split(), np.argsort(start, kind="stable")
                    start, hashed, end = start[order], hashed[order], np.maximum.accumulate(end[order])
                    # hits whose surroundings meet stay together, so that no window and no run is cut
                    heads = np.flatnonzero(np.concatenate([[True], start[1:] - around > end[:-1] + around]))
                    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(start)]):
                        rows.append(i)
                        snippets.append(" ".join(words[max(0, int(start[a]) - around) : int(end[b - 1]) + around]))
                        found.append(np.unique(hashed[a:b]))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(snippets, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=kind.names)

    met = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc", "t").mapInArrow(stretches, kind).withColumn("snippet", F.monotonically_increasing_id()))
    pairs = met.select("snippet", F.explode("hs").alias("h")).join(pieces.select("h", "no"), "h").select("snippet", "no").distinct()
    both = pairs.join(met.select("snippet", "row", "doc", "words"), "snippet").join(numbered, "no").select("row", "no", "doc", "id", "words", "t").sortWithinPartitions("no")
    out_kind = T.StructType([*both.schema.fields[:4], T.StructField("n", T.IntegerType()), T.StructField("e", T.IntegerType())])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            rows, runs, edits = [], [], []
            for i, (no, words, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 4, 5)))):
                if no != last:
                    last, index = no, LeakIndex([(no, t)], min_words, max_edits)
                for _, n, e in index.search_words(f" {words} ", True):
                    rows.append(i), runs.append(n), edits.append(e)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(4)), pa.array(runs, pa.int32()), pa.array(edits, pa.int32())], names=out_kind.names)

    found = both.mapInArrow(verify, out_kind).groupBy("row", "no", "doc", "id").agg(F.max("n").alias("n"), F.min("e").alias("e")).where(F.col("e") <= max_edits)
    return found.select(F.col("doc").alias(schema.names[0]), F.col("id").alias(schema.names[1]), F.col("n").alias("matched_words"), F.col("e").alias("edits"))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
