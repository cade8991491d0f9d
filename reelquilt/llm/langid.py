"""Document and passage languages: multinomial naive Bayes over hashed character n-grams.

The model is a ``(buckets, languages)`` matrix of log-probabilities.  It is fitted on a bounded, documented sample of
labelled rows, broadcast (its size is fixed by ``buckets`` and the number of languages), and applied to whole texts:
every character n-gram of every word is scored in numpy, the scores are summed per word, and the most probable sequence
of languages (a Viterbi path with a price for every change) divides each text into passages.

A passage's confidence is the share of its words that are to be expected to be in its language: a logistic function of
its lead over the next language and of its length, fitted on passages put together from texts that the model hasn't seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from reelquilt.llm.texts import slices

LANGUAGES = ("en", "de", "fr", "it", "es")

# The words for "page" and "of" in running heads of the five languages.  They tell the heads that occur once;
# those that recur are told by their numbers, whatever their words.
_PAGE = r"(?:page|seite|pagina|página)"
_OF = r"(?:of|von|sur|di|de)"
_RUNNING_HEAD = re.compile(
    rf"\n[ \t]*(?:[^\n]{{0,60}}[-–—|][ \t]*)?{_PAGE}[ \t]*\d+(?:[ \t]*(?:{_OF}|/)[ \t]*\d+)?[ \t]*(?=\n|\Z)"
    r"|\n[ \t]*[-–—][ \t]*\d+[ \t]*[-–—][ \t]*(?=\n|\Z)",
    re.IGNORECASE,
)
_SPLIT_WORD = re.compile(r"(?<=[^\W\d_])[-­‐‑][ \t\r]*\n\s*(?=[^\W\d_])")
_BMP = 1 << 16
#: Characters that are scored together.
BLOCK_CHARS = 1 << 20


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(_BMP)), dtype=bool, count=_BMP)


_LETTER: np.ndarray | None = None


_HEAD_CHARS = 90
_NUMBER = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_]")


def _without_running_heads(text: str) -> str:
    """The text without lines that stand alone and recur with one number counting up, and nothing else changed."""
    lines = text.split("\n")
    found: dict[str, list[tuple[int, list[str]]]] = {}
    for i in range(1, len(lines) - 1):
        line = lines[i].strip()
        if line and len(line) <= _HEAD_CHARS and not lines[i - 1].strip() and not lines[i + 1].strip() and _LETTERS.search(line):
            numbers = _NUMBER.findall(line)
            if numbers:
                found.setdefault(_NUMBER.sub("0", line), []).append((i, numbers))
    drop = set()
    for places in found.values():
        if len(places) < 2:
            continue
        changing = [column for column in zip(*(numbers for _, numbers in places)) if len(set(column)) > 1]
        if len(changing) == 1:
            counts = [int(x[:18]) for x in changing[0]]
            if all(b == a + 1 for a, b in zip(counts, counts[1:])):
                drop.update(i for i, _ in places)
    return "\n".join(line for i, line in enumerate(lines) if i not in drop) if drop else text


def clean_text(text: str) -> str:
    """Lower case, composed, without page heads and with words split at a line end put together."""
    text = "\n" + _without_running_heads(unicodedata.normalize("NFC", text))
    if _RUNNING_HEAD.search(text):
        text = _RUNNING_HEAD.sub("\n", text)
    if "-\n" in text or "­" in text or "- \n" in text:
        text = _SPLIT_WORD.sub("", text)
    return text.lower()


@dataclass(frozen=True)
class NgramModel:
    """Log-probabilities of hashed n-grams, ``weights[bucket, language]``; buckets are a power of two.

    ``calibration`` has the factors of 1, the logarithm of a passage's lead and that of its words in the log odds of its
    words being in its language.
    """

    languages: tuple[str, ...]
    orders: tuple[int, ...]
    buckets: int
    weights: np.ndarray
    calibration: tuple[float, float, float] | None = None


def _chars(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters as one array of codes, the same with 0 for what isn't a letter, 4 zeros around each text; text starts."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _letter_table()
    pad = "\0" * 4
    codes = np.frombuffer((pad + pad.join(texts) + pad).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum(np.fromiter((0, *(len(t) + 4 for t in texts)), dtype=np.int64, count=len(texts) + 1)) + 4
    low = np.minimum(codes, _BMP - 1).astype(np.uint16)
    return low, np.where(_LETTER[low], low, 0).astype(np.uint32), starts


def _hashes(codes: np.ndarray, centres: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each centre's right neighbour, for every centre."""
    h = np.full(len(centres), 0x9E3779B1 * order & 0xFFFFFFFF, dtype=np.uint32)
    for shift in range(2 - order, 2):
        h ^= codes[centres + shift]
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int32)


def words_of(texts: Sequence[str], orders: Sequence[int], buckets: int):
    """Words of cleaned texts: places of letters, the first letter of each word, the first word of each text, hashes of the
    letters' n-grams by order, and per word the numbers that follow it: (on its line, all).
    """
    raw, codes, starts = _chars(texts)
    letter = codes != 0
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    centres = np.flatnonzero(letter)
    word_starts = np.flatnonzero(first)
    owner = np.searchsorted(centres, word_starts)
    bounds = np.searchsorted(word_starts, starts)
    return centres, owner, bounds, [_hashes(codes, centres, n, buckets) for n in orders], _numbers(raw, letter, word_starts, starts, bounds)


def _numbers(raw: np.ndarray, letter: np.ndarray, word_starts: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Runs of digits after each word of their text: those before the next line break, and all."""
    digit = (raw >= 48) & (raw <= 57)
    head = digit.copy()
    head[1:] &= ~digit[:-1] & ~letter[:-1]
    at = np.flatnonzero(head)
    word = np.searchsorted(word_starts, at, side="right") - 1
    text = np.searchsorted(starts, at, side="right") - 1
    own = (word >= 0) & (text < len(bounds) - 1)
    own[own] &= word[own] >= bounds[text[own]]
    at, word = at[own], word[own]
    lines = np.flatnonzero(raw == 10)
    beside = np.searchsorted(lines, at) == np.searchsorted(lines, word_starts[word])
    n = len(word_starts)
    return np.stack([np.bincount(word[beside], minlength=n), np.bincount(word, minlength=n)], axis=1)


def fit(
    texts: Sequence[str],
    labels: Sequence[int],
    *,
    languages: Sequence[str] = LANGUAGES,
    orders: Sequence[int] = (2, 4),
    buckets: int = 1 << 16,
    rounds: int = 3,
    smoothing: float = 0.5,
) -> NgramModel:
    """Fit on texts with noisy labels.

    The first round trusts the labels; each later round takes the passages that the model of the round before finds, so
    that wrong labels and quoted passages stop counting for the wrong language.  Without any text the weights are all
    equal and every language is as likely.
    """
    counts = np.zeros((buckets, len(languages)))
    cleaned = [clean_text(t) for t in texts]
    blocks, start, size = [], 0, 0
    for i, t in enumerate(cleaned):
        size += len(t)
        if size >= BLOCK_CHARS or i == len(cleaned) - 1:
            blocks.append((start, i + 1))
            start, size = i + 1, 0
    model = None
    for _ in range(rounds if cleaned else 0):
        counts[:] = 0
        for low, high in blocks:  # block by block, so that memory doesn't grow with the sample
            centres, owner, bounds, hashes, _ = words_of(cleaned[low:high], orders, buckets)
            if not len(owner):
                continue
            if model is None:
                by_word = np.repeat(np.asarray(labels[low:high], dtype=np.int64), np.diff(bounds))
            else:
                by_word = viterbi(word_scores(model, centres, owner, hashes), bounds)
            lang = np.repeat(by_word, np.diff(np.append(owner, len(centres))))
            for h in hashes:
                counts += np.bincount(h * np.int64(len(languages)) + lang, minlength=counts.size).reshape(counts.shape)
        logs = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * buckets)
        model = NgramModel(tuple(languages), tuple(orders), buckets, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32))
    return model or NgramModel(tuple(languages), tuple(orders), buckets, np.zeros(counts.shape, dtype=np.float32))


def word_scores(model: NgramModel, centres: np.ndarray, owner: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """Log-probabilities of each word in each language, summed over its n-grams."""
    if not len(owner):
        return np.zeros((0, len(model.languages)), dtype=np.float32)
    total = model.weights[hashes[0]]
    for h in hashes[1:]:
        total += model.weights[h]
    return np.add.reduceat(total, owner, axis=0)


def viterbi(scores: np.ndarray, bounds: np.ndarray, *, change: float = 14.0, word_cap: float = 6.0) -> np.ndarray:
    """Language index of each word, texts side by side; ``bounds`` has the first word of each text and the end.

    ``change`` is the price of going from one language to another, ``word_cap`` the most by which one word may favour a
    language, so that a name can't outweigh the words around it.
    """
    s = np.clip(scores - scores.max(axis=1, keepdims=True), -word_cap, 0) if len(scores) else scores
    out = np.zeros(len(s), dtype=np.int64)
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    first, alive = bounds[:-1][order], np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    if not len(alive):
        return out
    n_lang = s.shape[1]
    best = np.zeros((len(first), n_lang), dtype=np.float32)
    back = np.zeros((len(s), n_lang), dtype=np.int8)
    own = np.arange(n_lang, dtype=np.int8)
    for i, n in enumerate(alive):
        b = best[:n]
        if i:
            top = b.argmax(axis=1)
            jump = b[np.arange(n), top] - np.float32(change)
            stay = b >= jump[:, None]
            back[first[:n] + i] = np.where(stay, own, top[:, None].astype(np.int8))
            b = np.where(stay, b, jump[:, None])
        best[:n] = b + s[first[:n] + i]
    now = best.argmax(axis=1)
    for i in range(len(alive) - 1, -1, -1):
        n = alive[i]
        rows = first[:n] + i
        out[rows] = now[:n]
        now[:n] = back[rows, now[:n]]
    return out


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about BLOCK_CHARS, cut at white space (or anywhere, if there is none)."""
    at = 0
    while len(text) - at > BLOCK_CHARS:
        cut = max(text.rfind(" ", at, at + BLOCK_CHARS), text.rfind("\n", at, at + BLOCK_CHARS))
        cut = cut if cut > at else at + BLOCK_CHARS
        yield text[at:cut]
        at = cut
    yield text[at:]


def _lead(sums: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """By how much each passage's language leads the next one."""
    at = np.arange(len(sums))
    others = sums.copy()
    others[at, picked] = -np.inf
    return sums[at, picked] - others.max(axis=1)


def _features(lead: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(lead)), np.log1p(np.maximum(lead, 0)), np.log(np.maximum(sizes, 1))], axis=1)


def confidence(model: NgramModel, sums: np.ndarray, picked: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Expected share of words in the language ``picked`` for passages with summed scores and numbers of words."""
    if not len(sums):
        return np.zeros(0)
    if model.calibration is not None:
        return 1 / (1 + np.exp(-np.clip(_features(_lead(sums, picked), sizes) @ np.array(model.calibration), -30, 30)))
    scaled = sums / np.sqrt(np.maximum(sizes, 1))[:, None]
    odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    return odds[np.arange(len(sums)), picked] / odds.sum(axis=1)


def mixtures(texts: Sequence[str], labels: Sequence[int], n: int, rng: np.random.Generator) -> Iterator[list[tuple[str, int]]]:
    """Texts put together from windows of others, as (window, language): short ones, whole ones, ones with an insertion."""
    words = [t.split() for t in texts]
    usable = [i for i, w in enumerate(words) if len(w) >= 3]

    def window(size: int) -> tuple[str, int]:
        i = usable[rng.integers(len(usable))]
        start = int(rng.integers(max(1, len(words[i]) - size + 1)))
        return " ".join(words[i][start : start + size]), labels[i]

    for k in range(n if usable else 0):
        if k % 3 == 0:
            yield [window(int(rng.integers(1, 9)))]
        elif k % 3 == 1:
            yield [window(int(rng.integers(8, 200)))]
        else:
            yield [window(int(rng.integers(10, 90))), window(int(2 ** rng.uniform(0, 6))), window(int(rng.integers(10, 90)))]


def mixed_passages(model: NgramModel, parts: Sequence[list[tuple[str, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Summed scores, language, words and true share of words in it, of the passages of texts whose languages are known."""
    joined = [clean_text(" ".join(w for w, _ in p)) for p in parts]
    centres, owner, bounds, hashes, _ = words_of(joined, model.orders, model.buckets)
    total = word_scores(model, centres, owner, hashes)
    path = viterbi(total, bounds)
    truth = np.full(len(path), -1)
    for k, p in enumerate(parts):
        at = int(bounds[k])
        for text, lang in p:  # the words of the parts are those of the whole, as parts are joined by white space
            size = len(words_of([clean_text(text)], model.orders, model.buckets)[1])
            truth[at : min(at + size, int(bounds[k + 1]))] = lang
            at += size
    starts = np.zeros(len(path) + 1, dtype=bool)
    starts[bounds] = True
    starts[1:-1] |= path[1:] != path[:-1]
    heads = np.flatnonzero(starts[:-1])
    sizes = np.diff(np.append(heads, len(path)))
    return np.add.reduceat(total, heads, axis=0), path[heads], sizes, np.add.reduceat(truth == path, heads) / sizes


def calibrated(model: NgramModel, texts: Sequence[str], labels: Sequence[int], *, held: int = 5, n: int = 1500, seed: int = 1234, **fit_options) -> NgramModel:
    """The model with its confidence fitted: every ``held``-th text of a language is kept from a second model of the rest.

    Passages of ``n`` texts put together from the kept ones show how often that model is right; texts whose label it
    contradicts aren't used.  Without enough texts the model comes back as it is.
    """
    rank: dict[int, int] = {}
    kept = []
    for lang in labels:
        rank[lang] = rank.get(lang, -1) + 1
        kept.append(rank[lang] % held == held - 1)
    rest = [i for i, k in enumerate(kept) if not k]
    own = [i for i, k in enumerate(kept) if k]
    if not own:
        return model
    second = fit([texts[i] for i in rest], [labels[i] for i in rest], languages=model.languages, orders=model.orders, buckets=model.buckets, **fit_options)
    main = [max(found, key=lambda s: s[1])[0] if found else None for found in passages(second, [texts[i] for i in own])]
    agreed = [i for i, lang in zip(own, main) if lang == model.languages[labels[i]]]
    parts = list(mixtures([texts[i] for i in agreed], [labels[i] for i in agreed], n, np.random.default_rng(seed)))
    if not parts:
        return model
    sums, picked, sizes, right = mixed_passages(second, parts)
    x = _features(_lead(sums, picked), sizes)
    b = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method, with a small penalty so that it ends where everything is right
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(b)), x.T @ (right - p) - 0.1 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return replace(model, calibration=tuple(map(float, b)))


def passages(model: NgramModel, texts: Sequence[str | None]) -> Iterator[list[tuple[str, int, float]]]:
    """For each text its passages as (language, words, confidence), in order; none for a text without a letter.

    Words are runs of letters and runs of digits; languages are told by the letters alone.
    """
    scores: list[np.ndarray] = []
    numbers: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    block: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if block:
            centres, owner, bounds, hashes, beside = words_of(block, model.orders, model.buckets)
            scores.append(word_scores(model, centres, owner, hashes))
            numbers.append(beside)
            np.add.at(counts, owners, np.diff(bounds))
            block.clear(), owners.clear()
            size = 0

    for k, text in enumerate(texts):
        for piece in _pieces(clean_text(text)) if text else ():
            block.append(piece)
            owners.append(k)
            size += len(piece)
            if size >= BLOCK_CHARS:
                flush()
    flush()
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate(scores) if scores else np.zeros((0, len(model.languages)), dtype=np.float32)
    path = viterbi(total, bounds)
    starts = np.zeros(len(path) + 1, dtype=bool)
    starts[bounds] = True
    starts[1:-1] |= path[1:] != path[:-1]
    heads = np.flatnonzero(starts[:-1])
    sums = np.add.reduceat(total, heads, axis=0) if len(heads) else total
    sizes = np.diff(np.append(heads, len(path)))
    picked = path[heads]
    sure = confidence(model, sums, picked, sizes)
    if len(heads):  # numbers are words too: all within a passage, and those on the line of its last word
        beside = np.concatenate(numbers)
        last = heads + sizes - 1
        sizes = sizes + np.add.reduceat(beside[:, 1], heads) - beside[last, 1] + beside[last, 0]
    edges = np.searchsorted(heads, bounds)
    for k in range(len(texts)):
        a, b = edges[k], edges[k + 1]
        yield [(model.languages[picked[i]], int(sizes[i]), float(sure[i])) for i in range(a, b)]


def label_language(label, languages: Sequence[str] = LANGUAGES):
    """The language a label names: the code alone or followed by ``-`` or ``_`` and more, trimmed, in any case; else null."""
    bare = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    code = F.regexp_extract(bare, rf"^({'|'.join(languages)})(?:[-_].*)?$", 1)
    return F.when(code != "", code)


def sample_texts(docs: DataFrame, *, text: str = "text", label: str = "lang", languages: Sequence[str] = LANGUAGES, per_language: int = 400, max_chars: int = 200_000) -> tuple[list[str], list[int]]:
    """At most ``per_language`` distinct texts of each language that labels name, and the numbers of their languages.

    They are those with the smallest hashes among the language's texts, so that the sample is the same however the table
    is partitioned, and copies of a text count once.  Only hashes are compared; the texts taken are read in a second
    pass.  Texts longer than ``max_chars`` aren't taken as examples (they are scored like any others).
    """
    rows = docs.select(F.col(text).alias("t"), label_language(F.col(label), languages).alias("l"))
    rows = rows.where(F.col("l").isNotNull() & F.length("t").between(1, max_chars)).withColumn("h", F.xxhash64("t"))
    ranked = rows.select("l", "h").distinct().withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h"))).where(F.col("r") <= per_language)
    limits = {r["l"]: r["h"] for r in ranked.groupBy("l").agg(F.max("h").alias("h")).collect()}
    if not limits:
        return [], []
    taken = F.lit(False)
    for lang, most in limits.items():
        taken = taken | ((F.col("l") == lang) & (F.col("h") <= most))
    picked = rows.where(taken).select("t", "l").distinct().toArrow()
    order = sorted(zip(picked["t"].to_pylist(), picked["l"].to_pylist()))
    return [t for t, _ in order], [list(languages).index(lang) for _, lang in order]


def fit_on_sample(
    docs: DataFrame, *, text: str = "text", label: str = "lang", languages: Sequence[str] = LANGUAGES, per_language: int = 400, max_chars: int = 200_000, **fit_options
) -> NgramModel:
    """:func:`fit` on :func:`sample_texts`."""
    return fit(*sample_texts(docs, text=text, label=label, languages=languages, per_language=per_language, max_chars=max_chars), languages=languages, **fit_options)


def fit_calibrated(docs: DataFrame, *, text: str = "text", label: str = "lang", languages: Sequence[str] = LANGUAGES, per_language: int = 400, max_chars: int = 200_000, **fit_options) -> NgramModel:
    """:func:`fit_on_sample`, its confidence :func:`calibrated` on the same sample."""
    texts, labels = sample_texts(docs, text=text, label=label, languages=languages, per_language=per_language, max_chars=max_chars)
    return calibrated(fit(texts, labels, languages=languages, **fit_options), texts, labels, **fit_options)


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_words", T.IntegerType()), T.StructField("confidence", T.DoubleType())]))


def detect_languages(docs: DataFrame, model: NgramModel, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``pred_lang``, ``confidence`` and ``segments`` (language, words, confidence).

    ``pred_lang`` is the language of most words (on a tie the one that comes first in the text).  A null or empty text,
    and one without letters, has no language: null, confidence 0 and no segments.  Ids may be null or repeated; rows are
    kept as they are.  Other columns are ignored, whatever their names.  Texts of any length are scored whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    key = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, key), T.StructField("pred_lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("segments", _SEGMENTS)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        seg_type = pa.list_(pa.struct([("lang", pa.string()), ("n_words", pa.int32()), ("confidence", pa.float64())]))
        for batch in batches:
            for part, texts in slices(batch, 1):
                langs, sures, segs = [], [], []
                for found in passages(fitted, texts):
                    words: dict[str, int] = {}
                    for lang, n, _ in found:
                        words[lang] = words.get(lang, 0) + n
                    main = max(words, key=words.get) if words else None
                    langs.append(main)
                    sures.append(sum(n * c for lang, n, c in found if lang == main) / words[main] if words else 0.0)
                    segs.append([{"lang": lang, "n_words": n, "confidence": c} for lang, n, c in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(sures, pa.float64()), pa.array(segs, seg_type)], names=[doc_id, "pred_lang", "confidence", "segments"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def unnamed_languages(docs: DataFrame, model: NgramModel, *, doc_id: str = "doc_id", text: str = "text", label: str = "lang", min_words: int = 20) -> DataFrame:
    """Languages with a passage of at least ``min_words`` that the row's label doesn't name: ``doc_id``, ``lang``; each once."""
    keyed = docs.select(F.struct(F.col(doc_id).alias("id"), label_language(F.col(label), model.languages).alias("named")).alias("key"), F.col(text).alias("t"))
    found = detect_languages(keyed, model, doc_id="key", text="t")
    langs = F.array_distinct(F.transform(F.filter("segments", lambda s: s["n_words"] >= min_words), lambda s: s["lang"]))
    return (
        found.select(F.col("key.id").alias(doc_id), F.col("key.named").alias("named"), F.explode(langs).alias("lang"))
        .where(~F.col("lang").eqNullSafe(F.col("named")))
        .select(doc_id, "lang")
    )
