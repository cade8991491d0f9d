import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquilt.llm import langid, leakage, mixing

# --- leakage ---


def brute_words(text):
    text = re.sub(r"(?<=[^\W_])-[ \t]*\n\s*(?=[^\W_])", "", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text)


@pytest.mark.parametrize("text, words", [("Ça va: L'été_2020!", "ca va l ete 2020"), ("inter-\n  national co-op", "international co op"), ("GROẞE Straße", "grosse strasse"), ("a—b «c» …", "a b c"), ("Привет, мир", "привет мир"), ("███", ""), ("", "")])
def test_words(text, words):
    assert leakage.normal_words(text) == words == " ".join(brute_words(text))


def test_myers_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        assert leakage.myers_best(p, t) == min(row)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, item_id string")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    its = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(8, 40)))) for i in range(20)]
    texts = []
    for d in range(60):
        body = [rng.choice(words) for _ in range(30)]
        for _ in range(2):
            w = its[rng.randrange(20)][1].split()
            n = rng.randint(6, 16)
            s = rng.randrange(max(1, len(w) - n))
            part = w[s : s + n]
            if rng.random() < 0.4 and len(part) > 8:
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(body))
            body[at:at] = part
        texts.append((d, ", ".join(body).upper()))
    got = {(r["doc_id"], r["item_id"]): r for r in leakage.find_leaks(docs(spark, texts), items(spark, its), min_words=12, max_edits=1).collect()}
    exact, near = set(), set()
    for d, t in texts:
        w = brute_words(t)
        for i, it in its:
            v = it.split()
            size = min(12, len(v))
            windows = [v[s : s + size] for s in range(len(v) - size + 1)]
            if any(w[s : s + size] == x for x in windows for s in range(len(w) - size + 1)):
                exact.add((d, i))
            if any(leakage.myers_best(x, w) <= 1 for x in windows):
                near.add((d, i))
    assert {k for k, r in got.items() if r["edits"] == 0} == exact and set(got) == near and exact < near
    blocks = leakage.find_leaks(docs(spark, texts), items(spark, its), min_words=12, max_edits=1, block_chars=500)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == near


def test_leak_edges(spark):
    long_item = " ".join(f"x{i}" for i in range(15))
    its = items(spark, [(1, long_item), (1, long_item), (2, None), (3, ""), (4, "---"), (None, "one two three"), (5, "solo")])
    rows = [(1, None), (2, ""), (3, "filler " * 300_000 + long_item), (4, "one, two - three"), (None, long_item.replace("x7", "y")), (5, "a solo b"), (5, "a solo b")]
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["matched_words"], r["edits"]) for r in leakage.find_leaks(docs(spark, rows), its).collect())
    assert got == [("3", "1", 15, 0), ("4", "None", 3, 0), ("5", "5", 1, 0), ("5", "5", 1, 0), ("None", "1", 7, 1)]
    assert leakage.find_leaks(docs(spark, []), its).count() == 0
    assert leakage.find_leaks(docs(spark, rows), items(spark, [])).count() == 0


def test_pieces_joined_by_hash_give_the_same_rows(spark):
    """Also for long texts, short items, items that share their pieces, and passages that only Myers' distance finds."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(25)] + ["été", "straße"]
    stock = [rng.choice(words) for _ in range(9)]
    its = [(i, " ".join([*stock[: rng.randint(0, 9)], *(rng.choice(words) for _ in range(rng.choice([1, 3, 7, 20, 60])))])) for i in range(40)] + [(0, "solo"), (99, None), (None, "a b c d e f g h")]
    texts = []
    for d in range(40):
        body = []
        for _ in range(rng.randint(0, 6)):
            w = its[rng.randrange(40)][1].split()
            part = w[rng.randrange(len(w)) :]
            if rng.random() < 0.6:
                part[rng.randrange(len(part))] = "other"
            body += [*(rng.choice(words) for _ in range(rng.choice([0, 2, 300]))), *part]
        texts.append((d % 35, " ".join(body)))
    texts += [(50, None), (51, ""), (None, "a b c d e f g h"), (52, " ".join(["w1 w2"] * 3000))]
    tell = lambda n: sorted((str(r["doc_id"]), str(r["item_id"]), r["matched_words"], r["edits"]) for r in leakage.find_leaks(docs(spark, texts), items(spark, its), min_words=12, max_edits=e, block_chars=n).collect())
    for e in (0, 1, 2):
        want = tell(10**6)
        assert want and tell(10) == want
        assert not e or any(0 < x[3] <= e for x in want)


def test_piece_hashes():
    flat = " ab c déf ab c déf gh "
    for piece in (1, 2, 3):
        h, w = leakage.piece_hashes(flat, piece), flat.split()
        grams = [tuple(w[i : i + piece]) for i in range(len(w) - piece + 1)]
        assert len(h) == len(grams) and len({(g, x) for g, x in zip(grams, h.tolist())}) == len(set(grams)) == len(set(h.tolist()))
    assert len(leakage.piece_hashes(" a ", 2)) == 0


# --- languages ---

SAMPLES = {
    "en": "the court held that the appeal of the claimant was dismissed because the time limit had expired and no proof was offered by them",
    "de": "das Gericht hielt fest, dass die Berufung der Klägerin abgewiesen wird, weil die Frist bereits abgelaufen war und kein Beleg vorgelegt wurde",
    "fr": "le tribunal a retenu que l'appel de la demanderesse était rejeté parce que le délai était déjà échu et qu'aucune preuve n'a été produite",
    "it": "il tribunale ha ritenuto che il ricorso della parte attrice fosse respinto perché il termine era già scaduto e nessuna prova era stata offerta",
    "es": "el tribunal consideró que el recurso de la demandante debía ser desestimado porque el plazo ya había vencido y no se ofreció ninguna prueba",
}


@pytest.fixture(scope="module")
def model():
    texts = [t for t in SAMPLES.values() for _ in range(4)]
    labels = [i for i in range(5) for _ in range(4)]
    labels[3] = 1  # a wrong label
    return langid.fit(texts, labels)


def test_passages(spark, model):
    mixed = SAMPLES["de"] + ".\n\nSeite 2 von 4\n\n" + SAMPLES["fr"] + " (the time limit) " + SAMPLES["fr"]
    rows = [(1, mixed, "de"), (2, None, "fr"), (3, "", None), (4, "123 — █", "x"), (5, SAMPLES["it"] + " " + SAMPLES["it"], "it-CH"), (5, SAMPLES["it"], "IT_x"), (None, SAMPLES["es"], " EN "), (7, " ".join([SAMPLES["en"]] * 12_000), "de_CH")]
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, pred_lang string, confidence double")
    got = [r for r in langid.detect_languages(df, model).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [s["lang"] for s in by[1]["segments"]] == ["de", "fr"] and by[1]["pred_lang"] == "fr"
    for i in (2, 3, 4):
        assert by[i]["pred_lang"] is None and by[i]["confidence"] == 0 and by[i]["segments"] == []
    assert by[7]["pred_lang"] == "en" and len(by[7]["segments"]) == 1 and by[7]["segments"][0]["n_words"] == 12_000 * len(re.findall(r"[^\W\d_]+", SAMPLES["en"]))
    assert all(0 <= r["confidence"] <= 1 for r in got)
    named = sorted((str(r["doc_id"]), r["lang"]) for r in langid.unnamed_languages(df, model).collect())
    assert named == [("1", "fr"), ("7", "en"), ("None", "es")]
    assert langid.detect_languages(df.limit(0), model).count() == 0


def test_decomposed_letters_are_one_word(model):
    plain = SAMPLES["fr"]
    assert list(langid.passages(model, [unicodedata.normalize("NFD", plain)])) == list(langid.passages(model, [plain]))


def test_numbers_are_words(model):
    text = "12 " + SAMPLES["de"] + " 7, 1999 und 5\n\n[3] " + SAMPLES["fr"] + " 159'250\n\n4."
    words = lambda t: len(re.findall(r"[^\W\d_]+", t))
    got = [(lang, n) for lang, n, _ in next(iter(langid.passages(model, [text])))]
    assert got == [("de", words(SAMPLES["de"]) + 4), ("fr", words(SAMPLES["fr"]) + 2)]
    assert [n for _, n, _ in next(iter(langid.passages(model, ["und 7"])))] == [2]


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in (" DE ", "de-CH", "fr_XX", "english", "und", "", None, "it", "en\n")], "l string")
    assert [r[0] for r in df.select(langid.label_language(F.col("l"))).collect()] == ["de", "de", "fr", None, None, None, None, "it", "en"]


def test_sample_is_bounded_for_each_language(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(langid, "fit", lambda texts, labels, **_: taken.append(sorted(zip(texts, labels))))
    texts = [(f"text {i}", "en" if i % 2 else "de") for i in range(80)]
    df = spark.createDataFrame(texts, "text string, lang string").withColumn("h", F.xxhash64("text"))
    copied = df.where("lang = 'en'").orderBy("h").first()["text"]  # certain to be in the sample
    docs = df.select("text", "lang").union(spark.createDataFrame([(copied, "en")] * 400, "text string, lang string"))
    for parts in (1, 7):
        langid.fit_on_sample(docs.repartition(parts), per_language=10)
    want = sorted((r["text"], langid.LANGUAGES.index(r["lang"])) for lang in ("de", "en") for r in df.where(F.col("lang") == lang).orderBy("h").limit(10).collect())
    assert taken == [want, want]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = langid.fit_on_sample(docs.where("pmod(doc_id, 2) = 0"), per_language=60)
    rest = docs.where("pmod(doc_id, 2) = 1").withColumn("named", langid.label_language(F.col("lang"))).where("named is not null and text is not null and n_chars > 500")
    found = langid.detect_languages(rest, fitted).join(rest.select("doc_id", "named"), "doc_id")
    share = found.agg(F.avg((F.col("pred_lang") == F.col("named")).cast("double"))).first()[0]
    assert share > 0.87  # about one label in eleven is wrong


def test_confidence_is_reliable(spark):
    """Of passages with about a confidence, about that share of words is in their language, on texts not seen before."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = langid.fit_calibrated(docs.where("pmod(doc_id, 2) = 0"))
    texts, labels = langid.sample_texts(docs.where("pmod(doc_id, 2) = 1"))
    main = [max(found, key=lambda s: s[1])[0] if found else None for found in langid.passages(fitted, texts)]
    own = [i for i, lang in enumerate(main) if lang == langid.LANGUAGES[labels[i]]]
    assert len(own) > 0.85 * len(texts)
    parts = list(langid.mixtures([texts[i] for i in own], [labels[i] for i in own], 3000, np.random.default_rng(9)))
    sums, picked, sizes, right = langid.mixed_passages(fitted, parts)
    sure = langid.confidence(fitted, sums, picked, sizes)
    assert np.ptp(sure) > 0.3 and sure[sizes < 3].mean() < sure[sizes > 40].mean() - 0.05  # short passages are less certain
    edges = np.quantile(sure, np.linspace(0, 1, 9))
    for low, high in zip(edges, edges[1:]):
        some = (sure >= low) & (sure <= high)
        assert abs(sure[some].mean() - right[some].mean()) <= 0.05


def test_running_heads_are_told_by_their_numbers():
    body = "the court held that the appeal was dismissed"
    heads = [f"Kammer 7 * Blatt {i} / 4" for i in (2, 3, 4)]
    text = body + "".join(f"\n\n{h}\n\n{body}" for h in heads) + "\n\nArticle 5\n\n" + body + "\n\nArticle 9\n\n" + body
    assert "blatt" not in langid.clean_text(text) and langid.clean_text(text).count("article") == 2
    assert "blatt" in langid.clean_text(body + "\n\n" + heads[0] + "\n\n" + body)  # once: nothing tells that it's no part of the text
    assert "page" not in langid.clean_text(body + "\n\nPage 2 of 2\n\n" + body)


def test_very_long_and_null_texts_are_sliced():
    import pyarrow as pa

    from reelquilt.llm.texts import slices

    texts = ["a" * 50, None, "", "b" * 500, "c" * 60, "d" * 60, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = list(slices(batch, 1, 160))
    assert [t for _, part in got for t in part] == texts and [part.num_rows for part, _ in got] == [3, 1, 2, 1]
    assert list(slices(batch.slice(0, 0), 1)) == []


def test_empty_sample(spark):
    empty = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    fitted = langid.fit_on_sample(empty)
    assert not fitted.weights.any()
    assert langid.detect_languages(empty, fitted).first()["pred_lang"] == "en"


def test_viterbi_against_dynamic_programming():
    rng = np.random.default_rng(2)
    scores, bounds = rng.normal(size=(40, 3)).astype(np.float32) * 4, np.array([0, 7, 7, 25, 40])
    got = langid.viterbi(scores, bounds, change=3.0, word_cap=50.0)
    for a, b in zip(bounds, bounds[1:]):
        if a == b:
            continue
        best = {(k,): float(scores[a, k]) for k in range(3)}
        for i in range(a + 1, b):
            best = {max((p for p in best if True), key=lambda p: best[p] - 3.0 * (p[-1] != k)) + (k,): max(best[p] - 3.0 * (p[-1] != k) for p in best) + float(scores[i, k]) for k in range(3)}
        path = got[a:b]
        value = sum(float(scores[a + i, k]) for i, k in enumerate(path)) - 3.0 * (np.diff(path) != 0).sum()
        assert value == pytest.approx(max(best.values()), abs=1e-3)


# --- mixing ---


def plain_quotients(weights, caps, seats):
    out = [0] * len(weights)
    for _ in range(seats):
        best = max((i for i in range(len(weights)) if weights[i] > 0 and out[i] < caps[i]), key=lambda i: (weights[i] / (2 * out[i] + 1), -i), default=None)
        if best is None:
            break
        out[best] += 1
    return out


def test_sainte_lague():
    rng = random.Random(1)
    for _ in range(100):
        n = rng.randint(1, 6)
        w, caps = [rng.choice([0, 1, 2, 3, 5, 0.3]) for _ in range(n)], [rng.randint(0, 30) for _ in range(n)]
        seats = rng.randint(0, 60)
        assert mixing.sainte_lague(w, caps, seats) == plain_quotients(w, caps, seats)
    big = mixing.sainte_lague([0.5, 0.3, 0.2], [10**12] * 3, 10**9)
    assert sum(big) == 10**9 and big[0] == pytest.approx(5e8, abs=2)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "ü" * 1000 + " <|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in mixing.count_tokens(df, ["doc_id"]).collect()}
    enc = mixing.load_encoding(mixing.DEFAULT_VOCABULARY)
    assert got == {1: len(enc.encode_ordinary("hello world")), 2: 0, 3: 0, 4: len(enc.encode_ordinary("ü" * 1000 + " <|endoftext|>"))}
    assert enc.decode(enc.encode_ordinary("Grüße, l'été 12")) == "Grüße, l'été 12"


def mix(spark, rows, targets, **options):
    d = spark.createDataFrame([(i, s, t, 9) for i, s, t in rows], "doc_id long, source string, text string, tokens long")
    t = spark.createDataFrame([(*x, "y") for x in targets], "source string, target_share double, max_repeats int, key string")
    return mixing.Mix(d, t, **options)


def test_mix(spark):
    rows = [(i, "big_source", "word " * 50) for i in range(400)] + [(1000 + i, "Small-Source", "word " * 50) for i in range(40)] + [(2000 + i, "tiny", "word " * 50) for i in range(4)]
    rows += [(3000, None, "word " * 900), (3001, "unlisted", "word " * 900), (3002, "big source", None), (3003, "BIG.SOURCE", ""), (None, "tiny", "word " * 50)]
    targets = [("big_source", 0.6, 2), ("small_source", 0.3, 4), ("tiny", 0.1, 2), ("absent", 0.0, None), (None, 0.5, 1), ("--", 0.5, 1)]
    m = mix(spark, rows, targets, block_tokens=32, shard_tokens=5000)
    assert m.shards > 1
    report = {r["source"]: r for r in m.report().collect()}
    assert set(report) == {"big_source", "small_source", "tiny", "absent"}
    assert [r["source"] for r in m.unreachable().collect()] == ["tiny"]
    assert report["small_source"]["actual_share"] == pytest.approx(0.34, abs=0.03)  # takes over what tiny can't fill
    assert report["tiny"]["mixed_tokens"] <= 2 * report["tiny"]["held_tokens"]
    assert sum(r["mixed_tokens"] for r in report.values()) == pytest.approx(m.total, rel=0.03)
    drawn = m.selection().collect()
    caps = {"big_source": 2, "small_source": 4, "tiny": 2}
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in drawn)
    again = mix(spark, rows[::-1], targets, block_tokens=32, shard_tokens=5000).selection().collect()
    assert sorted(map(str, drawn)) == sorted(map(str, again))


def test_shards_by_plain_quotients(spark):
    """Sources have shards by their own size, and a shard's quota is that of highest quotients taken one by one."""
    rng = random.Random(3)
    rows = [(i, "large", "word " * rng.randint(1, 80)) for i in range(600)] + [(1000 + i, "small", "word " * 20) for i in range(30)]
    m = mix(spark, rows, [("large", 0.7, 2), ("small", 0.3, 9)], block_tokens=16, shard_tokens=1500)
    shards = {r["source"]: r["shards"] for r in m.sources}
    assert shards["large"] > 10 and shards["small"] == 1
    rows_of = m.sized.join(spark.createDataFrame([(r["key"], r["shards"]) for r in m.sources], "key string, shards long"), "key").withColumn("shard", F.pmod("h", "shards"))
    held = {}
    for r in rows_of.groupBy("key", "shard").agg(F.sum("tokens").alias("t")).collect():
        held.setdefault(r["key"], {})[r["shard"]] = r["t"]
    got = {(r["key"], r["shard"]): (r["whole"], r["rest"]) for r in m.shard_quotas(rows_of).collect()}
    for r in m.sources:
        t = [held[r["key"]][s] for s in sorted(held[r["key"]])]
        want = plain_quotients(t, [-(-x * r["max_repeats"] // 16) for x in t], r["blocks"])
        for shard, x, blocks in zip(sorted(held[r["key"]]), t, want):
            n = min(blocks * 16, x * r["max_repeats"])
            assert got.get((r["key"], shard), (0, 0)) == divmod(n, x)


def test_null_ids_are_spread(spark):
    rows = [(None, "a", f"word {i} " * 20) for i in range(400)]
    m = mix(spark, rows, [("a", 1.0, 1)], block_tokens=16, shard_tokens=2000)
    assert m.sized.select(F.pmod("h", F.lit(m.shards))).distinct().count() == m.shards > 5
    assert m.selection().count() == pytest.approx(400, abs=30)


def test_mix_edges(spark):
    none = mix(spark, [], [("a", 1.0, 1)])
    assert none.selection().count() == 0 and none.report().first()["actual_share"] == 0 and none.total == 0
    assert mix(spark, [(1, "a", "x")], []).report().count() == 0
    with pytest.raises(ValueError):
        mix(spark, [], [("a", 1.0, 1), ("b", 1.0, 1)], max_sources=1)
