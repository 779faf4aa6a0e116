"""Toxicity and language: held-out accuracy, what is learnt from, and odd rows."""

import math
import random
import zlib
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from listwright.llm import langid as L
from listwright.llm import toxicity as T
from tests.llm.conftest import prose


def toxic_rows():
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        words = prose(rng, rng.randint(20, 120)).split()
        if rng.random() < (0.9 if toxic else 0.1):
            words[rng.randrange(len(words))] = rng.choice(["muslims", "women", "immigrants"])
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "scumly", "scumful", "rotten"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_rows()
    extra = [(1000, "the women of the and"), (1001, ""), (1002, None), (None, "vile vile vile"), (1003, "muslims"), (1003, "muslims"), (1004, "asian women"), (1005, "asian men"), (1006, "vile of " * 50_000)]
    df = spark.createDataFrame([*docs, *extra], "doc_id long, text string").withColumn("score", F.lit(7)).withColumn("y", F.lit(1))
    lab = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (1, 1, None), (5, 0, 1), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rows = T.toxicity_scores(df, lab).collect()
    assert len(rows) == len(docs) + len(extra)
    by = {r["doc_id"]: r for r in rows}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i]["lw_held"] == (i in set(held)) for i, _ in docs)
    truth = {i: t for i, _, t in labels}
    right = sum((by[i]["lw_score"] >= 0.7) == bool(truth[i]) for i in held)
    assert right / len(held) > 0.95
    assert by[1000]["lw_score"] < 0.5 and by[1001]["lw_score"] == by[1002]["lw_score"]
    assert 0 < by[1006]["lw_score"] < 1
    assert abs(by[1004]["lw_score"] - by[1005]["lw_score"]) < 0.05
    empty = df.limit(0)
    assert T.toxicity_scores(empty, lab).count() == 0
    assert {r["lw_score"] for r in T.toxicity_scores(df, lab.limit(0)).collect()} == {0.5}


def test_swaps_pull_group_names_together():
    # the name 0 stands in nine of ten toxic texts, the name 1 in one of ten; each text is also seen with the other name
    rows = []
    for i in range(200):
        toxic = i % 2
        own = 0 if (i // 2 % 10 > 0) == bool(toxic) else 1
        rows.append((toxic, [own], [T.UNIT], [[(own, -T.UNIT), (1 - own, T.UNIT)]]))
    apart = [abs(w[0] - w[1]) for w in (T.train(rows, 2, replace(T.ToxicityPlan(), swap_penalty=p)) for p in (0.0, 10.0))]
    assert apart[0] > 2 and apart[1] < 0.2


def random_rows(rng, n, size):
    rows = []
    for _ in range(n):
        own = sorted(rng.sample(range(size), 3))
        toxic = int(rng.random() < (0.8 if 0 in own else 0.3))
        swaps = [[(1, T.UNIT), (2, -T.UNIT)]] if 2 in own else []
        rows.append((toxic, own, [rng.randint(500, 2500) for _ in own], swaps))
    return rows


def test_training_ends_at_the_least_loss():
    rng = random.Random(23)
    rows, plan = random_rows(rng, 300, 6), T.ToxicityPlan(tolerance=1e-9)
    w = T.train(rows, 6, plan)
    loss = T.Loss(rows, 6, plan)

    def brute(w):
        total, counts = 0.0, [sum(r[0] == k for r in rows) for k in (0, 1)]
        for y, f, v, _ in rows:
            z = w[-1] + sum(w[a] * b / T.UNIT for a, b in zip(f, v))
            total += 0.5 / counts[y] * math.log1p(math.exp(-z if y else z))
        changes = [c for r in rows for c in r[3]]
        total += plan.swap_penalty * sum(sum(w[a] * b / T.UNIT for a, b in c) ** 2 for c in changes) / len(changes)
        return total + 0.5 * plan.l2 * sum(x * x for x in w[:-1])

    assert abs(brute(w) - loss.value(w)) < 1e-6
    assert max(abs(loss.gradient(w)[0])) < 1e-8
    for k in range(7):
        for by in (-1e-3, 1e-3):
            other = w.copy()
            other[k] += by
            assert brute(other) > brute(w)


def test_group_names_that_go_with_the_label_lose_their_weight(spark):
    docs, labels = toxic_rows()
    asked = [(9000 + i, f"{name} of the and", ) for i, name in enumerate(["women", "men", "muslims", "jews"])]
    df, lab = spark.createDataFrame([*docs, *asked], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    gaps = []
    for penalty in (0.0, T.ToxicityPlan().swap_penalty):
        by = {r["doc_id"]: math.log(r["lw_score"] / (1 - r["lw_score"])) for r in T.toxicity_scores(df, lab, plan=T.ToxicityPlan(swap_penalty=penalty)).where("doc_id >= 9000").collect()}
        gaps.append(max(abs(by[9000] - by[9001]), abs(by[9002] - by[9003])))
    assert gaps[0] > 1 and gaps[1] < 0.05


LANGS = {"en": "the of and ing tion that", "de": "der und ung lich sch nicht", "fr": "les que eau eux ment oi", "es": "los que ciones mente ado ñas", "xx": "qaz wsx edc rfv tgb yhn"}


def lang_rows():
    rng = random.Random(22)
    out = []
    for i in range(600):
        lang = rng.choice(sorted(LANGS))
        words = LANGS[lang].split()
        out.append((i, " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))).capitalize(), lang))
    return out


def test_language(spark):
    rows = lang_rows()
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", "de"), (1003, "the and of the", None), (None, "der und die nicht", "de"), (1004, "x", "fr"), (1005, "les eaux " * 40_000, "fr")]
    df = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string").withColumn("profile", F.lit(1))
    got = L.identify_languages(df).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    held = [(i, lang) for i, _, lang in rows if by[i]["lw_held"]]
    assert all(by[i]["lw_held"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(by[i]["lw_lang"] == lang for i, lang in held) / len(held) > 0.97
    assert [by[i]["lw_lang"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lw_lang"] == "en" and by[1005]["lw_lang"] == "fr"
    assert all(0 <= r["lw_score"] <= 1 for r in got)
    nothing = L.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lw_lang"] for r in nothing} == {"und"}
    assert L.identify_languages(df.limit(0)).count() == 0


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 100)
    df = spark.createDataFrame(lang_rows(), "doc_id long, text string, lang string")
    assert L.SAMPLE // L.SAMPLE_LEAST < len(LANGS)
    assert {r["lw_lang"] for r in L.identify_languages(df).collect()} == set(LANGS)


def test_family_machines():
    rows = lang_rows()
    model = L.LanguageModel(sorted(LANGS), np.array([L.profile(t) for _, t, _ in rows], float), [lang for *_, lang in rows])
    assert model.families == ["germanic", "other", "romance"]
    assert sorted(model.pair_w) == [("de", "en"), ("es", "fr")]


def test_language_votes_against_plain_loops():
    """Every prediction again by plain loops over the same weights: trigram counts, the best family, a vote for each pair."""
    rows = lang_rows()
    model = L.LanguageModel(sorted(LANGS), np.array([L.profile(t) for _, t, _ in rows], float), [lang for *_, lang in rows])
    seen = set()
    for _, text, _ in rows[:150] + [(0, "x", ""), (0, "ü é", ""), (0, "The 12 und QUE", "")]:
        raw = b" " + bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()) + b" "
        counts = [0.0] * L.DIMENSIONS
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            counts[((a * 2654435761 + b * 40503 + c * 2246822519) % 2**32 >> 7) % L.DIMENSIONS] += 1
        norm = sum(counts) ** 0.5
        x = [n**0.5 / norm for n in counts]
        dot = lambda w: sum(u * v for u, v in zip(w, x) if v) + w[-1]
        family = max(zip((dot(w) for w in model.family_w), model.families))[1] if model.family_w is not None else model.families[0]
        own = model.members[family]
        wins = dict.fromkeys(own, 0.0)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                z = dot(model.pair_w[a, b])
                wins[a if z >= 0 else b] += 1 + min(abs(z), 1e3) / 1e6
        assert model.predict(text)[0] == max(own, key=lambda v: (wins[v], v))
        seen.add(model.predict(text)[0])
    assert seen == set(LANGS)


def test_what_is_no_letter_has_no_language():
    rows = lang_rows()
    model = L.LanguageModel(sorted(LANGS), np.array([L.profile(t) for _, t, _ in rows], float), [lang for *_, lang in rows])
    for text in ("½ ²", "①", "Ⅷ", "12 %", "_", " ", "", None, "٣"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("a")[0] in LANGS
