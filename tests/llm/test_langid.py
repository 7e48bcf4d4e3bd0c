import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridspark.llm.langid import BANDS, FOLDS, ROOM, STEPS, Profiles, classify, count_grams, fit, fit_folds, fold_of, least_scores, predict
from gridspark.llm.queries import op1_rank_order_langid


def slow_profile(texts, longest, top):
    n = Counter()
    for t in texts:
        word = ""
        words = []
        for ch in (t or "").lower():
            if ch.isalpha():
                word += ch
            elif word:
                words.append(word)
                word = ""
        if word:
            words.append(word)
        for w in words:
            padded = f" {w} "
            for k in range(1, longest + 1):
                for i in range(len(padded) - k + 1):
                    g = padded[i : i + k]
                    if g != " ":
                        n[g] += 1
    return sorted(n, key=lambda g: (-n[g], len(g), g))[:top]


def slow_classify(text, ranked, longest, top):
    own = slow_profile([text], longest, top)
    if not own:
        return "und", 0.0
    found = []
    for name in sorted(ranked):
        at = {g: r for r, g in enumerate(ranked[name])}
        found.append((sum(abs(at[g] - r) if g in at else top for r, g in enumerate(own)), name))
    d, name = min(found)
    return name, 1 - d / (len(own) * top)


def test_fit_and_classify_against_brute_force(spark):
    rng = random.Random(3)
    make = lambda abc: " ".join("".join(rng.choice(abc) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 40)))
    rows = [(i, make("abcdeé"), "x") for i in range(20)] + [(i, make("defghñÑ1 -"), "y") for i in range(20)] + [(i, make("漢字仮名abc"), "z") for i in range(9)]
    rows += [(90, None, "x"), (91, "abc", None), (92, "", "y"), (93, "12 --", "z"), (94, "İstanbul ẞ", "x")]
    df = spark.createDataFrame([(*r, 0, "q") for r in rows], "doc_id int, text string, lang string, n int, gram string").repartition(3)
    for longest, top in ((3, 50), (2, 400)):
        p = fit(df, "text", "lang", longest, top)
        want = {k: slow_profile([t for _, t, x in rows if x == k and t], longest, top) for k in "xyz"}
        assert p.ranked == want
        texts = [r[1] for r in rows]
        lang, score = classify(texts, p)
        for t, a, s in zip(texts, lang, score):
            assert (a, round(float(s), 12)) == (lambda w: (w[0], round(w[1], 12)))(slow_classify(t, want, longest, top)), t
    got = df.select(predict(F.col("text"), p).alias("p")).select("p.*").collect()
    assert {r.lang for r in got} <= {"x", "y", "z", "und"}


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id int, text string, lang string")
    p = fit(df, "text", "lang")
    assert p.ranked == {}
    assert classify(["abc", None], p)[0] == ["und", "und"]
    assert classify([], Profiles({"x": ["a"]}))[0] == []


def test_query_held_out_accuracy(spark, sf):
    got = op1_rank_order_langid(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count()
    held = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.count() > 20
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert got.where("score < 0 or score > 1 or score is null").isEmpty()


def test_cutoffs_come_from_every_labelled_text(spark):
    rng = random.Random(5)
    make = lambda abc, n: " ".join("".join(rng.choice(abc) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, n)))
    few = [(make("abcdeéfgh", 60), "x") for _ in range(150)] + [(make("ghijkñ漢字", 300), "y") for _ in range(60)]
    few += [(None, "x"), ("", "y"), ("12 --", "y"), ("abc", None)]
    # More texts than were once held (4,000) or taught (20,000): short ones, so that each counts.
    rows = [(i, *r) for i, r in enumerate(few + [("".join(rng.choice("abcdeéfgh") for _ in range(3)), "x") for _ in range(26_000)])]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(4).cache()
    fold = fold_of(F.col("text"))
    longest, top = 2, 60
    whole, *others = fit_folds(df, "text", "lang", fold, FOLDS, longest, top)
    assert whole == fit(df, "text", "lang", longest, top)
    of = [(r.text, r.lang, r.fold) for r in df.where("text is not null and lang is not null").select("text", "lang", fold.alias("fold")).collect()]
    assert len(of) > 26_000 and len(others) == FOLDS
    bands = [[] for _ in range(BANDS)]
    for k, p in enumerate(others):
        assert p.ranked == {x: slow_profile([t for t, y, f in of if y == x and f != k], longest, top) for x in "xy"}
        for t in (t for t, _, f in of if f == k):
            n = sum(map(str.isalpha, t))
            for b in range(min(n.bit_length(), BANDS)):
                at = [i for i, ch in enumerate(t) if ch.isalpha()][(1 << b) - 1] + 1
                bands[b].append(t[:at])
            if n:
                bands[min(n.bit_length(), BANDS) - 1].append(t)
        for b, cuts in enumerate(bands):
            bands[b] = [x for x in cuts if not isinstance(x, str)] + classify([x for x in cuts if isinstance(x, str)], p)[1].tolist()
    got = least_scores(df, "text", "lang", others)
    for b, scores in enumerate(bands):
        low, fifth, half = np.quantile(scores, [0.001, 0.05, 0.5]) if scores else (0, 0, 0)
        assert abs(got[b] - max(0, ROOM * min(low, half - 3 * (half - fifth)))) < 8 / STEPS, b


def test_cutoffs_of_little_or_nothing(spark):
    for rows in ([(1, "abc", None)], [(1, None, "x")], [(1, "abc", "x")], [(1, "abc", "x"), (2, "abc", "x")]):
        df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
        _, *others = fit_folds(df, "text", "lang", fold_of(F.col("text")), FOLDS)
        assert least_scores(df, "text", "lang", others) == [0.0] * BANDS


def test_few_characters_are_counted_at_a_time():
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcdefghijkl", k=5)) for _ in range(rng.randint(0, 170))) for _ in range(1400)]
    langs, folds = [rng.choice(["x", "y"]) for _ in texts], [rng.randrange(3) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(folds, pa.int32()), pa.array(texts)], names=["lang", "fold", "text"])
    want = Counter()
    for lang, fold, text in zip(langs, folds, texts, strict=True):
        for word in text.split():
            for n in (1, 2, 3):
                w = f" {word} " if n > 1 else word
                want.update((lang, fold, w[i : i + n]) for i in range(len(w) - n + 1))
    tracemalloc.start()
    got = Counter()
    for b in count_grams([batch], 3):
        for lang, fold, gram, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
            got[lang, fold, gram] += n
    fitted = tracemalloc.get_traced_memory()[1]
    assert got == want
    profiles = Profiles({"x": sorted({g for _, _, g in want})[:400]})
    few = classify(texts[:100], profiles)[1]
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    scores = classify(texts, profiles)[1]
    scored = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert scores[:100].tolist() == few.tolist()
    assert fitted < 60e6 and scored < 60e6, (fitted, scored)
