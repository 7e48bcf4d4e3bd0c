"""Language identification with rank-order profiles of character n-grams.

A profile lists a text's `top` most frequent n-grams (1 to `longest` letters, words padded by one blank on each side)
by falling count, ties by length and code points. A document's distance to a language is the sum, over the document's
profile, of how far each n-gram's rank is from its rank there; an n-gram that is absent there costs `top`. The language
of least distance wins, ties by name; the score is 1 - distance / the greatest possible distance.

Fitting counts n-grams of every labelled text in one distributed pass; only languages x top n-grams reach the driver.

Rows: a text that is null or has no letter is `und` with score 0. A null language is not learned from. With nothing
learned, every text is `und`. Repeated rows weigh as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridspark.llm.common import c, lean, release

UNKNOWN = "und"
#: Texts that a worker holds as strings at a time, and characters of those that are counted together.
SLICE = 2_000
CHUNK = 1 << 17


@dataclass(frozen=True)
class Profiles:
    """For each language its most frequent n-grams, in order of rank."""

    ranked: dict[str, list[str]]
    longest: int = 3
    top: int = 400


def codes_of(texts: list[str]) -> np.ndarray:
    """Code points of lower-cased texts, a blank before each and one after all."""
    return np.frombuffer((" " + " ".join(x.lower() for x in texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def letters_of(codes: np.ndarray) -> np.ndarray:
    """The letters that occur, by code point."""
    present = np.flatnonzero(np.bincount(codes))
    return np.array([x for x in present.tolist() if chr(x).isalpha()], np.int64)


def symbols(texts: list[str], letters: np.ndarray | None = None):
    """(alphabet, symbol of each place, text of each place): letters as 1.., gaps between words as single 0s.

    Symbols number the letters of the texts, or those given, by code point, so their order does not depend on the batch."""
    codes = codes_of(texts)
    if letters is None:
        letters = letters_of(codes)
    lengths = np.fromiter((len(x.lower()) for x in texts), np.int64, len(texts)) + 1
    owner = np.r_[0, np.repeat(np.arange(len(texts)), lengths)]
    number = np.zeros(int(codes.max()) + 1, np.int64)
    here = letters < len(number)
    number[letters[here]] = np.arange(1, len(letters) + 1)[here]
    s = number[codes]
    keep = (s != 0) | np.r_[True, s[:-1] != 0]
    return letters, s[keep], owner[keep]


def grams(letters: np.ndarray, s: np.ndarray, owner: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(n-gram number, text) of each n-gram that holds a letter and spans no two words."""
    base = len(letters) + 1
    start = 0
    numbers, owners = [], []
    for n in range(1, longest + 1):
        if len(s) < n:
            break
        m = len(s) - n + 1
        g = np.zeros(m, np.int64)
        for k in range(n):
            g = g * base + s[k : k + m]
        ok = np.ones(m, bool) if n > 1 else s != 0
        for k in range(1, n - 1):
            ok &= s[k : k + m] != 0
        # The blank before a word belongs to the text of the word's letters.
        own = owner[1 : 1 + m] if n > 1 else owner
        numbers.append(g[ok] + start)
        owners.append(own[ok])
        start += base**n
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    return np.concatenate(numbers), np.concatenate(owners), start


def spell(letters: np.ndarray, number: np.ndarray, longest: int) -> np.ndarray:
    """The n-grams of these numbers, blanks as spaces."""
    base = len(letters) + 1
    codes = np.r_[ord(" "), letters].astype(np.uint32)
    out = np.zeros((len(number), longest), np.uint32)
    start = 0
    for n in range(1, longest + 1):
        at = np.flatnonzero((number >= start) & (number < start + base**n))
        g = number[at] - start
        for k in reversed(range(n)):
            g, r = np.divmod(g, base)
            out[at, k] = codes[r]
        start += base**n
    return out.view(f"<U{longest}").ravel()


def numbers_of(letters: np.ndarray, ngrams: list[str]) -> np.ndarray:
    """The numbers of n-grams in this alphabet, -1 for those with other letters."""
    base = len(letters) + 1
    longest = max(map(len, ngrams), default=1)
    codes = np.array(ngrams, f"<U{longest}").view(np.uint32).reshape(len(ngrams), longest)
    size = np.fromiter(map(len, ngrams), np.int64, len(ngrams))
    digits = np.searchsorted(letters, codes)
    known = letters[np.minimum(digits, len(letters) - 1)] == codes if len(letters) else np.zeros(codes.shape, bool)
    digits = np.where(known, digits + 1, 0)
    known |= codes == ord(" ")
    out, found = np.zeros(len(ngrams), np.int64), np.ones(len(ngrams), bool)
    for k in range(longest):
        here = size > k
        out = np.where(here, out * base + digits[:, k], out)
        found &= known[:, k] | ~here
    starts = np.cumsum([0, 0, *(base**n for n in range(1, longest))])
    return np.where(found, out + starts[size], -1)


def chunks(texts: list[str]):
    lo, held = 0, 0
    for i, x in enumerate(texts):
        if i > lo and (held + len(x) > CHUNK or i - lo >= 4096):
            yield lo, i
            lo, held = i, 0
        held += len(x)
    if texts:
        yield lo, len(texts)


def counted(number: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count), sorted by owner and n-gram."""
    if size * (int(owner.max(initial=0)) + 1) < (1 << 62):
        key = np.sort(owner * size + number)
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.r_[at, len(key)])
        return key[at] // size, key[at] % size, n
    order = np.lexsort((number, owner))
    o, g = owner[order], number[order]
    at = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (g[1:] != g[:-1])])
    return o[at], g[at], np.diff(np.r_[at, len(o)])


def count_grams(batches, longest: int):
    """Batches (lang, fold, gram, n) of batches (lang, fold, text); an n-gram may come more than once, as nothing is held
    beyond a slice: what follows adds them up."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            langs, folds, texts = (x.slice(at, SLICE).to_pylist() for x in batch.columns)
            groups = list(zip(langs, folds, strict=True))
            names = {x: i for i, x in enumerate(dict.fromkeys(groups))}
            of = np.array([names[x] for x in groups])
            lang, fold = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.int32())
            every = np.unique(np.concatenate([letters_of(codes_of(texts[lo:hi])) for lo, hi in chunks(texts)]))
            found = []
            for lo, hi in chunks(texts):
                _, s, owner = symbols(texts[lo:hi], every)
                number, own, size = grams(every, s, owner, longest)
                found.append(counted(number, of[lo:hi][own], size))
            o, g, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((g, o))
            o, g, n = o[order], g[order], n[order]
            if not len(o):
                continue
            first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (g[1:] != g[:-1])])
            o, g, n = pa.array(o[first]), spell(every, g[first], longest), np.add.reduceat(n, first)
            yield pa.RecordBatch.from_arrays([lang.take(o), fold.take(o), pa.array(g, pa.string()), pa.array(n, pa.int64())], names=["lang", "fold", "gram", "n"])


def fit(df: DataFrame, text: str, lang: str, longest: int = 3, top: int = 400) -> Profiles:
    """Profiles of the rows whose language and text are not null."""
    return fit_folds(df, text, lang, F.lit(0), 0, longest, top)[0]


def fit_folds(df: DataFrame, text: str, lang: str, fold: Column, folds: int, longest: int = 3, top: int = 400) -> list[Profiles]:
    """Profiles of the rows whose language and text are not null, then for each fold those of the rows outside it: all
    from one count of every such row. `fold` is an int column below `folds`."""
    rows = df.select(c(lang).cast("string").alias("lang"), fold.cast("int").alias("fold"), c(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(lean(lambda batches: count_grams(batches, longest)), "lang string, fold int, gram string, n long")
    every = F.sum("n")
    # Part 0 is all rows, part k + 1 those outside fold k.
    parts = [every, *(every - F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("n"))), F.lit(0)) for k in range(folds))]
    counts = counts.groupBy("lang", "gram").agg(F.array(*parts).alias("ns")).select("lang", "gram", F.posexplode("ns").alias("fold", "n")).where("n > 0")
    # The first `top` of each language among those of its parts: no task ranks a whole language.
    counts = counts.withColumn("len", F.length("gram")).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(32)))
    order = [F.desc("n"), F.asc("len"), F.asc("gram")]
    for keys in (["fold", "lang", "part"], ["fold", "lang"]):
        counts = counts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= top)
    ranked: list[dict[str, list[str]]] = [{} for _ in range(folds + 1)]
    for r in sorted(counts.select("fold", "lang", "r", "gram").collect()):
        ranked[r[0]].setdefault(r[1], []).append(r[3])
    return [Profiles(x, longest, top) for x in ranked]


def classify(texts: list[str | None], profiles: Profiles) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    names = sorted(profiles.ranked)
    out = np.full(len(texts), -1)
    score = np.zeros(len(texts))
    whole = [x or "" for x in texts]
    top = profiles.top
    every = sorted({g for x in profiles.ranked.values() for g in x})
    rank = np.full((len(every) + 1, len(names)), -1)
    place = {g: i for i, g in enumerate(every)}
    for k, name in enumerate(names):
        for r, g in enumerate(profiles.ranked[name]):
            rank[place[g], k] = r
    for lo, hi in chunks(whole) if names else ():
        letters, s, owner = symbols(whole[lo:hi])
        if not len(letters):
            continue
        number, own, size = grams(letters, s, owner, profiles.longest)
        o, g, n = counted(number, own, size)
        most = int(n.max()) + 1
        order = np.argsort(o * most + (most - 1 - n), kind="stable")
        o, g = o[order], g[order]
        first = np.searchsorted(o, np.arange(hi - lo))
        r = np.arange(len(o)) - first[o]
        keep = r < top
        o, g, r = o[keep], g[keep], r[keep]
        known = numbers_of(letters, every)
        sort = np.argsort(known, kind="stable")
        at = np.minimum(np.searchsorted(known[sort], g), len(every) - 1)
        row = np.where(known[sort][at] == g, sort[at], len(every))
        size_of = np.bincount(o, minlength=hi - lo)
        distance = np.empty((hi - lo, len(names)), np.int64)
        for k in range(len(names)):
            there = rank[row, k]
            cost = np.where(there < 0, top, np.abs(there - r))
            distance[:, k] = np.bincount(o, weights=cost, minlength=hi - lo).astype(np.int64)
        best = np.argmin(distance, axis=1)
        has = size_of > 0
        out[lo:hi] = np.where(has, best, -1)
        score[lo:hi] = np.where(has, 1 - distance[np.arange(hi - lo), best] / np.maximum(1, size_of * top), 0)
    return [names[k] if k >= 0 else UNKNOWN for k in out.tolist()], score


def predict(text: Column, profiles: Profiles) -> Column:
    """A struct (lang, score) for each text."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for texts in parts:
                found = [classify([x if isinstance(x, str) else None for x in texts[lo : lo + SLICE]], profiles) for lo in range(0, len(texts), SLICE)]
                yield pd.DataFrame({"lang": [x for lang, _ in found for x in lang], "score": np.concatenate([np.zeros(0), *(x for _, x in found)])})
        finally:
            release()

    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return F.pandas_udf(run, kind)(text.cast("string"))


#: Folds of the labelled texts: each is scored by profiles that all the others taught.
FOLDS = 5
#: Scores are counted in this many steps, rounded down, so that their quantiles need no list of all scores.
STEPS = 1 << 14
#: A cutoff as a share of the low scores of labelled texts: the rest is room for odd texts in a learned language.
ROOM = 0.7
#: Texts are banded by letters: 1, 2 to 3, 4 to 7 and so on; those of 1,024 or more are one band.
BANDS = 11


def fold_of(text: Column) -> Column:
    """The fold of a text: copies share one, so that none is scored by profiles which another taught."""
    return F.pmod(F.xxhash64(text.cast("string"), F.lit(29)), F.lit(FOLDS)).cast("int")


def held_out(texts: list[str], profiles: Profiles) -> tuple[list[int], list[float]]:
    """(band, score) of each text, and of its first 1, 2, 4 ... letters: the shortest texts of each band it reaches."""
    bands, cuts = [], []
    for t in texts:
        at = list(islice((i for i, ch in enumerate(t) if ch.isalpha()), 1 << (BANDS - 1)))
        most = len(at).bit_length()
        bands += [*range(most), *([most - 1] if at else [])]
        cuts += [t[: at[(1 << b) - 1] + 1] for b in range(most)] + ([t] if at else [])
    return bands, classify(cuts, profiles)[1].tolist()


def least_scores(df: DataFrame, text: str, lang: str, others: list[Profiles]) -> list[float]:
    """For each band of letters the score that a text in a learned language hardly ever falls below, from every labelled
    text, each scored by others[its fold]: the profiles that all labelled texts outside its fold taught; 0 where there
    are none. It is ROOM times the 0.1 % quantile, or where that is less the median minus three times its distance from
    the 5 % quantile, so that few texts do not make it too high."""
    rows = df.where(c(lang).isNotNull() & c(text).isNotNull()).select(fold_of(c(text)).alias("fold"), c(text).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            counts = np.zeros(BANDS * (STEPS + 1), np.int64)
            for lo in range(0, batch.num_rows, SLICE):
                folds = np.array(batch.column(0).slice(lo, SLICE).to_pylist())
                texts = batch.column(1).slice(lo, SLICE).to_pylist()
                for k, profiles in enumerate(others):
                    if profiles.ranked and (mine := np.flatnonzero(folds == k)).size:
                        bands, scores = held_out([texts[i] for i in mine.tolist()], profiles)
                        step = np.clip(np.floor(np.array(scores) * STEPS), 0, STEPS).astype(np.int64)
                        counts += np.bincount(np.array(bands, np.int64) * (STEPS + 1) + step, minlength=len(counts))
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array((at // (STEPS + 1)).astype(np.int32)), pa.array((at % (STEPS + 1)).astype(np.int32)), pa.array(counts[at])], names=["band", "step", "n"])

    scores = rows.mapInArrow(lean(run), "band int, step int, n long").groupBy("band", "step").agg(F.sum("n").alias("n"))
    out = [0.0] * BANDS
    for r in scores.groupBy("band").agg(F.percentile("step", F.array(F.lit(0.001), F.lit(0.05), F.lit(0.5)), F.col("n")).alias("q")).collect():
        low, fifth, half = (x / STEPS for x in r.q)
        out[r.band] = max(0.0, ROOM * min(low, half - 3 * (half - fifth)))
    return out


def scores_enough(text: Column, score: Column, least: list[float]) -> Column:
    """Whether the score is at least that of the band of the text's letters; letters are counted only where it matters."""
    band = F.least(F.lit(BANDS), F.greatest(F.lit(1), F.length(F.bin(F.regexp_count(text, F.lit(r"\p{L}"))))))
    return F.when(score >= max(least), True).otherwise(score >= F.element_at(F.array(*map(F.lit, least)), band))
