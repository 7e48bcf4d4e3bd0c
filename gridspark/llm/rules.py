"""Quality rules with risk-controlled thresholds, on built-in functions only.

``measures`` computes per-text counts. ``thresholds`` picks, for each stratum and rule, the strictest cutoff of a fixed
grid for which labelled holdout rows prove that at most `risk` / rules of good documents fail it: the exact binomial
probability of so few failures at that rate must not exceed the level. Cutoffs of a rule are tested from the most
lenient on and stop at the first that is not proved, so they share one level; the level is split evenly over strata and
rules (Bonferroni). With probability 1 - `error` no stratum loses more than `risk` of its good documents.

A stratum with too few good rows for that to prove anything (their number decides, not their values) tests one sequence
of rule sets instead, each at the whole `risk` and a stratum's share of `error`: the cutoffs of the first rule from the
most lenient on, then with its strictest those of the second, and so on, up to the first set that is not proved. Where
even that is too few rows nothing can be proved and nothing is rejected.

Rows: a null text has no words; a null stratum is a stratum of its own; labels of null id or quality are ignored, and an
id with any quality 0 is not good; a document row counts once however often it is labelled; repeated document rows each
count. Empty tables of documents or labels give an empty result, or rules that reject nothing.
"""

from __future__ import annotations

from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import SPACES, WORD, c, cut, hot_keys, salted_join

#: Words of a window, for repeats.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Each rule: what it measures (over the columns of ``measures``) and its cutoffs; a document fails above the cutoff.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("n_symbols / n_words", [3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1]),
    "marks_per_word": ("n_marks / n_words", [3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2]),
    "upper_share": ("n_upper / word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]),
    "repeat_share": ("n_repeat_words / n_words", [0.28, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "dup_line_share": ("n_dup_lines / n_lines", [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1]),
    "word_length": ("word_chars / n_words", [40.0, 30.0, 20.0, 15.0, 12.0, 10.0]),
}
#: Good documents of a stratum that all rules together may lose, and the chance that this fails anywhere.
RISK, ERROR = 0.05, 0.05
#: Strata up to which the table of cutoffs is broadcast.
BROADCAST_STRATA = 10_000


def length_without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def measures(df: DataFrame, text: str, keep: dict[str, Column]) -> DataFrame:
    """Columns `keep` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks."""
    held = list(keep)
    t = F.col("__t")
    df = df.select(*[v.alias(k) for k, v in keep.items()], F.coalesce(c(text).cast("string"), F.lit("")).alias("__t"))
    has_word = lambda x: F.char_length(F.translate(x, SPACES, "")) > 0
    df = df.select(
        *held,
        F.expr(f"regexp_extract_all(__t, r'{WORD}', 0)").alias("__w"),
        length_without(t, SPACES).cast("long").alias("word_chars"),
        (F.char_length(t) - length_without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length(t) - length_without(t, "!?")).cast("long").alias("n_marks"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.filter(F.split(t, "\n"), has_word).alias("__lines"),
    )
    counts = ["word_chars", "n_symbols", "n_marks", "n_upper"]
    df = df.select(
        *held,
        *counts,
        F.size("__w").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines"]
    windows = F.transform(
        F.sequence(F.lit(0), F.size("__h") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(WINDOW)]),
    )
    df = df.select(*held, *counts, F.when(F.size("__h") >= WINDOW, windows).alias("__g"))
    some = F.size("__g") > F.size(F.array_distinct("__g"))
    pairs = F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.select(*held, *counts, F.when(some, pairs).alias("__p"))
    again = F.expr("filter(sequence(0, size(__p) - 1), j -> __p[j].g <=> get(__p, j - 1).g or __p[j].g <=> get(__p, j + 1).g)")
    df = df.select(*held, *counts, F.when(F.col("__p").isNotNull(), F.sort_array(F.transform(again, lambda j: F.get(F.col("__p"), j)["i"]))).alias("__s"))
    # Words covered: each window adds its words up to the start of the next.
    cover = F.expr(f"aggregate(zip_with(__s, slice(__s, 2, size(__s)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (x, y) -> x + y)")
    return df.select(*held, *counts, F.when(F.col("__s").isNotNull(), cover).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def ln_gamma(x: Column) -> Column:
    """ln of gamma(x) for x >= 1, by Stirling's series eight steps up: right to about 1e-12."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return series - F.log(reduce(lambda a, k: a * (x + k), range(1, 8), x))


def binomial_cdf(k: str, n: str, p: float, terms: int = 2000) -> Column:
    """P(X <= k) for X of n draws at rate p, for k < n * p; 1 otherwise. Beyond `terms` terms a geometric series
    stands for the rest, which it exceeds: never too small."""
    kk, nn = F.col(k).cast("double"), F.col(n).cast("double")
    first = F.exp(ln_gamma(nn + 1) - ln_gamma(kk + 1) - ln_gamma(nn - kk + 1) + kk * log(p) + (nn - kk) * log(1 - p))
    ratio = (1 - p) / p
    body = f"""aggregate(sequence(0, cast(least({k}, {terms}) as int)), named_struct('t', 1d, 's', 0d),
        (a, j) -> named_struct('t', a.t * ({k} - j) / ({n} - {k} + j + 1) * {ratio!r}d, 's', a.s + a.t),
        a -> a.s + a.t / (1d - least(0.999999d, greatest(0d, ({k} - least({k}, {terms})) / ({n} - {k} + {terms} + 1) * {ratio!r}d))))"""
    return F.when(kk < nn * p, F.least(F.lit(1.0), first * F.expr(body))).otherwise(1.0)


def value(rule: str) -> Column:
    """A document's value under a rule; null where its divisor is 0."""
    top, bottom = RULES[rule][0].split(" / ")
    return F.when(F.col(bottom) > 0, F.col(top).cast("double") / F.col(bottom))


def thresholds(measured: DataFrame, labels: DataFrame, id: str, label_id: str, quality: str, risk: float = RISK, error: float = ERROR, sequences: bool = True) -> DataFrame:
    """(stratum, <rule>...): the cutoff of each rule, null where none is proved. Without `sequences` small strata test
    rule by rule like the others, which proves nothing there."""
    good = labels.where(c(label_id).isNotNull() & c(quality).isNotNull()).groupBy(c(label_id).alias(id)).agg(F.min(c(quality)).alias("__q")).where("__q = 1").select(id)
    held = measured.where(~base_failed()).join(good, id, "left_semi")
    tests = [(r, i) for r, (_, cuts) in RULES.items() for i in range(len(cuts))]
    # The first set of the sequence that a row fails: it fails all later ones too.
    first = F.coalesce(*[F.when(value(r) > RULES[r][1][i], F.lit(k)) for k, (r, i) in enumerate(tests)], F.lit(len(tests)))
    n = held.withColumn("__first", first).groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.count(F.when(value(r) > RULES[r][1][i], 1)).alias(f"{r}_{i}") for r, i in tests],
        *[F.count(F.when(F.col("__first") <= k, 1)).alias(f"first_{k}") for k in range(len(tests))],
    )
    n = cut(n)
    strata = n.count()
    level = error / max(1, strata * len(RULES))
    rows = n.select(
        "stratum",
        "n",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(RULES[r][1][i]).alias("cutoff"), F.col(f"{r}_{i}").alias("k"), F.col(f"first_{j}").alias("joint")) for j, (r, i) in enumerate(tests)])).alias("x"),
    ).select("stratum", "n", "x.*")
    enough = F.col("n") * log(1 - risk / len(RULES)) <= log(level)
    by_rule = binomial_cdf("k", "n", risk / len(RULES)) <= level
    together = binomial_cdf("joint", "n", risk) <= error / max(1, strata)
    proved = rows.withColumn("proved", F.when(enough, by_rule).otherwise(together) if sequences else by_rule)
    # Failures only grow as the cutoff falls, and their probability with them: the proved cutoffs are the first ones.
    return proved.groupBy("stratum").agg(*[F.min(F.when(F.col("proved") & (F.col("rule") == r), F.col("cutoff"))).alias(r) for r in RULES])


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """measured with base_failed, failed_rules (names) and kept."""
    cuts = cutoffs.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES])
    # A null stratum meets its own cutoffs: joined under a name that no stratum has.
    key = lambda x: x.withColumn("stratum", F.when(F.col("stratum").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), "stratum")))
    left, right = key(measured), cut(key(cuts))
    if right.count() <= BROADCAST_STRATA:
        both = left.join(F.broadcast(right), "stratum", "left")
    else:
        both = salted_join(left, right, "stratum", hot_keys(left, "stratum"))
    failed = F.array_compact(F.array(*[F.when(value(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    out = both.withColumn("failed_rules", failed).withColumn("base_failed", base_failed())
    stratum = F.when(F.col("stratum") != "null", F.substring("stratum", 2, 1 << 30))
    return out.withColumn("stratum", stratum).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(*[f"cut_{r}" for r in RULES])


def risk_controlled(df: DataFrame, labels: DataFrame, id: str, text: str, stratum: str, label_id: str = "doc_id", quality: str = "quality", risk: float = RISK, error: float = ERROR, sequences: bool = True) -> DataFrame:
    """For each row of df: id, stratum, the measures, base_failed, failed_rules, kept."""
    measured = cut(measures(df, text, {"__id": c(id), "stratum": c(stratum).cast("string")}))
    found = thresholds(measured, labels, "__id", label_id, quality, risk, error, sequences)
    return judge(measured, found).withColumnRenamed("__id", id)
