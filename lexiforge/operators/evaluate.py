"""Measures of a corrector: tallies, curves, sweeps, reports.

Thresholds never multiply rows: a row is counted once at the highest threshold it reaches, and the
few counts are summed upwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import ratio, softmax_top
from ..session import ranged, running, small

CURVE = [0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99]
SWEEP = [0.5, 0.9, 0.99, 0.999, 0.9999, 0.99999]
NEVER = -1e9


def at_thresholds(df: DataFrame, score: Column, thresholds: list[float], sums: dict[str, Column], groups: list[str] | None = None) -> DataFrame:
    """(groups, threshold, sums): each sum over the rows whose score reaches the threshold; all
    thresholds are there, groups without a row that reaches them have 0."""
    groups = groups or []
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= score))
    d = df.groupBy(*groups, F.coalesce(reached, F.lit(0)).alias("_reached")).agg(*[F.sum(c.cast("long")).alias(n) for n, c in sums.items()])
    steps = F.array(*[F.struct(F.lit(k + 1).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(thresholds)])
    d = d.withColumn("_s", F.explode(steps))
    return d.groupBy(*groups, F.col("_s.t").alias("threshold")).agg(*[F.sum(F.when(F.col("_reached") >= F.col("_s.k"), F.col(n)).otherwise(0)).alias(n) for n in sums])


def curve(rows: DataFrame, groups: list[str] | None = None, thresholds: list[float] = CURVE) -> DataFrame:
    """Rows (p, pred, gold, is_error) to precision and recall of changes at each threshold. A
    change is right if it is the gold fix; a null gold can't be made right."""
    groups = groups or []
    error, one = F.col("is_error"), F.lit(1)
    counts = at_thresholds(rows, F.col("p"), thresholds, {"changed": one, "detected": error, "right": error & F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))}, groups)
    whole = rows.groupBy(*groups).agg(F.count_if(error).alias("mistakes"), F.count_if(~error).alias("clean"))
    d = counts.join(F.broadcast(whole), groups) if groups else counts.withColumns({"mistakes": whole.select("mistakes").scalar(), "clean": whole.select("clean").scalar()})
    return d.select(
        *groups, "threshold", "changed",
        ratio(F.col("detected"), F.col("changed")).alias("detect_precision"), ratio(F.col("detected"), F.col("mistakes")).alias("detect_recall"),
        ratio(F.col("right"), F.col("changed")).alias("right_precision"), ratio(F.col("right"), F.col("mistakes")).alias("right_recall"),
        (1000 * ratio(F.col("changed") - F.col("detected"), F.col("clean"))).alias("false_per_1000"),
    )


def f1(curve_: DataFrame) -> DataFrame:
    """Adds the harmonic mean of right precision and recall."""
    p, r = F.col("right_precision"), F.col("right_recall")
    return curve_.withColumn("right_f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def sample_methods(samples: DataFrame, teachers: DataFrame | None = None, expanded: bool = False) -> DataFrame:
    """J1 and the scores of each way to choose: samples, one row per id, with (id, set, class, truth,
    candidates); adds `gold` and `keep` (0-based places, null if absent) and `methods`, a map from a
    method's name to its scores. Without `expanded`, candidates marked x can't be chosen."""
    c = F.col("candidates")

    def masked(score):
        return F.transform(c, lambda x: F.when(~F.lit(expanded) & F.coalesce(x["x"], F.lit(False)), NEVER).otherwise(score(x)))

    def place(test):
        at = F.filter(F.transform(c, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())
        return F.try_element_at(at, F.lit(1))

    def is_gold(x):
        ok = F.lower(x["t"]) == F.lower("truth")
        return ok if expanded else ok & ~F.coalesce(x["x"], F.lit(False))

    ways = [F.lit("ngram"), masked(lambda x: F.coalesce(x["s"], F.lit(NEVER))), F.lit("ngram_right"), masked(lambda x: F.coalesce(x["s"], F.lit(NEVER)) + F.coalesce(x["r"], F.lit(0.0)))]
    d = samples
    if teachers is not None:
        d = d.join(teachers, "id")
        for name in ("left", "full"):
            # A score that is missing or no number can't win.
            own = F.transform(F.sequence(F.lit(0), F.greatest(F.size(c), F.lit(1)) - 1), _score_at(f"ll_{name}", expanded))
            ways += [F.lit(f"teacher_{name}"), F.when(F.size(c) > 0, own).otherwise(F.array().cast("array<double>"))]
    return d.withColumns({"gold": place(is_gold), "keep": place(lambda x: F.coalesce(x["keep"], F.lit(False))), "methods": F.create_map(*ways)})


def _score_at(col: str, expanded: bool):
    def score(i: Column) -> Column:
        v = F.try_element_at(F.col(col), i + 1)
        hidden = F.lit(False) if expanded else F.coalesce(F.get("candidates", i)["x"], F.lit(False))
        return F.when(hidden | v.isNull() | F.isnan(v), NEVER).otherwise(v)

    return score


def choices(methods: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, gold, keep_at, method, top, p): what each method chooses, and its softmax probability."""
    d = methods.select(*keep, "gold", F.col("keep").alias("keep_at"), F.explode("methods").alias("method", "_v")).where(F.size("_v") > 0)
    return d.withColumn("_t", softmax_top(F.col("_v"))).select(*keep, "gold", "keep_at", "method", F.col("_t.at").alias("top"), F.col("_t.p").alias("p"))


def accuracy(chosen: DataFrame, groups: list[str]) -> DataFrame:
    """Per group and method: rows with the answer among the candidates, their share, and how often it is chosen."""
    return chosen.groupBy(*groups, "method").agg(F.count("gold").alias("n"), (F.count("gold") / F.count("*")).alias("coverage"), F.avg(F.when(F.col("gold").isNotNull(), (F.col("top") == F.col("gold")).cast("int"))).alias("accuracy"))


def safe_sweep(chosen: DataFrame, clean: Column, thresholds: list[float] = SWEEP) -> DataFrame:
    """Per method and threshold: fixes (the kept candidate is not chosen), right, wrong, clean words changed per 1000."""
    fix = F.coalesce(F.col("top") != F.col("keep_at"), F.lit(True))
    right = F.coalesce(F.col("top") == F.col("gold"), F.lit(False))
    d = at_thresholds(chosen.withColumn("_clean", F.coalesce(clean, F.lit(False))), F.col("p"), thresholds, {"fixes": fix, "right": fix & right, "wrong": fix & ~right, "clean_changed": fix & ~right & F.col("_clean")}, ["method"])
    whole = chosen.groupBy("method").agg(F.count_if(F.coalesce(clean, F.lit(False))).alias("_n"))
    return d.join(F.broadcast(whole), "method").select("method", "threshold", "fixes", "right", "wrong", (1000 * ratio(F.col("clean_changed"), F.col("_n"))).alias("clean_per_1000"))


def system_score(rows: DataFrame, groups: list[str], typed: str = "typed", output: str = "output", golds: str = "gold", is_error: str = "is_error") -> DataFrame:
    """An output that differs from what was typed is a change; it is right if among the golds (a|b)."""
    out, low = F.lower(output), F.lower(typed)
    changed = F.coalesce((F.col(output) != "") & (out != low), F.lit(False))
    error = F.col(is_error) == 1
    right = F.coalesce(F.array_contains(F.split(golds, r"\|"), out), F.lit(False))
    return rows.where(F.col(is_error).isNotNull()).groupBy(*groups).agg(F.count_if(changed).alias("changed"), F.count_if(changed & error).alias("detected"), F.count_if(changed & error & right).alias("right"), F.count_if(changed & ~error).alias("false"), F.count_if(error).alias("mistakes"), F.count_if(~error).alias("clean"))


def budget_matched(baseline: DataFrame, points: DataFrame) -> DataFrame:
    """Baseline (setting, target) and points (threshold, right, false_per_1000): for each setting
    the point with the most right changes within its target of false ones. Both are small reports;
    points enter as one array, so no join without a key is needed."""
    packed = points.agg(F.collect_list(F.struct("threshold", "right", "false_per_1000")).alias("p")).select("p").scalar()
    ok = F.filter("_p", lambda x: x["false_per_1000"] <= F.col("target") + 1e-9)
    best = F.array_max(F.transform(ok, lambda x: F.struct(x["right"].alias("right"), (-x["threshold"]).alias("t"))))
    return baseline.withColumn("_p", packed).select("setting", "target", (-best["t"]).alias("threshold"), best["right"].alias("right"))


def class_tally(rows: DataFrame, cls: str, fix: str, truth: str, typed: str, known: Column) -> DataFrame:
    """Per class: n, right, wrong, missed, and missed words that are real words themselves."""
    changed = F.coalesce((F.col(fix) != "") & (F.lower(fix) != F.lower(typed)), F.lit(False))
    right = changed & F.coalesce(F.lower(fix) == F.lower(truth), F.lit(False))
    return rows.groupBy(cls).agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(changed & ~right).alias("wrong"), F.count_if(~changed).alias("missed"), F.count_if(~changed & known).alias("missed_real"))


def audit_tally(rows: DataFrame) -> DataFrame:
    """Rows (is_error, right, taken_back) of fixes: fixes, wrong ones taken back, right ones lost, clean words restored."""
    return rows.agg(F.count("*").alias("fixes"), F.count_if(F.col("taken_back") & ~F.col("right") & F.col("is_error")).alias("wrong_back"), F.count_if(F.col("taken_back") & F.col("right")).alias("right_lost"), F.count_if(F.col("taken_back") & ~F.col("is_error")).alias("clean_back"))


def golden_report(cases: DataFrame, group: str = "grp", level: str = "level", ok: str = "ok") -> DataFrame:
    """Passed and all `must` and `goal` cases per group, with a TOTAL row."""
    must, passed = F.col(level) != "goal", F.col(ok)
    d = cases.rollup(group).agg(F.count_if(must & passed).alias("must_passed"), F.count_if(must).alias("must"), F.count_if(~must & passed).alias("goal_passed"), F.count_if(~must).alias("goal"), F.grouping(group).alias("_g"))
    return d.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(group)).alias(group), "must_passed", "must", "goal_passed", "goal")


def pick(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Of each group the value at index floor((n - 1) * share) in rising order.

    Distinct values are counted first and sorted by range; a value is at the index if the counts up to it
    pass it. Counts are carried over range borders, so no group meets in one task."""
    d = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    d = ranged(d, *[F.col(g) for g in groups], F.col(value))
    whole = d.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    d = running(d, groups, [F.col(value)], F.col("_range"), F.col("_n"), "_to")
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups]
    d = d.alias("l").join(small(whole).alias("r"), on).select("l.*", "r._all")
    at = lambda s: F.floor((F.col("_all") - 1) * s)
    return d.groupBy(*groups).agg(F.max("_all").alias("n"), *[F.min(F.when(F.col("_to") > at(s), F.col(value))).alias(name) for name, s in shares.items()])


def agreement(a: Column, b: Column, p: Column, q: Column) -> list[Column]:
    """Share of equal decisions and mean gap of probabilities, as aggregates."""
    return [F.avg((a == b).cast("int")).alias("agree"), F.avg(F.abs(p - q)).alias("gap")]


def outcomes(intended: Column, baseline: Column, shown: Column, undone: Column, app_wrote: Column) -> Column:
    """Kept, broken, fixed, missed or wrong; an undone change is judged by what was written."""
    final = F.when(undone, app_wrote).otherwise(shown)
    return F.when(baseline == intended, F.when(final == intended, "kept").otherwise("broken")).when(final == intended, "fixed").when(final == baseline, "missed").otherwise("wrong")
