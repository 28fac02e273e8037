"""A learned choice among candidates."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.edits import slip_kind
from ..functions.text import bare

KINDS = "none tone tone_drop tone_add tone_place mark_drop mark_add neighbour substitute omit double swap extra insert tone_convention".split()


def features(df: DataFrame) -> DataFrame:
    """Candidate rows (case_id, typed, typed_score, word, score, stage, place, n, gap, golds) with
    their numbers as columns f_..., and the label."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    own = F.coalesce("typed_score", F.lit(0.0))
    d = df.withColumn("_kind", F.coalesce(slip_kind("typed", "word"), F.lit("none")))
    cols: dict[str, Column] = {
        "known": flag(F.col("typed_score").isNotNull()), "own": own, "score": F.col("score"), "over": F.when(F.col("typed_score").isNotNull(), F.col("score") - own).otherwise(20.0), "gap": F.col("gap"),
        "place": F.col("place").cast("double"), "n": F.col("n").cast("double"), "near": flag(F.col("stage") == "near"), "far": flag(F.col("stage") == "far"), "split": flag(F.col("stage") == "split"),
        "length": F.char_length("word").cast("double"), "typed_length": F.char_length("typed").cast("double"), "longer": (F.char_length("word") - F.char_length("typed")).cast("double"),
        "same_letters": flag(bare("word") == bare("typed")), "ascii": flag(F.col("word").rlike("^[\\x00-\\x7F]*$")), "spaced": flag(F.contains("word", F.lit(" "))),
        "caps": flag((F.char_length("typed") > 1) & (F.upper("typed") == F.col("typed")) & (F.lower("typed") != F.col("typed"))), "odd_start": flag(F.lower("typed").rlike("^[jwzfsrx]")),
    }
    cols |= {f"kind_{k}": flag(F.col("_kind") == k) for k in KINDS}
    label = (F.array_contains(F.split("golds", r"\|"), F.lower("word")) & (F.lower("word") != F.lower("typed"))).cast("double")
    return d.withColumns({f"f_{k}": F.coalesce(c, F.lit(0.0)) for k, c in cols.items()} | {"label": F.coalesce(label, F.lit(0.0))}).drop("_kind")


def fit(df: DataFrame, boosted: bool = False) -> PipelineModel:
    """Fits on all rows given; the learners are Spark's distributed ones."""
    cols = [c for c in df.columns if c.startswith("f_")]
    stages = [VectorAssembler(inputCols=cols, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="features", withMean=True)]
    learner = GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.1, seed=7) if boosted else LogisticRegression(maxIter=100, regParam=1e-4)
    return Pipeline(stages=[*stages, learner.setFeaturesCol("features").setLabelCol("label")]).fit(df)


def decide(model: PipelineModel, rows: DataFrame, key: str = "case_id", tau: float = 0.5) -> DataFrame:
    """(key, word, p): the likeliest candidate of each case if it reaches tau; ties to the earlier place."""
    d = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    best = d.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("p"), "place", "word"))).where((F.col("_r") == 1) & (F.col("p") >= tau))
    return best.select(key, "word", "p")
