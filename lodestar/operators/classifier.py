"""A classifier on weak labels: features, standardised logistic regression on four fifths of the rows, thresholds, what to look at."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Penalty and turns of the regression, and the share that it learns from, in hundredths.
PENALTY, TURNS, LEARN = 0.01, 600, 80


def votes(functions: list[Column]) -> Column:
    """1 with two votes for it and none against, 0 with one against and none for it, else null. Votes are 1, -1 or null."""
    count = lambda v: sum((F.coalesce((f == v).cast("int"), F.lit(0)) for f in functions), F.lit(0))
    return F.when((count(1) >= 2) & (count(-1) == 0), 1).when((count(-1) >= 1) & (count(1) == 0), 0)


def share_of_kinds(skills: Column, kinds: dict[str, list[str]]) -> dict[str, Column]:
    """Of each kind, how many of the skills are of it and which part of all that is."""
    out = {}
    for kind, names in kinds.items():
        n = F.size(F.array_intersect(skills, F.array(*map(F.lit, names))))
        out |= {f"n_{kind}": n, f"share_{kind}": F.when(F.size(skills) > 0, n / F.size(skills)).otherwise(0.0)}
    return out


def learns(key: Column) -> Column:
    """Four fifths of the rows, by a hash of the key."""
    return F.pmod(F.xxhash64(key), F.lit(100)) < LEARN


def fitted(df: DataFrame, features: list[str], label: str) -> PipelineModel:
    """df should hold rows to learn from alone, with a label of 0 or 1."""
    assembled = VectorAssembler(inputCols=features, outputCol="raw_", handleInvalid="error")
    scaled = StandardScaler(inputCol="raw_", outputCol="scaled_", withMean=True, withStd=True)
    regression = LogisticRegression(featuresCol="scaled_", labelCol=label, regParam=PENALTY, elasticNetParam=0.0, maxIter=TURNS, standardization=False)
    return Pipeline(stages=[assembled, scaled, regression]).fit(df)


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("raw_", "scaled_", "rawPrediction", "probability", "prediction")


def threshold_sweep(df: DataFrame, label: str, thresholds: list[float]) -> DataFrame:
    """threshold, precision, recall, f1: one pass over the rows for all thresholds."""
    each = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), "p", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    up = F.col("p") >= F.col("threshold")
    g = each.groupBy("threshold").agg(F.count_if(up & (F.col("y") == 1)).alias("tp"), F.count_if(up & (F.col("y") == 0)).alias("fp"), F.count_if(~up & (F.col("y") == 1)).alias("fn"))
    part = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    g = g.withColumns({"precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("tp") + F.col("fn"))})
    return g.select("threshold", "precision", "recall", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def least_certain(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows whose probability is nearest to one half, which people should look at; the key breaks ties."""
    return df.orderBy(F.abs(F.col("p") - 0.5), key).limit(n)
