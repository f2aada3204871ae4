"""Text regression: weighted one- and two-word features and a ridge chosen on validation rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, SQLTransformer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from . import text as texts


def grams(df: DataFrame, text: str, out: str = "grams") -> DataFrame:
    """Words and pairs of neighbouring words of a text, folded; a null text has none."""
    words = texts.tokens(F.coalesce(F.col(text), F.lit("")), [])
    rows = df.withColumn("__w", words)
    pairs = F.when(F.size("__w") > 1, F.zip_with(F.slice("__w", F.lit(1), F.size("__w") - 1), F.slice("__w", F.lit(2), F.size("__w") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return rows.withColumn(out, F.concat("__w", F.coalesce(pairs, F.expr("cast(array() as array<string>)")))).drop("__w")


def fitted(train: DataFrame, validation: DataFrame, text: str, real: str, strengths: list[float], least_docs: int = 2, most: int = 1 << 18) -> tuple[PipelineModel, float, float]:
    """(model, strength, validation error) of the ridge whose mean absolute error is least.

    Counts weigh with their logarithm and the inverse document frequency; the vocabulary has the
    ``most`` frequent features of at least ``least_docs`` documents.
    """
    counted = CountVectorizer(inputCol="grams", outputCol="__n", minDF=least_docs, vocabSize=most)
    weigh = [counted, IDF(inputCol="__n", outputCol="__i", minDocFreq=least_docs), Normalizer(inputCol="__i", outputCol="features"), SQLTransformer(statement="SELECT * FROM __THIS__")]
    rows, held = grams(train, text), grams(validation, text)
    best = None
    for strength in strengths:
        model = Pipeline(stages=[*weigh, LinearRegression(labelCol=real, regParam=strength, elasticNetParam=0.0, maxIter=50)]).fit(rows)
        error = model.transform(held).agg(F.avg(F.abs(F.col("prediction") - F.col(real)))).first()[0]
        if best is None or error < best[2]:
            best = model, strength, error
    return best


def predicted(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """``df`` with the model's ``prediction``."""
    return model.transform(grams(df, text)).drop("grams", "__n", "__i", "features")


def perturbation_study(df: DataFrame, y: str, removed: str, models: dict[str, tuple[str, str, str]], most: float | None = None) -> DataFrame:
    """How each model's predictions answer to changes of the text that should, or should not, matter; one pass.

    ``models``: {name: columns of its predictions for the text, for the text with its dates moved, and for the
    text without a part}.  ``removed`` is how much of ``y`` the part stood for; rows where it is null are
    left out of the figures about it, and what remains of ``y`` is held within 0 and ``most``.  ``slope``
    and ``corr`` are of the change in prediction on the expected change, 0 for a model that doesn't change at all.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), *[F.col(c).cast("double").alias(n) for n, c in zip(("plain", "moved", "cut"), columns)]) for name, columns in models.items()]))
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(removed).cast("double").alias("removed"), each.alias("m")).select("y", "removed", "m.*")
    left = F.when(F.col("removed").isNotNull(), F.greatest(F.col("y") - F.col("removed"), F.lit(0.0)))
    left = left if most is None else F.when(left.isNotNull(), F.least(left, F.lit(float(most))))
    change, expected = F.when(F.col("removed").isNotNull(), F.col("cut") - F.col("plain")), -F.col("removed")
    fixed = F.coalesce(F.stddev_pop(change), F.lit(0.0)) <= 1e-9
    together = F.covar_pop(change, expected)
    slope = together / F.nullif(F.var_pop(expected), F.lit(0.0))
    corr = together / F.nullif(F.stddev_pop(change) * F.stddev_pop(expected), F.lit(0.0))
    return rows.groupBy("model").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("plain") - F.col("y"))).alias("mae"), F.avg(F.abs(F.col("moved") - F.col("plain"))).alias("moved_change"), F.avg(F.abs(F.col("moved") - F.col("y"))).alias("moved_mae"),
        F.avg(F.abs(F.col("cut") - left)).alias("cut_mae"), F.avg(change).alias("cut_change"), F.avg(expected).alias("expected_change"),
        F.when(fixed, 0.0).otherwise(slope).alias("slope"), F.when(fixed, 0.0).otherwise(corr).alias("corr"))
