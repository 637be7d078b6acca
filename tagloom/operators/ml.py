"""Models on cubes: random forests over fingerprints, and low-dimensional maps of building blocks."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.cube import Cube, row_mean


def hashed_fingerprint(smiles: Column, bits: int = 256, size: int = 3) -> Column:
    """A bit array of hashed character n-grams up to ``size``; what stands in for circular
    fingerprints where RDKit is not installed.  A gram's bit: the first 32 of its md5, modulo ``bits``.

    The slots are the variable of an outer lambda, so that they are made once a row and not once a bit."""
    text = F.coalesce(smiles, F.lit(""))
    grams = []
    for n in range(1, size + 1):
        grams.append(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), _gram(text, n)))
    slots = F.array_distinct(F.transform(F.flatten(F.array(*grams)), lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("long") % bits))
    places = F.array(*[F.lit(b).cast("long") for b in range(bits)])
    return F.transform(F.array(slots), lambda s: F.transform(places, lambda b: F.array_contains(s, b).cast("double")))[0]


def _gram(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def with_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int"))


def forest_regression(df: DataFrame, key: str, features: str, target: str, folds: int = 5, trees: int = 20, seed: int = 42) -> DataFrame:
    """Per fold: R2 of a random forest on held-out rows and of the training mean."""
    spark = df.sparkSession
    data = with_folds(df.select(key, array_to_vector(F.col(features)).alias("x"), F.col(target).cast("double").alias("y")), key, folds, seed).cache()
    rows = []
    for k in range(folds):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        made = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=trees, seed=seed).fit(train).transform(test)
        mean = train.agg(F.avg("y")).first()[0]
        r2 = RegressionEvaluator(labelCol="y", metricName="r2")
        rows.append((k, float(r2.evaluate(made)), float(r2.evaluate(test.withColumn("prediction", F.lit(mean))))))
    data.unpersist()
    return spark.createDataFrame(rows, "fold int, r2 double, baseline_r2 double")


def forest_classification(df: DataFrame, key: str, features: str, label: Column, folds: int = 5, trees: int = 20, seed: int = 42) -> DataFrame:
    """Per fold: accuracy of a random forest, of the majority class, and the confusion counts."""
    spark = df.sparkSession
    data = with_folds(df.select(key, array_to_vector(F.col(features)).alias("x"), label.cast("double").alias("y")), key, folds, seed).cache()
    rows = []
    for k in range(folds):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        made = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, seed=seed).fit(train).transform(test)
        accuracy = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy").evaluate(made)
        major = train.groupBy("y").count().orderBy(F.desc("count"), "y").first()[0]
        c = {(int(r["y"]), int(r["prediction"])): r["count"] for r in made.groupBy("y", "prediction").count().collect()}
        base = test.agg(F.avg((F.col("y") == major).cast("double"))).first()[0]
        rows.append((k, float(accuracy), float(base), c.get((1, 1), 0), c.get((0, 1), 0), c.get((1, 0), 0), c.get((0, 0), 0)))
    data.unpersist()
    return spark.createDataFrame(rows, "fold int, accuracy double, majority_accuracy double, tp long, fp long, fn long, tn long")


def map_2d(df: DataFrame, key: str, features: str) -> DataFrame:
    """Two principal components of the feature arrays: the documented stand-in for t-SNE."""
    data = df.select(key, array_to_vector(F.col(features)).alias("x"))
    made = PCA(k=2, inputCol="x", outputCol="p").fit(data).transform(data)
    at = vector_to_array("p")
    return made.select(key, at[0].alias("x"), at[1].alias("y"))


def comparison_space(cube: Cube, key: str, features: str, experiments: list[str], most: int = 3000) -> DataFrame:
    """Long form of one shared map: a row for each compound and experiment with a dot size.

    The ``most`` most enriched compounds are drawn, as a plot can show no more.
    """
    best = F.greatest(*[row_mean(cube.indexes[e]) for e in experiments]) if len(experiments) > 1 else row_mean(cube.indexes[experiments[0]])
    top = cube.data.withColumn("__v", best).orderBy(F.desc("__v"), key).limit(most)
    at = map_2d(top, key, features)
    sizes = F.explode(F.array(*[F.struct(F.lit(e).alias("experiment"), row_mean(cube.indexes[e]).alias("value")) for e in experiments])).alias("s")
    long = top.select(key, sizes)
    return long.join(at, key).select(key, "x", "y", "s.experiment", "s.value", (F.log1p(F.greatest(F.col("s.value"), F.lit(0.0))) + 1).alias("size"))
