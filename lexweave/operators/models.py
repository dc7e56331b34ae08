"""Classifiers over clause features, on pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import HashingTF, IDF, Normalizer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.keys import computed_once
from lexweave.operators import decisions, features
from lexweave.session import materialize


def with_features(df: DataFrame, text: str) -> DataFrame:
    """Adds the eight actionability features and `terms`: the text's words and pairs of neighbouring words (none for null)."""
    x = df.withColumns({k: v.cast("double") for k, v in features.actionability(F.col(text)).items()})
    words = F.filter(F.split(F.coalesce(F.lower(text), F.lit("")), "[^a-z0-9]+"), lambda w: w != "")
    x = computed_once(x, _w=words)
    pairs = F.zip_with(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return x.withColumn("terms", F.concat("_w", pairs)).drop("_w")


def with_weight(df: DataFrame, label: str) -> DataFrame:
    """Adds weight = n_all / (classes * n_class)."""
    return df.join(F.broadcast(decisions.class_weights(df, label).select(label, "weight")), label)  # one row for each class


def _front(label: str, buckets: int) -> list:
    names = list(features.actionability(F.lit("")))
    return [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        HashingTF(numFeatures=2 * buckets, inputCol="terms", outputCol="tf"),
        IDF(inputCol="tf", outputCol="idf"),
        Normalizer(inputCol="idf", outputCol="n"),
        VectorAssembler(inputCols=["n", *names], outputCol="features", handleInvalid="keep"),
    ]


def logistic(df: DataFrame, text: str, label: str, c: float = 1.0, buckets: int = 1 << 12, steps: int = 1000, tol: float = 1e-4) -> PipelineModel:
    """Multinomial regression with balanced weights; c is the inverse penalty summed over rows, as regParam = 1 / (c * weights)."""
    x = materialize(with_weight(with_features(df.where(F.col(label).isNotNull()), text), label), "features")  # read by every stage's fit
    total = x.agg(F.sum("weight")).first()[0] or 1.0
    lr = LogisticRegression(family="multinomial", weightCol="weight", standardization=False, regParam=1.0 / (c * total), maxIter=steps, tol=tol)
    return Pipeline(stages=[*_front(label, buckets), lr]).fit(x)


def svm(df: DataFrame, text: str, label: str, buckets: int = 1 << 12, steps: int = 30) -> PipelineModel:
    x = with_features(df.where(F.col(label).isNotNull()), text)
    return Pipeline(stages=[*_front(label, buckets), OneVsRest(classifier=LinearSVC(maxIter=steps, regParam=0.01))]).fit(x)


def perceptron(df: DataFrame, text: str, label: str, classes: int, hidden: int = 16, seed: int = 42) -> PipelineModel:
    names = list(features.actionability(F.lit("")))
    x = with_features(df.where(F.col(label).isNotNull()), text)
    front = [StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=names, outputCol="features")]
    return Pipeline(stages=[*front, MultilayerPerceptronClassifier(layers=[len(names), hidden, classes], seed=seed, maxIter=50)]).fit(x)


def save(model: PipelineModel, path: str) -> None:
    """Writes a fitted pipeline, its labels with it; an existing one at the path is replaced."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def ensemble(members: list[tuple[PipelineModel, float]], df: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id, guess, score): the label with the largest weighted mean of the members' class probabilities (ties: the first label). A
    member without probabilities, such as a one-against-rest machine, brings the softmax of its scores. Members must know the same labels."""
    labels = members[0][0].stages[0].labels
    total = None
    for model, weight in members:
        if model.stages[0].labels != labels:
            raise ValueError("the members have different labels")
        got = PipelineModel(model.stages[1:]).transform(with_features(df, text))
        raw = vector_to_array("probability" if "probability" in got.columns else "rawPrediction")
        e = F.transform(raw, lambda x: F.exp(x))
        p = raw if "probability" in got.columns else F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        one = got.select(F.col(id_col).alias("id"), F.transform(p, lambda x: x * F.lit(weight)).alias("p"))
        total = one if total is None else total.unionByName(one)
    sums = total.groupBy("id").agg(*[F.round(F.sum(F.get("p", F.lit(i))), 9).alias(f"_{i}") for i in range(len(labels))])
    best = F.greatest(*[F.struct(F.col(f"_{i}").alias("s"), F.lit(-i).alias("i"), F.lit(x).alias("l")) for i, x in enumerate(labels)])
    return sums.select("id", best.l.alias("guess"), (best.s / sum(w for _, w in members)).alias("score"))


def predict(model: PipelineModel, df: DataFrame, text: str) -> DataFrame:
    """df with guess: the label of the largest score."""
    names = model.stages[0].labels
    got = PipelineModel(model.stages[1:]).transform(with_features(df, text))
    return got.withColumn("guess", F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1))
