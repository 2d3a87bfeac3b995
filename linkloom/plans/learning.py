"""Learned matchers: word vectors and classifiers from title to series."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def word_vectors(titles: DataFrame, size: int = 100, window: int = 5, seed: int = 42):
    """A skip-gram model over the titles' content words (id, text)."""
    words = titles.select(T.content_words(F.col("text")).alias("words"))
    return Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, inputCol="words", outputCol="vector").fit(words)


def classifier(kind: str = "logistic", features: int = 4096, seed: int = 42) -> Pipeline:
    """TF-IDF features of column words and a classifier of column target."""
    models = {
        "logistic": lambda: LogisticRegression(maxIter=20),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=20)),
        "forest": lambda: RandomForestClassifier(numTrees=20, seed=seed),
    }
    steps = [StringIndexer(inputCol="target", outputCol="label", handleInvalid="skip"), HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features")]
    return Pipeline(stages=[*steps, models[kind]()])


def scores(predictions: DataFrame) -> dict[str, float]:
    names = {"accuracy": "accuracy", "precision": "weightedPrecision", "recall": "weightedRecall"}
    return {k: MulticlassClassificationEvaluator(metricName=m).evaluate(predictions) for k, m in names.items()}
