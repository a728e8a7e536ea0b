"""Assigning clusters to new documents with fitted models, in a batch or on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusweave.operators.dense import Encoder, dense_encode
from corpusweave.operators.gmm import GmmFit
from corpusweave.operators.kmeans import KMeansFit
from corpusweave.operators.pca import PcaFit
from corpusweave.operators.svd import SvdFit
from corpusweave.operators.tfidf import TfidfModel
from corpusweave.plans.config import ExperimentConfig
from corpusweave.plans.experiment import Lemmas, _reducer_input, preprocess
from corpusweave.sources import store


def score_documents(
    docs: DataFrame,
    config: ExperimentConfig,
    embedder: TfidfModel | None,
    reducer: SvdFit | PcaFit,
    clusterer: KMeansFit | GmmFit,
    lemmas: Lemmas = None,
    make_encoder: Callable[[], Encoder] | None = None,
) -> DataFrame:
    """``docs`` plus ``cluster``. Every step looks at one row only, so ``docs`` may be a stream.

    Dense experiments take ``make_encoder`` in place of the embedder. Stored agglomerative labels cannot
    score new documents, nor can a layout, which has no projection.
    """
    if not isinstance(clusterer, (KMeansFit, GmmFit)):
        raise TypeError("only K-Means and Gaussian mixtures assign clusters to new documents")
    if reducer is None:
        raise TypeError("a layout does not project new documents; see place_new_rows")
    cleaned = preprocess(docs, config, lemmas)
    if embedder is not None:
        vectors = embedder.vectors(cleaned)
    elif make_encoder is not None:
        vectors = dense_encode(cleaned, make_encoder, batch_size=config.sentence_transformer_embedding.batch_size)
    else:
        raise ValueError("scoring needs the embedder or make_encoder")
    projected = reducer.transform(_reducer_input(vectors, config, embedder))
    return clusterer.predict(projected).drop("tfidf", "vector", "_features", "reduced", "probability")


def load_scorer(
    spark: SparkSession, folder: str, config: ExperimentConfig, lemmas: Lemmas = None, make_encoder: Callable[[], Encoder] | None = None
) -> Callable[[DataFrame], DataFrame]:
    """A function that scores documents with the models an experiment wrote below ``folder``."""
    embedder = None if make_encoder else TfidfModel.load(spark, f"{folder}/models/vocabulary")
    reducer = store.load_reducer(spark, f"{folder}/models/reducer")
    clusterer = store.load_model(spark, f"{folder}/models/clusterer")
    return lambda docs: score_documents(docs, config, embedder, reducer, clusterer, lemmas, make_encoder)
