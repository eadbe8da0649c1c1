"""Corpus and topic-model engine on PySpark: XML decisions to topic mixtures."""

from topicloom.functions.text import clean, stopwords
from topicloom.operators.classify import CompositionErrors, classify_compositions
from topicloom.operators.dtm import Dtm, corpus_to_dtm
from topicloom.operators.gibbs import GibbsOptions
from topicloom.operators.lasso import PathOptions
from topicloom.operators.lda import LdaOptions, TopicModel, fit_lda, fit_together, prepare
from topicloom.operators.reduce_lasso import LassoReduction, reduce_by_lasso, reduce_by_lasso_cv
from topicloom.operators.reduce_tfidf import TfidfReduction, reduce_by_tfidf
from topicloom.operators.split import keep_largest_classes, stratified_split
from topicloom.operators.weights import tfidf_diagnostics, tfidf_weights
from topicloom.plans.reduce import Reduction, reduce_dtm
from topicloom.plans.sweep import Sweep, sweep_topics, topic_counts
from topicloom.sources.corpus import decisions_to_corpus
from topicloom.sources.decisions import read_decisions, read_reported
from topicloom.sources.exports import export_corpus, export_reduction, export_sweep
from topicloom.sources.saved import SavedReduction, SavedSweep, load_reduction, load_sweep

__all__ = [
    "CompositionErrors",
    "Dtm",
    "GibbsOptions",
    "LassoReduction",
    "LdaOptions",
    "PathOptions",
    "Reduction",
    "SavedReduction",
    "SavedSweep",
    "Sweep",
    "TfidfReduction",
    "TopicModel",
    "classify_compositions",
    "clean",
    "corpus_to_dtm",
    "decisions_to_corpus",
    "export_corpus",
    "export_reduction",
    "export_sweep",
    "fit_lda",
    "fit_together",
    "keep_largest_classes",
    "load_reduction",
    "load_sweep",
    "prepare",
    "read_decisions",
    "read_reported",
    "reduce_by_lasso",
    "reduce_by_lasso_cv",
    "reduce_by_tfidf",
    "reduce_dtm",
    "stopwords",
    "stratified_split",
    "sweep_topics",
    "tfidf_diagnostics",
    "tfidf_weights",
    "topic_counts",
]
