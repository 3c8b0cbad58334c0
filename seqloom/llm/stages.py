"""The stages of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.llm import jaccard, mixing, packing, quality, secretscan
from seqloom.llm.queries import vocabulary
from seqloom.session import read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    rated = quality.scored(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))
    return rated.where("predicted = 1").select(*COLUMNS)


def jaccard_stage(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one of smallest id.
    Documents link from a Jaccard similarity of 0.8 on shingles of five words."""
    return jaccard.first_of_each(docs.select(*COLUMNS), k=5, num=80, den=100)


def secrets_stage(spark, docs, sf_dir):
    """Secrets are replaced in the texts; all documents stay."""
    return secretscan.redacted(docs.select(*COLUMNS))


def mixing_stage(spark, docs, sf_dir):
    """The mix's words: for each pass over a source, the words of each document
    that the pass takes. A document is a row for each pass that takes of it."""
    return mixing.mixed(docs.select(*COLUMNS))


def packing_stage(spark, docs, sf_dir):
    """The packed pieces of the mixed documents."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))
