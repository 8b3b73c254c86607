"""Queries p7 to p9, over the whole table of documents each, and their oracle SQL where SQL can say it.

SQL can't encode, pack or score; what it can say is that no document is lost on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import packing, tokens, toxicity
from tidelog.plans.tables import table
from tidelog.session import shared_checkpoint, spread

CAPACITY = 2048


def _documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", *more, "text"), "doc_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(_documents(spark, sf_dir), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.counted(_documents(spark, sf_dir), "doc_id", "text")
    return packing.containers(sizes, "doc_id", "n_tokens", CAPACITY)


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = toxicity.labelled_sample(table(spark, sf_dir, "review_snippets"), "snippet", "category")
    model = toxicity.fit(labelled)
    # Reading is most of the work, and is done once for the counts and the scores.
    texts = shared_checkpoint(toxicity.read(_documents(spark, sf_dir, "source"), "doc_id", "text", model, keep=["source"]))
    model = toxicity.with_counts(model, toxicity.background_counts(texts, model))
    return toxicity.scored(texts, "doc_id", model, keep=["source"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_scores(spark, sf_dir).where("flagged").select("doc_id")


def p9_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are compared without letter case, blanks at the ends, and with dashes as underscores."""
    scores = p9_scores(spark, sf_dir)
    return toxicity.rates(scores.withColumn("source", F.regexp_replace(F.lower(F.trim("source")), "[\\s-]+", "_")), "source")


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a place in some container: all of them."""
    return p8_containers(spark, sf_dir).select("doc_id").distinct()


def p9_texts_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rates are rates of: every text scored, per source."""
    return p9_source_rates(spark, sf_dir).select("source", "n_texts")


QUERIES = {f.__name__: f for f in (p7_ids, p8_containers, p9_found, p9_scores, p9_source_rates, p8_placed, p9_texts_per_source)}
SQL = {
    "p8_placed": "SELECT doc_id FROM documents",
    "p9_texts_per_source": r"SELECT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source, count(*) AS n_texts FROM documents GROUP BY 1",
}
