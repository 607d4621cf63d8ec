"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.text import normalised_terms, term_set
from platewise.llm import formatting_copies, leaked_tests, similar_sets, subject_areas, term_counts, together, token_ids
from platewise.llm.sql import SQL  # noqa: F401
from platewise.operators.packed_values import split_values
from platewise.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of recipes whose ingredients, or whose keywords, are nearly the same set."""
    models = table(spark, folder, "recipe_models").select("id", "ingredients", "keywords")
    records = similar_sets.set_records(models, "id", {f: F.col(f) for f in ("ingredients", "keywords")})
    return similar_sets.similar_pairs(records)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of recipes by name, and of staged pages by address, that differ only in formatting."""
    names = table(spark, folder, "recipes").select(F.lit("recipes").alias("tbl"), "id", formatting_copies.title_pieces(F.col("name")).alias("pieces"))
    pages = table(spark, folder, "recipe_urls").select(F.lit("recipe_urls").alias("tbl"), "id", formatting_copies.address_pieces(F.col("url")).alias("pieces"))
    return formatting_copies.formatting_copies(names.unionByName(pages)).filter("copies > 1")


def _pairs(spark: SparkSession, folder: str, least: int = 1, share: int | None = None) -> DataFrame:
    models = table(spark, folder, "recipe_models")
    records = [models.select(F.lit(f).alias("field"), term_set(F.col(f)).alias("terms")) for f in ("ingredients", "keywords")]
    return together.pair_counts(reduce(DataFrame.unionByName, records), least, share)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Ingredients, and keywords, found together far more often than chance."""
    return _pairs(spark, folder, least=10, share=1000).filter(together.above_chance(4)).select("field", "term_a", "term_b")


def _with_odds(pairs: DataFrame) -> DataFrame:
    return pairs.select("field", "term_a", "term_b", "k", F.round(F.col("odds") * 1000).cast("long").alias("odds_milli"))


def p5_odds(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair found together in ten and a thousandth of the records, with its odds ratio in thousandths."""
    return _with_odds(_pairs(spark, folder, least=10, share=1000))


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair found together in any record, with its odds ratio in thousandths."""
    return _with_odds(_pairs(spark, folder))


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    keywords = table(spark, folder, "recipe_models").select(F.lit("keywords").alias("field"), F.col("keywords").alias("terms"))
    recipes = table(spark, folder, "recipes")
    cuisines = recipes.select(F.lit("cuisine").alias("field"), F.array("cuisine").alias("terms"))
    categories = recipes.select(F.lit("category").alias("field"), split_values(F.col("category")).alias("terms"))
    records = reduce(DataFrame.unionByName, (keywords, cuisines, categories))
    return term_counts.term_counts(records.select("field", normalised_terms(F.col("terms")).alias("terms")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords, cuisines and categories that are too rare or too common to be useful."""
    return term_counts.marked(_counts(spark, folder))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of every keyword, cuisine and category, and the recipes that have it."""
    return _counts(spark, folder).select("field", "term", "occurrences", "records")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    documents = table(spark, folder, "documents")
    vocabulary = f"{token_ids.VOCABULARIES}/byte_bpe_50k.tiktoken"
    return documents.select("doc_id", token_ids.token_ids(F.col("text"), vocabulary).alias("ids"))


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text that the token ids of every document spell; the empty text for null."""
    vocabulary = f"{token_ids.VOCABULARIES}/byte_bpe_50k.tiktoken"
    return p8_ids(spark, folder).select("doc_id", F.decode(token_ids.decoded_text(F.col("ids"), vocabulary), "UTF-8").alias("text"))


def _leaked(spark: SparkSession, folder: str) -> DataFrame:
    corpus = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    tests = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "text")
    return leaked_tests.leaked_passages(corpus, tests, window=12)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and evaluation items that share a run of 12 words."""
    return _leaked(spark, folder).filter("run >= 12").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p9_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold half of an evaluation item or more, by their alignment's share of a whole copy's score, edited or not."""
    share = leaked_tests.score_share(F.col("score"), F.col("length"))
    return _leaked(spark, folder).filter(share >= 0.5).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "score", "run", F.floor(share * 1000).alias("share_milli"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Main subjects of every document without a label."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = table(spark, folder, "doc_labels").select(F.col("doc_id").alias("id"), "subject")
    # The list of subjects is fixed: a row for each that the corpus is measured by.
    subjects = sorted(r["subject"] for r in table(spark, folder, "subject_areas").select("subject").distinct().collect())
    return subject_areas.main_subjects(documents, labels, subjects).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p5_found, p5_odds, p5_pairs, p6_found, p6_counts, p8_ids, p8_texts, p9_found, p9_scored, p10_found)}
