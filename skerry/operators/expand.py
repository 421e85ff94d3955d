"""Conservative query expansion from a synonym table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_spaces
from .tables import ranked

# Noun synonyms that results must agree with.
SYNONYMS = {
    "aircraft": ["plane", "airplane", "aviation"],
    "automobile": ["car", "vehicle"],
    "vehicles": ["cars", "automobiles"],
    "ship": ["vessel"],
    "ships": ["vessels"],
    "cancer": ["tumor"],
    "rabies": ["hydrophobia"],
    "counterfeiting": ["forgery"],
    "piracy": ["copyright", "infringement"],
    "e-mail": ["email"],
    "email": ["e-mail"],
}


def synonym_rows(overrides: Mapping[str, object] | None = None) -> list[tuple[str, int, str]]:
    """``(term, position, synonym)``; an override replaces a term's list, and
    may be one string. Terms and synonyms are lower-cased, blanks dropped."""
    table = dict(SYNONYMS)
    for term, value in (overrides or {}).items():
        listed = [value] if isinstance(value, str) else list(value)
        table[str(term).strip().lower()] = [str(x).strip().lower() for x in listed if str(x).strip()]
    return [(t, k, s) for t, listed in table.items() if t for k, s in enumerate(listed)]


def synonym_table(spark: SparkSession, overrides: Mapping[str, object] | None = None) -> DataFrame:
    return spark.createDataFrame(synonym_rows(overrides), "term string, pos int, synonym string")


def lexicon_synonyms(
    nouns: DataFrame, lexicon: DataFrame, *, senses: int = 3, lemmas: int = 3
) -> DataFrame:
    """A synonym table ``(term, pos, synonym)`` from a noun lexicon.

    ``nouns`` is ``(term)``, the terms that a tagger found to be nouns;
    ``lexicon`` is ``(term, sense, lemma_no, lemma)``, the noun senses of a
    term by frequency and their lemmas in order. Of the first ``senses`` senses
    a term gets at most ``lemmas`` different one-word lemmas other than itself.
    """
    wanted = nouns.select(F.lower(F.trim("term")).alias("term")).distinct()
    plain = lexicon.select(F.lower("term").alias("term"), "sense", "lemma_no", F.lower(F.trim("lemma")).alias("synonym"))
    near = ranked_senses(plain.join(wanted, "term", "left_semi"), senses)
    usable = near.where((F.col("synonym") != F.col("term")) & (F.col("synonym") != "") & ~F.col("synonym").rlike(r"[\s_]"))
    first = ranked(usable, ["term", "synonym"], [F.col("sense"), F.col("lemma_no")], "n", 1)
    placed = ranked(first, ["term"], [F.col("sense"), F.col("lemma_no")], "n", lemmas)
    return placed.select("term", (F.col("n") - 1).alias("pos"), "synonym")


def ranked_senses(rows: DataFrame, senses: int) -> DataFrame:
    """Rows of each term's first ``senses`` senses."""
    order = Window.partitionBy("term").orderBy("sense")
    return rows.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= senses).drop("n")


def expand_terms(
    topics: DataFrame, synonyms: DataFrame | None, *, enabled: bool = True, max_terms: int = 5
) -> DataFrame:
    """``(topic_id, terms)``: the words of each topic's text, expanded.

    Disabled: the words as they are. Enabled: lower-cased, without repeats,
    then at most ``max_terms`` synonyms in the order of their terms, never one
    that is there already.
    """
    words = F.filter(F.split(normalize_spaces(F.col("text")), " "), lambda w: w != "")
    base = topics.select("topic_id", words.alias("words"))
    if not enabled:
        return base.select("topic_id", F.col("words").alias("terms"))
    base = base.select("topic_id", F.array_distinct(F.transform("words", F.lower)).alias("words"))
    asked = base.select("topic_id", "words", F.posexplode("words").alias("at", "term"))
    found = asked.join(synonyms, "term").where(~F.array_contains(F.col("words"), F.col("synonym")))
    order = Window.partitionBy("topic_id", "synonym").orderBy("at", "pos")
    first = found.withColumn("n", F.row_number().over(order)).where("n = 1")
    added = ranked(first, ["topic_id"], [F.col("at"), F.col("pos")], top=max_terms)
    lists = added.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", "synonym"))).alias("more"))
    return base.join(lists, "topic_id", "left").select(
        "topic_id",
        F.concat(
            "words", F.coalesce(F.transform("more", lambda x: x["synonym"]), F.array().cast("array<string>"))
        ).alias("terms"),
    )


def expand_text(topics: DataFrame, synonyms: DataFrame | None, **options) -> DataFrame:
    """``(topic_id, text)`` with the expanded words joined by single blanks."""
    return expand_terms(topics, synonyms, **options).select("topic_id", F.array_join("terms", " ").alias("text"))
