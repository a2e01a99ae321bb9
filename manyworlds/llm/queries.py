"""Queries of the operators for training data and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyworlds.llm import leak, mix, names, spam, tokens
from manyworlds.plans.runtime import checkpoint
from manyworlds.sources import table


def _persons(spark: SparkSession, root: str) -> DataFrame:
    return names.linked(names.spellings((table(spark, root, "playerinfo"), "player"), (table(spark, root, "performance"), "player")))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Each two different spellings of one player."""
    return names.variant_pairs(checkpoint(_persons(spark, root)))


def p1_players(spark: SparkSession, root: str) -> DataFrame:
    """One row per spelling: the key of its player and how many spellings that player has."""
    persons = checkpoint(_persons(spark, root))
    return persons.join(persons.groupBy("person").agg(F.count(F.lit(1)).alias("spellings")), "person").select("spelling", "person", "spellings")


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leak.leaked_items(table(spark, root, "documents"), table(spark, root, "eval_item"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Mails that carry at least 12 consecutive words of an item."""
    return _leaks(spark, root).filter("longest_run >= 12").select("doc_id", "item_id")


def p7_leak_report(spark: SparkSession, root: str) -> DataFrame:
    """Per item: how many mails carry a passage of it word for word, the longest one, how many carry only an altered one."""
    exact = F.col("longest_run") > 0
    return _leaks(spark, root).groupBy("item_id").agg(F.count_if(exact).alias("mails"), F.max("longest_run").alias("longest_run"), F.count_if(~exact).alias("altered_mails"), F.max(F.when(~exact, F.col("similarity"))).alias("altered_similarity"))


def _mixture(spark: SparkSession, root: str) -> DataFrame:
    sized = checkpoint(tokens.sized(table(spark, root, "documents"), "doc_id", "text", ["source"]))
    return mix.mixture(sized, table(spark, root, "mix_target"))


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The chosen mails in mixing order, one row per use."""
    return mix.ordered(_mixture(spark, root))


def p8_repeats(spark: SparkSession, root: str) -> DataFrame:
    """The chosen mails, how often each is used."""
    return mix.repeats(_mixture(spark, root))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """The share each source reaches."""
    return mix.shares(_mixture(spark, root), table(spark, root, "mix_target"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Mails that are stuffing or link lists instead of sentences."""
    return spam.stuffed_pages(table(spark, root, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_players, p7_found, p7_leak_report, p8_mixture, p8_repeats, p8_shares, p9_found)}
SQL: dict[str, str] = {}
