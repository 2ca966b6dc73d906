"""A training corpus from `documents` in five stages, each written before the next reads it.

Language identification drops what has no language, near-duplicate detection keeps one document of each group, decontamination drops documents
with benchmark passages, mixing puts the rest in the order of the target mixture, and sharding deals that order to shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, langid, mixing, sharding, simhash
from tideline.llm.shared import cut, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the others, null or without a letter, are rejected."""
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model).where("lang_pred <> 'und'").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id: shingles of five words, similarity of 0.8 or more."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item. Null and empty texts stay; rows are judged one by one, whatever their ids."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mixture: a column of a name that no other has holds their places in it, marked for the next stage. Rows without an id or with equal ones have places too."""
    return mixing.mixed(docs, place=mixing.free_name(docs.drop(mixing.place_of(docs) or "")))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 24 and their slot in it: the mixture dealt in turn, or a stratified split where there is no mixture. Columns named shard and slot are replaced."""
    place = mixing.place_of(docs)
    return sharding.dealt(docs, place) if place else sharding.sharded(docs)


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: The first stage's model can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs, name)
    return docs
