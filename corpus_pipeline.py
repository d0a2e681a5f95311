"""The corpus pipeline: five stages over ``documents``, each working on all that the one before it kept.

Rejected languages go, one document of each near-duplicate group stays, documents that hold benchmark
passages go, personal data is replaced by pseudonyms, and what is left is packed into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import language_mix, near_dup, pack_dp, pii
from chunkloom.llm.decontaminate import drop_contaminated
from chunkloom.plans.lineage import cut


#: Session setting that holds the secret key of the pseudonyms; without it the query's public one serves.
KEY_SETTING = "spark.chunkloom.pii.key"


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: keeps the documents whose language mixture is one of known languages.

    The model is fitted on the stage's own input. Null and empty texts and those without a letter have no
    language and go; texts of any length are read whole; repeated rows fare alike; null doc_ids are no
    obstacle; an empty table, or one without any labelled language, comes back as it is. Columns of any
    name pass through.
    """
    return language_mix.keep_identified(docs, language_mix.fit(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: keeps the document of the smallest id of each near-duplicate group.

    Null, empty and wordless texts are nobody's copy and stay; so do rows with a null doc_id, which can't be
    told apart. Of rows that repeat a doc_id one stays, the one whose text was compared. Texts of any length
    are compared whole; an empty table stays empty; columns of any name pass through.
    """
    return near_dup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: drops the rows in which a passage of a benchmark item is found.

    Each row is judged by its own text, whatever other rows share its doc_id, and also where that is null.
    Null and empty texts stay; texts of any length are scanned whole; an empty table or benchmark drops
    nothing; columns of any name pass through.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: replaces validated personal data in the texts, by the key of ``KEY_SETTING``.

    Rows, their number and all other columns stay as they are; null and empty texts too. Equal values get
    equal pseudonyms in all rows. Texts and values of any length are taken whole.
    """
    return pii.pseudonymise(docs, spark.conf.get(KEY_SETTING, pii.KEY.decode()).encode())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: windows of the kept documents, as spans of doc_ids and characters.

    Null and empty texts take no place. Rows with a null doc_id are packed like the others, before all ids,
    their spans naming the null. Rows that repeat a doc_id each take their place, in the order of their texts'
    hashes. Texts of any length are cut at sentences. An empty table gives no window; other columns end here.
    """
    return pack_dp.packed(docs)


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("pii", pseudonymise), ("packing", pack)]

#: Expectation-maximisation and the packing programme are beyond SQL: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut(docs), sf_dir)
    return docs
