"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.llm.common import table, written
from learntrail.llm.decontam import contaminated_pairs
from learntrail.llm.minhash import near_duplicates
from learntrail.llm.packing import pack_documents
from learntrail.llm.pii import redact_texts
from learntrail.llm.toxicity import trained_chain, without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def _row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``id``, which is doc_id or, where that is null, a number beyond ordinary ids made from the text, and ``row``, a key of id and text."""
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), made)).withColumn("row", F.xxhash64("id", F.coalesce("text", F.lit(""))))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; the chain is trained on the labelled ones among ``docs``.

    Null and blank texts have no features and stay; each row is judged by its own text, so repeated ids and null ids are no
    special case; an empty table gives an empty one.
    """
    return without_toxic(docs.select(*COLUMNS), trained_chain(docs, table(spark, sf_dir, "labels")))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document of the least id stays, once.

    A null id counts as greater than all others, and rows without ids are compared like any. Rows that repeat an id with other
    texts are documents of their own; of rows equal in id and text the one of least language and source stays. Null and blank
    texts belong to no group.
    """
    docs = _row(docs.select(*COLUMNS))
    found = near_duplicates(docs.select(F.col("id").alias("doc_id"), "text"), keep_key=True)
    stays = found.where("stays").select(F.col("key").alias("row")).distinct()
    once = docs.join(stays.hint("merge"), "row", "left_semi").groupBy("row", "id").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("d"))
    return once.select("d.*").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also a re-parameterised one, go.

    Rows go by id and text together, so a clean row stays whatever another row of its id holds, and rows with a null id are
    judged like any. Null and blank texts, empty tables and an empty benchmark match nothing; repeated rows share their fate.
    """
    docs = _row(docs.select(*COLUMNS))
    leaked = contaminated_pairs(docs.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct()
    return docs.join(leaked, "row", "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes its kind in brackets; all rows stay, null texts and ids and repeats included."""
    return _documents(redact_texts(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as sequences; null and blank texts are packed as their closing id, repeated rows and null ids as they come."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("minhash", minhash), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
