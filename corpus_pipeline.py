"""A corpus pipeline: each stage reads what the one before kept, and its decisions take effect.

toxicity drops the documents that the factorization machine rejects; jaccard keeps the
smallest doc_id of each component of near copies (documents without shingles, which link
with nothing, all stay);
pii puts pseudonyms into the texts; mixing writes the documents in the order of the
schedule; packing cuts them and packs ranges of that order, so that sequences follow the schedule. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillgraph.llm.common import partitions, table, written
from rillgraph.llm.mixing import mix
from rillgraph.llm.ngram_join import one_of_each
from rillgraph.llm.packing import pack_in_order
from rillgraph.llm.pii import pseudonymise
from rillgraph.llm.toxicity import score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels, does not reject. Null and empty texts have a score as any other."""
    scored = score(docs, table(spark, sf_dir, "labels"), keep=["text", *[c for c in COLUMNS if c not in ("doc_id", "text")]])
    return scored.where("predicted = 0").select(*COLUMNS)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies; without words all stay (see one_of_each)."""
    return one_of_each(docs.select(*COLUMNS))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in their texts and n_chars of the new text; null texts stay null."""
    return pseudonymise(docs.select(*COLUMNS), counts=False).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, range-partitioned and sorted by their place in the schedule; a null source is a source."""
    mixed = mix(docs.select(*COLUMNS))
    return mixed.repartitionByRange(partitions(spark), "slot", "place").sortWithinPartitions("slot", "place").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences that follow the rows' order; null texts are one end id."""
    return pack_in_order(docs)


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("pii", pii), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # training and tokenizing are not SQL; tests hold each stage against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of the documents that the stages keep. Each stage's rows are written, and deleted once the next stand."""
    docs, drop = table(spark, sf_dir, "documents"), lambda: None
    for _, stage in STAGES[:-1]:
        before = drop
        docs, drop = written(stage(spark, docs, sf_dir))
        before()
    return STAGES[-1][1](spark, docs, sf_dir)
