"""The corpus pipeline: language, toxicity, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last
return the columns of documents and nothing else, whatever further columns ``docs`` has. An empty table gives
an empty one at every stage. A null text counts as empty; it is no language's, so the first stage rejects it.
Models learn only from rows whose crc32(doc_id as text) mod 5 is not 0, so the others test them. Rows
without an id are judged like all others but not learned from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm.common import maybe_broadcast, table, written
from strataline.llm.exact_dedup import exact_dedup
from strataline.llm.jaccard_join import jaccard_classes
from strataline.llm.language_id import UNDETERMINED, identify_languages, learn_language_model
from strataline.llm.packing import pack_documents
from strataline.llm.toxicity import learn_toxicity, tag_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document is rejected as of no known language when a smaller share of its n-grams is the winner's.
LEAST_COVERAGE = 0.2


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def _learned_from(df: DataFrame) -> DataFrame:
    return df.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; wordless ones and those whose n-grams fit none go.

    Null, empty and wordless texts go. A tie between languages doesn't matter, as any of them keeps the row.
    Repeated rows are judged alike. Without a row to learn from there is no language, and everything goes.
    """
    model = learn_language_model(_learned_from(docs))
    judged = identify_languages(docs, model)
    return _columns(judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("coverage") >= LEAST_COVERAGE)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted toxic; a score of exactly one half is.

    Null and empty texts hold nothing toxic. Repeated rows are judged alike. With labels of one kind only,
    or none, every document has that share as its score.
    """
    model = learn_toxicity(_learned_from(docs), _learned_from(table(spark, sf_dir, "labels")))
    return _columns(tag_toxicity(docs, model).where("predicted = 0"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the largest doc_id, a null id being smaller than all others.

    Of rows repeated with that id and text one stays. Null and empty texts are equal.
    """
    return _columns(exact_dedup(docs).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest doc_id.

    A document is what has one doc_id: several texts under an id stay or go together. Texts without words
    are linked with nothing and stay, as do rows without an id.
    """
    classes = jaccard_classes(docs)
    dropped = written(classes.where("component_id <> doc_id").select("doc_id"), "pipeline-near-copies")
    return _columns(docs.join(maybe_broadcast(dropped, dropped.count(), 16), "doc_id", "left_anti"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, a row per piece; see pack_documents.

    A null or empty text is the end token alone. Repeated rows are packed as often as they occur.
    """
    return pack_documents(docs)


STAGES = [("language_id", language), ("toxicity", toxicity), ("exact_dedup", exact_copies), ("near_copies", near_copies), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language, toxicity and tokenizing cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
