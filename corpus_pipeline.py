"""From raw documents to piece ids: toxicity, near duplicates, benchmark passages, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows of the one before. All but the last return the
columns of documents. SQL cannot express the learned stages, so ORACLE_SQL is None and tests compare each
stage with a plain version of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthframe.llm import decontaminate, minmax, pieces, pii, toxicity
from hearthframe.llm.base import table
from hearthframe.llm.queries import TOKENIZERS
from hearthframe.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models do not call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8."""
    others = minmax.near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage similar to a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, checked by decoding them."""
    return pieces.encode_pieces(docs, pieces.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("pii", redact_pii), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
