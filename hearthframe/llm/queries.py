"""Registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, edits, hamming, infill, language, licenses, minmax, pieces, pii, suffixes, toxicity, weighting, whitening
from .base import table

#: Folder of the public vocabulary files, read on the driver only.
TOKENIZERS = "/opt/tokenizers"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of repeated 100-byte passages from every whole text of documents."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text of documents, and whether they decode to it."""
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), pieces.load_pieces(f"{TOKENIZERS}/piece_bpe_32k.model"))


@query
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole text of documents."""
    return weighting.score_texts(table(spark, sf_dir, "documents"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of documents before and after two edits."""
    docs = edits.own_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return edits.count_through_edits(docs, edits.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of documents."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents."""
    return language.identify_language(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text of documents, learned from labels."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of embeddings nearest in Hamming distance to each whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming.nearest(rows, rows.where("vec_id % 20 = 0"))


ORACLES["op8_hamming_topk"] = """
WITH codes AS (SELECT vec_id, [coalesce(x > 0, false) for x in embedding] AS bits FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum([CAST(q.bits[i] <> c.bits[i] AS INT) for i in range(1, len(q.bits) + 1)]) AS INT) AS distance
          FROM codes q JOIN codes c ON len(q.bits) = len(c.bits) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank, vec_id, distance
FROM pairs QUALIFY rank <= 10"""


@query
def op9_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents over two-word shingles."""
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a window similar to a benchmark item."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of embeddings on the first 32 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents rearranged for fill-in-middle training, as digests."""
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


ORACLES["op12_fill_in_middle"] = infill.SQL


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every whole text of documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))
