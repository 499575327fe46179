"""The corpus pipeline: documents through five stages, each stage's result written and read again by the next.

Quality filter, line dedup, near-dedup, PII surrogates, packing. All but the last return the columns of ``documents``.
Near-dedup takes the groups of the SimHash operator, whose 3 bits find almost equal texts only, and completes them by an
exact similarity join (``near_copies``): at a similarity of 0.8 some 10 bits differ.
No stage can be put in SQL as a whole (a fitted model, connected components, keyed hashes, a tokenizer), so the tests
hold the stages against brute-force versions and ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import line_dedup, near_copies, packing, pii, quality, simhash
from folio.llm.common import spool, table

ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where it is a column, after a change of text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on the labelled ones among them, scores at 0.3 or more."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; later repeats of passages are cut out of their texts."""
    return _measured(line_dedup.remove_repeats(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: fingerprints of five-word shingles within 3 bits, or shingle sets with a Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one(docs, also=lambda rows: simhash.near_duplicates(rows, size=near_copies.SIZE))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; personal data and secrets in their texts are replaced by surrogates."""
    return _measured(pii.replace_entities(docs, pii.session_key(spark)))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_filter", quality_filter),
    ("dedup_lines", dedup_lines),
    ("dedup_documents", dedup_documents),
    ("replace_pii", replace_pii),
    ("pack_documents", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
