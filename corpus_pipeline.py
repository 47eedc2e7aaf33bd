"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Quality rules drop documents; near-duplicates keep the smallest id of each group (five-word shingles, similarity
0.8); documents that hold a benchmark window are dropped; personal data is blanked out in the text; what is left is
encoded to piece ids, which decode to the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelake.llm import decontam, neardup, pieces, pii, quality
from pipelake.llm.common import table, written
from pipelake.llm.queries import TOKENIZER_DIR


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, size=5, percent=80).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = pieces.PieceModel.read(f"{TOKENIZER_DIR}/piece_bpe_32k.model")
    decoded = pieces.encode(docs, model, decoded=True)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), "ids", "text")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: Trained span scores and best-path segmentation have no SQL form; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
