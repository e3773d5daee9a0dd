"""The corpus pipeline: STAGES applied in order to `documents`, each one's rows written as Parquet and reread as the next one's input.

1. toxicity: documents that the ordinal model rejects go.
2. line dedup: repeated lines go from the texts; every document stays.
3. MinHash near-dedup: of each group of near copies the document of smallest id stays (five-word shingles, similarity 0.8).
4. PII: personal data in the texts is replaced by its kind.
5. packing: the documents' tokens in sequences of 2048; one row per piece.

Every stage but the last returns the columns of `documents`, with n_chars brought up to date where the text has changed. Rows whose
text is null stay; a null id is kept. Every stage works on all rows of its predecessor. An empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelflow.llm.line_dedup import without_repeated_lines
from voxelflow.llm.minhash import near_duplicates
from voxelflow.llm.packing import pack
from voxelflow.llm.pii import redact
from voxelflow.llm.toxicity import train, without_toxic
from voxelflow.session import checkpoint_folder, reach

#: No stage but the first two is plain SQL.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't reject. It is fitted to labelled documents of the corpus as it came, a bounded sample."""
    reach(spark)
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_toxic(docs, train(corpus, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, or nearly so, in an earlier one or above."""
    reach(spark)
    return _counted(without_repeated_lines(docs, shorter=True).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without words are no copies of each other and stay.

    Documents that share an id stay or go together.
    """
    reach(spark)
    kept = near_duplicates(docs, percent=80).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    reach(spark)
    return _counted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    reach(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]


def _drop(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage makes is written to the shared folder and reread, and goes when the next one's is there.

    The last one's folder stays, as the result reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{top}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            _drop(spark, f"{top}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
