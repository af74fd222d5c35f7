"""Training-data pipeline over the ``documents`` table.

Five stages, each calling one operator of ``corpuslab.llm``; a stage's result is
written as Parquet and read again as the next one's input:

1. language ID: documents that the calibrated rule rejects go;
2. line dedup: lines that many documents share stay in one of them only;
3. n-gram Jaccard join: one row of each group of near copies stays, the one
   with the smallest doc_id (none is the largest), then the smallest text hash;
4. mixing: documents are taken as often as the target weights of their sources
   ask for;
5. byte-level BPE: ids of every whole text, checked by decoding them.

All stages but the last return the columns of ``documents`` (``n_chars`` follows
an edited text).  Null text counts as empty: it has no language and goes in the
first stage.  Every row is a document: rows that share a doc_id, or have none,
are copies only if their texts are.  An empty table gives an empty result.  A
text that loses all its lines stays as an empty document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import bpe, langid, linededup, mixing, partenum
from corpuslab.llm.q_bpe import vocabulary_path
from corpuslab.session import ensure_checkpoint_dir, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = langid.train(docs)
    scored = langid.predict(docs, model, lang_out="_lid_lang", score_out="_lid_score", rejected_out="_lid_rejected")
    return scored.where(~F.col("_lid_rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    done = linededup.dedup_lines(docs, kept_col="_ld_kept", n_lines_col="_ld_lines", n_dropped_col="_ld_dropped")
    made = {"text": F.col("_ld_kept"), "n_chars": F.char_length("_ld_kept").cast("long")}
    return done.select(*[made[c].alias(c) if c in made else F.col(c) for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return partenum.one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path(), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join),
          ("mixing sources", mix_sources), ("byte-level BPE", byte_bpe)]

# Language ID, near copies and BPE ids are not SQL: tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages go to the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
