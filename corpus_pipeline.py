"""A corpus pipeline of five operators: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``docs``.  Every stage works on all rows that it is given; rows
with a null id pass the stages that compare documents, an empty table passes all.
Ids are expected to be unique until the mixing stage repeats documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import minhash, mixing, quality, sentencepiece_codec, suffix_dedup
from txrisk.llm.common import Scratch, scratch_scope, table


#: Columns of documents that stages read.
READ = ("doc_id", "text", "source", "n_chars")


def sealed(docs: DataFrame) -> DataFrame:
    """``docs`` with numbers for the names of the columns that no stage reads, so that none can clash."""
    return docs.toDF(*[c if c in READ else f"_col_{i}" for i, c in enumerate(docs.columns)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (null and empty texts are rejected)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(sealed(docs), model, score="score")
    return scored.filter(F.col("score") >= quality.ACCEPT).drop("score").toDF(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group (five-word shingles, similarity 0.8 or more)."""
    found = minhash.near_duplicates(docs, rule=minhash.Similar(width=5, num=80))
    gone = found.filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that start earlier; n_chars follows.

    A document that loses all of its text is dropped, since each byte of it stands
    in an earlier one.
    """
    own = sealed(docs)
    cut = suffix_dedup.cut_repeats(own)
    cut = cut.filter((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")),
           "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return cut.select(*[new.get(c, F.col(c)).alias(c) for c in own.columns]).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, in whole copies that come to each source's words.

    Rows of one id are taken alike.  Documents that the mix does not take, and
    those without words, go.
    """
    share = (mixing.mix_whole(docs).groupBy(F.col("doc_id").alias("_id"))
             .agg(F.floor(F.try_divide(F.sum("taken"), F.sum("size")) + 0.5).cast("int").alias("_copies"), F.sum("size").alias("_size"))
             .filter("_size > 0 AND _copies > 0"))
    own = sealed(docs)
    return (own.join(share.select("_id", "_copies"), own["doc_id"].eqNullSafe(F.col("_id")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*own.columns)
            .toDF(*docs.columns))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every row."""
    return sentencepiece_codec.encode_decode(docs, sentencepiece_codec.default_model(), outputs=("ids",))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing to target weights", mix_sources),
    ("SentencePiece encoding", tokenise),
]

#: A trained classifier, graph search and a tokenizer: not for SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        with scratch_scope(spark):  # a stage's own tables go once its result is written
            docs = scratch.keep(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
