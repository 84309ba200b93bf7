"""Sinks (ops 3-7): Parquet model-ready table, resumable JSON-lines append,
denormalised JSON exports and CSV sheets.  Paths must be shared storage on a
cluster (see ``models.shared_path``)."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# op 3
def sink_model_ready(df: DataFrame, path: str, partition_by: str | None = "month") -> DataFrame:
    """Write the features+label table as Parquet (partitioned so time splits prune) and
    read it back; the returned DataFrame has a one-scan lineage."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.select(*df.columns)


# op 4
#: Folders of a resumable log: its batches, and the entries that make them visible.
BATCHES, ENTRIES = "batches", "_commits"


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the log's committed batches, oldest first: one listing, an entry per append."""
    fs, p = _folder(spark, f"{path}/{ENTRIES}")
    if not fs.exists(p):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(p))
    return [n.split(".", 1)[1] for n in names if re.fullmatch(r"\d{10}\.[0-9a-f]{32}", n)]


def _commit(spark: SparkSession, path: str, batch: str, number: int) -> None:
    """Make ``batch`` visible as the log's ``number``-th append, if no other writer took the number."""
    claim = f"{path}/{ENTRIES}/{number:010d}"
    fs, p = _folder(spark, f"{claim}.claim")
    try:
        fs.create(p, False).close()  # fails if the file exists
    except Py4JJavaError as e:
        raise ConcurrentAppend(f"append {number} of {path} was made or begun by another writer") from e
    entry, name = _folder(spark, f"{claim}.{batch}")
    entry.create(name, False).close()


class ConcurrentAppend(RuntimeError):
    """Another writer's append came first; nothing of this one is visible. Run it again."""


def sink_jsonl_resume(records: DataFrame, path: str, id_col: str = "row_index") -> DataFrame:
    """Append the records whose id is not yet in the log at ``path``; returns what was appended.

    A batch is written to a folder of its own: the records as JSON lines, then their ids as
    Parquet, read back from what was written.  Its entry in the log makes both visible at
    once, so a run that ends anywhere before leaves nothing that a reader or a later run
    sees, and a resumed run reads ids alone.  Appends are numbered: of two writers that
    began from the same state one commits, the other gets ``ConcurrentAppend`` (on stores where
    creating a file is atomic).  A writer that dies between its claim and its entry leaves a
    number taken: ``release_claim`` frees it.  Records without an id are appended by each run.
    """
    spark = records.sparkSession
    done = committed(spark, path)
    todo = records
    if done:
        ids = spark.read.schema(records.select(id_col).schema).parquet(*[f"{path}/{BATCHES}/{b}/ids" for b in done])
        todo = records.join(ids, id_col, "left_anti").select(*records.columns)
    batch = uuid.uuid4().hex
    folder = f"{path}/{BATCHES}/{batch}"
    todo.write.json(f"{folder}/records")
    written = spark.read.schema(records.schema).json(f"{folder}/records")
    written.select(id_col).write.parquet(f"{folder}/ids")
    _commit(spark, path, batch, len(done))
    return written


def release_claim(spark: SparkSession, path: str) -> bool:
    """Free the number of an append that was claimed and never committed; True if there was one.

    For the operator of a log whose writer died: never while a writer runs."""
    number = len(committed(spark, path))
    fs, p = _folder(spark, f"{path}/{ENTRIES}/{number:010d}.claim")
    return fs.exists(p) and fs.delete(p, False)


def read_jsonl(spark, path: str, schema) -> DataFrame:
    """The committed records of a resumable log (none, if nothing was committed)."""
    done = committed(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/{BATCHES}/{b}/records" for b in done])


def logged_ids(spark, path: str, schema) -> DataFrame:
    """The committed ids of a resumable log, from its id tables alone; ``schema`` has the id column."""
    done = committed(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{BATCHES}/{b}/ids" for b in done])


# op 5 / 6
def sink_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON export; ``single_file`` only for small, bounded documents (coalesce(1))."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").json(path)


def to_json_document(df: DataFrame, name: str = "document") -> DataFrame:
    """Fold a small result table into one JSON string column (array of row objects)."""
    return df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))


# op 7
def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
