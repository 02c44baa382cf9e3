"""Sources and sinks: text lines, triplets, JSON lines, generated vectors, and an index as a folder of tables."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVAL_SCHEMA = "query string, docs array<string>, reference string, gt_docs array<string>, new_docs array<string>"
_SPACE = r"(?U)^\s+|\s+$"


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df below spark.checkpoint.dir (a temporary folder in local mode, if unset) and read it back."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """The session's configuration with these values, for what is written meanwhile."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def text_lines(spark: SparkSession, path: str, strict: bool = False, max_docs: int | None = None) -> DataFrame:
    """doc_id, text: stripped lines without the blank ones, numbered in the order of files and lines. A missing path is
    an error if strict, else a warning and no rows. max_docs counts after blank lines are gone; 0 means all."""
    schema = "doc_id long, text string"
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        warnings.warn(f"no such file: {path}", stacklevel=2)
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).select(F.regexp_replace("value", _SPACE, "").alias("text"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_o"), F.monotonically_increasing_id().alias("_n")).where("text <> ''")
    # A part is a file's lines from one offset on, as one task reads them; parts are numbered on by file and offset, so
    # there is one count for each part and no sort of lines in a single task.
    counts = lines.groupBy("_f", "_o").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_f", "_o").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_f", "_o", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_s"))
    own = F.row_number().over(Window.partitionBy("_f", "_o").orderBy("_n"))
    out = lines.withColumn("_k", own).join(starts, ["_f", "_o"]).select((F.col("_s") + F.col("_k") - 1).cast("long").alias("doc_id"), "text")
    return out.where(F.col("doc_id") < max_docs) if max_docs else out


def in_memory(spark: SparkSession, texts: list[str]) -> DataFrame:
    """doc_id, text: the texts of a list, numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """query, pos, neg: lines that have exactly three tab-separated fields after stripping; a missing path gives a
    warning and no rows."""
    if not exists(spark, path):
        warnings.warn(f"no such file: {path}", stacklevel=2)
        return spark.createDataFrame([], "query string, pos string, neg string")
    parts = spark.read.text(path).select(F.split(F.regexp_replace("value", _SPACE, ""), "\t").alias("p")).where(F.size("p") == 3)
    return parts.select(F.col("p")[0].alias("query"), F.col("p")[1].alias("pos"), F.col("p")[2].alias("neg"))


def eval_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of evaluation records; a bad line is an error, a missing query is ''."""
    return spark.read.schema(EVAL_SCHEMA).option("mode", "FAILFAST").json(path).withColumn("query", F.coalesce("query", F.lit("")))


def corpus(spark: SparkSession, spec: str) -> DataFrame:
    """'file:path', or a path, to text lines."""
    return text_lines(spark, spec.removeprefix("file:") if spec.startswith("file:") and not spec.startswith("file:/") else spec, strict=True)


#: Names of text columns, the first that is there being taken.
TEXT_COLUMNS = ("text", "content", "document", "passage")


def text_column(columns: list[str]) -> str:
    return next((c for c in TEXT_COLUMNS if c in columns), columns[0])


def synthetic(spark: SparkSession, split: str = "train", num_samples: int = 100, embedding_dim: int = 384, num_classes: int = 10) -> DataFrame:
    """id, embedding (standard normal), label (uniform): the same rows for the same split."""
    seed = {"train": 42, "val": 43, "test": 44}[split]
    return spark.range(num_samples).select("id", F.array(*[F.randn(seed * 1000 + i) for i in range(embedding_dim)]).alias("embedding"), F.floor(F.rand(seed) * num_classes).cast("int").alias("label"))


def save_index(path: str, corpus: DataFrame, embeddings: DataFrame, edges: DataFrame) -> str:
    for name, table in (("corpus", corpus), ("embeddings", embeddings), ("edges", edges)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("corpus", "embeddings", "edges")}


def index_report(embeddings: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: rows, dimension, corpus size."""
    size = embeddings.agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("embedding")).alias("dim"))
    return size.join(corpus.agg(F.count(F.lit(1)).alias("n_documents")))


def vectors_digest(embeddings: DataFrame) -> str:
    """SHA-256 of the vectors' bytes, as big-endian doubles in the order of vec_id: of each part of the order the rows'
    hashes are hashed in its task, and then the parts' hashes, so no vector comes to the driver."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).sort("vec_id")

    def run(batches):
        part, n = hashlib.sha256(), 0
        for batch in batches:
            n += batch.num_rows
            part.update(batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(">f8").tobytes())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([part.hexdigest()])], names=["part", "h"])

    parts = sorted((r["part"], r["h"]) for r in rows.mapInArrow(run, "part int, h string").collect())  # a row for each part
    return hashlib.sha256("".join(h for _, h in parts).encode()).hexdigest() if len(parts) != 1 else parts[0][1]


def save_report(embeddings: DataFrame, corpus: DataFrame, name: str, folder: str) -> str:
    """One JSON line in {name}_{sha12}_{utc}: name, sha12 (of the vectors), timestamp, shape, size of the corpus."""
    row = index_report(embeddings, corpus).first()
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    sha = vectors_digest(embeddings)[:12]
    report = {"name": name, "sha12": sha, "timestamp": stamp, "embeddings_shape": [row["n_vectors"], row["dim"] or 0], "corpus_size": row["n_documents"]}
    path = f"{folder}/{name}_{sha}_{stamp}.json"
    embeddings.sparkSession.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def save_vectors(embeddings: DataFrame, path: str) -> tuple[int, int]:
    """(rows, dimension) of what is written."""
    embeddings.write.mode("overwrite").parquet(path)
    row = embeddings.sparkSession.read.parquet(path).agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return row[0], row[1] or 0


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_json(rows: DataFrame, path: str) -> str:
    """As a folder of JSON lines."""
    rows.write.mode("overwrite").json(path)
    return path


def save_csv(rows: DataFrame, path: str) -> str:
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path
