"""What the operators share: staging in the shared folder, column hygiene, defined word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: White space that separates words, and its complement, as Java and DuckDB regular expressions.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]"
#: Stands for a null identifier inside operators.
LARGEST = (1 << 63) - 1
RANGE_BYTES = 256 << 20
MOST_RANGES = 50_000


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests) gets a temporary folder; a cluster is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="staged-"))
    return _own_folder[0]


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: later jobs read committed files, so a lost executor costs only the
    tasks it ran.  The committed table also fixes what a re-run task would see.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that no later job reads."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = file[: file.rindex("/")]
            if "/staged/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other column can clash with its own.

    A null identifier counts as the largest number (LARGEST) inside operators; ``null_ids`` turns it back.
    So LARGEST itself is reserved: a row that carries it is a row without an identifier.
    """
    ship(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col(id_col).cast(T.LongType()), F.lit(LARGEST)).alias("doc_id"),
        F.col(text_col).cast(T.StringType()).alias("text"),
    )


def null_ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(LARGEST)) for c in columns or ("doc_id",)})


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of the identifier as text falls in a part; a row without an identifier is not held out."""
    name = F.nullif(F.col(doc_id), F.lit(LARGEST)).cast("string")
    return F.coalesce(F.pmod(F.crc32(name), F.lit(parts)) == part, F.lit(False))


def range_count(df: DataFrame) -> int:
    """Ranges for a sort of ``df``: the session's shuffle partitions, or more if the input is large.

    The optimizer's size estimate gives RANGE_BYTES of input to a range; MOST_RANGES bounds the
    splitters on the driver (ranges beyond it grow, and their sorts spill).
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(MOST_RANGES, size // RANGE_BYTES))


def skew_join(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of rows with one row per key that was aggregated from them.

    Joined on the keys alone, the aggregate's own shuffle would serve the join, and adaptive execution
    splits a hot key only between two plain shuffles.  A derived key gives the join its own.
    """
    hashed = F.xxhash64(*keys).alias("_key")
    return rows.select("*", hashed).join(groups.select("*", hashed), ["_key", *keys]).drop("_key")


def let(value, body):
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable holds the value, so the optimizer cannot copy its expression to each use.
    """
    return F.transform(F.array(value), body)[0]


def keep_rows(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose identifier has a kept row in ``judged`` (doc_id, kept).

    A null identifier meets a null identifier.  All columns of ``docs`` are returned as they are.
    """
    kept = judged.filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast(T.LongType()).eqNullSafe(kept["_kept_id"]), "left_semi")
