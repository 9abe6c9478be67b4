"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that separate words: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Rows of whole texts that cross to a Python worker at once. Spark's default of 10,000 is meant for numbers.
TEXT_ROWS = 500


def text_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in small batches, unless the session asks for even smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. A session that names none may use a local one only if it runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wakeline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/wakeline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int = 0, per_part: int = 1) -> int:
    """Enough partitions that each holds about per_part rows, and never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_part))


def held_out(id_col: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit_mb: int = 32) -> DataFrame:
    """Hint a broadcast only when the counted rows are known to fit; else Spark shuffles both sides."""
    return F.broadcast(df) if rows * row_bytes <= limit_mb * 1_000_000 else df


def join_sized(many: DataFrame, one: DataFrame, key: list[str], size: str, n: int, salts: int = 64) -> DataFrame:
    """many joined with one (a row a key, written), where `size` says how many of many's n rows have the key.

    Keys of more than a thousandth of all rows (so fewer than 1000 of them) are dealt to `salts` tasks, each with its copy of one's row.
    """
    hot = one.filter(F.col(size) > max(5000, n // 1000)).select(*[F.col(c).alias(f"_hot_{c}") for c in key])
    is_hot = F.col(f"_hot_{key[0]}").isNotNull()

    def marked(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for c in key:
            same = same & (F.col(c) == F.col(f"_hot_{c}"))
        return df.join(F.broadcast(hot), same, "left")

    spread = [c for c in many.columns if c not in key] or key
    dealt = marked(many).withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int")).drop(*hot.columns)
    copies = marked(one).withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(*hot.columns)
    return dealt.join(copies, [*key, "_salt"]).drop("_salt")
