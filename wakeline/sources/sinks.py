"""Where results go: the shared folder, append-only stores, bundles with a manifest."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. A session that names none may use a local one only if it runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wakeline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: A write's shuffles are of no use once its files are there; left alone, they stay until the driver happens to collect garbage.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows that are dealt by some keys of a join are joined where they lie, if the other side is dealt so too.
_DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, dealt: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back, so that later jobs start from files that outlive any executor. dealt: what df reads has been dealt
    by one key (materialize_dealt) and is joined by that key and more."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/wakeline-{name}-{uuid.uuid4().hex}"
    with _settings(df.sparkSession, _WRITING | (_DEALT if dealt else {})):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_dealt(df: DataFrame, name: str, parts: int, key: str) -> DataFrame:
    """As materialize, in buckets by key, the same as of repartition(parts, key): what groups, orders or joins rows by the key and more reads them without a
    shuffle. df should be dealt so already, as a task writes a file for each bucket that it has rows of."""
    table = f"wakeline-{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{table}"
    with _settings(df.sparkSession, _WRITING | _DEALT):
        df.write.bucketBy(parts, key).option("path", path).option("compression", "zstd").saveAsTable(table := table.replace("-", "_"))
    return df.sparkSession.table(table)


def few(rows: DataFrame, row_bytes: int = 160) -> bool:
    """Are rows, written, below 32 MB at so many bytes a row?"""
    return rows.count() * row_bytes < 32 << 20


def sized(df: DataFrame, name: str, row_bytes: int = 160, dealt: bool = False, otherwise: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """df, written and counted; broadcast where it is small (see few), else what otherwise makes of it."""
    rows = materialize(df, name, dealt)
    return F.broadcast(rows) if few(rows, row_bytes) else otherwise(rows)


def read_ndjson(spark: SparkSession, path: str, schema) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that do not, with file and text. Blank lines are skipped."""
    lines = spark.read.text(path).select("*", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    parsed = lines.select("file", "value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.try_parse_json("value").alias("any"))
    bad = F.col("any").isNull() | (F.schema_of_variant("any").startswith("OBJECT") != F.lit(True))
    return parsed.filter(~bad).select("r.*"), parsed.filter(bad).select("file", "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, blank lines counted), value of text files. Files are split as Spark likes: lines are counted by block."""
    at = F.monotonically_increasing_id()
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"), "value")
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each block of a file
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def line_status(value) -> F.Column:
    """ok, or why a line is no JSON object that a contract takes: blank, invalid (also NaN and Infinity, which are no JSON), not_object, or range
    (a whole number beyond 2**53 - 1, or a number beyond the doubles)."""
    parsed = F.try_parse_json(value)
    bare = F.regexp_replace(value, r'"(\\.|[^"\\])*"', '""')
    whole = F.regexp_extract_all(bare, F.lit(r"(?<![\d.eE+-])-?\d{16,}(?![\d.eE])"), 0)
    huge = F.exists(whole, lambda n: F.abs(F.try_to_number(n, F.lit("S" + "9" * 38))) > (1 << 53) - 1) | bare.rlike(r"[eE]\+?(309|3[1-9]\d|[4-9]\d\d|\d{4,})")
    return F.when(F.trim(value) == "", "blank").when(parsed.isNull() | bare.rlike("NaN|Infinity"), "invalid").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not_object").when(F.coalesce(huge, F.lit(False)), "range").otherwise("ok")


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("errorifexists").option("header", True).csv(path)


def read_registry(spark: SparkSession, path: str, schema: str, where: str, expected: int | None = None) -> DataFrame:
    """The rows of a CSV registry that meet a condition; fails if there are not as many as expected."""
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path).filter(where)
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"registry has {n} rows where {expected} are expected")
    return rows


def terminal_store(attempts: DataFrame, key: list[str], order: list[str], content: str) -> DataFrame:
    """Append-only store: per key the first attempt is kept; a later one of equal content is idempotent, any other is rejected."""
    first = attempts.groupBy(*key).agg(F.min(F.struct(*order, content)).alias("first"))
    joined = attempts.join(first, key)
    is_first = F.struct(*order).eqNullSafe(F.struct(*[F.col(f"first.{c}") for c in order]))
    return joined.withColumn("outcome", F.when(is_first, "stored").when(F.col(content).eqNullSafe(F.col(f"first.{content}")), "idempotent").otherwise("rejected")).drop("first")


def write_bundle(frames: dict[str, DataFrame], path: str) -> None:
    """Each frame as JSON lines under path; an existing bundle is never overwritten."""
    for name, frame in frames.items():
        frame.select(sorted(frame.columns)).write.mode("errorifexists").json(f"{path}/{name}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file of a bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_manifests(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed; empty if the bundle is intact."""
    both = stored.alias("s").join(found.alias("f"), "file", "full_outer")
    problem = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("s.sha256").isNull(), "unexpected").when((F.col("s.sha256") != F.col("f.sha256")) | (F.col("s.bytes") != F.col("f.bytes")), "changed")
    return both.select("file", problem.alias("problem")).filter("problem IS NOT NULL")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")
