"""The walk through nested records for what must not reach the online side, and guards on numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def findings(rows: DataFrame, id_col: str, json_col: str, keys: list[str], values: list[str] | None = None, depth: int = 64) -> DataFrame:
    """id, path, kind (key or value), found: forbidden keys at any depth (whatever their case) and texts that equal a forbidden value.

    Each round opens one level of what is still nested, for all rows at once; as many rounds as the deepest record has levels. What has been found stays
    among the rows, so that records are read and parsed once, not once for each level and kind. (Once more before, to learn how deep they are.)
    """
    text = lambda v: F.try_variant_get(v, "$", "string")

    def judged(path: Column, key: Column, v: Column) -> Column:
        """What is found at a node, and the node itself (of no kind) if it can be opened."""
        row = lambda kind, found, rest: F.struct(path.alias("path"), F.lit(kind).alias("kind"), found.alias("found"), rest.alias("v"))
        shape, none, closed = F.schema_of_variant(v), F.lit(None).cast("string"), F.lit(None).cast("variant")
        each = [F.when(F.lower(key).isin([k.lower() for k in keys]), row("key", key, closed)), F.when(shape.startswith("OBJECT") | shape.startswith("ARRAY"), row(None, none, v))]
        if values:
            each.append(F.when((shape == "STRING") & text(v).isin(values), row("value", text(v), closed)))
        return F.array_compact(F.array(*each))

    level = rows.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("v")).select("id", F.inline(judged(F.lit(""), F.lit(None).cast("string"), F.col("v"))))
    for _ in range(depth):
        if level.filter("kind IS NULL").isEmpty():
            return level.filter("kind IS NOT NULL").select("id", "path", "kind", "found")
        opened = level.withColumnRenamed("path", "above").lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
        step = F.when(F.col("key").isNull(), F.concat("above", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("above", F.when(F.col("above") == "", "").otherwise("."), "key"))
        kept = F.array(F.struct(F.col("above").alias("path"), F.col("kind"), F.col("found"), F.lit(None).cast("variant").alias("v")))
        level = opened.select("id", F.inline(F.when(F.col("kind").isNotNull(), kept).otherwise(judged(step, F.col("key"), F.col("value")))))
    raise ValueError(f"a record is nested more than {depth} levels deep")


def finite_or_null(value: Column) -> Column:
    """A number as double; null for NaN and the infinities."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def unit_or_null(value: Column) -> Column:
    """A finite number from 0 to 1, else null."""
    x = finite_or_null(value)
    return F.when(x.between(0.0, 1.0), x)


def assert_finite(frame: DataFrame) -> DataFrame:
    """The frame, whose job fails at a number that is NaN, infinite or a negative zero. Truth values are no numbers and pass."""
    checked = []
    for field in frame.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, NumericType) and field.dataType.typeName() in ("double", "float"):
            bad = F.isnan(c) | (F.abs(c) == float("inf")) | (c.cast("string") == "-0.0")
            c = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{field.name} is not a finite number")).cast(field.dataType)).otherwise(c)
        checked.append(c.alias(field.name))
    return frame.select(*checked)


def json_pointer(record: Column, pointer: str) -> Column:
    """What a JSON pointer names in a parsed record, or null: /a/b, /a/0, with ~1 for a slash and ~0 for a tilde."""
    path = "$"
    for step in pointer.split("/")[1:]:
        name = step.replace("~1", "/").replace("~0", "~")
        path += f"[{name}]" if name.isdigit() else "['" + name.replace("'", "\\'") + "']"
    return F.try_variant_get(record, path, "variant")
