"""Delimited text without a header: a record a line, quoted fields, empty fields are NULL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from brindle.tables import MOVIE_SCHEMAS, SCHEMAS


def _fields(line: Column, sep: str, escape: str) -> Column:
    """The line's fields as they stand. Lines without a quote are just split."""
    s, body = re.escape(sep), r'[^"\\]*+(?:\\.[^"\\]*+)*+' if escape == "\\" else r'[^"]*+(?:""[^"]*+)*+'
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{s}("{body}"(?={s}|$)|[^{s}]*+)'), F.lit(1))
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, s))


def _text(field: Column, escape: str) -> Column:
    """A field's value: quotes around it go, and what is escaped stands for itself. An empty field is NULL, ``""`` is not."""
    inner = F.when((F.length(field) > 1) & field.startswith('"') & field.endswith('"'), F.substr(field, F.lit(2), F.length(field) - 2)).otherwise(field)
    if escape == "\\":
        plain = F.when(inner.contains("\\"), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(inner)
    else:
        plain = F.replace(inner, F.lit('""'), F.lit('"'))
    return F.when(field != "", plain)


def _typed(text: Column, f: StructField) -> Column:
    if isinstance(f.dataType, StringType):
        return text
    if isinstance(f.dataType, BooleanType):
        return text == "true"
    kind = f.dataType.simpleString()
    value = text.try_cast(f.dataType)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{f.name} is no {kind}: "), text)).cast(f.dataType)).otherwise(value)


def read_delimited(spark: SparkSession, path: str, schema: str | StructType, sep: str = "|", escape: str = "\\") -> DataFrame:
    """Rows of a file or folder in the given schema (a StructType, DDL, or the name of a known table).

    Each line is a record; blank lines are none. A separator may end it. ``escape`` precedes quotes, and with a
    backslash any character, that stand for themselves; ``"`` for it means doubled quotes. Booleans are true where the
    text is ``true``, false for any other text. Text that is no value of its column's type, and a line with too few or
    too many fields, fail the query that reads them: neither turns into NULL.
    """
    if escape not in ("\\", '"'):
        raise ValueError('escape must be a backslash or "')
    wanted = (MOVIE_SCHEMAS | SCHEMAS).get(schema, schema) if isinstance(schema, str) else schema
    wanted = StructType.fromDDL(wanted) if isinstance(wanted, str) else wanted
    n = len(wanted)
    lines = spark.read.text(path).where(F.length("value") > 0).select("value", _fields(F.col("value"), sep, escape).alias("_f"))
    size = F.size("_f")
    whole = (size == n) | (size == n + 1) & (F.get("_f", F.lit(n)) == "")
    lines = lines.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit(f"not {n} fields: "), F.col("value"))).cast("boolean")))
    return lines.select(*(_typed(_text(F.get("_f", F.lit(k)), escape), f).alias(f.name) for k, f in enumerate(wanted)))


def write_delimited(df: DataFrame, path: str, sep: str = "|") -> None:
    """The counterpart of ``read_delimited``, one file per partition. A line end inside a value fails: it has no form."""

    def field(f: StructField) -> Column:
        c = F.col(f"`{f.name}`").cast("string")
        special = (c == "") | c.contains(sep) | c.contains('"') | c.contains("\\")
        quoted = F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
        out = F.when(special, quoted).otherwise(c)
        if isinstance(f.dataType, StringType):
            out = F.when(c.rlike("[\r\n]"), F.raise_error(F.lit(f"{f.name} has a line end")).cast("string")).otherwise(out)
        return F.coalesce(out, F.lit(""))

    df.select(F.concat(*(F.concat(field(f), F.lit(sep)) for f in df.schema)).alias("value")).write.text(path)
