"""Content hashes, redaction and record migration."""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: key names whose values must not leave a log.
SECRET_KEYS = r"(?i)(secret|token|passphrase|password|api[-_]?key|private[-_]?key|authorization|bearer)"


def sorted_struct(df: DataFrame, name: str) -> Column:
    """A struct column with its fields in alphabetical order at every level."""
    return _sorted(F.col(name), df.schema[name].dataType)


def _sorted(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        return F.when(col.isNotNull(), F.struct(*[_sorted(col[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _sorted(x, dtype.elementType))
    return col


def canonical_hash(column: Column) -> Column:
    """sha256 of the JSON of a struct whose fields are already in order; NULL fields are written."""
    return F.sha2(F.to_json(column, {"ignoreNullFields": "false"}), 256)


def text_hash(*parts: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def redact(df: DataFrame) -> DataFrame:
    """Replace values under secret-looking names in columns, nested fields and map keys."""
    secret = re.compile(SECRET_KEYS)

    def clean(col: Column, dtype: T.DataType, name: str) -> Column:
        if secret.search(name):
            return F.when(col.isNotNull(), F.lit("[REDACTED]"))
        if isinstance(dtype, T.StructType):
            return F.when(col.isNotNull(), F.struct(*[clean(col[f.name], f.dataType, f.name).alias(f.name)
                                                      for f in dtype.fields]))
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda x: clean(x, dtype.elementType, ""))
        if isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.StringType):
            return F.transform_values(col, lambda k, v: F.when(k.rlike(SECRET_KEYS), "[REDACTED]").otherwise(v))
        return col

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def canonical_json(text: Column) -> Column:
    """JSON text of any shape with the keys of every object in order, at every depth, and no white space.

    A VARIANT holds the fields of an object sorted by key, so parsing and writing is the sort. Decimals lose trailing zeros,
    numbers with an exponent are written as doubles. NULL where the text is no JSON or an object repeats a key.
    """
    return F.to_json(F.try_parse_json(text))


def json_hash(text: Column) -> Column:
    """sha256 of a record of any shape, the same for every order of its keys."""
    return F.sha2(canonical_json(text), 256)


_PART = r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^"{}\[\]:,]+'


def hide_values(text: str) -> str:
    """Canonical JSON text whose values under secret-looking keys are replaced, whatever they hold.

    One pass over the text's parts without recursion; numbers keep their digits.
    """
    secret, out, last, depth, hidden = re.compile(SECRET_KEYS), [], "", 0, -1
    for part in re.findall(_PART, text):
        depth += (part in ("{", "[")) - (part in ("}", "]"))
        if hidden >= 0:
            hidden = -1 if depth == hidden else hidden
            continue
        out.append(part)
        if part == ":" and secret.search(json.loads(last)):
            out.append('"[REDACTED]"')
            hidden = depth
        last = part
    return "".join(out)


def redact_json(text: Column) -> Column:
    """Redaction of JSON texts of any shape; keys come out in order, NULL where ``canonical_json`` is NULL.

    Only texts in which a secret-looking name occurs are sent to Python, in Arrow batches.
    """
    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        return texts.map(hide_values, na_action="ignore")

    plain = canonical_json(text)
    suspect = plain.rlike(SECRET_KEYS)
    return F.when(suspect, hide(F.when(suspect, plain))).otherwise(plain)


def migrate_records(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Bring version-1 records to version 2, which adds a certificate id, and union both."""
    up = v1.withColumn("schema", F.lit("v2")).withColumn(
        "certificate_id", F.concat(F.lit("migrated:"), F.col("id").cast("string")))
    return v2.unionByName(up, allowMissingColumns=True)
