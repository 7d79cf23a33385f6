"""Landing files of JSON lines: one pass judges every line, rejects go to a side table with their reason."""
from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from . import readers as RD

CORRUPT = "corrupt_line"


class Form(NamedTuple):
    """Fields of a line, what an accepted line must hold, and the field a bare array stands for."""
    schema: str
    needed: str
    bare: str | None = None


FORMS = {
    "snapshots": Form(RD.SNAPSHOT, "record.ts"),
    "charts": Form(RD.CHART, "get(record.chart.result, 0)"),
    "pages": Form(RD.QUOTE_PAGE, "record.data.primaryData"),
    "news": Form(RD.NEWS, "record.news"),
    "macro": Form(f"data {RD.MACRO_DAYS}", "record.data", bare="data"),
    "books": Form(RD.BOOK, "coalesce(record.bids, record.asks)"),
}


class Landed(NamedTuple):
    rows: DataFrame
    rejects: DataFrame


def judge(lines: DataFrame, form: Form, value: str = "value") -> DataFrame:
    """``lines`` with a column ``reject``: NULL, ``malformed`` (no JSON, or a field of another type) or ``missing``.

    Null and blank lines are left out. Columns named ``record`` or ``reject`` are replaced.
    """
    text = F.col(value)
    if form.bare:
        text = F.when(F.ltrim(text).startswith("["), F.concat(F.lit(f'{{"{form.bare}":'), text, F.lit("}"))).otherwise(text)
    record = F.from_json(text, f"{form.schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    held = lines.filter(F.trim(value) != "").withColumn("record", record)
    reject = (F.when(F.col("record").isNull() | F.col(f"record.{CORRUPT}").isNotNull(), "malformed")
              .when(F.expr(form.needed).isNull(), "missing"))
    return held.withColumn("reject", reject).drop("record")


def land(spark: SparkSession, path: str, form: Form) -> Landed:
    """Accepted lines and rejects of the text files under ``path``, with file names and folder columns such as ``ticker=``.

    Lines are judged once and written to the shared folder by verdict, so each side reads its own files only.
    """
    judged = judge(spark.read.text(path).withColumn("file", F.col("_metadata.file_name")), form)
    store = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    judged.withColumn("accepted", F.col("reject").isNull()).write.partitionBy("accepted").parquet(store)
    table = spark.read.schema(T.StructType(judged.schema.fields + [T.StructField("accepted", T.BooleanType())])).parquet(store)
    return Landed(table.filter("accepted").drop("accepted", "reject"), table.filter("NOT accepted").drop("accepted"))
