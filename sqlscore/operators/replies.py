"""Service replies (JSON text) -> status and flat telemetry; prompt render."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLY_SCHEMA = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("created_timestamp", T.LongType()),
    T.StructField("attachments", T.ArrayType(T.StructType([
        T.StructField("query", T.StructType([
            T.StructField("query", T.StringType()),
            T.StructField("description", T.StringType()),
        ])),
        T.StructField("text", T.StringType()),
        T.StructField("row_count", T.LongType()),
    ]))),
])

INSTRUCTION_SCHEMA = T.StructType([
    T.StructField("ai_system_instruction", T.StringType()),
    T.StructField("rationale", T.StringType()),
])


CORRUPT = "_corrupt_record"


def parse_json(df: DataFrame, col: str, schema: T.StructType, out: str = "parsed") -> DataFrame:
    """H8: parse a model's JSON reply; ``parse_error`` is true only for text that is
    no JSON object of the schema.  Valid JSON without the keys is no error."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(F.col(col), whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    # blank text gives a null struct, text that is no object keeps the corrupt record
    bad = F.col(col).isNotNull() & (F.col(out).isNull() | F.col(out)[CORRUPT].isNotNull())
    return (df.withColumn(out, parsed).withColumn("parse_error", bad)
            .withColumn(out, F.col(out).dropFields(CORRUPT)))


def classify(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Status per reply: parse_error, no_attachment, multiple_attachments,
    followup (no query attached) or ok — a column instead of an exception."""
    p = parse_json(df, reply, REPLY_SCHEMA, "r")
    n = F.size(F.col("r.attachments"))
    status = (F.when(F.col(reply).isNull(), F.lit("no_reply"))
              .when(F.col("parse_error"), F.lit("parse_error"))
              .when(F.col("r.attachments").isNull() | (n == 0), F.lit("no_attachment"))
              .when(n > 1, F.lit("multiple_attachments"))
              .when(F.col("r.attachments")[0]["query"].isNull(), F.lit("followup"))
              .otherwise(F.lit("ok")))
    return p.withColumn("status", status)


def telemetry(df: DataFrame, reply: str = "reply", ts_unit: str = "ms") -> DataFrame:
    """Flat telemetry; query fields are null unless the status is ok.
    ``ts_unit`` says how ``created_timestamp`` is encoded (s or ms)."""
    c = classify(df, reply)
    ok = F.col("status") == "ok"
    att = F.col("r.attachments")[0]
    secs = F.col("r.created_timestamp") / (1000 if ts_unit == "ms" else 1)
    return c.select(
        *[x for x in df.columns if x != reply], "status",
        F.col("r.conversation_id").alias("conversation_id"),
        F.when(ok, att["query"]["query"]).alias("candidate_sql"),
        F.when(ok, att["query"]["description"]).alias("description"),
        F.when(ok, att["row_count"]).alias("row_count"),
        F.when(F.col("status") == "followup", att["text"]).alias("followup"),
        F.timestamp_seconds(secs).alias("created_ts"))
