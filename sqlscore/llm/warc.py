"""Content-addressed WARC archive.

An archive is a folder with two tables: ``payloads`` keeps the bytes of every
distinct payload once, addressed by SHA-256; ``records`` keeps the exact
header block of every record with the address of its payload.  Reading joins
the two, checks each payload against the SHA-1 that the record's own header
states, and gives back the original records byte by byte.

A payload that many records share is stored with its number of copies; when
records are read back, both sides of the join are split over
``copies / COPIES_PER_TASK`` salts, so no task serves all records of a hot
payload.

Defined cases: null payload counts as empty; among records with equal payloads
of at least ``min_bytes`` bytes, that with the smallest identifier is the
response (every row that has this identifier, if rows repeat) and the others
are revisits; a null identifier is larger than any other; a null URL leaves
its header line out; CR and LF in a URL are written as %0D and %0A; columns
beyond the three named ones are not read; an empty table gives an empty
archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlscore.session import stash

COPIES_PER_TASK = 256
CRLF = "\r\n"
# fixed values: the digit alphabet of conv() and that of RFC 4648 base 32, and the profile of WARC 1.1
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: 5 hex digits are 4 base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*parts)), CONV_DIGITS, BASE32_DIGITS)


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(F.url_encode(record_id.cast("string")), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("address"))
    heads = stash(rows.select("record_id", "url", "address", F.octet_length("payload").cast("long").alias("n_bytes"),
                              base32_sha1(F.col("payload")).alias("sha1")), "warc-heads")
    groups = stash(heads.groupBy("address").agg(F.min("record_id").alias("first_id"), F.count("*").alias("copies")),
                   "warc-groups")
    # the limit of one row per address is applied before the shuffle, too
    nth = F.row_number().over(Window.partitionBy("address").orderBy(F.col("record_id").asc_nulls_last()))
    (rows.select("record_id", "address", "payload").withColumn("nth", nth).filter("nth = 1").join(groups, "address")
     .select("address", "copies", "payload").write.parquet(f"{path}/payloads"))
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    when_revisit = lambda c: F.when(revisit, c)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(F.concat_ws(
        CRLF, F.lit("WARC/1.1"), _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("record_id"))), F.lit(f"WARC-Date: {date}"), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        when_revisit(_line("WARC-Refers-To", _urn(F.col("first_id")))),
        when_revisit(F.lit(f"WARC-Profile: {REVISIT_PROFILE}")), F.lit("Content-Type: text/html; charset=utf-8"),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string"))),
        F.lit(CRLF + CRLF))
    (heads.join(groups, "address").select(header.alias("header"), "address", "copies")
     .write.parquet(f"{path}/records"))


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Every record of the archive: ``record_id``, ``record_type``, ``refers_to``,
    ``url``, ``header``, full ``payload`` and its ``payload_digest``.  A payload
    that differs from its header's digest is an error."""
    salts = F.ceil(F.col("copies") / COPIES_PER_TASK).cast("int")
    payloads = (spark.read.parquet(f"{path}/payloads")
                .select("address", "payload", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    field = lambda name: F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    urn = lambda name: F.url_decode(F.nullif(
        F.regexp_extract("header", rf"\n{name}: <urn:record:([^>]*)>\r\n", 1), F.lit(""))).cast(id_type)
    records = (spark.read.parquet(f"{path}/records")
               .withColumn("salt", F.pmod(F.xxhash64("header"), salts).cast("int")))
    stated, found = F.regexp_extract("header", r"\nWARC-Payload-Digest: sha1:(\w+)\r\n", 1), F.col("payload_digest")
    whole = (records.join(payloads, ["address", "salt"])
             .select("header", "payload", base32_sha1(F.col("payload")).alias("payload_digest")))
    checked = F.when(found == stated, found).otherwise(
        F.raise_error(F.concat(F.lit("payload differs from the digest of "), F.col("header"))))
    return whole.select(urn("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"),
                        urn("WARC-Refers-To").alias("refers_to"),
                        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
                        "header", "payload", checked.alias("payload_digest"))


def record_bytes(records: DataFrame) -> DataFrame:
    """The original record of each row as in a WARC file, revisits with their payload left out."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")))
