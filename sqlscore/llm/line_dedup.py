"""Line dedup by site-relative frequency (DataFrame operations only).

Pages are grouped by host.  A line is boilerplate on a host if the pages of
the host that contain it, divided by all pages of the host, exceed ``ratio``
and are at least ``min_pages`` (a line of a single page is none); such lines are dropped from the host's pages.

Lines travel to the count as 16-byte digests, once per page, and partly
counted before the shuffle.  The boilerplate of a host holds at most (mean
distinct lines per page) / ratio lines, however many pages the host has, so
it goes back to the pages as one array per host.

Defined cases: null content has no lines; a page without a host (null URL or
no authority part) keeps all its lines; a line that repeats inside a page
counts once and is dropped at each place; repeated rows count as pages; long
pages are processed whole; an empty table gives an empty result; columns
beyond the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlscore.session import stash

# fixed values: patterns that both Java's and RE2's regular expressions read alike
HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|"
         r"main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>")
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def html_lines(html: Column) -> Column:
    """Text lines of a page: a block-level tag ends a line, other tags vanish, blanks collapse."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BLOCK, "\n"), TAG, "")
    lines = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")), "\n")
    return F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x != "")


def line_dedup(pages: DataFrame, id_col: str, host: Column, lines: Column, ratio: float = 0.3,
               min_pages: int = 2) -> DataFrame:
    """One row per page: identifier, ``host``, ``n_lines``, ``n_dropped`` and
    ``text`` (the remaining lines, newline between)."""
    rows = stash(pages.select(F.col(id_col).alias("row_id"), host.alias("host"), lines.alias("lines")), "site-lines")
    digest = lambda x: F.unhex(F.md5(x))
    sited = rows.filter("host IS NOT NULL")
    seen = sited.select("host", F.explode(F.array_distinct(F.transform("lines", digest))).alias("line"))
    often = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = sited.groupBy("host").agg(F.count("*").alias("pages"))
    boiler = stash(often.join(totals, "host").filter(F.col("n") / F.col("pages") > ratio)
                   .groupBy("host").agg(F.collect_list("line").alias("boiler")), "site-boiler")
    none = F.array().cast("array<binary>")
    joined = rows.join(boiler, "host", "left").withColumn("boiler", F.coalesce("boiler", none))
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("boiler"), digest(x)))
    kept = F.when(F.size("boiler") == 0, F.col("lines")).otherwise(kept)
    return joined.withColumn("kept", kept).select(
        F.col("row_id").alias(id_col), "host", F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
