"""Text-corpus jobs: questions from chat logs, packing source texts into
groups, sectioning pages into heading -> bullets, message ids from URLs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlscore.functions.sqltext import message_id, strip_heading


def user_questions(conv: DataFrame, limit: int | None = None) -> DataFrame:
    """A4: user turns with text, in (conversation, turn) order, as eval rows
    with null gold and issues.  ``limit`` keeps the first n (a top-k)."""
    q = (conv.filter((F.col("role") == "user") & F.col("text").isNotNull() & (F.trim(F.col("text")) != ""))
         .select("conv_id", "turn", F.col("text").alias("question"),
                 F.lit(None).cast("string").alias("gold_sql"), F.lit(None).cast("string").alias("issues")))
    return q.orderBy("conv_id", "turn").limit(limit) if limit else q


def group_count(docs: DataFrame, target_chars: int, text: str = "text", length_col: str | None = None) -> int:
    """Number of groups so that a group holds about ``target_chars`` (one
    scalar aggregate; the group count is what bounds each group's size).
    ``length_col`` names a stored character count, so the sizing pass reads
    one integer column instead of the texts."""
    if target_chars <= 0:
        raise ValueError("target_chars must be > 0")
    size = F.col(length_col) if length_col else F.length(text)
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    return max(1, math.ceil(total / target_chars))


def pack_documents(docs: DataFrame, num_groups: int, key: str = "doc_id", text: str = "text",
                   sep: str = "\n", seed: int = 42, group_expr: Column | None = None) -> DataFrame:
    """Texts packed into ``num_groups`` groups, each joined in key order.

    Group = hash of the key (or ``group_expr``), so the assignment is stable
    and spreads a skewed source over all groups.  num_groups <= 0 is an error.
    """
    if num_groups <= 0:
        raise ValueError("num_groups must be > 0")
    gid = group_expr if group_expr is not None else F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(num_groups))
    return (docs.select(gid.alias("group_id"), F.col(key).alias("k"), F.col(text).alias("t"))
            .groupBy("group_id")
            .agg(F.count(F.lit(1)).alias("n_docs"),
                 F.sum(F.length("t")).alias("n_chars"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]),
                              sep).alias("text")))


# (?s): an element may span lines; a blank or > must follow the name, so <link> is no <li>
ELEMENT_RE = r"(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]\s*>|<li(?:\s[^>]*)?>.*?</li\s*>"
# Markdown lines: # headings; -, * and 1. bullets
LINE_RE = r"(?m)^[ \t]*(?:#{1,6}[ \t]+[^\r\n]*|(?:[-*]|[0-9]+\.)[ \t]+[^\r\n]*)"


def sectionise(pages: DataFrame, key: str = "page_id", html: str = "html", form: str = "html") -> DataFrame:
    """Heading -> bullets per page.  ``form`` says what the text is: ``html``
    (headings h1..h6, bullets are list items) or ``lines`` (Markdown: ``#``
    headings, ``-``, ``*`` and ``1.`` bullets).  Texts are trimmed, a heading's
    ``:`` too, tags are removed and line breaks inside an element are blanks.
    Bullets before the first heading are dropped; a repeated heading keeps only
    its last section.

    One shuffle: the running heading count is a window partitioned by page,
    and the following group-bys on (page, ...) reuse that partitioning.
    """
    if form not in ("html", "lines"):
        raise ValueError(f"unknown form {form!r}")
    found = F.regexp_extract_all(F.col(html), F.lit(ELEMENT_RE if form == "html" else LINE_RE), F.lit(0))
    els = (pages.select(key, F.posexplode_outer(found).alias("pos", "el"))
           .filter(F.col("el").isNotNull()))  # _outer: no inferred filter that runs the regex again
    if form == "html":
        is_h = F.lower(F.col("el")).startswith("<h")
        bare = F.regexp_replace("el", "<[^>]*>", "")
    else:
        is_h = F.trim(F.translate("el", "\t", " ")).startswith("#")
        bare = F.regexp_replace("el", r"^[ \t]*(?:#{1,6}|[-*]|[0-9]+\.)[ \t]+", "")
    txt = F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = (els.withColumn("is_h", is_h)
              .withColumn("txt", F.when(is_h, strip_heading(txt)).otherwise(txt))
              .withColumn("section", F.sum(F.col("is_h").cast("int")).over(w))
              .filter(F.col("section") > 0))
    sections = marked.groupBy(key, "section").agg(
        F.max(F.when(F.col("is_h"), F.col("txt"))).alias("heading"),
        F.array_sort(F.collect_list(F.when(~F.col("is_h"), F.struct("pos", "txt")))).alias("items"))
    last = sections.groupBy(key, "heading").agg(F.max_by("items", "section").alias("items"))
    return last.select(key, "heading", F.size("items").alias("n_bullets"),
                       F.array_join(F.transform("items", lambda x: x["txt"]), "\n").alias("bullets"))


def url_message_ids(pages: DataFrame, url: str = "url") -> DataFrame:
    """H6: message id = text after the last 'm=' of the URL (whole URL if none)."""
    return pages.select("page_id", url, message_id(F.col(url)).alias("message_id"))
