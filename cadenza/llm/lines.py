"""Site-relative line dedup: drop lines that a large share of their host's pages carry.

Pages are grouped by host. A line's frequency is the number of the host's pages that contain it (once a page, however
often it stands there) over the host's page total. Lines above `ratio` on at least `min_pages` pages are boilerplate
and go from all pages of that host; other hosts keep them. Lines are compared without leading and trailing spaces;
blank lines always stay. At most (mean lines a page) / ratio lines of a host can be boilerplate, so what a page is
held against does not follow the host's size.

Null text stays null and has no lines; empty text has one blank line. A null host counts as the empty host. Repeated
rows count as pages of their own. An empty table gives no rows. All other columns pass through, whatever their names;
input columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import Scratch, fresh, is_small

#: Where the lines to drop are too many to broadcast, a host's pages are dealt to so many tasks.
DEALT = 32


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line), F.length(F.trim(line)))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host_key, line_key, pages) of the lines to drop."""
    keyed = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host_key"), F.split(F.col(text), "\n").alias("lines"))
    totals = keyed.groupBy("host_key").agg(F.count("*").alias("total"))
    real = F.filter("lines", lambda x: F.trim(x) != "")
    once = keyed.select("host_key", F.explode(F.array_distinct(F.transform(real, _key))).alias("line_key"))
    often = once.groupBy("host_key", "line_key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return often.join(totals, "host_key").where(F.col("pages") > F.col("total") * ratio).select("host_key", "line_key", "pages")


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.02, min_pages: int = 3) -> DataFrame:
    """pages with the boilerplate lines taken out of the text, and n_lines and n_dropped."""
    scratch = Scratch(pages.sparkSession, "lines")
    common = scratch.keep(boilerplate(pages, host, text, ratio, min_pages), "common")
    host_, common_, kept_, part_ = fresh(pages.columns, "host_key", "common", "kept_lines", "part")
    by_host = common.groupBy(F.col("host_key").alias(host_)).agg(F.collect_set("line_key").alias(common_))
    joined = pages.withColumn(host_, F.coalesce(F.col(host).cast("string"), F.lit("")))
    if is_small(common):
        joined = joined.join(F.broadcast(by_host), host_, "left")
    else:  # the pages of a large host are dealt to many tasks, each with that host's lines
        every = by_host.withColumn(part_, F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
        joined = joined.withColumn(part_, F.pmod(F.xxhash64(F.col(text)), F.lit(DEALT)).cast("int")).join(every, [host_, part_], "left")
    lines = F.split(F.col(text), "\n")
    stays = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(common_), _key(x)))
    out = joined.withColumn(kept_, F.when(F.col(common_).isNull(), lines).otherwise(stays))
    many, left = F.coalesce(F.array_size(lines), F.lit(0)).cast("long"), F.coalesce(F.array_size(kept_), F.lit(0)).cast("long")
    new = F.when(F.col(text).isNotNull(), F.array_join(kept_, "\n"))
    others = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*(new.alias(c) if c == text else F.col(c) for c in others), many.alias("n_lines"), (many - left).alias("n_dropped"))
