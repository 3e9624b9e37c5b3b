"""Line dedup by site-relative frequency (built-in expressions only).

For each host, the number of its pages that contain a line is divided by the number of its pages;
a line whose ratio exceeds ``max_ratio`` is boilerplate of that host and is dropped from all of
its pages. Two things are stated beside the ratio:

- A line on one page alone repeats nothing, so it never is boilerplate (``min_pages=2``). On a
  host of few pages any line of two pages exceeds the ratio.
- A page whose lines would all go stays whole (``keep_whole``): the operator takes lines out of
  pages, not pages out of the table, which is what near-duplicate removal is for. A page copied
  over more than ``max_ratio`` of its host thus keeps its text; near copies of a page that is, lose
  the lines that they share and keep those of their own.

Lines are split at ``\n`` and compared without surrounding spaces, tabs and carriage
returns. A line counts once per page however often it stands there. Blank lines are never
boilerplate. Defined cases: a null host is the host ''; a null text stays null and counts
as a page without lines; very long texts and lines are taken whole; a page of blank lines stays as
it is; repeated rows count as pages each and are all returned; all columns pass through, and the
counts take other names where the input has theirs; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, release, scratch_table

BLANKS = " \t\r"


def _key(line: Column) -> Column:
    """128 bits that stand for a line in shuffles and lookups."""
    line = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) == F.lit("")


def boilerplate(pages: DataFrame, host: Column, text: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, lines), written: the keys of each host's boilerplate lines; hosts without any are absent.

    A host has at most ``lines per page / max_ratio`` boilerplate lines, so the array is
    bounded whatever the number of its pages. Lines are made distinct inside the page before
    they are exploded and pre-aggregated before each shuffle, so a hot host, line or page
    costs one row per task. The pages of each host and the lines over the ratio are written before
    they are used, so the many other lines of a hot host need not come together for either.
    """
    src = pages.select(F.coalesce(host, F.lit("")).alias("__host"), F.col(text).alias("__text"))
    totals = scratch_table(src.groupBy("__host").agg(F.count("*").alias("__pages")))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: ~_blank(x))
    seen = (
        src.select("__host", F.explode(F.array_distinct(F.transform(lines, _key))).alias("__line"))
        .groupBy("__host", "__line")
        .agg(F.count("*").alias("__with"))
        .filter(F.col("__with") >= F.lit(min_pages))
    )
    over = F.col("__with").cast("double") / F.col("__pages") > F.lit(float(max_ratio))
    over = scratch_table(seen.join(totals, "__host").filter(over).select("__host", "__line"))
    bad = scratch_table(over.groupBy("__host").agg(F.collect_list("__line").alias("__lines")))
    release(totals, over)
    return bad


def drop_boilerplate(pages: DataFrame, host: Column, text: str = "text", max_ratio: float = 0.05, min_pages: int = 2, keep_whole: bool = True, counts: bool = True) -> DataFrame:
    """``pages`` with boilerplate lines removed from ``text``; with ``counts`` also ``n_lines``, the
    lines of the text before, and ``dropped_lines``.

    The boilerplate table is written first; the planner then broadcasts it if its size is
    under the broadcast threshold and joins by host otherwise, where adaptive execution
    splits a hot host. A page's lines meet those of its host by their hashes, so a host with many
    boilerplate lines costs their sum, not their product.
    """
    bad = boilerplate(pages, host, text, max_ratio, min_pages).withColumnRenamed("__host", "__h")
    lines = F.split(F.col("__text"), "\n", -1)
    of_line, of_host = F.transform("__all", lambda x: _key(x)["a"]), F.transform("__lines", lambda k: k["a"])
    keep = F.filter("__all", lambda x: _blank(x) | ~F.array_contains(F.col("__met"), _key(x)["a"]) | ~F.array_contains(F.col("__lines"), _key(x)))
    joined = (
        pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("__page"), F.col(text).alias("__text"), F.coalesce(host, F.lit("")).alias("__host"))
        .join(bad, F.col("__host") == F.col("__h"), "left")
        .withColumn("__all", lines)
        .withColumn("__met", F.when(F.col("__lines").isNotNull(), F.array_intersect(of_line, of_host)))
        .withColumn("__kept", F.when(F.coalesce(F.size("__met"), F.lit(0)) > 0, keep).otherwise(F.col("__all")))
    )
    if keep_whole:
        joined = joined.withColumn("__kept", F.when(F.exists("__kept", lambda x: ~_blank(x)), F.col("__kept")).otherwise(F.col("__all")))

    def size(lines: str) -> Column:
        return F.when(F.col(lines).isNull(), F.lit(0)).otherwise(F.size(lines))

    out = [F.when(F.col("__text").isNotNull(), F.array_join("__kept", "\n")).alias(c) if c == text else F.col("__page")[c].alias(c) for c in pages.columns]
    if counts:
        out += [size("__all").cast("int").alias(free_name("n_lines", pages.columns)), (size("__all") - size("__kept")).cast("int").alias(free_name("dropped_lines", pages.columns))]
    return joined.select(*out)
