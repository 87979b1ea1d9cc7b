"""Finding pages of listings that answer only what they are asked, for all portals at once.

A page source takes (portal, page) rows and answers those pages that exist; nothing can be listed. ``last_page`` finds
each portal's last page with links by doubling and then by bisection, ``first_page_not_after`` the first page of a
newest-first listing whose oldest article isn't newer than a date, by bisection. A round is one question for all
portals that are still open, so the number of rounds follows the longest listing and not the number of portals; a
portal of n pages is asked at most 2 log2(n) + 3 times. The state (a row a portal) is cut from its lineage every round.

Defined results: a portal without a first page has last page 0 and no page of any date; portals are distinct; pages
between the first and the last must have links, as listings do (``last_page`` finds one border otherwise).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialised

#: A page source: (portal, page) in, (portal, page, links, oldest, newest) of the pages that exist out.
Source = Callable[[DataFrame], DataFrame]


def table_source(pages: DataFrame) -> Source:
    """A source over a table of (portal, page, links, oldest, newest), which is read only at the pages asked."""
    return lambda asked: pages.join(asked.select("portal", "page"), ["portal", "page"], "left_semi")


def _round(source: Source, state: DataFrame, open_: Column, page: Column, right: Column, low: Column, high: Column) -> DataFrame:
    """The state after one question: ``low`` where the answer is ``right``, else ``high``, is moved to the page asked."""
    asks = state.where(open_).select("portal", page.cast("int").alias("page"))
    answers = asks.join(source(asks), ["portal", "page"], "left").select("portal", "page", F.coalesce(right, F.lit(False)).alias("is_right"))
    told = state.join(answers, "portal", "left")
    moved = lambda side, when: F.when(F.col("page").isNotNull() & (F.col("is_right") == when), F.col("page")).otherwise(F.col(side)).alias(side)
    kept = [c for c in state.columns if c not in ("low", "high", "asked")]
    return materialised(told.select(*kept, moved("low", low), moved("high", high), (F.col("asked") + F.col("page").isNotNull().cast("int")).alias("asked")))


def last_page(source: Source, portals: DataFrame) -> DataFrame:
    """(portal, last, asked): the last page with links and the number of pages asked for."""
    # low has links (or is 0), high has none (null while unknown)
    state = materialised(portals.select("portal").distinct().select("portal", F.lit(0).alias("low"), F.lit(None).cast("int").alias("high"), F.lit(0).alias("asked")))
    open_ = F.col("high").isNull() | (F.col("high") - F.col("low") > 1)
    page = F.when(F.col("high").isNull(), F.greatest(F.col("low") * 2, F.lit(1))).otherwise(F.expr("(low + high) div 2"))
    while not state.where(open_).isEmpty():
        state = _round(source, state, open_, page, F.col("links") > 0, F.lit(True), F.lit(False))
    return state.select("portal", F.col("low").alias("last"), "asked")


def first_page_not_after(source: Source, ends: DataFrame, day: str) -> DataFrame:
    """(portal, first, asked): the first page up to ``last`` whose oldest article is of ``day`` or before; null if none.

    ``ends`` has portal and last; pages run from the newest articles to the oldest.
    """
    # the page searched is in (low, high]; high is last + 1 while no page is known to qualify
    state = materialised(ends.select("portal", F.col("last").cast("int").alias("last"), F.lit(0).alias("low"), (F.col("last") + 1).cast("int").alias("high"), F.lit(0).alias("asked")))
    open_ = F.col("high") - F.col("low") > 1
    while not state.where(open_).isEmpty():
        state = _round(source, state, open_, F.expr("(low + high) div 2"), F.col("oldest") <= F.lit(day).cast("date"), F.lit(False), F.lit(True))
    return state.select("portal", F.when(F.col("high") <= F.col("last"), F.col("high")).alias("first"), "asked")


def pages_of_day(source: Source, portals: DataFrame, day: str) -> DataFrame:
    """(portal, first, last): the run of pages whose dates span ``day``, by two bisections between known ends.

    The run starts at the first page whose oldest article is of the day or before, and ends before the first page
    whose newest article is older; portals without such a page have no row.
    """
    ends = last_page(source, portals)
    first = first_page_not_after(source, ends, day).select("portal", "first").where("first IS NOT NULL")
    # newest < day is the same search with the other end of a page
    older = lambda asked: source(asked).withColumn("oldest", F.date_add("newest", 1))
    after = first_page_not_after(older, ends, day).select("portal", F.col("first").alias("after"))
    runs = first.join(ends.select("portal", "last"), "portal").join(after, "portal", "left")
    return runs.select("portal", "first", F.coalesce(F.col("after") - 1, F.col("last")).alias("last")).where("first <= last")


def listing(articles: DataFrame, portal: str, order: list, size: int) -> DataFrame:
    """Pages of ``size`` articles a portal in the given order: (portal, page, links, oldest, newest) of articles with day.

    What stands behind a site; searches see it only through a source.
    """
    n = F.row_number().over(Window.partitionBy(portal).orderBy(*order)) - 1
    placed = articles.withColumn("page", (F.floor(n / size) + 1).cast("int"))
    return placed.groupBy(F.col(portal).alias("portal"), "page").agg(F.count("*").alias("links"), F.min("day").alias("oldest"), F.max("day").alias("newest"))
