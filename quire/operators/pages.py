"""Selecting, moving, copying and merging the pages of documents.

Each takes a relation with doc_id and page0 and returns it, all columns, with page0
numbered anew from 0. Page numbers in selections start at 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import facing, is_landscape
from ..functions.numbers import quarter_turns
from ..functions.ranges import append_missing, parse_order, parse_pages
from ..functions.text import substitute_tokens


def per_doc():
    return Window.partitionBy("doc_id")


def page_count() -> Column:
    return F.count("*").over(per_doc()).cast("int")


def renumber(pages: DataFrame, *order: str | Column) -> DataFrame:
    place = F.row_number().over(per_doc().orderBy(*(order or ("page0",)))) - 1
    return pages.withColumn("page0", place.cast("int"))


def _selected(pages: DataFrame, selection: str) -> DataFrame:
    """pages with __hit. One count of pages a document; the selection is parsed once for each page."""
    hit = F.array_contains(parse_pages(F.lit(selection), F.col("__n")), F.col("page0").cast("int") + 1)
    return pages.withColumn("__n", page_count()).withColumn("__hit", hit).drop("__n")


def select(pages: DataFrame, selection: str) -> DataFrame:
    return renumber(_selected(pages, selection).where("__hit").drop("__hit"))


def delete(pages: DataFrame, selection: str) -> DataFrame:
    """All but the selected pages. A blank selection deletes nothing; documents that lose all pages are kept whole."""
    if not selection.strip():
        return pages
    marked = _selected(pages, selection).withColumn("__all", F.every("__hit").over(per_doc()))
    return renumber(marked.where("not __hit or __all").drop("__hit", "__all"))


def rotate(pages: DataFrame, degrees: int, selection: str = "", column: str = "rotation") -> DataFrame:
    """Turns the selected pages, blank for all, further by the nearest quarter turn."""
    turned = F.pmod(F.col(column) + quarter_turns(F.lit(degrees)), F.lit(360)).cast("int")
    marked = _selected(pages, selection)
    return marked.withColumn(column, F.when(F.col("__hit"), turned).otherwise(F.col(column))).drop("__hit")


def reorder(pages: DataFrame, order: str, complete: bool = True) -> DataFrame:
    """The pages in an order such as "3, 1-2"; pages it leaves out follow, or go if complete is False."""
    n = F.col("__n")
    wanted = parse_order(F.lit(order))["pages"]
    places = append_missing(wanted, n) if complete else wanted
    placed = pages.withColumn("__n", page_count()).withColumn(
        "__at", F.array_position(places, (F.col("page0") + 1).cast("int"))
    )
    return renumber(placed.where("__at > 0"), "__at").drop("__n", "__at")


def order_problem(order: Column, n_pages: Column) -> Column:
    """Why an order is no permutation of all pages, or null."""
    parsed = parse_order(order, n_pages)
    short = F.size(parsed["pages"]) != n_pages
    return F.when(~parsed["valid"], parsed["message"]).when(short, "the order must name every page once")


def reverse(pages: DataFrame) -> DataFrame:
    return renumber(pages, F.desc("page0"))


def duplicate(pages: DataFrame, page: int) -> DataFrame:
    """A copy of a page right after it; documents without that page stay as they are."""
    times = F.when(F.col("page0") == page - 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return renumber(pages.withColumn("__copy", F.explode(times)), "page0", "__copy").drop("__copy")


def insert_blank(pages: DataFrame, before: int | None, blank: dict[str, Column]) -> DataFrame:
    """A new page before a page, or at the end for None; blank gives its columns, others are null."""
    first = pages.groupBy("doc_id").agg(F.count("*").alias("__n"))
    place = F.col("__n") if before is None else F.least(F.col("__n"), F.greatest(F.lit(0), F.lit(before - 1)))
    kinds = {f.name: f.dataType for f in pages.schema}
    filled = [
        F.col("doc_id") if c == "doc_id" else place.cast(kinds[c]).alias(c) if c == "page0"
        else blank.get(c, F.lit(None)).cast(kinds[c]).alias(c)
        for c in pages.columns
    ]
    new = first.select(*filled, F.lit(0).alias("__old"))
    return renumber(pages.withColumn("__old", F.lit(1)).unionByName(new), "page0", "__old").drop("__old")


def interleave(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pages of both relations by turns, document by document; the longer one's rest follows."""
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)))
    return renumber(both, "page0", "__side").drop("__side")


def merge(pages: DataFrame, group: str, order: str) -> DataFrame:
    """The documents of each group as one, in the order of a column, which tells them apart: adds merged_page0.

    Pages are numbered within their own document; only the sizes of documents are summed
    over a group, so that a group of many pages is no task of its own.
    """
    sizes = pages.groupBy(F.col(group).alias("__group"), F.col(order).alias("__order")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__group").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = F.col(group).eqNullSafe(F.col("__group")) & F.col(order).eqNullSafe(F.col("__order"))
    own = F.row_number().over(Window.partitionBy(group, order).orderBy("page0")) - 1
    joined = pages.withColumn("__own", own).join(placed, same)
    return joined.withColumn("merged_page0", (F.col("__first") + F.col("__own")).cast("int")).drop("__group", "__order", "__first", "__own")


def mergeable(files: DataFrame, group: str, least: int = 2) -> DataFrame:
    """files with error where their group has fewer than the least number of inputs."""
    few = F.count("*").over(Window.partitionBy(group)) < least
    return files.withColumn("error", F.when(few, F.lit("UNSUPPORTED_INPUT")))


def by_orientation(pages: DataFrame, orientation: str = "any") -> DataFrame:
    if orientation not in ("landscape", "portrait"):
        return pages
    wide = is_landscape(F.col("width"), F.col("height"))
    return renumber(pages.where(wide if orientation == "landscape" else ~wide))


def number(pages: DataFrame, template: str = "{n}", start: int = 1, relative_start: int = 1, skip_first: int = 0,
           skip_last: int = 0, place: str = "bottom-center", mirrored: bool = False) -> DataFrame:
    """The numbered pages with label and place.

    Tokens: {n} is start plus the page's index, {p} that of the last numbered page, {r}
    and {rf} count within the numbered pages from relative_start.
    """
    n = page_count()
    counted = pages.withColumn("__n", n).where((F.col("page0") >= skip_first) & (F.col("page0") < F.col("__n") - skip_last))
    last = F.max("page0").over(per_doc())
    ordinal = F.row_number().over(per_doc().orderBy("page0")) - 1
    label = substitute_tokens(
        F.lit(template), F.col("page0") + start, last + start, ordinal + relative_start,
        F.count("*").over(per_doc()) - 1 + relative_start,
    )
    return counted.withColumns({"label": label, "place": facing(F.lit(place), F.col("page0"), mirrored)}).drop("__n")


# Label templates by format.
LABEL_FORMATS = {"n": "{n}", "page-n": "Page {n}", "n-of-total": "{n} of {p}"}
