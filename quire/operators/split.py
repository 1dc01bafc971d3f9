"""Splitting documents into parts: each mode gives pages a part number from 1.

Results have all columns of the pages, part and part_page0. A page stands once in each
part that holds it, so only ranges that overlap repeat pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import half_boxes
from ..functions.names import pad_number, sanitize_title
from ..functions.ranges import parse_pages
from .intervals import within
from .pages import page_count, per_doc
from .prefix import with_sums_before


def _numbered(pages: DataFrame) -> DataFrame:
    return pages.withColumn("part_page0", (F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("page0")) - 1).cast("int"))


def every_page(pages: DataFrame) -> DataFrame:
    return _numbered(pages.withColumn("part", (F.col("page0") + 1).cast("int")))


def fixed(pages: DataFrame, size: float | None) -> DataFrame:
    """Parts of so many pages; fractions are cut off, less than 1 and None count as 1."""
    each = max(1, int(size or 1))
    return _numbered(pages.withColumn("part", (F.floor(F.col("page0") / each) + 1).cast("int")))


def odd_even(pages: DataFrame, which: str = "both") -> DataFrame:
    """Odd pages as part 1, even ones as part 2, or one of them."""
    part = (F.col("page0") % 2 + 1).cast("int")
    wanted = {"odd": [1], "even": [2]}.get(which, [1, 2])
    return _numbered(pages.withColumn("part", part).where(F.col("part").isin(wanted)))


def by_size(pages: DataFrame, megabytes: float, size: str = "size") -> DataFrame:
    """Greedy parts of at most so many MiB, taking a document's pages for equally large; at least a page each."""
    share = F.greatest(F.lit(1.0), F.col(size) / page_count())
    each = F.greatest(F.lit(1), F.floor(F.lit(megabytes * 1024 * 1024) / share))
    return _numbered(pages.withColumn("part", (F.floor(F.col("page0") / each) + 1).cast("int")))


def halves(pages: DataFrame, vertical: bool = True) -> DataFrame:
    """Each page as two, with box the half of (0, 0, width, height); page0 counts the halves."""
    boxes = half_boxes(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"), vertical)
    cut = pages.select("*", F.posexplode(boxes).alias("__half", "box"))
    return cut.withColumn("page0", (F.col("page0") * 2 + F.col("__half")).cast("int")).drop("__half")


def selection(pages: DataFrame, pages_text: str) -> DataFrame:
    """The selected pages, each as a part."""
    counted = pages.withColumn("__n", page_count())
    hit = F.array_contains(parse_pages(F.lit(pages_text), F.col("__n")), (F.col("page0") + 1).cast("int"))
    kept = counted.where(hit).drop("__n")
    return _numbered(kept.withColumn("part", F.row_number().over(per_doc().orderBy("page0"))))


def ranges(pages: DataFrame, wanted: list[tuple[float, float]]) -> DataFrame:
    """A part for each range of page numbers that holds pages; overlapping ranges repeat pages.

    The ranges become an array in each row, so that the pages are neither joined nor shuffled for it.
    """
    bounds = [(int(min(a, b)), int(max(a, b))) for a, b in wanted]
    listed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(bounds)])
    place = F.col("page0") + 1
    met = F.filter(listed, lambda r: (r["a"] <= place) & (place <= r["b"]))
    found = pages.withColumn("__range", F.explode(F.transform(met, lambda r: r["i"])))
    part = F.dense_rank().over(per_doc().orderBy("__range"))
    return _numbered(found.withColumn("part", part).drop("__range"))


def by_ranges(pages: DataFrame, wanted: DataFrame, merged: bool = False) -> DataFrame:
    """A part for each range of its document that holds pages, or merged one part of all; overlapping ranges repeat pages.

    wanted has doc_id, ord, which orders the ranges of a document and tells them apart, a and
    b, the page numbers of both ends in either order; fractions are cut off, ends that are no
    numbers drop their range, ranges are cut to the document. Pages meet ranges by place, and
    parts are numbered over ranges, not over pages: a document of any number of pages and
    ranges is dealt out.
    """
    sizes = pages.groupBy(F.col("doc_id").alias("__doc")).agg(F.count("*").alias("__n"))
    ends = [F.col(c).cast("double") for c in "ab"]
    low, high = F.floor(F.least(*ends)), F.floor(F.greatest(*ends))
    first, last = F.greatest(low, F.lit(1)) - 1, F.least(high, F.col("__n")) - 1
    finite = [~F.isnan(e) & (F.abs(e) < float("inf")) for e in ends]
    held = wanted.where(finite[0] & finite[1]).join(sizes, F.col("doc_id").eqNullSafe(F.col("__doc")))
    held = held.select("doc_id", "ord", first.alias("__first"), last.alias("__last")).where("__first <= __last")
    counts = {"__parts": F.lit(1).cast("long"), "__pages": F.col("__last") - F.col("__first") + 1}
    counted = with_sums_before(held, ["doc_id"], ["ord"], counts)
    part, before = (F.lit(1), F.col("__pages")) if merged else (F.col("__parts") + 1, F.lit(0))
    parts = counted.select("doc_id", part.cast("int").alias("part"), before.alias("__before"), "__first", "__last")
    found = within(pages, parts, "doc_id", "page0", "__first", "__last")
    place = F.col("__before") + F.col("page0") - F.col("__first")
    return found.withColumn("part_page0", place.cast("int")).drop("__first", "__last", "__before")


def resolve_destinations(outline: DataFrame, destinations: DataFrame) -> DataFrame:
    """outline (doc_id, ord, title, name, page0) with page0 found: its own, or that of its named destination.

    destinations has doc_id, name and page0. What leads nowhere keeps a null page0, which
    outline_ranges() passes over; of a name given twice the first page counts.
    """
    named = destinations.groupBy(F.col("doc_id").alias("__doc"), F.col("name").alias("__name")).agg(F.min("page0").alias("__page0"))
    joined = outline.join(named, (F.col("doc_id") == F.col("__doc")) & (F.col("name") == F.col("__name")), "left")
    return joined.withColumn("page0", F.coalesce("page0", "__page0")).drop("__doc", "__name", "__page0")


def outline_ranges(outline: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, part, start0, end0 and title of the chapters of an outline (doc_id, ord, title, page0).

    documents has doc_id and n_pages. Places are cut to the document, the first title of
    a page wins, a chapter ends before the next; pages before the first are in none.
    """
    within = outline.where("page0 is not null").join(documents.select("doc_id", "n_pages"), "doc_id")
    start = F.greatest(F.lit(0), F.least(F.col("page0"), F.col("n_pages") - 1)).cast("int")
    first = within.withColumn("start0", start).groupBy("doc_id", "n_pages", "start0").agg(F.min_by("title", "ord").alias("title"))
    order = per_doc().orderBy("start0")
    end = F.coalesce(F.lead("start0").over(order) - 1, F.col("n_pages") - 1).cast("int")
    return first.select("doc_id", F.row_number().over(order).alias("part"), "start0", end.alias("end0"), "title")


def by_outline(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """The pages of each chapter, with part and title."""
    sizes = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    chapters = outline_ranges(outline, sizes).select(F.col("doc_id").alias("__doc"), "part", "start0", "end0", "title")
    inside = (F.col("doc_id") == F.col("__doc")) & F.col("page0").between(F.col("start0"), F.col("end0"))
    return _numbered(pages.join(chapters, inside).drop("__doc", "start0", "end0"))


def part_name(base: Column, part: Column, total: Column, title: Column | None = None) -> Column:
    """report-page-03, or report-Chapter for a title."""
    if title is not None:
        return F.concat_ws("-", base, sanitize_title(title, part))
    return F.concat(base, F.lit("-page-"), pad_number(part, total))
