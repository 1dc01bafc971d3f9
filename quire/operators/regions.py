"""Regions of pages: finding personal data and search terms, and uniting redactions.

Text items have doc_id, page0, item, str, x, y, w, h, page_w and page_h; regions have
doc_id, page0 and region, a struct<x, y, w, h> of fractions of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import contains, text_region
from ..functions.text import MAY_MATCH, PII_PATTERNS, literal_pattern, match_spans
from .lineage import bounded, stored

#: In pages of up to so many regions each is compared with all others.
CROWDED = 32


def items_of_text(documents: DataFrame, page_w: float = 612.0, line_h: float = 12.0) -> DataFrame:
    """The lines of doc_id and text as text items of one page, one below the other."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("item", "str"))
    return lines.select(
        "doc_id", F.lit(0).alias("page0"), "item", "str", F.lit(0.0).alias("x"),
        (F.col("item") * line_h).alias("y"), F.lit(page_w).alias("w"), F.lit(line_h).alias("h"),
        F.lit(page_w).alias("page_w"), ((F.col("item") + 1) * line_h).alias("page_h"),
    )


def find_spans(items: DataFrame, presets: list[str] = tuple(PII_PATTERNS), term: str = "") -> DataFrame:
    """doc_id, page0, item, preset, start and end of every match; preset is "search" for the term."""
    patterns = {k: PII_PATTERNS[k] for k in presets}
    if term.strip():
        patterns["search"] = literal_pattern(term)
    else:
        items = items.where(F.col("str").rlike(MAY_MATCH))

    def named(preset: str, pattern: str) -> Column:
        one = lambda s: F.struct(F.lit(preset).alias("preset"), s["start"].alias("start"), s["end"].alias("end"))
        return F.transform(match_spans(F.col("str"), pattern), one)

    kinds = [named(k, p) for k, p in patterns.items()]
    return items.select("*", F.explode(F.concat(*kinds)).alias("span")).select("*", "span.*").drop("span")


def detect(items: DataFrame, presets: list[str] = tuple(PII_PATTERNS), term: str = "") -> DataFrame:
    """doc_id, page0, preset and region of every match that covers an area."""
    found = find_spans(items, presets, term)
    n = F.length("str").cast("double")
    region = text_region(*[F.col(c) for c in ("x", "y", "w", "h", "page_w", "page_h")], F.col("start") / n, F.col("end") / n)
    return found.select("doc_id", "page0", "preset", region.alias("region")).where("region is not null")


def unite(manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """Both sets of regions less those inside another of their page; of equal ones the first stays, manual first."""
    both = manual.select("doc_id", "page0", "region", F.lit(0).alias("__source")).unionByName(
        automatic.select("doc_id", "page0", "region", F.lit(1).alias("__source"))
    )
    return drop_contained(both, ["doc_id", "page0"]).drop("__source")


def _level(size: Column) -> Column:
    """The smallest power of two, as its exponent, that is larger than a size; -40 for next to nothing."""
    return (F.floor(F.log2(F.greatest(size, F.lit(2.0**-41)))) + 1).cast("int")


def _contained(distinct: DataFrame) -> DataFrame:
    """__page and region of the regions inside another one of their page, which meet by place.

    A region lies in cells as large as its level: one or two across, one or two down. What is
    inside of it begins in one of them, so each region looks up its own cell at every
    larger level that its page has. The work grows with the regions and the levels.
    """
    box, shrunk = F.col("region"), 1 - 1e-9  # rounding never hides a region that is a hair too large
    outer = distinct.select("__page", box.alias("__outer"))
    for at, size in (("x", "w"), ("y", "h")):
        cell = lambda v, k=at: F.floor(v / F.pow(F.lit(2.0), F.col(f"__level_{k}")))
        first = F.col("__outer")[at]
        outer = outer.withColumn(f"__level_{at}", _level(F.col("__outer")[size]))
        outer = outer.withColumn(f"__cell_{at}", F.explode(F.array_distinct(F.array(cell(first), cell(first + F.col("__outer")[size])))))
    levels = outer.groupBy("__page").agg(F.collect_set(F.struct("__level_x", "__level_y")).alias("__levels"))  # a few thousand a page at most
    larger = lambda s: (s["__level_x"] >= _level(box["w"] * shrunk)) & (s["__level_y"] >= _level(box["h"] * shrunk))
    probes = distinct.join(levels, "__page").select("__page", "region", F.explode(F.filter("__levels", larger)).alias("s")).select("__page", "region", "s.*")
    for at in "xy":
        probes = probes.withColumn(f"__cell_{at}", F.floor(box[at] / F.pow(F.lit(2.0), F.col(f"__level_{at}"))))
    met = probes.join(outer, ["__page", "__level_x", "__level_y", "__cell_x", "__cell_y"])
    return met.where(contains(F.col("__outer"), box) & (F.col("__outer") != box)).select("__page", "region").distinct()


def _apart_within(regions: DataFrame, page: list[str]) -> DataFrame:
    """drop_contained() for pages of few regions, each compared with all of its page: one shuffle and one sort."""
    order = [c for c in ("__source",) if c in regions.columns]
    same = F.struct("region")  # as a struct, so that null is equal to null
    before = F.lag(same).over(Window.partitionBy(*page).orderBy("region", *order))
    distinct = regions.withColumn("__before", before).where(~F.col("__before").eqNullSafe(same))
    boxes = distinct.withColumn("__boxes", F.collect_list("region").over(Window.partitionBy(*page)))
    box = F.col("region")
    inside = F.exists("__boxes", lambda o: F.coalesce(contains(o, box) & (o != box), F.lit(False)))
    return boxes.where(~inside).select(regions.columns)


def _apart_by_place(regions: DataFrame, page: list[str]) -> DataFrame:
    """drop_contained() for pages of any number of regions, which meet by place: neither a square nor one task."""
    order = [c for c in ("__source",) if c in regions.columns]
    first = Window.partitionBy(*page, "region").orderBy(*(order or [F.lit(1)]))
    distinct = regions.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
    distinct = stored(distinct.withColumn("__page", F.struct(*page)))  # as a struct, so that null is equal to null
    return distinct.join(_contained(distinct.select("__page", "region")), ["__page", "region"], "left_anti").select(regions.columns)


def drop_contained(regions: DataFrame, page: list[str]) -> DataFrame:
    """The regions that lie inside no other of the page; of equal ones one stays.

    Pages are counted first: in those of CROWDED regions or fewer all are compared, in others
    regions meet by place. Sizes are zero or more; nulls in page are a page.
    """
    rows = stored(regions)
    counts = rows.groupBy(*page).agg(F.count("*").alias("__n")).where(F.col("__n") > CROWDED)
    crowded = stored(counts.select(F.struct(*page).alias("__page")))
    if crowded.isEmpty():
        return _apart_within(rows, page)
    crowded, rows = bounded(crowded), rows.withColumn("__page", F.struct(*page))
    few, many = (rows.join(crowded, "__page", how).drop("__page") for how in ("left_anti", "left_semi"))
    return _apart_within(few, page).unionByName(_apart_by_place(many, page))
