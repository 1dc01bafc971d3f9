"""Decisions between candidates and formats, and budgets of sizes and characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import as_number, clamp_int, half_up

# Image formats as (type, extension, lossy), and what compressing makes of each type.
IMAGE_FORMATS = {
    "PNG": ("image/png", "png", False),
    "JPG": ("image/jpeg", "jpg", True),
    "WEBP": ("image/webp", "webp", True),
    "BMP": ("image/bmp", "bmp", False),
}
COMPRESSED_TYPES = {"image/jpeg": "image/jpeg", "image/png": "image/webp", "image/webp": "image/webp"}
ICON_SIZES = [16, 32, 48, 64, 128, 256]
ICON_DEFAULT = [16, 32, 48]
# Quality, longest image edge and raster dpi by level.
PDF_LEVELS = {"smaller": (0.5, 1000, 96), "balanced": (0.72, 1600, 120), "better": (0.85, 2200, 150)}


def meaningful_reduction(before: Column, after: Column) -> Column:
    """Whether a result has at most 97 % of the original's size."""
    return after <= before * 0.97


def smallest(original: Column, *candidates: Column) -> Column:
    """The smallest of structs with size; the original unless one is smaller, null ones do not count."""
    best = original
    for c in candidates:
        best = F.when(c.isNotNull() & (c["size"] < best["size"]), c).otherwise(best)
    return best


def compressed_type(mime: Column, palette: Column) -> Column:
    """The type that compressing an image gives; a palette keeps PNG."""
    table = F.create_map(*[F.lit(x) for pair in COMPRESSED_TYPES.items() for x in pair])
    return F.when((mime == "image/png") & palette, mime).otherwise(F.try_element_at(table, mime))


def image_targets(wanted: dict[str, Column]) -> Column:
    """array<struct<format, mime, extension, lossy>> of the formats whose column is true, in their fixed order."""
    one = lambda k, v: F.struct(F.lit(k).alias("format"), F.lit(v[0]).alias("mime"), F.lit(v[1]).alias("extension"), F.lit(v[2]).alias("lossy"))
    each = [F.when(F.coalesce(wanted.get(k, F.lit(False)), F.lit(False)), one(k, v)) for k, v in IMAGE_FORMATS.items()]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def icon_sizes(text: Column) -> Column:
    """The supported sizes in a comma list, unique and ascending; the default ones if it names none."""
    numbers = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int"))
    supported = F.array(*map(F.lit, ICON_SIZES))
    found = F.array_sort(F.array_intersect(numbers, supported))
    return F.when(F.size(found) == 0, F.array(*map(F.lit, ICON_DEFAULT))).otherwise(found)


def pdf_level(level: Column) -> Column:
    """struct<quality, edge, dpi> of a compression level, balanced if it is none."""
    struct = lambda v: F.struct(F.lit(v[0]).alias("quality"), F.lit(v[1]).alias("edge"), F.lit(v[2]).alias("dpi"))
    table = F.create_map(*[x for k, v in PDF_LEVELS.items() for x in (F.lit(k), struct(v))])
    return F.coalesce(F.try_element_at(table, level), struct(PDF_LEVELS["balanced"]))


def clamp_dpi(value: Column) -> Column:
    """0, for as it is, to 1200."""
    return clamp_int(F.coalesce(value.cast("string"), F.lit("0")), 0, 1200, 0)


def any_angle(value: Column) -> Column:
    """Degrees in [0, 360); 0 for what is no number."""
    n = as_number(F.coalesce(value.cast("string"), F.lit("0")))
    return F.coalesce(F.pmod(n, F.lit(360.0)), F.lit(0.0))


def target_page(page: Column, n_pages: Column) -> Column:
    """The page a signature goes to, from 0: the last for 0, less, none or beyond the end."""
    wanted = half_up(page)
    return F.when((wanted >= 1) & (wanted <= n_pages), wanted - 1).otherwise(n_pages - 1).cast("int")


def quad_points(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """The corners of a fractional box in points: upper left and right, lower left and right."""
    left, right, low, high = x * page_w, (x + w) * page_w, (1 - y - h) * page_h, (1 - y) * page_h
    return F.array(left, high, right, high, left, low, right, low)


def svg_path(points: Column, page_w: Column, page_h: Column) -> Column:
    """An SVG path through fractional points; empty for fewer than two."""
    text = F.transform(points, lambda p: F.concat_ws(",", (p["x"] * page_w).cast("string"), (p["y"] * page_h).cast("string")))
    return F.when(F.size(points) < 2, "").otherwise(F.concat(F.lit("M "), F.array_join(text, " L ")))


def opacity_alpha(percent: Column) -> Column:
    return percent / 100


def jpeg_options(quality: Column, progressive: Column, chroma: Column, grayscale: Column) -> Column:
    """struct of a JPEG encoder: chroma "4:4:4" keeps all colour samples; colour space 1 is grey, 3 is YCbCr."""
    return F.struct(
        quality.alias("quality"), F.lit(False).alias("baseline"), F.coalesce(progressive, F.lit(False)).alias("progressive"),
        F.lit(False).alias("auto_subsample"), F.when(chroma == "4:4:4", 1).otherwise(2).alias("chroma_subsample"),
        F.when(F.coalesce(grayscale, F.lit(False)), 1).otherwise(3).alias("color_space"),
    )


# Options of tracing as (default, whether zero counts).
TRACE_OPTIONS = {
    "filterSpeckle": (4, True), "cornerThreshold": (60, True), "lengthThreshold": (4, False),
    "maxIterations": (10, False), "spliceThreshold": (45, True), "pathPrecision": (8, True),
}
TRACE_MODES = ["polygon", "spline", "none"]


def trace_options(mode: Column, numbers: dict[str, Column]) -> Column:
    """struct of a tracer's options from columns of numbers; what is missing or too small takes its default."""
    chosen = F.when(mode.isin(TRACE_MODES), mode).otherwise("spline")
    each = []
    for name, (default, zero) in TRACE_OPTIONS.items():
        value = numbers.get(name, F.lit(None)).cast("double")
        each.append(F.when(value >= 0 if zero else value > 0, value).otherwise(float(default)).alias(name))
    return F.struct(chosen.alias("mode"), *each)


def archive_metadata(name: Column, title: Column, created: Column, now: Column, creator: str) -> Column:
    """struct of what an archival PDF states of itself: a missing title is the file's stem, a missing date is now."""
    stem = F.regexp_replace(name, r"(?s)^(.+)\.[^.]*\z", "$1")
    return F.struct(
        F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(stem).alias("title"), F.lit(creator).alias("creator"),
        F.coalesce(created, now).alias("created"), now.alias("modified"),
        F.lit("GTS_PDFA1").alias("output_intent"), F.lit("sRGB IEC61966-2.1").alias("profile"),
        F.lit(1).alias("part"), F.lit("B").alias("conformance"), F.lit(False).alias("object_streams"),
    )
