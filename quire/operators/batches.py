"""Images in batches: which one of a file counts, which re-encoding stays, how they become documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import replace_extension
from .archives import unique_names

#: The name of a document that holds all images of its batch.
MERGED = "images.pdf"


def primary_images(frames: DataFrame) -> DataFrame:
    """One of the images of each file (file_id, ord, is_primary, ...): the first that says it is primary, else the first.

    A null is_primary says nothing. Nothing but the smallest rank of a file is kept while images are met.
    """
    rank = F.struct((~F.coalesce("is_primary", F.lit(False))).alias("other"), "ord")
    row = F.struct(*[F.col(f"`{c}`") for c in frames.columns])
    return frames.groupBy(F.col("file_id").alias("__file")).agg(F.min_by(row, rank).alias("__row")).select("__row.*")


def may_reencode(filters: Column, has_mask: Column, has_decode: Column) -> Column:
    """Whether an embedded image may be encoded anew: JPEG data alone, without masks and without remapped samples."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.coalesce(filters == "/DCTDecode", F.lit(False)) & no(has_mask) & no(has_decode)


def kept_encoding(may: Column, size: Column, new_size: Column) -> Column:
    """"reencoded" where the new encoding may stand in and is smaller, else "original"; a failed one has a null size."""
    return F.when(may & F.coalesce(new_size < size, F.lit(False)), "reencoded").otherwise("original")


def image_documents(images: DataFrame, each: bool = False) -> DataFrame:
    """images (batch_id, ord, name, ...) with document, the name of the PDF that each goes to, and page0, its place there.

    One document for each batch, or with each one for each image, whose names are unique
    within the batch: a.jpg and a.png give a.pdf and a-2.pdf.
    """
    if not each:
        place = F.row_number().over(Window.partitionBy("batch_id").orderBy("ord")) - 1
        return images.withColumns({"document": F.lit(MERGED), "page0": place.cast("int")})
    wanted = images.select(F.col("batch_id").alias("archive_id"), "ord", replace_extension(F.col("name"), "pdf").alias("name"))
    named = unique_names(wanted).select(F.col("archive_id").alias("__batch"), F.col("ord").alias("__ord"), F.col("name").alias("document"))
    same = F.col("batch_id").eqNullSafe(F.col("__batch")) & (F.col("ord") == F.col("__ord"))
    return images.join(named, same).drop("__batch", "__ord").withColumn("page0", F.lit(0))
