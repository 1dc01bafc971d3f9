"""File names, paths, extensions and MIME types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import BLANK, trim_all

# MIME types by extension.
MIME_TYPES = {
    "txt": "text/plain",
    "csv": "text/csv",
    "json": "application/json",
    "xml": "application/xml",
    "html": "text/html",
    "htm": "text/html",
    "css": "text/css",
    "js": "text/javascript",
    "md": "text/markdown",
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "svg": "image/svg+xml",
    "bmp": "image/bmp",
    "ico": "image/x-icon",
    "mp3": "audio/mpeg",
    "wav": "audio/wav",
    "ogg": "audio/ogg",
    "mp4": "video/mp4",
    "webm": "video/webm",
    "zip": "application/zip",
}


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; the whole name if there is none."""
    return F.lower(F.substring_index(name, ".", -1))


def mime_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(name)), F.lit("application/octet-stream"))


def _dot(name: Column) -> Column:
    """The 1-based place of the last dot, 0 if there is none."""
    back = F.instr(F.reverse(name), ".")
    return F.when(back == 0, 0).otherwise(F.length(name) - back + 1)


def stem(name: Column) -> Column:
    """The name up to its last dot; a leading dot belongs to the name."""
    return F.when(_dot(name) > 1, F.substring(name, F.lit(1), _dot(name) - 1)).otherwise(name)


def suffix(name: Column) -> Column:
    """The last dot and what follows; empty if there is none or the name begins with it."""
    return F.when(_dot(name) > 1, F.substring(name, _dot(name), F.length(name))).otherwise("")


def replace_extension(name: Column, new: str) -> Column:
    return F.concat(stem(name), F.lit("." + new))


def with_suffix(name: Column, added: str, new: str | None = None) -> Column:
    """report.pdf as report-added.pdf, or with another extension."""
    return F.concat(stem(name), F.lit("-" + added), F.lit("." + new) if new else suffix(name))


def gzip_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.\z", ""), F.lit(".gz"))


def safe_basename(path: Column) -> Column:
    """The last segment that is no ".", ".." or empty; empty if none is."""
    kept = F.filter(F.split(path, r"[/\\]"), lambda s: ~s.isin("", ".", ".."))
    return F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))


def resolve_path(folder: Column, href: Column) -> Column:
    """An archive path from a relative reference: no fragment or query, dots resolved, a leading slash is the root."""
    bare = F.regexp_replace(href, r"[#?].*$", "")
    full = F.when(bare.startswith("/"), bare).otherwise(F.concat_ws("/", folder, bare))
    up = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    step = lambda s, x: (
        F.when(x.isin("", "."), s).when(x == "..", up(s)).otherwise(F.concat(s, F.array(x)))
    )
    none = F.expr("cast(array() as array<string>)")
    return F.aggregate(F.split(full, "/"), none, step, lambda s: F.array_join(s, "/"))


def sanitize_title(title: Column, index: Column) -> Column:
    """A title as a file name of at most 60 characters; part-<index> if nothing is left."""
    spaced = F.regexp_replace(F.coalesce(title, F.lit("")), r'[/\\:*?"<>|\x00-\x1F]', " ")
    short = trim_all(F.left(trim_all(F.regexp_replace(spaced, f"{BLANK}+", " ")), F.lit(60)))
    return F.when(short == "", F.concat(F.lit("part-"), index.cast("string"))).otherwise(short)


def pad_number(n: Column, total: Column) -> Column:
    """n with leading zeros to the width of total; never cut."""
    text, width = n.cast("string"), F.length(total.cast("string"))
    return F.lpad(text, F.greatest(F.length(text), width), F.lit("0"))


def natural_key(name: Column, collation: str = "UNICODE_CI_AI") -> Column:
    """A sort key in which digits count as numbers of any length and case and accents do not, by a collation.

    An array of structs: text as it collates, or for digits "0", which puts numbers where
    digits collate, with the number's length and digits. Leading zeros do not count.
    """
    tokens = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0))

    def key(token: Column) -> Column:
        number = token.rlike(r"^\d")
        digits = F.when(number, F.regexp_replace(token, r"^0+(?=\d)", "")).otherwise("")
        text = F.when(number, "0").otherwise(token)
        return F.struct(F.collate(text, collation).alias("text"), F.length(digits).alias("length"), digits.alias("digits"))

    return F.transform(tokens, key)


def accepts(mime: Column, name: Column, types: list[str], extensions: list[str] = ()) -> Column:
    """Whether a file may enter an operator: by MIME type, or by extension where it has no type."""
    typed = F.coalesce(mime.isin(*types), F.lit(False))
    blank = F.coalesce(mime, F.lit("")) == ""
    return typed | (blank & extension(name).isin(*extensions)) if extensions else typed


# Types that are HEIC, and image types that no extension makes HEIC.
HEIC_TYPES = ["image/heic", "image/heif", "image/heic-sequence", "image/heif-sequence"]
OTHER_IMAGES = ["image/jpeg", "image/png", "image/webp", "image/gif", "image/bmp", "image/tiff", "image/svg+xml", "image/avif"]


def accepts_heic(mime: Column, name: Column) -> Column:
    """Whether a file is taken for HEIC: by its type, or by its extension unless the type is another image's."""
    given = F.lower(F.coalesce(mime, F.lit("")))
    by_name = F.lower(F.substring_index(name, ".", -1)).isin("heic", "heif")
    return given.isin(HEIC_TYPES) | (~given.isin(OTHER_IMAGES) & by_name)


def accepts_table(mime: Column, name: Column, kind: str) -> Column:
    """Whether a file is taken for "csv" (a type that says csv) or "json": untyped ones are, others by their extension."""
    given = F.coalesce(mime, F.lit(""))
    typed = given.contains("csv") if kind == "csv" else given == "application/json"
    return typed | (given == "") | F.coalesce(name.endswith(f".{kind}"), F.lit(False))
