"""The catalog of operators: what each takes, gives and can be told, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, least inputs, one run per file, many outputs, accepted types, extension, options.
CATALOG = [
    ("audio-converter", 1, False, False, ["audio/*"], "mp3", ["format"]),
    ("compare-pdf", 1, False, False, ["application/pdf"], "html", ["fileB"]),
    ("compress-gif", 1, True, False, ["image/gif"], "gif", ["level"]),
    ("compress-image", 1, True, False, ["image/jpeg", "image/png", "image/webp"], "webp", ["mode", "quality", "targetKb", "grayscale", "progressive", "chroma", "pngQuantize", "pngColors", "autoOrient", "dpi"]),
    ("compress-pdf", 1, True, False, ["application/pdf"], "pdf", ["level", "losslessRepack"]),
    ("compress-video", 1, True, False, ["video/mp4"], "mp4", ["mode", "level", "bitrate", "targetMb", "resolution"]),
    ("create-tar", 1, False, False, ["any"], "tar", []),
    ("create-zip", 1, False, False, ["any"], "zip", []),
    ("crop-pdf", 1, False, False, ["application/pdf"], "pdf", ["marginTop", "marginRight", "marginBottom", "marginLeft"]),
    ("csv-to-json", 1, False, False, ["text/csv", "application/vnd.ms-excel"], "json", []),
    ("json-to-csv", 1, False, False, ["application/json"], "csv", []),
    ("delete-pdf-pages", 1, False, False, ["application/pdf"], "pdf", ["pages"]),
    ("epub-to-pdf", 1, False, False, ["application/epub+zip"], "pdf", []),
    ("extract-audio", 1, False, False, ["video/mp4"], "mp3", ["format"]),
    ("extract-pdf-images", 1, False, True, ["application/pdf"], "png", []),
    ("extract-zip", 1, False, True, ["application/zip", "application/x-zip-compressed"], "(per entry)", []),
    ("flac-to-mp3", 1, False, False, ["audio/flac", "audio/x-flac"], "mp3", []),
    ("flatten-pdf", 1, False, False, ["application/pdf"], "pdf", []),
    ("flip-video", 1, False, False, ["video/mp4"], "mp4", ["direction"]),
    ("gif-to-mp4", 1, False, False, ["image/gif"], "mp4", []),
    ("gzip", 1, False, False, ["any"], "gz", []),
    ("heic-to-jpg", 1, False, False, ["image/heic", "image/heif"], "jpg", []),
    ("html-to-pdf", 1, False, False, ["text/html"], "pdf", []),
    ("image-converter", 1, False, True, ["image/png", "image/jpeg", "image/webp", "image/gif", "image/bmp"], "png", ["formats", "quality", "background", "autoOrient", "dpi"]),
    ("image-crop", 1, False, False, ["image/jpeg", "image/png", "image/webp"], "png", ["crop"]),
    ("image-flip", 1, False, False, ["image/jpeg", "image/png", "image/webp"], "png", ["flip", "Horizontal", "Vertical"]),
    ("image-resize", 1, False, False, ["image/jpeg", "image/png", "image/webp"], "png", ["resizeBy", "size", "percentage", "noEnlarge", "format", "quality", "autoOrient", "dpi"]),
    ("image-rotate", 1, False, False, ["image/jpeg", "image/png", "image/webp"], "png", ["angle"]),
    ("image-to-ico", 1, False, False, ["image/jpeg", "image/png", "image/webp", "image/gif"], "ico", []),
    ("image-upscale", 1, False, False, ["image/jpeg", "image/png", "image/webp"], "png", ["scale", "sharpen", "format"]),
    ("images-to-pdf", 1, False, False, ["image/jpeg", "image/png"], "pdf", ["output", "pageSize", "orientation", "margin"]),
    ("m4a-to-mp3", 1, False, False, ["audio/mp4", "audio/x-m4a", "audio/m4a", "audio/aac"], "mp3", []),
    ("mp3-to-m4a", 1, False, False, ["audio/mpeg", "audio/mp3"], "m4a", []),
    ("mp3-to-wav", 1, False, False, ["audio/mpeg"], "wav", []),
    ("mp4-to-gif", 1, False, False, ["video/mp4"], "gif", ["fps", "width", "colors", "dither", "height", "loop", "trim"]),
    ("mp4-to-webm", 1, False, False, ["video/mp4"], "webm", []),
    ("mute-video", 1, False, False, ["video/mp4"], "mp4", []),
    ("ogg-to-mp3", 1, False, False, ["audio/ogg", "application/ogg", "audio/vorbis"], "mp3", []),
    ("add-page-numbers", 1, False, False, ["application/pdf"], "pdf", ["position", "facing", "format", "template", "start", "relativeStart", "excludeFirst", "excludeLast", "box", "boxOpacity", "fontSize"]),
    ("pdf-editor", 1, False, False, ["application/pdf"], "pdf", []),
    ("pdf-to-jpg", 1, False, True, ["application/pdf"], "jpg", []),
    ("pdf-to-png", 1, False, True, ["application/pdf"], "png", []),
    ("pdf-merge", 2, False, False, ["application/pdf"], "pdf", []),
    ("pdf-split", 1, False, True, ["application/pdf"], "pdf", []),
    ("pdf-to-pdfa", 1, False, False, ["application/pdf"], "pdf", []),
    ("pdf-to-text", 1, False, False, ["application/pdf"], "txt", ["format"]),
    ("png-to-jpg", 1, False, False, ["image/png"], "jpg", ["quality", "background"]),
    ("jpg-to-png", 1, False, False, ["image/jpeg", "image/jpg"], "png", []),
    ("png-to-svg", 1, False, False, ["image/png"], "svg", []),
    ("protect-pdf", 1, False, False, ["application/pdf"], "pdf", ["password", "ownerPassword", "printing", "allowCopy", "allowModify", "allowAnnotate", "allowForm", "allowAccessibility", "allowAssembly"]),
    ("redact-pdf", 1, False, False, ["application/pdf"], "pdf", []),
    ("remove-background", 1, False, False, ["image/jpeg", "image/png", "image/webp"], "png", []),
    ("remove-vocals", 1, False, False, ["audio/*"], "mp3", []),
    ("reorder-pdf-pages", 1, False, False, ["application/pdf"], "pdf", ["operation", "order", "insertAt", "blankSize", "duplicatePage", "secondPdf"]),
    ("repair-pdf", 1, False, False, ["application/pdf"], "pdf", ["linearize"]),
    ("reverse-video", 1, False, False, ["video/mp4"], "mp4", []),
    ("rotate-pdf-pages", 1, False, False, ["application/pdf"], "pdf", ["angle", "pages"]),
    ("sign-pdf", 1, False, False, ["application/pdf"], "pdf", []),
    ("svg-to-png", 1, False, False, ["image/svg+xml"], "png", ["scale", "background"]),
    ("unlock-pdf", 1, False, False, ["application/pdf"], "pdf", ["password"]),
    ("video-crop", 1, False, False, ["video/mp4"], "mp4", []),
    ("video-speed", 1, False, False, ["video/mp4"], "mp4", ["speed"]),
    ("video-trim", 1, False, False, ["video/mp4"], "mp4", ["trim"]),
    ("watermark-pdf", 1, False, False, ["application/pdf"], "pdf", ["watermarkType", "logoFile", "text", "placement", "rotation", "opacity", "fontSize", "pages"]),
    ("wav-to-mp3", 1, False, False, ["audio/wav", "audio/x-wav", "audio/wave", "audio/vnd.wave"], "mp3", []),
    ("webm-to-mp4", 1, False, False, ["video/webm"], "mp4", []),
    ("webp-to-jpg", 1, False, False, ["image/webp"], "jpg", []),
    ("jpg-to-webp", 1, False, False, ["image/jpeg", "image/jpg"], "webp", []),
    ("webp-to-png", 1, False, False, ["image/webp"], "png", []),
    ("png-to-webp", 1, False, False, ["image/png"], "webp", ["quality"]),
]

# The kinds of options and the option columns each writes.
OPTION_KINDS = {
    "number": [""], "range": [""], "slider": [""], "select": [""], "text": [""], "checkbox": [""],
    "dimensions": ["Width", "Height", "KeepAspect"], "page-range": [""], "crop": ["X", "Y", "W", "H"],
    "time-range": ["Start", "End"], "angle": [""], "toggle-group": [""], "file": [""],
}

# Error codes and whether a user can mend them.
ERRORS = {
    "UNSUPPORTED_INPUT": False, "DECODE_FAILED": False, "ENCODE_FAILED": False, "TOOL_MISSING": True,
    "INFERENCE_FAILED": True, "CANCELLED": True, "UNKNOWN": False,
}


COLUMNS = "id string, least_inputs int, per_file boolean, many_outputs boolean, accepts array<string>, extension string, options array<string>"


def operators(spark: SparkSession) -> DataFrame:
    """A row for each operator, with COLUMNS."""
    return spark.createDataFrame(CATALOG, COLUMNS)


def operator_options(spark: SparkSession) -> DataFrame:
    """id, ord and option: a row for each option of each operator."""
    return operators(spark).select("id", F.posexplode("options").alias("ord", "option"))


def option_columns(name: str, kind: str) -> list[str]:
    """The columns that an option writes, such as sizeWidth of the dimensions option size."""
    return [name + suffix for suffix in OPTION_KINDS[kind]]
