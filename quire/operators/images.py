"""Images as Spark's image struct, changed and encoded with numpy in Arrow batches.

Pixels come as the image source reads them: rows of B, G, R and perhaps A. An image is
one row; results keep that form until png() encodes them.
"""

from __future__ import annotations

import bisect
import math
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ICO_SIZES = (16, 32, 48, 64, 128, 256)
#: OpenCV's codes of 8-bit images by number of channels.
MODES = {1: 0, 3: 16, 4: 24}


def pixels(image: dict) -> np.ndarray:
    """height x width x channels, in the order R, G, B, A."""
    n = image["nChannels"]
    p = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], n)
    return p[:, :, [2, 1, 0, 3][:n]] if n > 1 else p


def as_image(p: np.ndarray, origin: str = "") -> dict:
    h, w, n = p.shape
    data = p[:, :, [2, 1, 0, 3][:n]] if n > 1 else p
    return {"origin": origin, "height": h, "width": w, "nChannels": n, "mode": MODES[n], "data": np.ascontiguousarray(data).tobytes()}


def change(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], column: str = "image") -> DataFrame:
    """images with kernel applied to the pixels of a column; images that were not read stay null."""
    index = images.columns.index(column)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            image = batch.column(index)
            done = [
                None if x is None or not x["data"] else as_image(kernel(pixels(x)), x["origin"]) for x in image.to_pylist()
            ]
            columns = [pa.array(done, image.type) if i == index else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return images.mapInArrow(run, images.schema)


def opaque(p: np.ndarray, background: int = 255) -> np.ndarray:
    """Without alpha, on a background."""
    if p.shape[2] < 4:
        return p
    alpha = p[:, :, 3:].astype(np.float64) / 255
    return np.floor(p[:, :, :3] * alpha + background * (1 - alpha) + 0.5).astype(np.uint8)


def luma(p: np.ndarray) -> np.ndarray:
    """The grey value of each pixel in all its colour channels."""
    if p.shape[2] == 1:
        return p
    grey = np.floor(p[:, :, :3] @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)
    return np.concatenate([np.repeat(grey[:, :, None], 3, axis=2), p[:, :, 3:]], axis=2)


def sharpen(p: np.ndarray) -> np.ndarray:
    """Five times a pixel less its four neighbours, edges repeated; alpha stays."""
    c = np.pad(p[:, :, :3].astype(np.int32), ((1, 1), (1, 1), (0, 0)), mode="edge")
    sharp = 5 * c[1:-1, 1:-1] - c[:-2, 1:-1] - c[2:, 1:-1] - c[1:-1, :-2] - c[1:-1, 2:]
    return np.concatenate([np.clip(sharp, 0, 255).astype(np.uint8), p[:, :, 3:]], axis=2)


def flip(p: np.ndarray, horizontal: bool, vertical: bool) -> np.ndarray:
    return p[:: -1 if vertical else 1, :: -1 if horizontal else 1]


def crop(p: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return p[y : y + h, x : x + w]


def resample(p: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = p.shape[:2]

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(h, height)
    x0, x1, fx = axis(w, width)
    q = p.astype(np.float64)
    rows = q[y0] * (1 - fy)[:, None, None] + q[y1] * fy[:, None, None]
    return np.floor(rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None] + 0.5).astype(np.uint8)


def rotate(p: np.ndarray, degrees: float, background: int = 0) -> np.ndarray:
    """Clockwise, on a canvas that holds all of it; quarter turns are exact."""
    if degrees % 90 == 0:
        return np.rot90(p, -int(degrees // 90) % 4)
    h, w, n = p.shape
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    out_w, out_h = max(1, math.floor(w * abs(c) + h * abs(s) + 0.5)), max(1, math.floor(w * abs(s) + h * abs(c) + 0.5))
    y, x = np.mgrid[0:out_h, 0:out_w]
    dx, dy = x - (out_w - 1) / 2, y - (out_h - 1) / 2
    at_x, at_y = np.rint(c * dx + s * dy + (w - 1) / 2).astype(int), np.rint(-s * dx + c * dy + (h - 1) / 2).astype(int)
    inside = (at_x >= 0) & (at_x < w) & (at_y >= 0) & (at_y < h)
    out = np.full((out_h, out_w, n), background, np.uint8)
    out[inside] = p[at_y[inside], at_x[inside]]
    return out


def letterboxed(p: np.ndarray, side: int = 512, grey: int = 128) -> np.ndarray:
    """Inside a square, centred, on grey."""
    h, w = p.shape[:2]
    scale = min(side / w, side / h)
    dw, dh = max(1, int(w * scale)), max(1, int(h * scale))
    out = np.full((side, side, p.shape[2]), grey, np.uint8)
    y, x = (side - dh) // 2, (side - dw) // 2
    out[y : y + dh, x : x + dw] = resample(p, dw, dh)
    return out


def planar(p: np.ndarray) -> np.ndarray:
    """Colour planes one after the other, -1 to 1."""
    return (p[:, :, :3].astype(np.float32) / 127.5 - 1).transpose(2, 0, 1)


def unpack_bits(data: bytes, width: int, height: int) -> np.ndarray | None:
    """One bit a pixel, the highest first, rows padded to bytes; null if there are too few."""
    row = (width + 7) // 8
    if len(data) < row * height:
        return None
    bits = np.unpackbits(np.frombuffer(data, np.uint8)[: row * height].reshape(height, row), axis=1)[:, :width]
    return (bits * 255)[:, :, None]


def unpack(data: bytes, width: int, height: int, channels: int) -> np.ndarray | None:
    """Three or four bytes a pixel as R, G, B, A, opaque without A; null if there are too few or there is no pixel."""
    size = width * height * channels
    if channels not in (3, 4) or size <= 0 or len(data) < size:
        return None
    p = np.frombuffer(data, np.uint8)[:size].reshape(height, width, channels)
    return p if channels == 4 else np.concatenate([p, np.full((height, width, 1), 255, np.uint8)], axis=2)


def orientation(content: bytes | None) -> int:
    """The Exif orientation of a JPEG file, 1 to 8; 1 if it states none."""
    data, at = content or b"", 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
            if order is None:
                return 1
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)
            first = number(4, 4)
            for entry in range(first + 2, first + 2 + 12 * number(first, 2), 12):
                if number(entry, 2) == 0x0112:
                    found = number(entry + 8, 2)
                    return found if 1 <= found <= 8 else 1
            return 1
        at += 2 + max(2, size)
    return 1


def upright(p: np.ndarray, code: int) -> np.ndarray:
    """An image as it is meant to be seen, by its Exif orientation."""
    turns, mirrored = {1: (0, False), 2: (0, True), 3: (2, False), 4: (2, True), 5: (3, True), 6: (3, False), 7: (1, True), 8: (1, False)}[code]
    turned = np.rot90(p, turns)
    return np.ascontiguousarray(turned[:, ::-1] if mirrored else turned)


def orientations(files: DataFrame, content: str = "content") -> DataFrame:
    """files with orientation, 1 to 8."""

    @F.arrow_udf("int")
    def found(values):
        import pyarrow as pa

        return pa.array([orientation(x.as_py()) for x in values], pa.int32())

    return files.withColumn("orientation", found(F.col(content)))


def straightened(images: DataFrame, files: DataFrame, column: str = "image") -> DataFrame:
    """images as they are meant to be seen; files has file_id (the path) and content of the files that they were read from.

    Only the head of a file goes along, since that is where its orientation stands.
    """
    path = lambda text: F.regexp_replace(text, r"^([A-Za-z0-9]+):/+", "$1:/")
    heads = files.select(path(F.col("file_id")).alias("__path"), F.substring("content", 1, 1 << 17).alias("content"))
    stated = orientations(heads).where("orientation > 1").select("__path", "orientation")
    joined = images.join(stated, path(F.col(column)["origin"]) == F.col("__path"), "left").select(*images.columns, "orientation")
    index = images.columns.index(column)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            image, codes = batch.column(index), batch.column("orientation").to_pylist()
            done = [
                x if x is None or not code or not x["data"] else as_image(upright(pixels(x), code), x["origin"])
                for x, code in zip(image.to_pylist(), codes, strict=True)
            ]
            columns = [pa.array(done, image.type) if i == index else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, images.schema)


def distinct_images(paints: DataFrame) -> DataFrame:
    """paints (doc_id, page0, ord, object_id, width, height, kind), the first of each image, with index from 1.

    An image object counts once in a document, an inline image (object_id null) once for
    its size and kind. Objects of a page come before its inline images.
    """
    inline = F.col("object_id").isNull()
    size = F.concat_ws(":", F.concat_ws("x", "width", "height"), F.coalesce(F.col("kind").cast("string"), F.lit("?")))
    keyed = paints.withColumn("__key", F.when(inline, F.concat(F.lit("inline:"), size)).otherwise(F.concat(F.lit("object:"), "object_id")))
    order = F.struct("page0", inline.alias("inline"), "ord")
    first = keyed.withColumn("__place", order).groupBy("doc_id", "__key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in paints.columns]), "__place").alias("row"), F.min("__place").alias("__place"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("__place"))
    return first.select("row.*", index.alias("index"))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(p: np.ndarray, dpi: int = 0) -> bytes:
    h, w, n = p.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), p.reshape(h, w * n)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    density = chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1)) if dpi else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + density + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def palette(p: np.ndarray, colors: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A table of at most so many colours, 2 to 256, and each pixel's place in it.

    An image of no more colours keeps them all; of others, colours that agree in their
    highest bits become their mean, with as many bits as the table allows.
    """
    colors = min(256, max(2, colors))
    flat = p.reshape(-1, p.shape[2]).astype(np.int64)
    for bits in range(8, -1, -1):
        _, at, n = np.unique(flat >> (8 - bits), axis=0, return_inverse=True, return_counts=True)
        if len(n) <= colors:
            at = at.ravel()
            sums = np.stack([np.bincount(at, c, len(n)) for c in flat.T], axis=1)
            return np.floor(sums / n[:, None] + 0.5).astype(np.uint8), at.astype(np.uint8).reshape(p.shape[:2])
    raise AssertionError("no bits leave one colour")


def palette_png(p: np.ndarray, colors: int = 256) -> bytes:
    """A PNG file of at most so many colours, alpha included."""
    p = np.repeat(p, 3, axis=2) if p.shape[2] == 1 else p
    table, at = palette(p, colors)
    h, w = at.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), at], axis=1).tobytes()
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3, 0, 0, 0)), chunk(b"PLTE", table[:, :3].tobytes())]
    if p.shape[2] == 4:
        parts.append(chunk(b"tRNS", table[:, 3].tobytes()))
    return b"\x89PNG\r\n\x1a\n" + b"".join([*parts, chunk(b"IDAT", zlib.compress(rows, 9)), chunk(b"IEND", b"")])


def set_png_density(data: bytes, dpi: int) -> bytes:
    """A PNG file with its density; other data, and a density of 0, stay as they are."""
    if not dpi or data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        return data
    out, at = data[:8], 8
    per_metre = math.floor(dpi / 0.0254 + 0.5)
    while at + 12 <= len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, whole = data[at + 4 : at + 8], data[at : at + 12 + size]
        if kind != b"pHYs":
            out += whole
        if kind == b"IHDR":
            out += chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1))
        at += 12 + size
    return out


def set_jpeg_density(data: bytes, dpi: int) -> bytes:
    """A JFIF file with its density; other data stay as they are."""
    if not dpi or data[:4] != b"\xff\xd8\xff\xe0" or data[6:11] != b"JFIF\0":
        return data
    return data[:13] + struct.pack(">BHH", 1, dpi, dpi) + data[18:]


def ico_bytes(p: np.ndarray, sizes: tuple[int, ...] = (16, 32, 48)) -> bytes:
    """An icon file with a PNG of each supported size, the image centred on transparent ground."""
    rgba = p if p.shape[2] == 4 else np.concatenate([np.repeat(p, 3 // p.shape[2], axis=2), np.full((*p.shape[:2], 1), 255, np.uint8)], axis=2)
    h, w = rgba.shape[:2]
    images = []
    wanted = sorted(set(sizes) & set(ICO_SIZES)) or [16, 32, 48]
    for side in wanted:
        scale = min(side / w, side / h)
        dw, dh = max(1, round(w * scale)), max(1, round(h * scale))
        square = np.zeros((side, side, 4), np.uint8)
        y, x = (side - dh) // 2, (side - dw) // 2
        square[y : y + dh, x : x + dw] = resample(rgba, dw, dh)
        images.append(png_bytes(square))
    at, entries = 6 + 16 * len(images), b""
    for side, data in zip(wanted, images, strict=True):
        entries += struct.pack("<BBBBHHII", side % 256, side % 256, 0, 0, 1, 32, len(data), at)
        at += len(data)
    return struct.pack("<HHH", 0, 1, len(images)) + entries + b"".join(images)


def encoded(images: DataFrame, encoder: Callable[[np.ndarray], bytes] = png_bytes, column: str = "image") -> DataFrame:
    """images with content, the file that encoder makes of a column."""

    @F.arrow_udf("binary")
    def encode(image):
        import pyarrow as pa

        return pa.array([None if x is None or not x["data"] else encoder(pixels(x)) for x in image.to_pylist()], pa.binary())

    return images.withColumn("content", encode(F.col(column)))


#: Qualities of a lossy encoder among which best_quality() searches.
QUALITIES = tuple(round(0.1 + 0.9 * i / 127, 4) for i in range(128))


def best_quality(encode: Callable[[float], bytes], target: int, qualities: Sequence[float] = QUALITIES) -> bytes:
    """The file of the highest of the rising qualities that makes at most target bytes, else that of the lowest.

    Sizes rise with the quality, so a search by halves encodes a few times only.
    """
    files: dict[float, bytes] = {}

    def size(quality: float) -> int:
        return len(files.setdefault(quality, files.get(quality) or encode(quality)))

    n = bisect.bisect_right(qualities, target, key=size)
    best = qualities[max(0, n - 1)]
    return files.get(best) or encode(best)


def with_matte(p: np.ndarray, matte: np.ndarray) -> np.ndarray:
    """An image whose alpha is multiplied by a square matte of 0 to 1, taken from where letterboxed() put the image."""
    h, w = p.shape[:2]
    side = len(matte)
    scale = min(side / w, side / h)
    dw, dh = max(1, int(w * scale)), max(1, int(h * scale))
    y, x = (side - dh) // 2, (side - dw) // 2
    grey = np.floor(np.clip(matte, 0, 1) * 255 + 0.5).astype(np.uint8)
    alpha = resample(grey[y : y + dh, x : x + dw, None], w, h)[:, :, 0].astype(np.float64)
    old = p[:, :, 3] if p.shape[2] == 4 else np.full((h, w), 255)
    new = np.floor(old * alpha / 255 + 0.5).astype(np.uint8)
    return np.concatenate([p[:, :, :3], new[:, :, None]], axis=2)
