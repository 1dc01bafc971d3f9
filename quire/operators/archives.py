"""ZIP, TAR and GZIP as relations of entries.

Entries have archive_id, ord, name and content; archive_id and ord tell them apart. Packing
works entry by entry: each is compressed and framed in its own row. Offsets are running sums
over sizes alone, in slices, so an archive may hold any number of entries; contents are
joined to them afterwards. zip_archives() and tar_archives() bring the frames of an archive
together as one value; zip_files() and tar_files() write files of any size, every task at
its own offsets. An archive that its format cannot hold is an error, not a file.
"""

from __future__ import annotations

import gzip as gzip_codec
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import gzip_name, mime_type, safe_basename
from ..sources.placed import write_placed
from .lineage import bounded, cut
from .prefix import sums_before, with_sums_before

LEVEL = 6
BLOCK = 512
# What the formats hold.
MAX_ENTRIES = 65_535  # entries of a ZIP archive
MAX_BYTES = 2**32 - 1  # bytes of a ZIP entry, and before one
NAME_BYTES, PREFIX_BYTES = 100, 155  # bytes of a TAR name and of the folders before it
#: An archive of more bytes is no value of a row.
MAX_FILE = 2**31 - 1
BY = ["archive_id"], ["ord"]


def unique_names(entries: DataFrame, style: str = "-{}") -> DataFrame:
    """archive_id, ord and name, made unique within the archive in the order of ord.

    The n-th entry of a name tries the name itself (n = 1) or the name with n before its
    extension. Where that meets the name of an earlier entry, it and all later entries of
    its name move on by one; each round of that is a join-free count by name, and there are
    as many rounds as such meetings follow one another, none for most archives.
    """
    dotted = F.col("name").rlike(r"(?s)^.+\.[^.]*\z")
    stem = F.when(dotted, F.regexp_extract("name", r"(?s)^(.+)(\.[^.]*)\z", 1)).otherwise(F.col("name"))
    before, after = style.split("{}")
    n = F.col("n").cast("string")
    numbered = F.concat(stem, F.lit(before), n, F.lit(after), F.substring("name", F.length(stem) + 1, F.length("name")))
    tried = F.when(F.col("n") == 1, F.col("name")).otherwise(numbered)
    alike = Window.partitionBy("archive_id", "name").orderBy("ord")
    rows = entries.select("archive_id", "ord", "name", F.row_number().over(alike).alias("place"))
    rows = cut(rows.withColumn("n", F.col("place")).withColumn("tried", tried))
    while True:
        same = Window.partitionBy("archive_id", "tried")
        late = F.col("ord") > F.min("ord").over(same)
        met = cut(rows.withColumn("late", late))
        if met.where("late").isEmpty():
            return rows.select("archive_id", "ord", F.col("tried").alias("name"))
        moved = F.max(F.col("n") + F.col("late").cast("int") - F.col("place")).over(alike)  # the farthest of those so far
        rows = cut(met.withColumn("n", F.col("place") + moved).drop("late").withColumn("tried", tried))


def _named(entries: DataFrame) -> DataFrame:
    base = entries.withColumn("name", safe_basename(F.col("name"))).where("name <> ''")
    names = unique_names(base).withColumnRenamed("name", "__name")
    return base.join(names, ["archive_id", "ord"]).withColumn("name", F.col("__name")).drop("__name")


def _deflate(entries: DataFrame) -> DataFrame:
    """archive_id, ord, name, size, crc and packed, the raw deflate stream."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            packed = []
            for content in batch.column("content"):
                codec = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
                packed.append(codec.compress(content.as_py()) + codec.flush())
            rest = [batch.column(c) for c in ("archive_id", "ord", "name", "size", "crc")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(packed, pa.binary())], names=["archive_id", "ord", "name", "size", "crc", "packed"])

    content = F.coalesce("content", F.to_binary(F.lit(""), F.lit("utf-8")))
    rows = entries.select("archive_id", "ord", "name", F.octet_length(content).cast("long").alias("size"), F.crc32(content).alias("crc"), content.alias("content"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"archive_id {kinds['archive_id']}, ord {kinds['ord']}, name string, size long, crc long, packed binary")


def _little(value: Column, n: int) -> Column:
    """The hex of n bytes, the lowest first; null for a number that they do not hold."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    text = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.when(value.between(0, min(256**n, 2**63) - 1), text)


def _bytes(*parts: Column | str) -> Column:
    return F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _shared() -> Column:
    """What an entry's frame and its entry in the directory have in common."""
    return _bytes(
        "0008" + "0800" + "00002100", _little(F.col("crc"), 4), _little(F.octet_length("packed"), 4),
        _little(F.col("size"), 4), _little(F.octet_length("name"), 2),
    )


LOCAL_BYTES, ENTRY_BYTES = 30, 46  # before the name, in a frame and in the directory


def _local() -> Column:
    return F.concat(_bytes("504B03041400"), _shared(), _bytes("0000"), F.to_binary("name", F.lit("utf-8")), F.col("packed"))


def zip_frames(entries: DataFrame) -> DataFrame:
    """archive_id, ord, local and entry: the frame of each entry and its entry in the directory.

    entry is null where a size or an offset is beyond MAX_BYTES.
    """
    packed = cut(_deflate(_named(entries)))
    placed = with_sums_before(packed, *BY, {"offset": _local_bytes()})
    tail = _bytes("0000" + "0000" + "0000" + "0000" + "00000000", _little(F.col("offset"), 4))
    entry = F.concat(_bytes("504B010214001400"), _shared(), tail, F.to_binary("name", F.lit("utf-8")))
    return placed.select("archive_id", "ord", _local().alias("local"), entry.alias("entry"))


def _local_bytes() -> Column:
    return (F.octet_length("name") + F.octet_length("packed") + LOCAL_BYTES).cast("long")


def zip_archives(entries: DataFrame) -> DataFrame:
    """archive_id, content and error, UNSUPPORTED_INPUT for an archive that the format or a row cannot hold.

    Frames of an archive meet once, in order, as bytes.
    """
    frames = zip_frames(entries)
    small = lambda column: f"listagg({column}) WITHIN GROUP (ORDER BY ord)"
    room = frames.groupBy("archive_id").agg(
        F.count("*").alias("n"), F.count("entry").alias("whole"),
        F.sum(F.octet_length("local").cast("long") + F.octet_length("entry")).alias("bytes"),
    )
    fits = (F.col("n") <= MAX_ENTRIES) & (F.col("whole") == F.col("n")) & (F.col("bytes") < MAX_FILE)
    checked = cut(room.select("archive_id", fits.alias("fits")))
    wrong = checked.where("not fits").select("archive_id", F.lit(None).cast("binary").alias("content"), F.lit("UNSUPPORTED_INPUT").alias("error"))
    whole = frames if wrong.isEmpty() else frames.join(wrong.select("archive_id"), "archive_id", "left_anti")
    joined = whole.groupBy("archive_id").agg(F.expr(small("local")).alias("locals"), F.expr(small("entry")).alias("directory"), F.count("*").alias("n"))
    end = _bytes(
        "504B0506" + "00000000", _little(F.col("n"), 2), _little(F.col("n"), 2),
        _little(F.octet_length("directory"), 4), _little(F.octet_length("locals"), 4), "0000",
    )
    return joined.select("archive_id", F.concat("locals", "directory", end).alias("content"), F.lit(None).cast("string").alias("error")).unionByName(wrong)


def padded(size: Column) -> Column:
    return (F.ceil(size / BLOCK) * BLOCK).cast("long")


def tar_size(sizes: Column) -> Column:
    """Aggregate: the bytes of an archive of files of those sizes."""
    return F.sum(padded(sizes) + BLOCK) + 2 * BLOCK


def tar_offsets(entries: DataFrame) -> DataFrame:
    """entries (archive_id, ord, size) with offset, where the header of each begins."""
    return with_sums_before(entries, *BY, {"offset": padded(F.col("size")) + BLOCK})


def tar_name(name: str) -> tuple[str, str] | None:
    """(name, prefix) as the header holds them; None if they do not fit.

    A prefix ends before a slash. Of the slashes that leave at most PREFIX_BYTES before and
    at most NAME_BYTES, but some, after them, the last counts.
    """
    raw = name.encode()
    if len(raw) <= NAME_BYTES:
        return name, ""
    low, high = max(1, len(raw) - NAME_BYTES - 1), min(PREFIX_BYTES, len(raw) - 2)
    slash = raw.rfind(b"/", low, high + 1)
    return None if slash < 0 else (raw[slash + 1 :].decode(), raw[:slash].decode())


def tar_header(name: str, prefix: str, size: int, mtime: int) -> bytes:
    head = struct.pack(
        "100s8s8s8s12s12s8s1s100s6s2s32s32s8s8s155s12x",
        name.encode(), b"0000644", b"0000000", b"0000000", b"%011o" % size, b"%011o" % mtime, b" " * 8, b"0", b"",
        b"ustar", b"00", b"", b"", b"", b"", prefix.encode(),
    )
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def _fits(name: Column) -> Column:
    @F.arrow_udf("boolean")
    def fits(names):
        import pyarrow as pa

        return pa.array([tar_name(n.as_py() or "") is not None for n in names], pa.bool_())

    return fits(name)


def tar_layout(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archive_id, ord, offset) of entries, and (archive_id, last, bytes, error) of archives; contents stay where they are.

    last is the offset of the last entry, bytes the size of the archive. A name that does not
    fit makes its archive an error.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    narrow = cut(entries.select("archive_id", "ord", (padded(size) + BLOCK).alias("frame_bytes"), _fits(F.col("name")).alias("fits")))
    totals = narrow.groupBy("archive_id").agg(
        (F.sum("frame_bytes") + 2 * BLOCK).alias("bytes"), (F.sum("frame_bytes") - F.max_by("frame_bytes", "ord")).alias("last"),
        F.when(~F.every("fits"), "UNSUPPORTED_INPUT").alias("error"),
    )
    return cut(sums_before(narrow, *BY, {"offset": F.col("frame_bytes")})), cut(totals)


def tar_frames(entries: DataFrame, mtime: int = 0) -> DataFrame:
    """archive_id, ord and frame, a header with content, of each entry; null for a name that does not fit."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            frames = []
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                data, split = content.as_py() or b"", tar_name(name.as_py() or "")
                frames.append(None if split is None else tar_header(*split, len(data), mtime) + data + bytes(-len(data) % BLOCK))
            yield pa.RecordBatch.from_arrays([batch.column("archive_id"), batch.column("ord"), pa.array(frames, pa.binary())], names=["archive_id", "ord", "frame"])

    rows = entries.select("archive_id", "ord", "name", "content")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"archive_id {kinds['archive_id']}, ord {kinds['ord']}, frame binary")


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the other columns of right; null keys are equal."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, same).drop(*[f"__{k}" for k in keys])


def _tar_placed(entries: DataFrame, mtime: int) -> tuple[DataFrame, DataFrame]:
    """(archive_id, ord, offset, frame) of the archives without an error, and the totals of all."""
    offsets, totals = tar_layout(entries)
    good = _with(offsets, bounded(totals.where("error is null").select("archive_id")), ["archive_id"])
    return _with(tar_frames(entries, mtime), bounded(good), ["archive_id", "ord"]), totals


def _error_rows(totals: DataFrame, **columns: str) -> DataFrame:
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]
    return totals.where("error is not null").select("archive_id", *nothing, "error")


def tar_parts(entries: DataFrame, mtime: int = 0, most: int = MAX_FILE // 2) -> DataFrame:
    """archive_id, part, content and error: each archive in parts of at most about so many bytes, to be written one after the other.

    No task holds more than a part of an archive, however large it is, nor the offsets of all
    of its entries. An archive with a name that does not fit is one row with UNSUPPORTED_INPUT.
    """
    placed, totals = _tar_placed(entries, mtime)
    own = placed.withColumn("part", F.floor(F.col("offset") / most))
    parts = own.groupBy("archive_id", "part").agg(F.expr("listagg(frame) WITHIN GROUP (ORDER BY ord)").alias("content"))
    ended = _with(parts, totals.select("archive_id", F.floor(F.col("last") / most).alias("last")), ["archive_id"])
    closing = F.to_binary(F.lit("00" * 2 * BLOCK), F.lit("hex"))
    content = F.when(F.col("part") == F.col("last"), F.concat("content", closing)).otherwise(F.col("content"))
    whole = ended.select("archive_id", "part", content.alias("content"), F.lit(None).cast("string").alias("error"))
    return whole.unionByName(_error_rows(totals, part="long", content="binary"))


def tar_archives(entries: DataFrame, mtime: int = 0) -> DataFrame:
    """archive_id, content and error, UNSUPPORTED_INPUT for a name that does not fit and for an archive that is no value of a row: tar_files() writes those."""
    parts = tar_parts(entries, mtime)
    return parts.groupBy("archive_id").agg(F.count("*").alias("n"), F.first("content").alias("content"), F.first("error").alias("error")).select(
        "archive_id", F.when(F.col("n") == 1, F.col("content")).alias("content"),
        F.when(F.col("n") > 1, "UNSUPPORTED_INPUT").otherwise(F.col("error")).alias("error"),
    )


def _file_name(extension: str) -> Column:
    return F.concat(F.coalesce(F.col("archive_id").cast("string"), F.lit("null")), F.lit(extension))


def tar_files(entries: DataFrame, folder: str, mtime: int = 0) -> DataFrame:
    """Writes <archive_id>.tar of each archive to folder and returns archive_id, name, bytes and error.

    Tasks write frames at their offsets; files appear when all are there, none if the job
    fails. Archives of any size; one with a name that does not fit has no file but an error.
    """
    placed, totals = _tar_placed(entries, mtime)
    name = _file_name(".tar").alias("name")
    closing = F.to_binary(F.lit("00" * 2 * BLOCK), F.lit("hex")).alias("content")
    ends = totals.where("error is null").select(name, (F.col("bytes") - 2 * BLOCK).alias("offset"), closing)
    write_placed(placed.select(name, "offset", F.col("frame").alias("content")).unionByName(ends), folder)
    good = F.col("error").isNull()
    return totals.select("archive_id", F.when(good, name).alias("name"), F.when(good, F.col("bytes")).alias("bytes"), "error")


def zip_files(entries: DataFrame, folder: str) -> DataFrame:
    """Writes <archive_id>.zip of each archive to folder and returns archive_id, name and bytes.

    Frames, entries of the directory and its end are rows with offsets of their own. Beyond
    MAX_ENTRIES entries or MAX_BYTES bytes the archive has the fields of ZIP64.
    """
    packed = cut(_deflate(_named(entries)))
    sized = packed.select("archive_id", "ord", F.octet_length("name").alias("name_bytes"), _local_bytes().alias("local_bytes"))
    offsets = sums_before(sized, *BY, {"offset": F.col("local_bytes"), "names": (F.col("name_bytes") + ENTRY_BYTES).cast("long")})
    far = F.col("offset") >= MAX_BYTES
    extra = F.when(far, FAR_BYTES).otherwise(0).cast("long")
    # Entries beyond MAX_BYTES follow all others, so the bytes of their extra fields add up by their place among them.
    placed = cut(sums_before(offsets, *BY, {"extras": extra}).withColumnsRenamed({"archive_id": "__a", "ord": "__o"}))
    both = offsets.join(placed, F.col("archive_id").eqNullSafe(F.col("__a")) & F.col("ord").eqNullSafe(F.col("__o"))).drop("__a", "__o")
    places = cut(both.select("archive_id", "ord", "offset", (F.col("names") + F.col("extras")).alias("at"), extra.alias("extra")))
    last = _with(sized, places, ["archive_id", "ord"])
    totals = cut(last.groupBy("archive_id").agg(
        F.count("*").alias("n"), F.max(F.col("offset") + F.col("local_bytes")).alias("start"),
        F.max(F.col("at") + F.col("extra") + F.col("name_bytes") + ENTRY_BYTES).alias("length"),
    ))
    rows = _with(packed, bounded(places), ["archive_id", "ord"])
    name = _file_name(".zip").alias("name")
    locals_ = rows.select(name, "offset", _local().alias("content"))
    entry = rows.select("archive_id", name, "at", _directory_entry().alias("content"))
    entry = _with(entry, bounded(totals.select("archive_id", "start")), ["archive_id"])
    listed = entry.select("name", (F.col("start") + F.col("at")).alias("offset"), "content")
    ends = totals.select(name, (F.col("start") + F.col("length")).alias("offset"), _directory_end().alias("content"))
    write_placed(locals_.unionByName(listed).unionByName(ends), folder)
    return totals.select("archive_id", name, (F.col("start") + F.col("length") + F.octet_length(_directory_end())).alias("bytes"))


#: Bytes of the extra field with an offset beyond MAX_BYTES.
FAR_BYTES = 12


def _directory_entry() -> Column:
    """An entry of the directory; its offset stands in an extra field if four bytes do not hold it."""
    far = F.col("offset") >= MAX_BYTES
    version = F.when(far, _bytes("504B01022D002D00")).otherwise(_bytes("504B010214001400"))
    own = F.when(far, "FFFFFFFF").otherwise(_little(F.col("offset"), 4))
    tail = _bytes(F.when(far, "0C00").otherwise("0000"), "0000" + "0000" + "0000" + "00000000", own)
    extra = F.when(far, _bytes("01000800", _little(F.col("offset"), 8))).otherwise(_bytes(""))
    return F.concat(version, _shared(), tail, F.to_binary("name", F.lit("utf-8")), extra)


def _directory_end() -> Column:
    """The end of an archive from n, start and length of its directory."""
    n, start, length = F.col("n"), F.col("start"), F.col("length")
    large = (n >= MAX_ENTRIES) | (start >= MAX_BYTES) | (length >= MAX_BYTES)
    eight = lambda x: _little(x, 8)
    wide = _bytes(
        "504B0606" + "2C00000000000000" + "2D002D00" + "00000000" + "00000000", eight(n), eight(n), eight(length), eight(start),
        "504B0607" + "00000000", eight(start + length), "01000000",
    )
    short = lambda x, size, most: F.when(x >= most, "FF" * size).otherwise(_little(x, size))
    end = _bytes(
        "504B0506" + "00000000", short(n, 2, MAX_ENTRIES), short(n, 2, MAX_ENTRIES), short(length, 4, MAX_BYTES), short(start, 4, MAX_BYTES), "0000",
    )
    return F.when(large, F.concat(wide, end)).otherwise(end)


def zip_entries(archives: DataFrame) -> DataFrame:
    """archive_id, ord, path, name, mime, size and content of every file in ZIP archives (archive_id, content).

    Folders are skipped and paths cut to their last segment; error tells of archives that
    cannot be read or hold no file.
    """
    kind = archives.schema["archive_id"].dataType.simpleString()

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for archive, content in zip(batch.column("archive_id").to_pylist(), batch.column("content"), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for i, info in enumerate(z.infolist()):
                            if not info.filename.endswith(("/", "\\")):
                                rows.append((archive, i, info.filename, z.read(info), None))
                    if not rows:
                        rows = [(archive, None, None, None, "DECODE_FAILED")]
                except (zipfile.BadZipFile, RuntimeError, zlib.error, NotImplementedError):
                    rows = [(archive, None, None, None, "DECODE_FAILED")]
                columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
                types = [columns[0].type, pa.int32(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types, strict=True)], names=["archive_id", "ord", "path", "content", "error"])

    found = archives.select("archive_id", "content").mapInArrow(run, f"archive_id {kind}, ord int, path string, content binary, error string")
    named = found.withColumn("name", safe_basename(F.col("path"))).where("error is not null or name <> ''")
    names = unique_names(named.where("error is null"), " ({})").withColumnRenamed("name", "__name")
    joined = named.join(names, ["archive_id", "ord"], "left")
    return joined.select(
        "archive_id", "ord", "path", F.col("__name").alias("name"), F.when(F.col("error").isNull(), mime_type(F.col("__name"))).alias("mime"),
        F.octet_length("content").alias("size"), "content", "error",
    )


def gzip_files(files: DataFrame) -> DataFrame:
    """files (name, content) as name.gz and their compressed content; error for empty ones."""

    @F.arrow_udf("binary")
    def packed(content):
        import pyarrow as pa

        return pa.array([gzip_codec.compress(x.as_py(), LEVEL, mtime=0) if x.as_py() else None for x in content], pa.binary())

    empty = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
    return files.withColumns({
        "name": gzip_name(F.col("name")), "content": packed(F.col("content")), "error": F.when(empty, "UNSUPPORTED_INPUT"),
    })


def gunzip_files(files: DataFrame) -> DataFrame:
    """files (content) with content decompressed; error where it is no whole gzip file."""

    @F.arrow_udf("binary")
    def unpacked(content):
        import pyarrow as pa

        def one(data):
            try:
                return gzip_codec.decompress(data)
            except (OSError, EOFError, zlib.error, TypeError):
                return None

        return pa.array([one(x.as_py()) for x in content], pa.binary())

    found = files.withColumn("content", unpacked(F.col("content")))
    return found.withColumn("error", F.when(F.col("content").isNull(), "DECODE_FAILED"))
