"""Argument lists for media and PDF tools, built from option columns.

A plan is an array<string>. Options are columns by name, missing ones count as null and
take their defaults; options at their defaults add no arguments. As in functions.numbers
nothing is a lambda, and a value is written down once where it can be: Spark runs it as often.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import (
    as_number, clamp_int, half_up, non_negative, plain, read_bool, read_enum, timecode_seconds, volume_factor,
)

Options = dict[str, Column]

# Choices and codec arguments.
SAMPLE_RATES = ["auto", "22050", "32000", "44100", "48000"]
CHANNELS = ["auto", "1", "2"]
BITRATES = ["auto", "320k", "256k", "192k", "128k", "96k", "64k"]
AUDIO_FORMATS = {
    # format: (codec, MIME type, extension, lossy, encoder with variable bitrate)
    "mp3": ("libmp3lame", "audio/mpeg", "mp3", True, "libmp3lame"),
    "wav": ("pcm_s16le", "audio/wav", "wav", False, None),
    "m4a": ("aac", "audio/mp4", "m4a", True, "aac"),
    "aac": ("aac", "audio/aac", "aac", True, "aac"),
    "flac": ("flac", "audio/flac", "flac", False, None),
    "ogg": ("libvorbis", "audio/ogg", "ogg", True, None),
    "opus": ("libopus", "audio/ogg", "opus", True, None),
    "aiff": ("pcm_s16be", "audio/aiff", "aiff", False, None),
}
VARIABLE_QUALITY = {
    "libmp3lame": {"320k": "0", "256k": "0", "192k": "2", "128k": "4", "96k": "6", "64k": "8"},
    "aac": {"320k": "2", "256k": "1.8", "192k": "1.5", "128k": "1.1", "96k": "0.8", "64k": "0.5"},
}
VIDEO_LEVELS = {"Smaller": "800k", "Balanced": "1500k", "Better": "3000k"}
GIF_LEVELS = {"Smaller": (8, 64), "Balanced": (12, 128), "Better": (15, 256)}
ROTATIONS = {"90": "transpose=1", "180": "hflip,vflip", "270": "transpose=2"}
CPU_USED = {"realtime": "8", "good": "5", "best": "0"}
FLIPS = {"Horizontal": "hflip", "Vertical": "vflip", "Both": "hflip,vflip"}
MAX_CROP = 8192
#: Plans are built once for each set of options up to so many sets, of so many bytes.
SETTINGS, SETTINGS_BYTES = 4096, 1 << 20


def argv(*parts: str | Column | list) -> Column:
    """array<string> of the parts in order; null parts drop out, lists stand for a flag and its value."""
    none = F.expr("cast(array() as array<string>)")

    def flagged(flags: list, value: Column) -> Column:
        """The flags and the value, empty for null; split into so many, the value stays whole whatever it holds."""
        text = F.concat(F.lit("".join(f"{x}\0" for x in flags)), value.cast("string")) if flags else value.cast("string")
        return F.coalesce(F.split(text, "\0", len(flags) + 1), none)

    arrays, fixed = [], []
    for part in [*parts, None]:
        if isinstance(part, str) or (isinstance(part, list) and isinstance(part[-1], str)):
            fixed += [part] if isinstance(part, str) else part
            continue
        if fixed:
            arrays.append(F.array(*map(F.lit, fixed)))
            fixed = []
        if part is not None:
            arrays.append(flagged(part[:-1], part[-1]) if isinstance(part, list) else flagged([], part))
    return F.concat(*arrays)


def planned(rows: DataFrame, keep: list[str], options: Options, plans: Callable[[Options], dict[str, Column]]) -> DataFrame:
    """The columns to keep and, by name, what plans() makes of the options as strings.

    Many rows share few sets of options, as a rule: then each set is planned once and joined
    to its rows. Where the sets are many, every row is planned by itself.
    """
    given = rows.select(*keep, *[v.cast("string").alias(f"__{k}") for k, v in options.items()])
    sets = given.select(*[f"__{k}" for k in options]).distinct()
    size = F.sum(sum((F.coalesce(F.octet_length(f"__{k}"), F.lit(0)) for k in options), F.lit(0)))
    n, held = sets.limit(SETTINGS + 1).agg(F.count("*"), size).head()
    if n > SETTINGS or (held or 0) > SETTINGS_BYTES:
        return given.select(*keep, *[v.alias(k) for k, v in plans({k: F.col(f"__{k}") for k in options}).items()])
    sets = sets.select(*[F.col(f"__{k}").alias(f"__of_{k}") for k in options])
    made = plans({k: F.col(f"__of_{k}") for k in options})
    sets = sets.select("*", *[v.alias(k) for k, v in made.items()])
    same = [F.col(f"__{k}").eqNullSafe(F.col(f"__of_{k}")) for k in options]
    return given.join(F.broadcast(sets), same).select(*keep, *made)


def _option(options: Options, name: str) -> Column:
    return options.get(name, F.lit(None).cast("string"))


def _enum(options: Options, name: str, allowed: list[str], default: str) -> Column:
    return read_enum(_option(options, name), allowed, default)


def _set(options: Options, name: str, allowed: list[str], default: str) -> Column:
    """Like _enum(), null for the default."""
    value = _option(options, name)
    return F.when(value.isin(*[x for x in allowed if x != default]), value)


def _joined(separator: str, *parts: Column) -> Column:
    """The parts that are not null, joined; null if none is left."""
    return F.nullif(F.concat_ws(separator, *parts), F.lit(""))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _fades(options: Options) -> tuple[Column, Column]:
    length = lambda name: clamp_int(F.coalesce(_option(options, name), F.lit("0")), 0, 60, 0)
    fade = lambda name: F.concat(F.lit("afade=t=in:st=0:d="), F.nullif(length(name), F.lit(0)).cast("string"))
    return fade("fadeIn"), F.concat(F.lit("areverse,"), fade("fadeOut"), F.lit(",areverse"))


def _volume(options: Options) -> Column:
    percent = clamp_int(F.coalesce(_option(options, "volume"), F.lit("100")), 50, 200, 100)
    return F.concat(F.lit("volume="), volume_factor(F.nullif(percent, F.lit(100))))


def seconds_text(x: Column) -> Column:
    return plain(x, 6)


def audio_filters(options: Options) -> Column:
    """Trim, reverse, volume and fades, in that order; null if nothing is set."""
    start, end = timecode_seconds(_option(options, "trimStart")), timecode_seconds(_option(options, "trimEnd"))
    bounds = _joined(":", F.concat(F.lit("start="), seconds_text(start)), F.concat(F.lit("end="), seconds_text(end)))
    trim = F.concat(F.lit("atrim="), bounds, F.lit(",asetpts=N/SR/TB"))
    reverse = F.when(read_bool(_option(options, "reverse")), "areverse")
    return _joined(",", trim, reverse, _volume(options), *_fades(options))


def audio(source: Column, target: Column, format: str | None, options: Options | None = None, drop_video: bool = False) -> Column:
    """The plan of an audio conversion; format None leaves the codec to the file name."""
    options = options or {}
    codec, _, _, lossy, variable = AUDIO_FORMATS[format] if format else (None, None, None, False, None)
    bitrate, vbr = _enum(options, "bitrate", BITRATES, "auto"), read_bool(_option(options, "vbr"))
    quality = _lookup(VARIABLE_QUALITY[variable], bitrate) if variable else F.lit(None).cast("string")
    return argv(
        "-i", source,
        *(["-vn"] if drop_video else []),
        *([["-c:a", codec]] if codec else []),
        ["-filter:a", audio_filters(options)],
        ["-q:a", F.when(vbr, quality) if lossy else F.lit(None).cast("string")],
        ["-b:a", F.when(~vbr, _set(options, "bitrate", BITRATES, "auto")) if lossy else F.lit(None).cast("string")],
        ["-ar", _set(options, "sampleRate", SAMPLE_RATES, "auto")],
        ["-ac", _set(options, "channels", CHANNELS, "auto")],
        target,
    )


def remove_vocals(source: Column, target: Column) -> Column:
    return argv("-i", source, "-af", "pan=stereo|c0=c0-c1|c1=c1-c0", "-c:a", "libmp3lame", "-b:a", "192k", target)


def source_bitrate(size: Column, seconds: Column) -> Column:
    """Bits a second of the source, 0.6 to 20 million; 4 million if its duration is unknown."""
    rate = F.least(F.lit(20_000_000.0), F.greatest(F.lit(600_000.0), size * 8.0 / seconds))
    return F.when(seconds > 0, half_up(rate)).otherwise(4_000_000).cast("long")


def target_bitrate(megabytes: Column, seconds: Column) -> Column:
    """The video bitrate, such as 742k, that brings a clip to a size."""
    bits = (megabytes * 8.0 * 1024 * 1024 - 128_000.0 * seconds) / seconds
    limited = F.least(F.lit(50_000_000), F.greatest(F.lit(150_000), half_up(bits)))
    text = F.concat(F.greatest(F.lit(1), half_up(limited / 1000)).cast("string"), F.lit("k"))
    return F.when(seconds > 0, text).otherwise(VIDEO_LEVELS["Balanced"])


def compress_video(options: Options | None = None, seconds: Column | None = None) -> Column:
    options = options or {}
    mode = _enum(options, "mode", ["level", "custom", "size"], "level")
    level = _lookup(VIDEO_LEVELS, _enum(options, "level", list(VIDEO_LEVELS), "Balanced"))
    custom = _enum(options, "bitrate", ["400k", "600k", "800k", "1200k", "1500k", "2000k", "3000k", "5000k"], "1500k")
    number = as_number(_option(options, "targetMb"))
    megabytes = F.when(number.isNull(), 10.0).otherwise(F.least(F.lit(2000.0), F.greatest(F.lit(1.0), number)))
    size = target_bitrate(megabytes, seconds if seconds is not None else F.lit(0.0))
    rate = F.when(mode == "custom", custom).when(mode == "size", size).otherwise(level)
    height = _enum(options, "resolution", ["keep", "1080", "720", "480"], "keep")
    scale = F.when(height != "keep", F.concat(F.lit("scale=-2:"), height))
    return argv("-i", "input.mp4", ["-vf", scale], "-c:v", "libopenh264", ["-b:v", rate], "-c:a", "aac", "-b:a", "128k", "output.mp4")


def gif_filter(options: Options | None = None) -> Column:
    options = options or {}
    whole = lambda name, low, high, default: clamp_int(F.coalesce(_option(options, name), F.lit(str(default))), low, high, default).cast("string")
    fps, colors = whole("fps", 5, 30, 12), whole("colors", 32, 256, 128)
    width = _enum(options, "width", ["480", "320", "240", "640"], "480")
    height = _enum(options, "height", ["auto", "240", "360", "480", "720"], "auto")
    dither = _enum(options, "dither", ["bayer", "sierra2_4a", "none"], "bayer")
    scale = F.when(height == "auto", F.concat(F.lit("scale="), width, F.lit(":-1"))).otherwise(F.concat(F.lit("scale=-2:"), height))
    return F.concat(
        F.lit("fps="), fps, F.lit(","), scale, F.lit(":flags=lanczos,split[s0][s1];[s0]palettegen=max_colors="), colors,
        F.lit("[p];[s1][p]paletteuse=dither="), dither,
    )


def _trim(options: Options) -> tuple[Column, Column]:
    """Start and end of a trim in seconds, null where unset; an end not after the start is no end."""
    start, end = non_negative(_option(options, "trimStart")), non_negative(_option(options, "trimEnd"))
    return F.when(start > 0, seconds_text(start)), F.when(end > start, seconds_text(end))


def mp4_to_gif(options: Options | None = None) -> Column:
    options = options or {}
    start, end = _trim(options)
    loop = _enum(options, "loop", ["0", "1", "3", "5"], "0")
    return argv(["-ss", start], ["-to", end], "-i", "input.mp4", ["-vf", gif_filter(options)], ["-loop", loop], "output.gif")


def compress_gif(level: Column) -> Column:
    fps, colors = ({k: str(v[i]) for k, v in GIF_LEVELS.items()} for i in (0, 1))
    chosen = read_enum(level, list(GIF_LEVELS), "Balanced")
    graph = F.concat(
        F.lit("fps="), _lookup(fps, chosen), F.lit(",scale=iw:-1:flags=lanczos,split[s0][s1];[s0]palettegen=max_colors="),
        _lookup(colors, chosen), F.lit("[p];[s1][p]paletteuse"),
    )
    return argv("-i", "input.gif", ["-vf", graph], "output.gif")


def _video_audio(options: Options, codec: Column | str) -> list:
    return [
        ["-af", _joined(",", _volume(options), *_fades(options))],
        ["-c:a", codec],
        ["-b:a", _set(options, "bitrate", BITRATES, "auto")],
        ["-ar", _set(options, "sampleRate", SAMPLE_RATES, "auto")],
    ]


def mp4_to_webm(bitrate: Column, options: Options | None = None) -> Column:
    options = options or {}
    vp9 = _enum(options, "videoCodec", ["vp8", "vp9"], "vp8") == "vp9"
    crf = clamp_int(F.coalesce(_option(options, "crf"), F.lit("33")), 10, 63, 33)
    preset = _enum(options, "preset", list(CPU_USED), "realtime")
    return argv(
        "-i", "input.mp4",
        ["-vf", _lookup(ROTATIONS, _option(options, "rotate"))],
        ["-c:v", F.when(vp9, "libvpx-vp9").otherwise("libvpx")],
        ["-b:v", F.when(vp9, "0").otherwise(bitrate.cast("string"))],
        ["-crf", F.when(vp9, crf)],
        ["-deadline", preset], ["-cpu-used", _lookup(CPU_USED, preset)], "-threads", "0",
        *_video_audio(options, _enum(options, "audioCodec", ["libopus", "libvorbis"], "libopus")),
        "output.webm",
    )


def webm_to_mp4(bitrate: Column, options: Options | None = None) -> Column:
    options = options or {}
    return argv(
        "-i", "input.webm",
        ["-vf", _lookup(ROTATIONS, _option(options, "rotate"))],
        "-c:v", "libopenh264", ["-b:v", bitrate], "-pix_fmt", "yuv420p", "-movflags", "+faststart",
        *_video_audio(options, "aac"),
        "output.mp4",
    )


def gif_to_mp4() -> Column:
    return argv("-i", "input.gif", "-movflags", "+faststart", "-pix_fmt", "yuv420p", "-c:v", "libopenh264", "output.mp4")


def tempo_chain(speed: Column) -> Column:
    """atempo stages between 0.5 and 2 whose product is the speed."""
    doubled = F.ceil(F.log2(speed) - 1e-9) - 1
    halved = F.ceil(-F.log2(speed) - 1e-9) - 1
    n = F.greatest(doubled, halved, F.lit(0)).cast("int")
    stage = F.when(speed > 1, "atempo=2.0").otherwise("atempo=0.5")
    rest = speed / F.pow(F.when(speed > 1, 2.0).otherwise(0.5), n)
    return F.array_join(F.concat(F.array_repeat(stage, n), F.array(F.concat(F.lit("atempo="), plain(rest, 4)))), ",")


def video_speed(speed: Column, bitrate: Column, has_audio: Column) -> Column:
    picture = F.concat(F.lit("[0:v]setpts="), F.format_string("%.6f", 1.0 / speed), F.lit("*PTS[v]"))
    graph = F.when(has_audio, F.concat(picture, F.lit(";[0:a]"), tempo_chain(speed), F.lit("[a]"))).otherwise(picture)
    return argv(
        "-i", "input.mp4", ["-filter_complex", graph], "-map", "[v]",
        ["-map", F.when(has_audio, "[a]")], F.when(~has_audio, "-an"),
        ["-b:v", bitrate], ["-b:a", F.when(has_audio, "192k")], "output.mp4",
    )


def video_trim(options: Options) -> Column:
    start, end = _trim(options)
    return argv(["-ss", start], ["-to", end], "-i", "input.mp4", "-c", "copy", "output.mp4")


def crop_geometry(options: Options | None = None) -> Column:
    """struct<w, h, x, y>: sides even and at most MAX_CROP, offsets inside."""
    options = options or {}

    def side(name: str, default: int) -> Column:
        n = as_number(F.coalesce(_option(options, name), F.lit("x")))
        whole = F.when(n >= 1, F.least(F.lit(MAX_CROP), half_up(n))).otherwise(default)
        return F.greatest(F.lit(2), F.floor(whole / 2) * 2).cast("int")

    def offset(name: str, size: Column) -> Column:
        n = as_number(_option(options, name))
        return F.least(F.greatest(F.lit(0), half_up(n)), F.lit(MAX_CROP) - size).cast("int")

    w, h = side("cropW", 640), side("cropH", 480)
    return F.struct(w.alias("w"), h.alias("h"), offset("cropX", w).alias("x"), offset("cropY", h).alias("y"))


def video_crop(bitrate: Column, options: Options | None = None) -> Column:
    box = crop_geometry(options)
    text = F.concat(F.lit("crop="), F.concat_ws(":", *[box[k].cast("string") for k in "whxy"]))
    return argv("-i", "input.mp4", ["-vf", text], ["-b:v", bitrate], "-c:a", "copy", "output.mp4")


def flip_video(direction: Column, bitrate: Column) -> Column:
    chosen = _lookup(FLIPS, read_enum(direction, list(FLIPS), "Horizontal"))
    return argv("-i", "input.mp4", ["-vf", chosen], ["-b:v", bitrate], "-c:a", "copy", "output.mp4")


def reverse_video(bitrate: Column) -> Column:
    return argv("-i", "input.mp4", "-vf", "reverse", "-af", "areverse", ["-b:v", bitrate], "-b:a", "192k", "output.mp4")


def mute_video() -> Column:
    return argv("-i", "input.mp4", "-c:v", "copy", "-an", "output.mp4")


def protect_pdf(source: Column, target: Column, options: Options) -> Column:
    """256-bit encryption with permissions; null if the password is blank. The owner password defaults to it."""
    password, owner = _option(options, "password"), _option(options, "ownerPassword")
    allowed = lambda name: F.when(F.coalesce(_option(options, name).cast("string"), F.lit("true")) == "false", "n").otherwise("y")
    flag = lambda text, name: F.concat(F.lit(text), allowed(name))
    printing = _enum(options, "printing", ["full", "low", "none"], "full")
    plan = argv(
        "--encrypt", password, F.when(F.coalesce(owner, F.lit("")) != "", owner).otherwise(password), "256",
        F.concat(F.lit("--print="), printing), flag("--extract=", "allowCopy"), flag("--modify-other=", "allowModify"),
        flag("--annotate=", "allowAnnotate"), flag("--form=", "allowForm"),
        flag("--accessibility=", "allowAccessibility"), flag("--assemble=", "allowAssembly"), "--", source, target,
    )
    return F.when(F.trim(F.coalesce(password, F.lit(""))) != "", plan)


def unlock_pdf(source: Column, target: Column, password: Column) -> Column:
    return argv(F.concat(F.lit("--password="), F.coalesce(password, F.lit(""))), "--decrypt", source, target)


def repair_pdf(source: Column, target: Column, linearize: Column) -> Column:
    return argv(F.when(linearize, "--linearize"), source, target)


def flatten_pdf(source: Column, target: Column) -> Column:
    """Form fields and annotations become part of their pages."""
    return argv("--generate-appearances", "--flatten-annotations=all", source, target)


def repack_pdf(source: Column, target: Column) -> Column:
    return argv("--object-streams=generate", "--linearize", source, target)
