"""Queries of whole argument lists, option readers and placements, over line items, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import choices, geometry, names, numbers, text
from .operators import archives, batches, epub, html, pages, split
from .plans import media
from .queries import _entries, _moved, _OLD, _pages, _parts, _read, query

_LINES = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, l_linenumber AS n FROM lineitem"


def _lines(spark, sf_dir, plan):
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(plan, " ").alias("argv"))


def _quantity():
    return F.col("l_quantity").cast("int")


def _pick(i, *values):
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


# Argument lists


@query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN q % 5 > 0 THEN '-ss ' || CAST(q % 5 AS VARCHAR) || '.5 ' ELSE '' END
  || CASE WHEN n * 2 > CASE WHEN q % 5 > 0 THEN q % 5 + 0.5 ELSE 0 END THEN '-to ' || CAST(n * 2 AS VARCHAR) || ' ' ELSE '' END || '-i input.mp4 -c copy output.mp4' AS argv FROM ({_LINES})""")
def video_trim_argv(spark, sf_dir):
    start = F.when(_quantity() % 5 > 0, F.concat((_quantity() % 5).cast("string"), F.lit(".5"))).otherwise("-3")
    return _lines(spark, sf_dir, media.video_trim({"trimStart": start, "trimEnd": (F.col("l_linenumber") * 2).cast("string")}))


@query(f"""
SELECT l_orderkey, l_linenumber, '-i input.mp4 -filter_complex [0:v]setpts=' || CASE n % 3 WHEN 0 THEN '4.000000' WHEN 1 THEN '0.666667' ELSE '0.250000' END || '*PTS[v]'
  || CASE WHEN q % 2 = 0 THEN ';[0:a]' || CASE n % 3 WHEN 0 THEN 'atempo=0.5,atempo=0.5' WHEN 1 THEN 'atempo=1.5' ELSE 'atempo=2.0,atempo=2' END || '[a] -map [v] -map [a]' ELSE ' -map [v] -an' END
  || ' -b:v ' || CAST(q * 1000 AS VARCHAR) || CASE WHEN q % 2 = 0 THEN ' -b:a 192k' ELSE '' END || ' output.mp4' AS argv FROM ({_LINES})""")
def video_speed_argv(spark, sf_dir):
    speed = _pick(F.col("l_linenumber") % 3, 0.25, 1.5, 4.0)
    return _lines(spark, sf_dir, media.video_speed(speed, (_quantity() * 1000).cast("string"), _quantity() % 2 == 0))


@query(f"""
SELECT l_orderkey, l_linenumber, '-i input.mp4 -vf ' || CASE n % 4 WHEN 1 THEN 'vflip' WHEN 2 THEN 'hflip,vflip' ELSE 'hflip' END || ' -b:v ' || CAST(q AS VARCHAR) || 'k -c:a copy output.mp4' AS flip,
  '-i input.mp4 -vf reverse -af areverse -b:v ' || CAST(q AS VARCHAR) || 'k -b:a 192k output.mp4' AS reversed, '-i input.mp4 -c:v copy -an output.mp4' AS muted,
  '-i input.gif -movflags +faststart -pix_fmt yuv420p -c:v libopenh264 output.mp4' AS from_gif,
  '-i input.mp4 -vf crop=' || CAST(greatest(2, q * 31 - q * 31 % 2) AS VARCHAR) || ':480:' || CAST(n AS VARCHAR) || ':0 -b:v ' || CAST(q AS VARCHAR) || 'k -c:a copy output.mp4' AS cropped,
  '-i input.gif -vf fps=' || CASE n % 4 WHEN 1 THEN '8' WHEN 2 THEN '15' ELSE '12' END || ',scale=iw:-1:flags=lanczos,split[s0][s1];[s0]palettegen=max_colors=' || CASE n % 4 WHEN 1 THEN '64' WHEN 2 THEN '256' ELSE '128' END || '[p];[s1][p]paletteuse output.gif' AS small
FROM ({_LINES})""")
def video_short_argv(spark, sf_dir):
    """Flip, reverse, mute, GIF to MP4, crop and a smaller GIF, with known, unknown and missing choices."""
    kind, rate = F.col("l_linenumber") % 4, F.concat(_quantity().cast("string"), F.lit("k"))
    options = {
        "cropW": (_quantity() * 31).cast("string"), "cropH": F.lit("0"), "cropX": F.col("l_linenumber").cast("string"), "cropY": F.lit("-1"),
        "rate": rate, "flip": _pick(kind, "Horizontal", "Vertical", "Both", "?"), "level": _pick(kind, "Balanced", "Smaller", "Better", "best"),
    }

    def plans(given):
        found = {
            "flip": media.flip_video(given["flip"], given["rate"]), "reversed": media.reverse_video(given["rate"]), "muted": media.mute_video(),
            "from_gif": media.gif_to_mp4(), "cropped": media.video_crop(given["rate"], given), "small": media.compress_gif(given["level"]),
        }
        return {k: F.array_join(v, " ") for k, v in found.items()}

    return media.planned(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], options, plans)


_SOUND = """CASE WHEN v <> 100 OR fi > 0 OR fo > 0 THEN ' -af ' || concat_ws(',', CASE v WHEN 50 THEN 'volume=0.5' WHEN 200 THEN 'volume=2' END,
  CASE WHEN fi > 0 THEN 'afade=t=in:st=0:d=' || CAST(fi AS VARCHAR) END, CASE WHEN fo > 0 THEN 'areverse,afade=t=in:st=0:d=' || CAST(fo AS VARCHAR) || ',areverse' END) ELSE '' END"""
_TUNED = f"""(SELECT *, CASE n % 3 WHEN 0 THEN 50 WHEN 1 THEN 100 ELSE 200 END AS v, q % 4 AS fi, least(60, q * 3 % 90) AS fo,
  CASE q % 4 WHEN 1 THEN ' -vf transpose=1' WHEN 2 THEN ' -vf hflip,vflip' WHEN 3 THEN ' -vf transpose=2' ELSE '' END AS turned,
  CASE WHEN n % 2 = 0 THEN ' -b:a 128k' ELSE '' END || CASE WHEN q % 3 = 0 THEN ' -ar 48000' ELSE '' END AS audio FROM ({_LINES}))"""


def _tuned():
    n, q = F.col("l_linenumber"), _quantity()
    return {
        "volume": _pick(n % 3, "30", "100", "900"), "fadeIn": (q % 4).cast("string"), "fadeOut": (q * 3 % 90).cast("string"),
        "rotate": _pick(q % 4, "0", "90", "180", "270"), "bitrate": F.when(n % 2 == 0, "128k").otherwise("99k"),
        "sampleRate": F.when(q % 3 == 0, "48000").otherwise("auto"), "videoCodec": F.when(n % 2 == 0, "vp9"),
        "crf": _pick(q % 4, "5", "31", "99", "x"), "preset": _pick(n % 4, "good", "best", "realtime", "none"), "audioCodec": F.when(q % 2 == 0, "libvorbis"),
    }


@query(f"""
SELECT l_orderkey, l_linenumber, '-i input.mp4' || turned || CASE WHEN n % 2 = 0 THEN ' -c:v libvpx-vp9 -b:v 0 -crf ' || CASE q % 4 WHEN 0 THEN '10' WHEN 1 THEN '31' WHEN 2 THEN '63' ELSE '33' END ELSE ' -c:v libvpx -b:v ' || CAST(q AS VARCHAR) END
  || CASE n % 4 WHEN 0 THEN ' -deadline good -cpu-used 5' WHEN 1 THEN ' -deadline best -cpu-used 0' ELSE ' -deadline realtime -cpu-used 8' END || ' -threads 0' || {_SOUND} || CASE WHEN q % 2 = 0 THEN ' -c:a libvorbis' ELSE ' -c:a libopus' END || audio || ' output.webm' AS argv
FROM {_TUNED}""")
def mp4_to_webm_argv(spark, sf_dir):
    return _lines(spark, sf_dir, media.mp4_to_webm(_quantity(), _tuned()))


@query(f"""
SELECT l_orderkey, l_linenumber, '-i input.webm' || turned || ' -c:v libopenh264 -b:v ' || CAST(q AS VARCHAR) || ' -pix_fmt yuv420p -movflags +faststart' || {_SOUND} || ' -c:a aac' || audio || ' output.mp4' AS argv
FROM {_TUNED}""")
def webm_to_mp4_argv(spark, sf_dir):
    return _lines(spark, sf_dir, media.webm_to_mp4(_quantity(), _tuned()))


@query(f"""
WITH l AS (SELECT *, least(2000, greatest(1, CASE WHEN q % 7 = 3 THEN 10 ELSE q - 3 END)) AS mb FROM ({_LINES})),
b AS (SELECT *, least(50000000, greatest(150000, floor((mb * 8.0::DOUBLE * 1024 * 1024 - 128000.0::DOUBLE * (n * 10)) / (n * 10) + 0.5))) AS bits FROM l)
SELECT l_orderkey, l_linenumber, '-i input.mp4' || CASE q % 3 WHEN 1 THEN ' -vf scale=-2:720' ELSE '' END || ' -c:v libopenh264 -b:v '
  || CASE n % 4 WHEN 0 THEN CASE q % 2 WHEN 0 THEN '800k' ELSE '1500k' END WHEN 1 THEN CASE q % 2 WHEN 0 THEN '400k' ELSE '1500k' END
    WHEN 2 THEN CAST(CAST(greatest(1, floor(bits / 1000 + 0.5)) AS BIGINT) AS VARCHAR) || 'k' ELSE CASE q % 2 WHEN 0 THEN '800k' ELSE '1500k' END END || ' -c:a aac -b:a 128k output.mp4' AS argv FROM b""")
def compress_video_argv(spark, sf_dir):
    n, q = F.col("l_linenumber"), _quantity()
    options = {
        "mode": _pick(n % 4, "level", "custom", "size", "?"), "level": F.when(q % 2 == 0, "Smaller").otherwise("?"), "bitrate": F.when(q % 2 == 0, "400k").otherwise("1k"),
        "targetMb": F.when(q % 7 == 3, "x").otherwise((q - 3).cast("string")), "resolution": _pick(q % 3, "keep", "720", "721"),
    }
    return _lines(spark, sf_dir, media.compress_video(options, n * 10.0))


@query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN q % 4 > 0 THEN '-ss ' || CAST(q % 4 AS VARCHAR) || ' ' ELSE '' END || CASE WHEN n > q % 4 THEN '-to ' || CAST(n AS VARCHAR) || ' ' ELSE '' END
  || '-i input.mp4 -vf fps=' || CAST(least(30, greatest(5, q)) AS VARCHAR) || CASE n % 3 WHEN 0 THEN ',scale=-2:360' WHEN 1 THEN ',scale=320:-1' ELSE ',scale=480:-1' END
  || ':flags=lanczos,split[s0][s1];[s0]palettegen=max_colors=' || CAST(least(256, greatest(32, q * 7)) AS VARCHAR) || '[p];[s1][p]paletteuse=dither=' || CASE n % 2 WHEN 0 THEN 'none' ELSE 'bayer' END
  || ' -loop ' || CASE q % 3 WHEN 0 THEN '3' ELSE '0' END || ' output.gif' AS argv FROM ({_LINES})""")
def mp4_to_gif_argv(spark, sf_dir):
    n, q = F.col("l_linenumber"), _quantity()
    options = {
        "trimStart": (q % 4).cast("string"), "trimEnd": n.cast("string"), "fps": q.cast("string"), "colors": (q * 7).cast("string"), "width": F.when(n % 3 == 1, "320").otherwise("9"),
        "height": F.when(n % 3 == 0, "360").otherwise("auto"), "dither": F.when(n % 2 == 0, "none").otherwise("?"), "loop": F.when(q % 3 == 0, "3").otherwise("2"),
    }
    return _lines(spark, sf_dir, media.mp4_to_gif(options))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN '--encrypt p' || p_size || ' ' || CASE p_size % 3 WHEN 0 THEN 'own' ELSE 'p' || p_size END || ' 256 --print=' || CASE p_size % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'none' ELSE 'full' END
    || ' --extract=' || CASE p_size % 2 WHEN 0 THEN 'n' ELSE 'y' END || ' --modify-other=y --annotate=y --form=' || CASE p_size % 3 WHEN 1 THEN 'n' ELSE 'y' END || ' --accessibility=y --assemble=y -- in.pdf out.pdf' END AS protect,
  '--password=' || CASE WHEN p_size % 4 > 0 THEN 'p' || p_size ELSE '' END || ' --decrypt in.pdf out.pdf' AS unlock, CASE p_size % 2 WHEN 0 THEN '--linearize ' ELSE '' END || 'in.pdf out.pdf' AS repair,
  '--generate-appearances --flatten-annotations=all in.pdf out.pdf' AS flatten, '--object-streams=generate --linearize in.pdf out.pdf' AS repack FROM part""")
def pdf_tool_argv(spark, sf_dir):
    size, paths = F.col("p_size"), (F.lit("in.pdf"), F.lit("out.pdf"))
    password = F.when(size % 4 > 0, F.concat(F.lit("p"), size.cast("string")))
    options = {
        "password": F.coalesce(password, F.lit("  ")), "ownerPassword": _pick(size % 3, "own", "", None), "printing": _pick(size % 5, "low", "none", "full", "?", None),
        "allowCopy": F.when(size % 2 == 0, "false").otherwise("yes"), "allowForm": F.when(size % 3 == 1, "false"),
    }
    plans = {
        "protect": media.protect_pdf(*paths, options), "unlock": media.unlock_pdf(*paths, password), "repair": media.repair_pdf(*paths, size % 2 == 0),
        "flatten": media.flatten_pdf(*paths), "repack": media.repack_pdf(*paths),
    }
    return _read(spark, sf_dir, "part").select("p_partkey", *[F.array_join(v, " ").alias(k) for k, v in plans.items()])


_FORMATS = [("wav", "pcm_s16le", ""), ("aac", "aac", " -b:a 96k"), ("flac", "flac", ""), ("ogg", "libvorbis", " -b:a 96k"), ("opus", "libopus", " -b:a 96k"), ("aiff", "pcm_s16be", "")]


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"'-i in.x -c:a {codec}' || CASE WHEN l_linenumber % 2 = 0 THEN '{rate}' ELSE '' END || CASE WHEN l_linenumber % 3 = 0 THEN ' -ar 22050 -ac 1' ELSE '' END || ' out.{name}' AS {name}" for name, codec, rate in _FORMATS
) + " FROM lineitem")
def audio_formats_argv(spark, sf_dir):
    """Every other audio format: lossless ones take no bitrate."""
    n = F.col("l_linenumber")
    options = {"bitrate": F.when(n % 2 == 0, "96k"), "sampleRate": F.when(n % 3 == 0, "22050"), "channels": F.when(n % 3 == 0, "1")}
    plans = lambda given: {name: F.array_join(media.audio(F.lit("in.x"), F.lit(f"out.{name}"), name, given), " ") for name, _, _ in _FORMATS}
    return media.planned(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], options, plans)


# Option readers


@query("""
SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 7 WHEN 1 THEN 7 ELSE least(40, greatest(5, p_size)) END AS INT) AS read_int,
  CASE p_size % 4 WHEN 2 THEN p_size * 0.5::DOUBLE ELSE 0.0::DOUBLE END AS seconds, CASE WHEN floor(p_size / 10.0 * 2 + 0.5) / 2 BETWEEN 1.5 AND 4 THEN floor(p_size / 10.0 * 2 + 0.5) / 2.0::DOUBLE ELSE 2.0::DOUBLE END AS upscale,
  CAST(CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE least(1200, p_size * 40) END AS INT) AS dpi, CASE p_size % 4 WHEN 1 THEN 0.0::DOUBLE WHEN 0 THEN 0.0::DOUBLE ELSE CAST(((p_size * 25 - 500) % 360 + 360) % 360 AS DOUBLE) END AS angle FROM part""")
def option_readers(spark, sf_dir):
    """Missing, wrong and good values of numeric options."""
    size = F.col("p_size")
    given = lambda good: F.when(size % 4 == 1, "abc").when(size % 4 > 1, good.cast("string"))
    seconds = F.when(size % 4 == 2, (size * 0.5).cast("string")).when(size % 4 == 3, "-4").otherwise(given(size))
    return _read(spark, sf_dir, "part").select(
        "p_partkey", numbers.read_int(given(size), 7, 5, 40).alias("read_int"), numbers.non_negative(seconds).alias("seconds"),
        numbers.snap_half(size / 10).alias("upscale"), choices.clamp_dpi(given(size * 40)).alias("dpi"), choices.any_angle(given(size * 25 - 500)).alias("angle"),
    )


@query("""
SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+', ' ', 'g'))) AS collapsed, md5(substr(text, 1, 20)) AS decoded FROM documents""")
def collapsed_and_decoded(spark, sf_dir):
    """White space collapsed, and the bytes of base64 data URLs."""
    head = F.to_binary(F.substring("text", 1, 20), F.lit("utf-8"))
    url = F.concat(F.lit("data:text/plain;base64,"), F.replace(F.base64(head), F.lit("\r\n"), F.lit("")))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse_space(F.col("text"))).alias("collapsed"), F.md5(text.decode_data_url(url)).alias("decoded"))


# Placement


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'empty crop' WHEN 1 THEN CASE WHEN 10 + w > w THEN 'crop outside of the image' END END AS problem,
  CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN w WHEN 2 THEN w // 2 ELSE w END AS cw, CAST(CASE p_size % 4 WHEN 1 THEN 10 ELSE 0 END AS INT) AS cx FROM
  (SELECT p_partkey, p_size * 97 + 13 AS w, CAST(p_partkey % 1900 + 40 AS INT) AS h, p_size FROM part)""")
def crop_requests(spark, sf_dir):
    w, kind = F.col("w"), F.col("p_size") % 4
    box = geometry.crop_box(w, F.col("h"), F.when(kind == 1, 10), F.when(kind == 2, -5), F.when(kind == 0, 0).when(kind == 1, w).when(kind == 2, F.floor(w / 2)), F.lit(None))
    return _parts(spark, sf_dir).select("p_partkey", box.alias("b")).select("p_partkey", F.col("b.error").alias("problem"), F.col("b.w").alias("cw"), F.col("b.x").alias("cx"))


@query(f"""
WITH p AS ({_OLD}), n AS (SELECT doc_id, page0, CASE page0 % 3 WHEN 0 THEN 'top-left' WHEN 1 THEN 'bottom-right' ELSE 'bottom-center' END AS place FROM p)
SELECT doc_id, page0, CASE WHEN page0 % 2 = 0 THEN place WHEN place LIKE '%right' THEN replace(place, 'right', 'left') WHEN place LIKE '%left' THEN replace(place, 'left', 'right') ELSE place END AS place,
  CAST(CASE WHEN page0 % 3 = 2 THEN (612 - 40) / 2 WHEN (page0 % 3 = 0) = (page0 % 2 = 1) THEN 612 - 36 - 40 ELSE 36 END AS INT) AS x, CAST(CASE WHEN page0 % 3 = 0 THEN 792 - 36 - 10 ELSE 36 END AS INT) AS y FROM n""")
def labels_on_facing_pages(spark, sf_dir):
    place = _pick(F.col("page0") % 3, "top-left", "bottom-right", "bottom-center")
    turned = geometry.facing(place, F.col("page0"))
    at = geometry.place_label(turned, F.lit(612.0), F.lit(792.0), F.lit(40.0), F.lit(10.0), 36.0)
    found = _pages(spark, sf_dir).select("doc_id", "page0", turned.alias("place"), at.alias("at"))
    return found.select("doc_id", "page0", "place", F.col("at.x").cast("int").alias("x"), F.col("at.y").cast("int").alias("y"))


@query("""
SELECT p_partkey, CAST(floor(least(1, p_size / 40.0::DOUBLE) * w + 0.5) AS INT) AS x, CAST(floor(least(1, p_size / 40.0::DOUBLE + 0.25) * w + 0.5) - floor(least(1, p_size / 40.0::DOUBLE) * w + 0.5) AS INT) AS n,
  w * 4 <= 8000 AND h * 4 <= 8000 AS fits FROM (SELECT p_partkey, p_size * 97 + 13 AS w, CAST(p_partkey % 1900 + 40 AS INT) AS h, p_size FROM part)""")
def pixels_of_regions(spark, sf_dir):
    region = F.struct((F.col("p_size") / 40).alias("x"), F.lit(0.0).alias("y"), F.lit(0.25).alias("w"), F.lit(1.0).alias("h"))
    box, large = geometry.region_pixels(region, F.col("w"), F.col("h")), geometry.upscaled(F.col("w"), F.col("h"), F.lit(4.0))
    return _parts(spark, sf_dir).select("p_partkey", box.alias("b"), large["allowed"].alias("fits")).select("p_partkey", F.col("b.x").alias("x"), F.col("b.w").alias("n"), "fits")


# Pages, names and reports


@query(f"""
WITH p AS ({_OLD}) SELECT doc_id, page0, md5(text) AS content, page0 + 1 AS part, CAST(0 AS INT) AS part_page0 FROM p""")
def split_every_page(spark, sf_dir):
    return _moved(split.every_page(_pages(spark, sf_dir)), "part", "part_page0")


@query(f"""
WITH p AS ({_OLD}) SELECT doc_id, page0, md5(text) AS content, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page0) AS INT) AS part, CAST(0 AS INT) AS part_page0 FROM p WHERE page0 + 1 IN (2, 4, 5)""")
def split_pages(spark, sf_dir):
    return _moved(split.selection(_pages(spark, sf_dir), "5-4, 2"), "part", "part_page0")


@query(f"""
WITH p AS ({_OLD}), w AS (SELECT *, length(text) AS width FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page0) - 1 AS INT) AS page0, md5(text) AS content FROM w WHERE width > 100""")
def landscape_pages(spark, sf_dir):
    sized = _pages(spark, sf_dir).withColumns({"width": F.length("text"), "height": F.lit(100)})
    return _moved(pages.by_orientation(sized, "landscape"))


@query(f"""
WITH p AS ({_OLD}) SELECT doc_id, CASE WHEN count(*) < 4 THEN 'UNSUPPORTED_INPUT' END AS error, count(*) AS n FROM p GROUP BY doc_id""")
def groups_with_too_few_inputs(spark, sf_dir):
    checked = pages.mergeable(_pages(spark, sf_dir), "doc_id", 4)
    return checked.groupBy("doc_id").agg(F.first("error").alias("error"), F.count("*").alias("n"))


@query("""
SELECT conv_id AS doc_id, n, CASE n % 4 WHEN 0 THEN 'the order must name every page once' WHEN 1 THEN 'out of range: 99' WHEN 2 THEN 'not a valid page number: x' END AS problem
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""")
def reorder_problems(spark, sf_dir):
    """Orders that leave pages out, name too many, are no numbers, and a good one."""
    sizes = _pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    whole = F.concat(F.lit("1-"), F.col("n").cast("string"))
    order = F.when(F.col("n") % 4 == 0, "1").when(F.col("n") % 4 == 1, "1, 99").when(F.col("n") % 4 == 2, F.concat(F.lit("x, "), whole)).otherwise(whole)
    return sizes.select("doc_id", "n", pages.order_problem(order, F.col("n").cast("int")).alias("problem"))


@query("""
SELECT conv_id AS archive_id, CAST(turn AS INT) AS ord, CASE WHEN k = 1 THEN role || '.txt' ELSE role || ' (' || CAST(k AS VARCHAR) || ').txt' END AS name
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)""")
def numbered_names(spark, sf_dir):
    named = _entries(spark, sf_dir).select("archive_id", "ord", names.safe_basename(F.col("name")).alias("name"))
    return archives.unique_names(named, " ({})")


@query("""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
e AS (SELECT doc_id, list_transform(a[1:3], lambda x: replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS a FROM d),
r AS (SELECT doc_id, a, list_transform(a, lambda x: '<tr class=''same''><td> </td><td>' || x || '</td></tr>') AS s FROM e)
SELECT doc_id, md5('<!doctype html><meta charset=''utf-8''><title>Comparison</title><h1>a &amp; b / c</h1><p>+1 -0</p><table>' || array_to_string(s, '') || '<tr class=''added''><td>+</td><td>&lt;last&gt;</td></tr></table>') AS page FROM r""")
def diff_reports(spark, sf_dir):
    """The whole page of a report on a line added after the first three."""
    lines = F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 3)
    same = F.transform(lines, lambda x: F.struct(F.lit(" ").alias("op"), x.alias("line")))
    added = F.array(F.struct(F.lit("+").alias("op"), F.lit("<last>").alias("line")))
    page = html.diff_report(F.concat(same, added), F.lit("a & b"), F.lit("c"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(page).alias("page"))


# Images in batches


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R' AND l_linenumber > 1) OVER (PARTITION BY l_orderkey, l_linenumber) AS p FROM lineitem)
SELECT l_orderkey AS file_id, CAST(coalesce(min(CASE WHEN p THEN l_linenumber END), min(l_linenumber)) AS INT) AS ord FROM l GROUP BY l_orderkey""")
def primary_images(spark, sf_dir):
    flag = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 1)
    frames = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("ord"), F.when(flag, True).alias("is_primary"))
    return batches.primary_images(frames).select("file_id", "ord")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber % 4 <> 0 AND l_returnflag <> 'R' AND l_discount < 0.09 AND l_quantity % 7 > 0 AND l_quantity < l_extendedprice / 1000 THEN 'reencoded' ELSE 'original' END AS kept FROM lineitem""")
def kept_encodings(spark, sf_dir):
    filters = F.when(F.col("l_linenumber") % 4 == 0, "/FlateDecode").otherwise("/DCTDecode")
    may = batches.may_reencode(filters, F.when(F.col("l_returnflag") == "R", True), F.col("l_discount") >= 0.09)
    new = F.when(F.col("l_quantity") % 7 > 0, F.col("l_quantity"))
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", batches.kept_encoding(may, F.col("l_extendedprice") / 1000, new).alias("kept"))


_IMAGES = """SELECT conv_id AS batch_id, CAST(turn AS INT) AS ord, role || CASE turn % 2 WHEN 0 THEN '.jpg' ELSE '.png' END AS name, role FROM conversations"""


def _images(spark, sf_dir):
    name = F.concat("role", F.when(F.col("turn") % 2 == 0, ".jpg").otherwise(".png"))
    return _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").cast("int").alias("ord"), name.alias("name"))


@query(f"""
SELECT batch_id, ord, name, CASE WHEN k = 1 THEN role || '.pdf' ELSE role || '-' || CAST(k AS VARCHAR) || '.pdf' END AS document, CAST(0 AS INT) AS page0
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, role ORDER BY ord) AS k FROM ({_IMAGES}))""")
def documents_of_images(spark, sf_dir):
    return batches.image_documents(_images(spark, sf_dir), each=True)


@query(f"""
SELECT batch_id, ord, name, 'images.pdf' AS document, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY ord) - 1 AS INT) AS page0 FROM ({_IMAGES})""")
def images_as_one_document(spark, sf_dir):
    return batches.image_documents(_images(spark, sf_dir))


@query("""
SELECT conv_id AS archive_id, CASE WHEN conv_id % 3 = 1 OR conv_id % 5 = 2 THEN 'DECODE_FAILED' END AS error FROM (SELECT DISTINCT conv_id FROM conversations)""")
def broken_books(spark, sf_dir):
    """Books with a broken package, a broken container or neither, beside each other."""
    book = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("archive_id")).distinct()
    key = F.col("archive_id")
    container = F.when(key % 5 == 2, "<container><rootfile full-path='OEBPS/a.opf'>").otherwise("<container><rootfiles><rootfile full-path='OEBPS/a.opf'/></rootfiles></container>")
    opf = F.when(key % 3 == 1, F.lit("<package><manifest><item id='c'")).otherwise("<package><manifest><item id='c' href='c.xhtml'/></manifest></package>")
    part = lambda path, xml: book.select("archive_id", F.lit(path).alias("path"), F.to_binary(xml, F.lit("utf-8")).alias("content"))
    return epub.package_errors(part("META-INF/container.xml", container).unionByName(part("OEBPS/a.opf", opf)))
