import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import arrays, geometry, names, numbers, ranges, text
from quire.plans import media


def value(spark, column, schema="x string", rows=((None,),)):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


@pytest.mark.parametrize(
    ("given_", "low", "high", "default", "expected"),
    [("5", 0, 10, 1, 5), ("2.5", 0, 10, 1, 3), ("-2.5", -9, 10, 1, -2), ("99", 0, 10, 1, 10), ("x", 0, 10, 7, 7), (" 4 ", 0, 10, 7, 4),
     ("", 3, 10, 7, 3), (None, 3, 10, 7, 3), ("1e1", 0, 99, 7, 10)],
)
def test_clamp_int(spark, given_, low, high, default, expected):
    assert one(spark, numbers.clamp_int(F.lit(given_).cast("string"), low, high, default)) == expected


@pytest.mark.parametrize(
    ("given_", "expected"),
    [("90", 90.0), ("1:30", 90.0), ("1:02:03.5", 3723.5), ("1:60", None), ("60:00:00", 216000.0), ("1:75:00", None), ("", None), ("a", None), ("-1", None), (" 5 ", 5.0)],
)
def test_timecode(spark, given_, expected):
    assert one(spark, numbers.timecode_seconds(F.lit(given_))) == expected


@pytest.mark.parametrize(
    ("expr", "n", "expected"),
    [("", 3, [1, 2, 3]), ("  ", 2, [1, 2]), ("1-3,5", 10, [1, 2, 3, 5]), ("3-1", 10, [1, 2, 3]), ("5-", 10, [1, 2, 3, 4, 5]), ("-2", 10, [1, 2]),
     ("x,2", 3, [2]), ("9", 3, []), ("2-99", 4, [2, 3, 4]), ("1.5", 4, []), ("2.0", 4, [2]), ("1", 0, []), (None, 2, [1, 2])],
)
def test_parse_pages(spark, expr, n, expected):
    assert one(spark, ranges.parse_pages(F.lit(expr).cast("string"), F.lit(n))) == expected


@pytest.mark.parametrize(
    ("expr", "n", "pages", "valid"),
    [("", None, [], True), ("3-1, 2", 5, [3, 2, 1], True), ("1,x", 5, [], False), ("5-", 5, [], False), ("6", 5, [], False), ("6", None, [6], True), ("0", None, [], False)],
)
def test_parse_order(spark, expr, n, pages, valid):
    found = one(spark, ranges.parse_order(F.lit(expr), F.lit(n) if n else None))
    assert (found["pages"], found["valid"], found["message"] is None) == (pages, valid, valid)


def test_append_missing(spark):
    assert one(spark, ranges.append_missing(F.array(F.lit(3), F.lit(1), F.lit(3)), F.lit(4))) == [3, 1, 2, 4]


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(1, 30), min_size=1))
def test_runs_round_trip(spark, chosen):
    text_ = one(spark, ranges.format_pages(F.array(*map(F.lit, chosen))))
    assert one(spark, ranges.parse_pages(F.lit(text_), F.lit(30))) == sorted(chosen)


@pytest.mark.parametrize(
    ("name", "new", "zipped", "base"),
    [("a.b.txt", "a.b.pdf", "a.b.txt.gz", "a.b.txt"), (".env", ".env.pdf", ".env.gz", ".env"), ("x", "x.pdf", "x.gz", "x"), ("n.", "n.pdf", "n.gz", "n."), ("a/../b\\c.d", "a/../b\\c.pdf", "a/../b\\c.d.gz", "c.d"), ("..", "..pdf", "..gz", "")],
)
def test_names(spark, name, new, zipped, base):
    assert one(spark, names.safe_basename(F.lit(name))) == base
    assert one(spark, names.replace_extension(F.lit(name), "pdf")) == new
    assert one(spark, names.gzip_name(F.lit(name))) == zipped


def test_natural_key(spark):
    given_ = ["page10", "Page2", "pâge1", "page02", "1", "x"]
    rows = spark.createDataFrame([(x,) for x in given_], "x string").orderBy(names.natural_key(F.col("x")), "x").collect()
    assert [r.x for r in rows] == ["1", "pâge1", "Page2", "page02", "page10", "x"]


def test_paths_and_titles(spark):
    assert one(spark, names.resolve_path(F.lit("OEBPS/text"), F.lit("../img/a.png#x"))) == "OEBPS/img/a.png"
    assert one(spark, names.resolve_path(F.lit("OEBPS"), F.lit("/a.png?q"))) == "a.png"
    assert one(spark, names.sanitize_title(F.lit(' a/b:  "c" '), F.lit(2))) == "a b c"
    assert one(spark, names.sanitize_title(F.lit("//"), F.lit(2))) == "part-2"
    assert one(spark, names.pad_number(F.lit(123), F.lit(12))) == "123"
    assert one(spark, names.mime_type(F.lit("A.PDF"))) == "application/pdf"


POSITIVE = {
    "email": ["a@b.co", "x.y+z@sub.mail-host.org"],
    "phone": ["555-123-4567", "(555) 123 4567", "+1 555.123.4567"],
    "creditCard": ["4111 1111 1111 1111", "4111-1111-1111-111", "4111111111111"],
    "ssn": ["123-45-6789", "123456789"],
}
NEGATIVE = {"email": ["a@b", "@b.co"], "phone": ["12345678901234"], "creditCard": ["411111111111"], "ssn": ["1234567890"]}


@pytest.mark.parametrize("kind", sorted(POSITIVE))
def test_personal_data(spark, kind):
    flag = text.pii_flags(F.col("x"))[kind]
    rows = [(x,) for x in POSITIVE[kind] + NEGATIVE[kind]]
    expected = [True] * len(POSITIVE[kind]) + [False] * len(NEGATIVE[kind])
    assert value(spark, flag, "x string", rows) == expected


def test_match_spans(spark):
    line = "é 123-45-6789 and 123-45-6780"
    found = one(spark, text.match_spans(F.lit(line), text.PII_PATTERNS["ssn"]))
    assert [(s["start"], s["end"]) for s in found] == [m.span() for m in re.finditer(r"\d{3}-\d{2}-\d{4}", line)]
    assert one(spark, text.match_spans(F.lit(""), "a")) == []


def test_long_address_is_fast(spark):
    assert one(spark, text.has_email(F.lit("a" * 10_000 + "@"))) is False


def test_texts(spark):
    assert one(spark, text.escape_html(F.lit("<a href=\"x\">'&</a>"))) == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&lt;/a&gt;"
    assert one(spark, text.normalize_typography(F.lit("“a”—b… •c™一 d﻿"))) == '"a"--b... * c(TM)  d'
    assert one(spark, text.document_text(F.array(F.lit("a"), F.lit(""), F.lit("b")))) == "a\n\nb\n"
    assert one(spark, text.document_text(F.array(F.lit("")))) == ""
    assert bytes(one(spark, text.decode_data_url(F.lit("data:image/png;base64,aGk=")))) == b"hi"
    assert one(spark, text.count_literal(F.lit("a.b A.B axb"), " a.b ")) == 2


def test_geometry(spark):
    at = lambda c: tuple(one(spark, c))
    assert at(geometry.fit_within(F.lit(4000), F.lit(1000), 1000)) == (1000, 250)
    assert at(geometry.fit_within(F.lit(10), F.lit(20), 1000)) == (10, 20)
    assert at(geometry.rotated_bounds(F.lit(100), F.lit(50), F.lit(90.0))) == (50, 100)
    assert at(geometry.resize(F.lit(100), F.lit(50), percent=300)) == (200, 100)
    assert at(geometry.resize(F.lit(100), F.lit(50), 400, 10, keep_aspect=False, no_enlarge=True)) == (100, 10)
    assert at(geometry.letterbox(F.lit(100), F.lit(50))) == (512, 256, 0, 128)
    assert at(geometry.crop_box(F.lit(10), F.lit(10), F.lit(5), F.lit(0), F.lit(6), F.lit(5)))[-1] is not None
    assert at(geometry.layout_image(F.lit(10), F.lit(20), margin="small")) == (46, 56, 18, 18, 10, 20)
    assert at(geometry.place_label(F.lit("top-right"), F.lit(600.0), F.lit(800.0), F.lit(50.0), F.lit(12.0))) == (514, 752)
    assert one(spark, geometry.facing(F.lit("bottom-left"), F.lit(1))) == "bottom-right"
    assert len(one(spark, geometry.tiles(F.lit(400.0), F.lit(250.0), F.lit(200.0), F.lit(130.0)))) == 9
    assert at(geometry.centered_origin(F.lit(100.0), F.lit(100.0), F.lit(20.0), F.lit(10.0), 0)) == (40, 45)
    box = geometry.text_region(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(10.0), F.lit(200.0), F.lit(100.0), F.lit(0.5), F.lit(1.0))
    assert at(box) == pytest.approx((0.25, 0.9, 0.25, 0.1))
    assert one(spark, geometry.text_region(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(200.0), F.lit(100.0))) is None
    region = F.struct(F.lit(0.75).alias("x"), F.lit(0.5).alias("y"), F.lit(-0.5).alias("w"), F.lit(0.25).alias("h"))
    assert at(geometry.region_pixels(region, F.lit(100), F.lit(100))) == (25, 50, 50, 25)
    assert at(geometry.page_crop(*[F.lit(x) for x in (0.0, 0.0, 100.0, 200.0)], *[F.lit(x) for x in ("10", "0", "10", "50")])) == (45, 20, 55, 160)


def test_plans(spark):
    plan = lambda c: " ".join(one(spark, c))
    lit = {k: F.lit(v) for k, v in {"trimStart": "0:15", "trimEnd": "1:30", "reverse": "true", "fadeOut": "2", "volume": "150", "bitrate": "192k", "sampleRate": "44100", "channels": "1"}.items()}
    assert plan(media.audio(F.lit("a.wav"), F.lit("o.mp3"), "mp3", lit)) == (
        "-i a.wav -c:a libmp3lame -filter:a atrim=start=15:end=90,asetpts=N/SR/TB,areverse,volume=1.5,areverse,afade=t=in:st=0:d=2,areverse"
        " -b:a 192k -ar 44100 -ac 1 o.mp3"
    )
    assert plan(media.audio(F.lit("a"), F.lit("o.wav"), "wav", {"bitrate": F.lit("192k")})) == "-i a -c:a pcm_s16le o.wav"
    assert plan(media.audio(F.lit("a"), F.lit("o.mp3"), "mp3", drop_video=True)) == "-i a -vn -c:a libmp3lame o.mp3"
    assert plan(media.compress_video()) == "-i input.mp4 -c:v libopenh264 -b:v 1500k -c:a aac -b:a 128k output.mp4"
    sized = {"mode": F.lit("size"), "targetMb": F.lit("10"), "resolution": F.lit("720")}
    assert plan(media.compress_video(sized, F.lit(60.0))) == "-i input.mp4 -vf scale=-2:720 -c:v libopenh264 -b:v 1270k -c:a aac -b:a 128k output.mp4"
    assert plan(media.mp4_to_gif({"trimStart": F.lit("5"), "trimEnd": F.lit("3")})).startswith("-ss 5 -i input.mp4 -vf fps=12,scale=480:-1")
    assert plan(media.video_trim({"trimStart": F.lit("0"), "trimEnd": F.lit("2.5")})) == "-to 2.5 -i input.mp4 -c copy output.mp4"
    assert "-c:v libvpx-vp9 -b:v 0 -crf 33" in plan(media.mp4_to_webm(F.lit(5), {"videoCodec": F.lit("vp9")}))
    assert plan(media.webm_to_mp4(F.lit(9), {"rotate": F.lit("90")})).startswith("-i input.webm -vf transpose=1 -c:v libopenh264 -b:v 9")
    assert plan(media.video_speed(F.lit(3.0), F.lit(7), F.lit(False))) == "-i input.mp4 -filter_complex [0:v]setpts=0.333333*PTS[v] -map [v] -an -b:v 7 output.mp4"
    assert one(spark, media.protect_pdf(F.lit("i"), F.lit("o"), {"password": F.lit(" ")})) is None
    assert "--encrypt p p 256 --print=full --extract=n" in plan(media.protect_pdf(F.lit("i"), F.lit("o"), {"password": F.lit("p"), "allowCopy": F.lit(False)}))
    assert plan(media.repair_pdf(F.lit("i"), F.lit("o"), F.lit(True))) == "--linearize i o"
    assert plan(media.unlock_pdf(F.lit("i"), F.lit("o"), F.lit("p"))) == "--password=p --decrypt i o"
    assert one(spark, media.source_bitrate(F.lit(100), F.lit(0))) == 4_000_000
    assert one(spark, media.tempo_chain(F.lit(0.3))) == "atempo=0.5,atempo=0.6"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 500])
def test_running_sum(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    found = one(spark, arrays.running_sum(F.array(*map(F.lit, values)) if n else F.expr("cast(array() as array<int>)")))
    assert found == list(itertools.accumulate(values))
    found = one(spark, arrays.running_max(F.array(*map(F.lit, values)) if n else F.expr("cast(array() as array<int>)")))
    assert found == list(itertools.accumulate(values, max))


def test_many_matches(spark):
    line = "é 123-45-6789, " * 300
    found = one(spark, text.match_spans(F.lit(line), text.PII_PATTERNS["ssn"]))
    assert [(s["start"], s["end"]) for s in found] == [m.span() for m in re.finditer(r"\d{3}-\d{2}-\d{4}", line)]


def test_read_int(spark):
    values = value(spark, numbers.read_int(F.col("x"), 30, 5, 100), rows=((None,), ("7.5",), ("",), ("x",), ("1e9",), ("-3",)))
    assert values == [30, 8, 5, 30, 100, 5]


@pytest.mark.parametrize(
    ("given_", "expected"),
    [("5.", 5.0), (".5", 0.5), (" 1e2\t", 100.0), (" \n", 0.0), ("", 0.0), ("1d", None), ("NaN", None), ("1 2", None), (None, None), ("-0x1", None)],
)
def test_as_number(spark, given_, expected):
    assert one(spark, numbers.as_number(F.lit(given_).cast("string"))) == expected


@pytest.mark.parametrize(
    ("given_", "expected"),
    [("1:59.99999999999999999", None), (" 1:05 ", 65.0), ("1:005", 65.0), ("007:00", 420.0), ("90.5", 90.5), ("0:90", None), ("1:2:3:4", None), ("1:", None), (None, None)],
)
def test_timecode_edges(spark, given_, expected):
    assert one(spark, numbers.timecode_seconds(F.lit(given_).cast("string"))) == expected


def test_plans_need_no_lambda(spark):
    """Spark would not compile a projection with one in it."""
    options = {k: F.col("x") for k in ("trimStart", "trimEnd", "volume", "fadeIn", "fadeOut", "bitrate", "vbr", "cropW", "cropX")}
    rows = spark.createDataFrame([("5",), (None,), ("a\0b",)], "x string")
    plans = rows.select(media.audio(F.col("x"), F.lit("o"), "m4a", options).alias("a"), media.video_crop(F.col("x"), options).alias("v"))
    assert "lambda" not in plans._jdf.queryExecution().optimizedPlan().toString().lower()
    found = [r.a for r in plans.collect()]
    assert found[1] == ["-i", "-c:a", "aac", "o"] and found[2][:2] == ["-i", "a\0b"] and found[2][-1] == "o"
    assert found[0] == ["-i", "5", "-c:a", "aac", "-filter:a", "atrim=start=5:end=5,asetpts=N/SR/TB,volume=0.5,afade=t=in:st=0:d=5,areverse,afade=t=in:st=0:d=5,areverse", "o"]


@pytest.mark.parametrize("most", [1, 4096])
def test_plans_for_sets_of_options(spark, monkeypatch, most):
    """The same plans whether made for each set or for each row, nulls among the options."""
    monkeypatch.setattr(media, "SETTINGS", most)
    given_ = [(i, v) for i, v in enumerate([None, "5", "5", "x", None, ""])]
    rows = spark.createDataFrame(given_, "id long, v string")
    found = media.planned(rows, ["id"], {"fadeIn": F.col("v"), "bitrate": F.lit("96k")}, lambda o: {"argv": media.audio(F.lit("i"), F.lit("o"), "mp3", o)})
    expected = {i: ["-i", "i", "-c:a", "libmp3lame", *(["-filter:a", "afade=t=in:st=0:d=5"] if v == "5" else []), "-b:a", "96k", "o"] for i, v in given_}
    assert {r.id: r.argv for r in found.collect()} == expected and found.columns == ["id", "argv"]
