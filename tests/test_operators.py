import gzip
import io
import random
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import archives, epub, html, images, pages, regions, split, tabular, timeline
from quire.plans import catalog, jobs
from quire.plans.run import run_plans
from quire.sources import files
from quire.streaming import ingest, naming


@pytest.fixture
def book(spark):
    rows = [(d, p, f"{d}-{p}", 0) for d, n in ((1, 5), (2, 2)) for p in range(n)]
    return spark.createDataFrame(rows, "doc_id long, page0 int, text string, rotation int")


def texts(df, doc=1):
    return [r.text for r in df.where(F.col("doc_id") == doc).orderBy("page0").collect()]


def test_pages(book):
    assert texts(pages.select(book, "4-3")) == ["1-2", "1-3"]
    assert texts(pages.delete(book, "")) == texts(book)
    assert texts(pages.delete(book, "1-5"), 1) == texts(book)
    assert texts(pages.delete(book, "1,5")) == ["1-1", "1-2", "1-3"]
    assert texts(pages.reorder(book, "5,1")) == ["1-4", "1-0", "1-1", "1-2", "1-3"]
    assert texts(pages.reorder(book, "5,1", complete=False)) == ["1-4", "1-0"]
    assert texts(pages.duplicate(book, 2), 2) == ["2-0", "2-1", "2-1"]
    assert texts(pages.insert_blank(book, None, {}), 2) == ["2-0", "2-1", None]
    assert texts(pages.insert_blank(book, -3, {"text": F.lit("x")}), 2) == ["x", "2-0", "2-1"]
    other = book.where("doc_id = 2").withColumn("doc_id", F.lit(1).cast("long"))
    assert texts(pages.interleave(book.where("doc_id = 1"), other)) == ["1-0", "2-0", "1-1", "2-1", "1-2", "1-3", "1-4"]
    turned = pages.rotate(pages.rotate(book, 90, "1"), -170, "1-2").orderBy("doc_id", "page0")
    assert [r.rotation for r in turned.collect()] == [270, 180, 0, 0, 0, 270, 180]


def test_order_problem(spark):
    ask = lambda x: spark.range(1).select(pages.order_problem(F.lit(x), F.lit(3)).alias("v")).head().v
    assert ask("3,1,2") is None
    assert ask("3,1") and ask("4,1,2") and ask("a")


def test_numbers(book):
    found = pages.number(book, "{n}/{p} {r}/{rf}", start=3, skip_first=1, place="bottom-right", mirrored=True)
    rows = [(r.label, r.place) for r in found.where("doc_id = 1").orderBy("page0").collect()]
    assert rows == [("4/7 1/4", "bottom-left"), ("5/7 2/4", "bottom-right"), ("6/7 3/4", "bottom-left"), ("7/7 4/4", "bottom-right")]
    assert pages.number(book, skip_first=3, skip_last=3).count() == 0


def test_splits_cover_each_page_once(book):
    sized = book.withColumn("size", F.lit(5 * 1024 * 1024))
    for found in (split.every_page(book), split.fixed(book, 2), split.odd_even(book), split.by_size(sized, 2)):
        assert sorted((r.doc_id, r.page0) for r in found.collect()) == sorted((r.doc_id, r.page0) for r in book.collect())
    parts = split.ranges(book, [(1, 3), (3, 2), (9, 9)]).where("doc_id = 1").collect()
    assert sorted((r.part, r.page0) for r in parts) == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert {r.part for r in split.odd_even(book, "even").collect()} == {2}
    assert split.fixed(book, None).agg(F.max("part")).head()[0] == 5


def test_outline(spark, book):
    outline = spark.createDataFrame(
        [(1, 0, "B", 3), (1, 1, "A", 1), (1, 2, "A2", 1), (1, 3, "lost", None), (1, 4, "late", 99)], "doc_id long, ord int, title string, page0 int"
    )
    sizes = book.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    found = [(r.start0, r.end0, r.title) for r in split.outline_ranges(outline, sizes).orderBy("start0").collect()]
    assert found == [(1, 2, "A"), (3, 3, "B"), (4, 4, "late")]
    assert split.by_outline(book, outline).count() == 4


def test_regions_form_an_antichain(spark):
    rng = np.random.default_rng(1)
    rows = [(int(d), 0, tuple(map(float, b))) for d, b in zip(rng.integers(0, 3, 120), rng.integers(0, 6, (120, 4)), strict=True)]
    schema = "doc_id long, page0 int, region struct<x: double, y: double, w: double, h: double>"
    manual, found = spark.createDataFrame(rows[:40], schema), spark.createDataFrame(rows[40:], schema)
    inside = lambda o, i: o[0] <= i[0] and o[1] <= i[1] and o[0] + o[2] >= i[0] + i[2] and o[1] + o[3] >= i[1] + i[3]
    distinct = set(rows)
    expected = {a for a in distinct if not any(a[0] == b[0] and a != b and inside(b[2], a[2]) for b in distinct)}
    got = [(r.doc_id, r.page0, tuple(r.region)) for r in regions.unite(manual, found).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("whole", [True, False])
def test_regions_by_place(spark, whole):
    """Against all pairs, with boxes of many sizes, in whole numbers and in fractions, empty ones too; null is a document."""
    rng = random.Random(5 + whole)
    size = lambda: rng.randint(0, 2 ** rng.randint(0, 6)) if whole else rng.random() ** 3
    place = lambda: rng.randint(-10, 60) if whole else rng.random()
    rows = [(d, 0, (float(place()), float(place()), float(size()), float(size()))) for d in (1, 2, None) for _ in range(60 * (d != 1) + 3)]
    found = regions.drop_contained(spark.createDataFrame(rows, "doc_id long, page0 int, region struct<x: double, y: double, w: double, h: double>"), ["doc_id", "page0"])
    inside = lambda b, o: o != b and o[0] <= b[0] + 1e-12 and o[1] <= b[1] + 1e-12 and b[0] + b[2] <= o[0] + o[2] + 1e-12 and b[1] + b[3] <= o[1] + o[3] + 1e-12
    expected = {(d, b) for d, _, b in rows if not any(e == d and inside(b, o) for e, _, o in rows)}
    got = [(r.doc_id, tuple(r.region)) for r in found.collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_regions_of_small_pages(spark, monkeypatch):
    """Pages of few regions take one shuffle and no join, and both ways agree: null pages, null regions, copies and other columns included."""
    rng = random.Random(8)
    box = lambda: tuple(rng.randint(0, 5) for _ in range(4)) if rng.random() < 0.95 else None
    rows = [(d, rng.choice([0, 1, None]), box(), {"n": k}) for k, d in enumerate([1, 2, 3, None] * 15 + [4] * 90)]
    df = spark.createDataFrame(rows, "doc_id long, page0 int, region struct<x: int, y: int, w: int, h: int>, note map<string, int>")
    few = regions.drop_contained(df.where("doc_id < 4 or doc_id is null"), ["doc_id", "page0"])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and few.columns == df.columns
    inside = lambda b, o: None not in (b, o) and b != o and o[0] <= b[0] and o[1] <= b[1] and b[0] + b[2] <= o[0] + o[2] and b[1] + b[3] <= o[1] + o[3]
    expected = {(d, p, b) for d, p, b, _ in rows if not any((e, q) == (d, p) and inside(b, o) for e, q, o, _ in rows)}
    held = lambda r: (r.doc_id, r.page0, r.region and tuple(r.region))
    got = sorted(map(held, few.collect()), key=str)
    assert got == sorted((k for k in expected if k[0] != 4), key=str)
    for most in (0, 10, regions.CROWDED, 1000):
        monkeypatch.setattr(regions, "CROWDED", most)
        whole = regions.drop_contained(df, ["doc_id", "page0"]).collect()
        assert sorted(map(held, whole), key=str) == sorted(expected, key=str)
        assert all((r.doc_id, r.page0, r.region and tuple(r.region)) == rows[r.note["n"]][:3] for r in whole)
        drawn = regions.unite(df.where("doc_id = 2"), df.where("doc_id = 2"))
        assert sorted(map(held, drawn.collect()), key=str) == sorted((k for k in expected if k[0] == 2), key=str)


def test_first_source_stays(spark, monkeypatch):
    rows = [(1, 0, (0, 0, 2, 2), s, k) for k, s in enumerate([1, 1, 0, 1, 0])]
    df = spark.createDataFrame(rows, "doc_id long, page0 int, region struct<x: int, y: int, w: int, h: int>, __source int, k int")
    for most in (0, 32):
        monkeypatch.setattr(regions, "CROWDED", most)
        assert [r["__source"] for r in regions.drop_contained(df, ["doc_id", "page0"]).collect()] == [0]


def test_detect(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or\ncall 555-123-4567"), (2, "nothing")], "doc_id long, text string")
    found = regions.find_spans(regions.items_of_text(docs), term="CALL")
    assert {(r.doc_id, r.item, r.preset, r.start, r.end) for r in found.collect()} == {(1, 0, "email", 5, 11), (1, 1, "phone", 5, 17), (1, 1, "search", 0, 4)}


def test_csv_files(spark, tmp_path):
    rows = [("007", 'say "hi"\nthere', " x "), ("1", "", "a,b"), ("2", "ü", "")]
    tabular.write_csv(spark.createDataFrame(rows, "id string, note string, rest string"), str(tmp_path / "t"))
    assert sorted(map(tuple, tabular.read_csv(spark, str(tmp_path / "t")).collect())) == sorted(rows)
    (tmp_path / "h.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="DECODE_FAILED"):
        tabular.read_csv(spark, str(tmp_path / "h.csv"))


def test_json_problems(spark):
    given = ['[{"a": 1}]', '{"a": 1}', "[1]", "[]", "[{", '[{"a": 1}, 2]', None]
    df = spark.createDataFrame([(x,) for x in given], "x string")
    got = [r[0] for r in df.select(tabular.json_problem(F.col("x"))).collect()]
    assert got == [None, "UNSUPPORTED_INPUT", "UNSUPPORTED_INPUT", "UNSUPPORTED_INPUT", "DECODE_FAILED", "UNSUPPORTED_INPUT", "DECODE_FAILED"]
    lenient = [r[0] for r in df.select(tabular.json_problem(F.col("x"), strict=False)).collect()]
    assert lenient[5] is None


def test_archives(spark):
    rows = [(1, 0, "a/x.txt", b"one"), (1, 1, "b/x.txt", b"two" * 500), (1, 2, "x-2.txt", b""), (2, 0, ".env", b"k=v")]
    entries = spark.createDataFrame(rows, "archive_id long, ord int, name string, content binary")
    packed = archives.zip_archives(entries)
    for r in packed.collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.content))) as z:
            assert z.testzip() is None
            if r.archive_id == 1:
                assert {n: z.read(n) for n in z.namelist()} == {"x.txt": b"one", "x-2.txt": b"two" * 500, "x-2-2.txt": b""}
    back = archives.zip_entries(packed.unionByName(spark.createDataFrame([(9, b"junk", None)], packed.schema)))
    assert {(r.archive_id, r.name, r.mime, r.error) for r in back.where("archive_id <> 1").collect()} == {
        (2, ".env", "application/octet-stream", None), (9, None, None, "DECODE_FAILED")
    }
    for r in archives.tar_archives(entries, 7).where("archive_id = 1").collect():
        with tarfile.open(fileobj=io.BytesIO(bytes(r.content))) as t:
            assert [(m.name, t.extractfile(m).read(), m.mtime) for m in t.getmembers()] == [(n, c, 7) for a, _, n, c in rows if a == 1]
    zipped = archives.gzip_files(entries.select("name", "content")).collect()
    assert gzip.decompress(bytes(zipped[1]["content"])) == b"two" * 500
    assert zipped[2]["error"] == "UNSUPPORTED_INPUT" and zipped[3]["name"] == ".env.gz"


def test_zip_traversal(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name in ("../../etc/passwd", "d/", "p/a.png", "q/a.png", "..\\b.txt"):
            z.writestr(name, "" if name.endswith("/") else name)
    found = archives.zip_entries(spark.createDataFrame([(1, raw.getvalue())], "archive_id long, content binary"))
    assert sorted(r.name for r in found.collect()) == ["a (2).png", "a.png", "b.txt", "passwd"]


def test_unique_names(spark):
    """Against naming one after the other, with names that meet numbered ones."""
    rng = random.Random(3)
    rows = [(a, i, rng.choice(["x.txt", "x.txt", "x-2.txt", "x-2-2.txt", "x-3.txt", ".env", ".env-2", "a.", "b"])) for a in range(12) for i in range(rng.randint(1, 14))]
    expected = {}
    for a in range(12):
        used = set()
        for _, i, name in (r for r in rows if r[0] == a):
            stem, dot, rest = name.rpartition(".") if name.rfind(".") > 0 else (name, "", "")
            tries = [name] + [f"{stem}-{n}{dot}{rest}" for n in range(2, 40)]
            used.add(expected.setdefault((a, i), next(t for t in tries if t not in used)))
    found = archives.unique_names(spark.createDataFrame(rows, "archive_id long, ord int, name string").repartition(3)).collect()
    assert {(r.archive_id, r.ord): r.name for r in found} == expected


def test_archives_beyond_the_format(spark):
    tiny = lambda n: spark.range(n).select(F.lit(n).alias("archive_id"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit(b"x").alias("content"))
    found = {r.archive_id: r for r in archives.zip_archives(tiny(65_536).unionByName(tiny(3)).unionByName(tiny(65_535))).collect()}
    assert (found[65_536].content, found[65_536].error) == (None, "UNSUPPORTED_INPUT")
    for n in (3, 65_535):
        with zipfile.ZipFile(io.BytesIO(bytes(found[n].content))) as z:
            assert len(z.namelist()) == n and z.read("f1") == b"x" and found[n].error is None
    little = spark.range(1).select(*[archives._little(F.lit(v), n) for v, n in ((70_000, 2), (5 * 2**30, 4), (65_535, 2), (258, 4))]).head()
    assert tuple(little) == (None, None, "FFFF", "02010000")


def test_tar_in_parts(spark):
    rows = [(1, i, f"f{i}", bytes([i]) * 700) for i in range(20)] + [(2, 0, "one", b"")]
    entries = spark.createDataFrame(rows, "archive_id long, ord int, name string, content binary")
    parts = archives.tar_parts(entries, 0, 5000).collect()
    whole = {r.archive_id: bytes(r.content) for r in archives.tar_archives(entries).collect()}
    for a in (1, 2):
        own = sorted((r.part, bytes(r.content)) for r in parts if r.archive_id == a)
        assert b"".join(c for _, c in own) == whole[a] and all(len(c) < 5000 + 3000 for _, c in own)
    assert len(parts) > 6


def test_tar_names():
    assert archives.tar_name("a" * 100) == ("a" * 100, "")
    assert archives.tar_name("d" * 90 + "/" + "f" * 50) == ("f" * 50, "d" * 90)
    assert archives.tar_name("x" * 101) is None
    assert archives.tar_name("é" * 40 + "/" + "a/" + "ü" * 49) == ("ü" * 49, "é" * 40 + "/a")
    assert archives.tar_name("a" * 120 + "/") is None and archives.tar_name("/" + "b" * 100) is None
    assert archives.tar_name("p" * 156 + "/x") is None


def test_diff(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc\n", "a\nc\nd"), (2, "same", "same"), (3, None, "x")], "id long, a string, b string")
    found = html.line_diff(pairs, "id").withColumn("page", html.diff_report(F.col("diff"), F.lit("A<"), F.lit("B")))
    rows = {r.id: r for r in found.collect()}
    assert [(x.op, x.line) for x in rows[1].diff] == [(" ", "a"), ("-", "b"), (" ", "c"), ("+", "d")]
    assert "A&lt;" in rows[1].page and "identical" in rows[2].page
    assert [(x.op, x.line) for x in rows[3].diff] == [("+", "x")]


def test_diff_hands_scripts_on(spark, monkeypatch):
    """Batches that leave a worker hold few scripts, whatever a batch of pairs holds."""
    monkeypatch.setattr(html, "SCRIPT_BYTES", 2000)
    lines = "\n".join(f"line {i}" for i in range(10))
    pairs = [(i, lines if i % 5 else None, f"{lines}\n{i}") for i in range(101)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pairs, strict=True)], names=["key", "a", "b"])
    handed = list(html._scripts([batch, batch.slice(0, 0)]))
    assert len(handed) == 51 and max(x.num_rows for x in handed) == 2
    same = [(" ", x) for x in lines.split("\n")]
    expected = {i: (same if i % 5 else [("+", x) for _, x in same]) + [("+", str(i))] for i, _, _ in pairs}
    assert {k: [tuple(x.values()) for x in v] for x in handed for k, v in zip(*x.to_pydict().values(), strict=True)} == expected
    found = html.line_diff(spark.createDataFrame(pairs, "id long, a string, b string"), "id")
    assert {r.id: [tuple(x) for x in r.diff] for r in found.collect()} == expected


def test_html_blocks(spark):
    page = '<body><h2>T</h2>loose<div>a<br>b &amp; c</div><ul><li>i</li></ul><img src="p.png"><style>x</style></body>'
    found = html.html_blocks(spark.createDataFrame([(7, page), (8, None)], "id long, html string"), "id").orderBy("block").collect()
    assert [(r.kind, r.level, r.text, r.href) for r in found] == [
        ("heading", 2, "T", None), ("paragraph", None, "loose", None), ("paragraph", None, "a b & c", None),
        ("listitem", None, "i", None), ("image", None, None, "p.png"),
    ]


def test_references_without_a_semicolon(spark):
    page = '<h1>a&amp;&amp</h1><p>&lt &copy;&copyx &am &#65;&#65 &nope; & <img src="p?a=1&copy=2">'
    frame = spark.createDataFrame([(1, page)], "id long, html string")
    read = lambda **how: [r.text or r.href for r in html.html_blocks(frame, "id", **how).orderBy("block").collect()]
    assert read(ended=True) == ["a&&amp", "&lt ©&copyx &am A&#65 &nope; &", "p?a=1&copy=2"]
    assert read()[:2] == ["a&&", "< ©©x &am AA &nope; &"]


def decode_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, {}
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]
        chunks[kind] = body
        at += 12 + size
    w, h, _, color = struct.unpack(">IIBB", chunks[b"IHDR"][:10])
    n = {0: 1, 2: 3, 6: 4}[color]
    return np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(h, w * n + 1)[:, 1:].reshape(h, w, n), chunks


@pytest.mark.parametrize("seed", range(6))
def test_edit_scripts_are_shortest(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a, b = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 25))] for _ in "ab")
        script = html.edit_script(a, b)
        assert [x for op, x in script if op != "+"] == a and [x for op, x in script if op != "-"] == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert sum(op == " " for op, _ in script) == best[-1][-1]


def test_blocks_are_cut_only_on_demand(spark):
    pages = spark.createDataFrame([(1, "<p>" + "x" * 300_000 + "</p><p>short</p>")], "id long, html string")
    whole = html.html_blocks(pages, "id").orderBy("block").collect()
    assert [(len(r.text), r.cut) for r in whole] == [(300_000, False), (5, False)]
    assert [(len(r.text), r.cut) for r in html.html_blocks(pages, "id", most=100).orderBy("block").collect()] == [(100, True), (5, False)]


def exif(order, code):
    number = lambda v, n: v.to_bytes(n, {"II": "little", "MM": "big"}[order])
    tiff = order.encode() + number(42, 2) + number(8, 4) + number(1, 2) + number(0x0112, 2) + number(3, 2) + number(1, 4) + number(code, 2) + b"\0\0" + number(0, 4)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xda\0\x02\xff\xd9"


def test_orientation(spark):
    rows = [exif("II", 6), exif("MM", 8), exif("II", 9), b"\xff\xd8\xff\xda", b"", None, exif("MM", 3)[:20]]
    found = images.orientations(spark.createDataFrame(list(enumerate(rows)), "id int, content binary")).orderBy("id").collect()
    assert [r.orientation for r in found] == [6, 8, 1, 1, 1, 1, 1]
    p = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    seen = {c: images.upright(p, c)[:, :, 0].tolist() for c in range(1, 9)}
    assert seen[1] == [[0, 1, 2], [3, 4, 5]] and seen[2] == [[2, 1, 0], [5, 4, 3]] and seen[3] == [[5, 4, 3], [2, 1, 0]]
    assert seen[4] == [[3, 4, 5], [0, 1, 2]] and seen[5] == [[0, 3], [1, 4], [2, 5]] and seen[6] == [[3, 0], [4, 1], [5, 2]]
    assert seen[7] == [[5, 2], [4, 1], [3, 0]] and seen[8] == [[2, 5], [1, 4], [0, 3]]


def test_straightened_images(spark, tmp_path):
    """A JPEG file that states a quarter turn comes upright, one without a statement and a PNG file as they are."""
    jvm, p = spark.sparkContext._jvm, np.zeros((8, 16, 3), np.uint8)
    p[:, 8:] = 255  # dark on the left, bright on the right
    picture = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for y in range(8):
        for x in range(16):
            picture.setRGB(x, y, 0xFFFFFF if x >= 8 else 0)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "plain.jpg")))
    plain = (tmp_path / "plain.jpg").read_bytes()
    (tmp_path / "turned.jpg").write_bytes(exif("MM", 6)[:-6].replace(b"\xff\xe0\0\x04ab", b"") + plain[2:])
    (tmp_path / "b.png").write_bytes(images.png_bytes(p))
    done = images.straightened(files.read_images(spark, str(tmp_path)), files.read_files(spark, str(tmp_path))).collect()
    found = {r.image.origin.rsplit("/", 1)[1]: images.pixels(r.image.asDict()) for r in done}
    assert found["plain.jpg"].shape == (8, 16, 3) and np.array_equal(found["b.png"], p)
    turned = found["turned.jpg"]
    assert turned.shape == (16, 8, 3) and turned[:6].max() < 60 and turned[10:].min() > 200


def test_palettes(spark, tmp_path):
    rng = np.random.default_rng(3)
    few = rng.integers(0, 4, (9, 7, 1), dtype=np.uint8) * np.array([80, 40, 60], np.uint8)
    many = rng.integers(0, 256, (40, 30, 4), dtype=np.uint8)
    for name, p in (("few", few), ("grey", few[:, :, :1])):
        (tmp_path / f"{name}.png").write_bytes(images.palette_png(p, 16))
    found = {r.image.origin.rsplit("/", 1)[1]: images.pixels(r.image.asDict()) for r in files.read_images(spark, str(tmp_path)).collect()}
    assert np.array_equal(found["few.png"], few) and np.array_equal(found["grey.png"], np.repeat(few[:, :, :1], 3, axis=2))
    table, at = images.palette(many, 64)
    assert 2 <= len(table) <= 64 and np.abs(table[at].astype(int) - many).max() <= 255 and np.abs(table[at].astype(int) - many).mean() < 70
    assert len(images.palette(many, 1)[0]) <= 2
    assert np.array_equal(*(x[0][x[1]] for x in (images.palette(few, 256), images.palette(few, 64))))


def test_unpacking():
    assert images.unpack(bytes(range(12)), 2, 2, 3).tolist() == [[[0, 1, 2, 255], [3, 4, 5, 255]], [[6, 7, 8, 255], [9, 10, 11, 255]]]
    assert images.unpack(bytes(range(8)) + b"more", 1, 2, 4).tolist() == [[[0, 1, 2, 3]], [[4, 5, 6, 7]]]
    assert images.unpack(b"123", 2, 1, 3) is None and images.unpack(b"", 0, 1, 3) is None and images.unpack(b"1234", 1, 1, 2) is None


def test_layout_with_a_limit_of_pages(spark):
    rows = [(1, 0, "heading", 1, 1), (1, 1, "paragraph", None, 9), (1, 2, "paragraph", None, 2)]
    blocks = spark.createDataFrame(rows, "doc_id long, ord int, kind string, level int, n_lines int")
    found = [(r.ord, r.page0, r.n_shown) for r in epub.lay_out(blocks, 250.0, 1).orderBy("ord").collect()]
    assert found == [(0, 0, 1), (1, 0, 6), (2, None, 0)]
    assert [r.n_shown for r in epub.lay_out(blocks, 250.0).orderBy("ord").collect()] == [1, 9, 2]
    three = spark.createDataFrame([(1, i, "image" if i % 2 else "paragraph") for i in range(6)], "doc_id long, ord int, kind string")
    assert sorted(r.ord for r in epub.within_count(three, "doc_id", ["ord"], "image", 2).collect()) == [0, 1, 2, 3, 4]


def test_images(spark, tmp_path):
    p = np.random.default_rng(0).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(images.png_bytes(p))
    read = files.read_images(spark, str(tmp_path))
    flipped = images.change(read, lambda x: images.flip(x, True, False))
    row = images.encoded(flipped).head()
    assert np.array_equal(decode_png(bytes(row["content"]))[0], p[:, ::-1])
    assert np.array_equal(images.rotate(p, 90), np.rot90(p, -1))
    assert images.rotate(p, 45).shape[:2] == (8, 8)
    assert np.array_equal(images.resample(p, 7, 5), p)
    assert images.letterboxed(p, 32).shape == (32, 32, 3)
    assert np.array_equal(images.crop(p, 1, 2, 3, 2), p[2:4, 1:4])
    assert images.luma(p)[0, 0, 0] == int(np.floor(p[0, 0] @ [0.299, 0.587, 0.114] + 0.5))
    assert np.array_equal(images.sharpen(np.full((3, 3, 3), 9, np.uint8)), np.full((3, 3, 3), 9))
    assert images.unpack_bits(b"\xa0", 3, 1)[0, :, 0].tolist() == [255, 0, 255] and images.unpack_bits(b"", 3, 1) is None
    alpha = np.zeros((1, 1, 4), np.uint8)
    assert images.opaque(alpha).tolist() == [[[255, 255, 255]]]
    dense = images.set_png_density(images.png_bytes(p), 300)
    assert decode_png(dense)[1][b"pHYs"] == struct.pack(">IIB", 11811, 11811, 1)
    assert images.set_png_density(b"no", 300) == b"no"
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\x00\x00\x01\x00\x01\x00\x00"
    assert images.set_jpeg_density(jpeg, 72)[13:18] == b"\x01\x00\x48\x00\x48"
    icon = images.ico_bytes(p, (256, 16, 5))
    assert struct.unpack("<HHH", icon[:6]) == (0, 1, 2) and icon[6] == 16 and icon[22] == 0


def test_files_and_gate(spark, tmp_path):
    (tmp_path / "a b.pdf").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"yy")
    found = files.gate(files.read_files(spark, str(tmp_path)), ["application/pdf"], ["pdf"]).orderBy("name").collect()
    assert [(r.name, r.mime, r.size, r.error and r.error.code) for r in found] == [
        ("a b.pdf", "application/pdf", 1, None), ("c.txt", "text/plain", 2, "UNSUPPORTED_INPUT")
    ]
    assert {r.name: r.text for r in files.read_texts(spark, str(tmp_path / "c.txt")).collect()} == {"c.txt": "yy"}


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"x")
    go = lambda: ingest.run_available(
        files.stream_files(spark, str(tmp_path / "in")), lambda d: d.select("name", "size"), str(tmp_path / "out"), str(tmp_path / "cp")
    ).awaitTermination()
    go()
    (tmp_path / "in" / "b.txt").write_bytes(b"xyz")
    go()
    assert sorted((r.name, r["size"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a.txt", 1), ("b.txt", 3)]


def test_files_seen_before(spark, tmp_path):
    """The same name and size in another folder or with other content is a new file."""
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.txt").write_bytes(folder.encode())
    (tmp_path / "in" / "b" / "y.txt").write_bytes(b"a")
    stream = spark.readStream.format("binaryFile").schema(files.BINARY).option("recursiveFileLookup", "true").load(str(tmp_path / "in"))
    twice = files._files(stream)
    twice = twice.unionByName(twice)
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    ingest.new_files_only(twice).select("name", "content").writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.name, bytes(r.content)) for r in spark.read.parquet(target).collect()) == [("x.txt", b"a"), ("x.txt", b"b"), ("y.txt", b"a")]


def test_layout_by_lines(spark):
    """Against setting line by line."""
    rng = random.Random(3)
    kinds = [("heading", 1), ("heading", 3), ("heading", 6), ("heading", None), ("heading", 0), ("heading", 9), ("paragraph", None), ("listitem", None)]
    rows = [(d, i, *rng.choice(kinds), rng.choice([0, 1, 1, 2, 5, 40])) for d in range(6) for i in range(30)]
    blocks = spark.createDataFrame(rows, "doc_id long, ord int, kind string, level int, n_lines int")
    for height, most in ((250.0, None), (250.0, 7), (125.0, None), (841.89, 3)):
        expected = {}
        for d in range(6):
            page, y, full = 0, 56.0, False
            for _, i, kind, level, n in (r for r in rows if r[0] == d):
                size = 11.0 if kind != "heading" else 16.0 if not level else {1: 20.0, 3: 14.0, 6: 11.0}.get(level, 14.0)
                y += size / 2 if kind == "heading" and y > 56 and not full else 0
                lines = []
                while len(lines) < n:
                    if y + size * 1.45 > height - 56 + 1e-6:
                        if most and page + 1 >= most:
                            full = True
                            break
                        page, y = page + 1, 56.0
                    lines.append((page, round(y, 4)))
                    y += size * 1.45
                y += 6.0
                expected[d, i] = (*(lines or [(None, None)])[0], len(lines))
        found = {(r.doc_id, r.ord): (r.page0, r.y if r.y is None else round(r.y, 4), r.n_shown) for r in epub.lay_out(blocks, height, most).collect()}
        assert found == expected


def test_stream_windows(spark, tmp_path):
    rows = [(i, "k", float(i)) for i in range(10)]
    events = spark.createDataFrame(rows, "s long, event_type string, value double").select(F.timestamp_seconds(F.col("s") * 1200).alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = ingest.windowed_sums(stream).writeStream.format("memory").queryName("sums").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n), sum(total) FROM sums").head() == (10, 45.0)
    assert ingest.sessions(events.withColumn("user_id", F.lit(1)), gap="15 minutes").count() == 10


def test_plans_without_the_tool(spark):
    df = spark.createDataFrame([("f", ["x"], "in", "out", b"1")], "file_id string, argv array<string>, input_name string, output_name string, content binary")
    assert run_plans(df, "no-such-tool-here").head()["error"] == "TOOL_MISSING"
    assert bytes(run_plans(df.withColumn("argv", F.array(F.lit("in"), F.lit("out"))), "cp").head()["content"]) == b"1"
    assert run_plans(df, "false").head()["error"] == "DECODE_FAILED"


def test_plans_with_a_tool(spark, tmp_path):
    """A tool that copies, one that fails, one that takes too long, and one that is no program."""
    tool, broken = tmp_path / "tool", tmp_path / "broken"
    tool.write_text("#!/bin/sh\ncase $1 in copy) cat in > out;; slow) sleep 60;; *) exit 3;; esac\n")
    broken.write_text("#!/no/such/program\n")
    tool.chmod(0o755)
    broken.chmod(0o755)
    rows = [("a", ["copy"], b"bytes"), ("b", ["fail"], b""), ("c", ["slow"], b"")]
    plans = spark.createDataFrame([(i, a, "in", "out", c) for i, a, c in rows], "file_id string, argv array<string>, input_name string, output_name string, content binary")
    found = {r.file_id: (None if r.content is None else bytes(r.content), r.error) for r in run_plans(plans, str(tool), 2).collect()}
    assert found == {"a": (b"bytes", None), "b": (None, "DECODE_FAILED"), "c": (None, "DECODE_FAILED")}
    assert {r.error for r in run_plans(plans, str(broken)).collect()} == {"TOOL_MISSING"}


def test_second_plans_and_cores(spark, tmp_path):
    """A plan that fails is followed by the row's second one; a tool of several threads has tasks of as many cores."""
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\ncase $1 in good) cat in > out;; *) exit 3;; esac\n")
    tool.chmod(0o755)
    rows = [("a", ["good"], ["bad"]), ("b", ["bad"], ["good"]), ("c", ["bad"], ["bad"]), ("d", ["bad"], None)]
    schema = "file_id string, argv array<string>, argv_again array<string>, input_name string, output_name string, content binary"
    plans = spark.createDataFrame([(i, a, b, "in", "out", b"x") for i, a, b in rows], schema)
    found = {r.file_id: (r.content and bytes(r.content), r.error) for r in run_plans(plans, str(tool), 5).collect()}
    assert found == {"a": (b"x", None), "b": (b"x", None), "c": (None, "DECODE_FAILED"), "d": (None, "DECODE_FAILED")}
    profile = lambda cores: run_plans(plans, str(tool), 5, cores)._jdf.queryExecution().analyzed().profile()
    assert profile(1).isEmpty() and profile(3).get().taskResources().apply("cpus").amount() == 3.0


def test_names_of_a_stream(spark, tmp_path):
    """As one batch over the same files, with a restart in between."""
    rng = random.Random(5)
    rows = [(a, i, rng.choice(["x.txt", "x.txt", "x-2.txt", "x-2-2.txt", ".env", "b"])) for i in range(12) for a in (1, 2)]
    entries = spark.createDataFrame(rows, "archive_id long, ord int, name string")
    timed = entries.withColumn("modified", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ord")))
    for first, last in ((0, 5), (5, 12)):
        timed.where(f"ord >= {first} and ord < {last}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in"))
        write = naming.unique_names(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = write.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    found = {(r.archive_id, r.ord): r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(r.archive_id, r.ord): r.name for r in archives.unique_names(entries).collect()} and len(found) == len(rows)


def test_catalog(spark):
    found = catalog.operators(spark)
    assert found.count() == 70 and found.select("id").distinct().count() == 70
    row = found.where("id = 'pdf-merge'").head()
    assert (row.least_inputs, row.many_outputs, row.accepts, row.extension) == (2, False, ["application/pdf"], "pdf")
    assert catalog.option_columns("size", "dimensions") == ["sizeWidth", "sizeHeight", "sizeKeepAspect"]


def test_samples(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], T.StructType([T.StructField("s", T.ArrayType(T.DoubleType()))]))
    ask = lambda c: df.select(c.alias("v")).head().v
    assert ask(timeline.fade_out(F.col("s"), 2)) == [1.0, 2.0, 1.5, 0.0]
    assert ask(timeline.trim_samples(F.col("s"), 2, 0.5, 1.5)) == [2.0, 3.0]
    assert ask(timeline.trim_samples(F.col("s"), 2, 0.5, 0.1)) == [2.0, 3.0, 4.0]
    assert ask(timeline.channel_difference(F.col("s"), F.reverse("s"))) == [-3.0, -1.0, 1.0, 3.0]


def test_epub(spark):
    container = b'<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
    opf = b'<package xmlns="urn:y"><manifest><item id="b" href="two%20b.xhtml"/><item id="a" href="One.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="gone"/><itemref idref="a"/></spine></package>'
    rows = [("META-INF/container.xml", container), ("OEBPS/book.opf", opf), ("OEBPS/two b.xhtml", b"<h1>T\xe2\x80\x94wo</h1><img src='../i.png'/>"), ("OEBPS/one.xhtml", b"<p>first</p>")]
    entries = [(1, p, c) for p, c in rows] + [(2, p, c) for p, c in rows] + [(2, "META-INF/encryption.xml", b"")]
    found = epub.blocks(spark.createDataFrame(entries, "archive_id long, path string, content binary")).orderBy("chapter", "block").collect()
    assert [(r.archive_id, r.chapter, r.kind, r.text, r.href) for r in found] == [
        (1, 0, "heading", "T--wo", None), (1, 0, "image", None, "i.png"), (1, 1, "paragraph", "first", None)
    ]


def test_jobs(spark):
    with jobs.cancellable(spark, "quire-test") as stop:
        assert spark.range(3).count() == 3 and stop() == []
    assert "quire-test" not in spark.getTags() and jobs.progress(spark) == []


def test_quality_search_and_matte():
    encode = lambda q: bytes(int(q * 1000))
    assert 590 <= len(images.best_quality(encode, 600)) <= 600
    assert len(images.best_quality(encode, 50)) > 100 - 1
    p = np.full((4, 8, 3), 9, np.uint8)
    assert (images.with_matte(p, np.ones((16, 16)))[:, :, 3] == 255).all()
    assert (images.with_matte(p, np.full((16, 16), 0.5))[:, :, 3] == 128).all()
