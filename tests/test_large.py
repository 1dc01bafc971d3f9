"""Groups that hold all rows: offsets, files, ranges, trees and differences, against plain versions."""

import io
import math
import os
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import archives, diff, intervals, prefix, split, tree
from quire.operators.html import edit_script
from quire.sources import placed


def test_sums_of_one_group_come_from_many_slices(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("int").alias("g"), (F.col("id") * 7919 % 20_000).alias("o"), (F.col("id") % 13).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(1, 5, 2), (1, 4, 3)], "g int, o long, v long"))
    found = {(r.g, r.o): r.s for r in prefix.sums_before(rows, ["g"], ["o"], {"s": F.col("v")}).collect()}
    expected, total = {}, 0
    for _, o, v in sorted((r for r in rows.collect() if r.g is None), key=lambda r: r.o):
        expected[None, o], total = total, total + v
    assert found == expected | {(1, 4): 0, (1, 5): 3}


def test_no_task_has_all_of_a_group(spark, monkeypatch):
    """Slices of the one group are windows of their own; contents take no part in windows."""
    slices = {}

    def watched(df, whole=prefix.stored):
        out = whole(df)
        slices.update({r["__slice"]: r["count"] for r in out.groupBy("__slice").count().collect()})
        return out

    monkeypatch.setattr(prefix, "stored", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        entries = spark.range(40_000).select(F.lit(1).alias("archive_id"), F.col("id").alias("ord"), F.lit("f").alias("name"), F.lit(b"x" * 10).alias("content"))
        offsets, totals = archives.tar_layout(entries)
        assert totals.head().bytes == 40_000 * 1024 + 1024 and offsets.agg(F.max("offset")).head()[0] == 39_999 * 1024
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(slices) == 4 and max(slices.values()) < 20_000
    sums = prefix.sums_before(entries, ["archive_id"], ["ord"], {"offset": F.octet_length("content")})
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "content" not in plan


def made(spark, rows):
    return spark.createDataFrame(rows, "archive_id long, ord int, name string, content binary")


def test_files(spark, tmp_path):
    rows = [(1, i, f"d/{i % 3}.txt", bytes([i]) * (i * 300)) for i in range(30)] + [(2, 0, "x" * 120, b"q"), (2, 1, "ok", b"z"), (None, 0, "n", b"")]
    entries = made(spark, rows).repartition(5)
    found = {r.archive_id: r for r in archives.tar_files(entries, str(tmp_path / "t"), 9).collect()}
    assert (found[2].name, found[2].bytes, found[2].error) == (None, None, "UNSUPPORTED_INPUT")
    assert sorted(os.listdir(tmp_path / "t")) == ["1.tar", "null.tar"]
    with tarfile.open(tmp_path / "t/1.tar") as t:
        assert [(m.name, t.extractfile(m).read(), m.mtime) for m in t.getmembers()] == [(n, c, 9) for a, _, n, c in rows if a == 1]
    assert os.path.getsize(tmp_path / "t/1.tar") == found[1].bytes and found[None].bytes == 512 + 1024
    in_row = {r.archive_id: r for r in archives.tar_archives(entries, 9).collect()}
    assert bytes(in_row[1].content) == (tmp_path / "t/1.tar").read_bytes() and (in_row[2].content, in_row[2].error) == (None, "UNSUPPORTED_INPUT")
    parts = archives.tar_parts(entries).where("archive_id = 2").collect()
    assert [(p.part, p.content, p.error) for p in parts] == [(None, None, "UNSUPPORTED_INPUT")]
    zipped = {r.archive_id: r for r in archives.zip_files(entries, f"file:{tmp_path}/z").collect()}
    with zipfile.ZipFile(tmp_path / "z/1.zip") as z:
        assert z.testzip() is None and z.namelist()[:4] == ["0.txt", "1.txt", "2.txt", "0-2.txt"] and z.read("0-2.txt") == rows[3][3]
    assert os.path.getsize(tmp_path / "z/1.zip") == zipped[1].bytes


def test_archive_of_many_entries(spark, tmp_path):
    """More entries than two bytes count: fields of ZIP64."""
    n = 66_000
    entries = spark.range(n).select(F.lit(7).alias("archive_id"), F.col("id").cast("int").alias("ord"), F.format_string("f%d", "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    archives.zip_files(entries, str(tmp_path)).collect()
    with zipfile.ZipFile(tmp_path / "7.zip") as z:
        assert len(z.namelist()) == n and z.read("f65999") == b"65999" and z.read("f3") == b"3"


def test_directory_beyond_four_bytes(spark):
    """An archive with a hole of five gigabytes in it is read by its directory."""
    at, content = 5 * 2**30, b"far away"
    row = made(spark, [(1, 0, "a/far.txt", content)])
    packed = archives._deflate(archives._named(row)).withColumn("offset", F.lit(at))
    r = packed.select(archives._local().alias("local"), archives._directory_entry().alias("entry")).head()
    start = at + len(r.local)
    end = spark.createDataFrame([(1, start, len(r.entry))], "n long, start long, length long").select(archives._directory_end()).head()[0]

    class Sparse(io.RawIOBase):
        tail, position = bytes(r.local) + bytes(r.entry) + bytes(end), 0

        def seekable(self):
            return True

        def readable(self):
            return True

        def tell(self):
            return self.position

        def seek(self, offset, whence=0):
            self.position = offset + (0, self.position, at + len(self.tail))[whence]
            return self.position

        def read(self, n=-1):
            held = bytes(max(0, min(n, at - self.position))) + self.tail[max(0, self.position - at) :] if n >= 0 else self.tail[self.position - at :]
            held = held[:n] if n >= 0 else held
            self.position += len(held)
            return held

    with zipfile.ZipFile(Sparse()) as z:
        assert z.infolist()[0].header_offset == at and z.read("far.txt") == content


def test_archive_above_two_gigabytes(spark, tmp_path):
    each, n = 1 << 20, 2100
    content = F.to_binary(F.repeat(F.lit("q"), each), F.lit("utf-8"))
    entries = spark.range(n, numPartitions=64).select(F.lit(1).alias("archive_id"), F.col("id").alias("ord"), F.format_string("f%04d", "id").alias("name"), content.alias("content"))
    found = archives.tar_files(entries, str(tmp_path)).head()
    assert found.bytes == n * (each + 512) + 1024 == os.path.getsize(tmp_path / "1.tar") > 2**31
    with tarfile.open(tmp_path / "1.tar") as t:
        assert t.getnames() == [f"f{i:04d}" for i in range(n)] and t.extractfile("f2099").read() == b"q" * each
    os.remove(tmp_path / "1.tar")


def test_nothing_is_seen_of_a_failed_job(spark, tmp_path):
    rows = spark.range(8, numPartitions=8).select(F.lit("whole").alias("name"), F.col("id").alias("offset"), F.lit(b"x").alias("content"))
    bad = rows.withColumn("name", F.when(F.col("offset") == 7, "no/name").otherwise(F.col("name")))
    with pytest.raises(Exception, match="no name of a file"):
        placed.write_placed(bad, str(tmp_path))
    assert os.listdir(tmp_path) == []
    placed.write_placed(rows, str(tmp_path))
    assert (tmp_path / "whole").read_bytes() == b"x" * 8
    with pytest.raises(ValueError, match="mounted"):
        placed.mounted("hdfs://host/folder")


def test_cells_make_up_an_interval(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(200)] + [(0, 0), (0, 1023), (1, 1), (3, 2), (2**33, 2**33 + 5)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", intervals.cells(F.col("a"), F.col("b")).alias("c")).collect():
        held = sorted(x for c in r.c for x in range(c.cell << c.level, (c.cell + 1) << c.level))
        assert held == list(range(r.a, r.b + 1)) and len(r.c) <= 2 * max(1, (r.b - r.a + 1)).bit_length()


@pytest.mark.parametrize("merged", [False, True])
def test_ranges_as_rows(spark, merged):
    rng = random.Random(4)
    sizes = {1: 50, 2: 7, None: 4}
    pages = spark.createDataFrame([(d, p) for d, n in sizes.items() for p in range(n)], "doc_id long, page0 int")
    end = lambda: rng.choice([rng.uniform(-3, 60), rng.uniform(-3, 60), math.inf, math.nan])
    rows = [(d, i, end(), end()) for d in (1, 2, None, 4) for i in range(30)]
    found = split.by_ranges(pages, spark.createDataFrame(rows, "doc_id long, ord int, a double, b double"), merged)
    expected = []
    for d, n in sizes.items():
        part = before = 0
        for _, _, a, b in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]):
            if math.isfinite(a) and math.isfinite(b):
                low, high = max(1, math.floor(min(a, b))), min(n, math.floor(max(a, b)))
                if low <= high:
                    part += 1
                    expected += [(d, 1 if merged else part, (before if merged else 0) + k, low - 1 + k) for k in range(high - low + 1)]
                    before += high - low + 1
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.part, r.part_page0, r.page0)) for r in found.collect())


def test_many_ranges_of_one_document(spark):
    """Pages and ranges meet as often as a range holds a page, and at most at every level besides."""
    n = 20_000
    doc = F.floor(F.col("id") / 1e9).alias("doc_id")
    pages = spark.range(n).select(doc, F.col("id").cast("int").alias("page0"))
    wanted = spark.range(n).select(doc, F.col("id").alias("ord"), (F.col("id") + 1).alias("a"), (F.col("id") + 2).alias("b"))
    found = split.by_ranges(pages, wanted)
    assert found.count() == 2 * n - 1 and "Cartesian" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_page_trees(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for doc in (1, 2):
        children = {0: []}
        for node in range(1, 60):
            parent = rng.choice(list(children)) if doc == 1 else node - 1  # bushy, and a chain of 60
            children[parent].append(node)
            children[node] = []
        order = {n: rng.randint(0, 5) for n in children}
        box = {n: rng.choice([None, None, n]) for n in children}
        parent_of = {c: p for p, own in children.items() for c in own}
        rows += [(doc, n, parent_of.get(n), order[n], not children[n], box[n]) for n in children]
        leaves = []

        def walk(n, held, children=children, order=order, box=box, leaves=leaves):
            held = box[n] if box[n] is not None else held
            if not children[n]:
                leaves.append((n, held))
            for c in sorted(children[n], key=lambda c: (order[c], c)):
                walk(c, held)

        walk(0, None)
        expected |= {(doc, n): (i, held) for i, (n, held) in enumerate(leaves)}
    rows += [(3, 1, 2, 0, False, 1), (3, 2, 1, 0, False, 1), (3, 4, 1, 0, True, 1), (3, 5, None, 0, True, None)]  # a circle and what hangs on it
    nodes = spark.createDataFrame(rows, "doc_id int, node int, parent int, ord int, leaf boolean, box int")
    found = tree.pages_of_tree(nodes, ["box"]).collect()
    assert {(r.doc_id, r.node): (r.page0, r.box) for r in found} == expected | {(3, 5): (0, None)}


def scripts(spark, pairs, most=diff.GAP):
    a = spark.createDataFrame([(k, i, x) for k, (own, _) in pairs.items() for i, x in enumerate(own)], "key string, i int, line string")
    b = spark.createDataFrame([(k, i, x) for k, (_, own) in pairs.items() for i, x in enumerate(own)], "key string, j int, line string")
    rows = diff.line_script(a, b, most).collect()
    return {k: sorted((r for r in rows if r.key == k), key=lambda r: (r.gap, r.kind, r.at)) for k in pairs}


def test_large_differences(spark, monkeypatch):
    monkeypatch.setattr(diff, "SLICE", 64)
    rng = random.Random(6)
    own = [f"line {i}" for i in range(400)]
    changed = [y for x in own if rng.random() > 0.1 for y in ([x, f"new {rng.random()}"] if rng.random() < 0.1 else [x])]
    alike = [f"w{rng.randint(0, 15)}" for _ in range(200)]
    pairs = {
        "changed": (own, changed), "moved": (own, own[150:] + own[:150]), "same": (own, own), "reversed": (own[:100], own[:100][::-1]),
        "alike": (alike, [x for x in alike if rng.random() > 0.2]), "apart": (own[:40], alike[:30]), None: (own[:20], own[5:25]), "new": ([], own[:5]),
    }
    for most in (50, 4096):
        for key, script in scripts(spark, pairs, most).items():
            a, b = pairs[key]
            assert [r.line for r in script if r.op != "+"] == a and [r.line for r in script if r.op != "-"] == b
            if key != "alike":
                assert sum(r.op != " " for r in script) == sum(op != " " for op, _ in edit_script(a, b))


def test_small_pairs_are_compared_as_a_whole(spark, monkeypatch):
    """By a shortest script and without rounds over all pairs, whatever lines repeat; a pair of many bytes is a large one."""
    rng = random.Random(8)
    pairs = {f"{i}": ([f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 40))], [f"w{rng.randint(0, 9)}" for _ in range(rng.randint(0, 40))]) for i in range(300)}
    pairs |= {None: (["a", "b"], ["b", "c"]), "alike": (["x"] * 900, ["y"] + ["x"] * 700), "apart": ([f"a{i}" for i in range(900)], [f"b{i}" for i in range(900)])}
    pairs = {k: v for k, v in pairs.items() if v != ([], [])}
    monkeypatch.setattr(diff, "PAIR_BYTES", 8 * 1800)
    whole = diff.line_matches
    monkeypatch.setattr(diff, "line_matches", lambda *_: pytest.fail("pairs of few lines go through rounds"))
    for key, script in scripts(spark, pairs).items():
        a, b = pairs[key]
        assert [r.line for r in script if r.op != "+"] == a and [r.line for r in script if r.op != "-"] == b
        assert sum(r.op != " " for r in script) == sum(op != " " for op, _ in edit_script(a, b))
    monkeypatch.setattr(diff, "line_matches", whole)
    monkeypatch.setattr(diff, "PAIR_BYTES", 20)
    few = {"bytes": (["long line"] * 3 + ["z"], ["long line", "y"]), "short": (["a"], ["b"])}
    for key, script in scripts(spark, few).items():
        assert [r.line for r in script if r.op != "+"] == few[key][0] and [r.line for r in script if r.op != "-"] == few[key][1]


def test_common_lines(monkeypatch):
    """By a chain of meetings or, where lines meet too often for it, by a shortest script: as many either way."""
    rng = random.Random(9)
    for n in (0, 1, 5, 30, 80):
        for kinds in (1, 3, 40):
            a, b = ([rng.randint(0, kinds) for _ in range(rng.randint(0, n))] for _ in range(2))
            for most in (0, 1 << 20):
                monkeypatch.setattr(diff, "MEETINGS", most)
                i, j = (x.tolist() for x in diff.common(a, b))
                assert i == sorted(set(i)) and j == sorted(set(j)) and [a[x] for x in i] == [b[x] for x in j]
                assert len(i) == sum(op == " " for op, _ in edit_script(a, b))


def test_chains(spark):
    """Against the longest increasing subsequence: slices keep nearly all of it where lines are mostly in order."""
    import numpy as np

    rng = random.Random(7)
    assert [len(diff.increasing(np.array(v))) for v in ([], [3, 1, 2], [1, 1, 1], [5, 4, 3])] == [0, 2, 1, 1]
    assert diff.increasing(np.array([5, 1, 2, 3]), np.array([9, 2, 2, 2])).tolist() == [0]
    assert diff.border(np.array([1, 2, 90]), np.array([3, 4, 5])) == 3
    values = list(range(600))
    for _ in range(30):
        i, j = rng.randrange(600), rng.randrange(600)
        values.insert(j, values.pop(i))
    whole = len(diff.increasing(np.array(values)))
    before, diff.SLICE = diff.SLICE, 50
    try:
        rows = spark.createDataFrame([("k", 0, i, v) for i, v in enumerate(values)], "key string, gap long, i long, j long")
        found = sorted((r.i, r.j) for r in diff.chains(rows).collect())
    finally:
        diff.SLICE = before
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:], strict=False)) and len(found) > 0.95 * whole
