"""Queries of operators that deal out groups of any size: offsets, files, ranges, trees, differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import archives, diff, prefix, split, tree
from .operators.lineage import shared_folder, stored
from .queries import _entries, _moved, _OLD, _pages, _read, query


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS size FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(512 + ceil(size / 512) * 512) OVER w, 0) AS BIGINT) AS "offset",
  CAST(coalesce(sum(CAST(ceil(size) AS BIGINT)) OVER w, 0) AS BIGINT) AS used
FROM e WINDOW w AS (ORDER BY l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def one_archive_offsets(spark, sf_dir):
    """Offsets and used budget of all line items as entries of a single archive."""
    keys = ["l_orderkey", "l_linenumber"]
    found = _read(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.max("l_extendedprice").alias("size"))
    values = {"offset": archives.padded(F.col("size")) + archives.BLOCK, "used": F.ceil("size")}
    return prefix.sums_before(found, [], keys, values)


_TAR = """
WITH e AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 3 THEN repeat('folder/', 30) ELSE '' END AS prefix, role || '.txt' AS name,
  conv_id % 11 = 5 AND turn = 1 AS wrong, text, octet_length(encode(text)) AS size FROM conversations),
h AS (SELECT *, rpad(CASE WHEN prefix = '' THEN name ELSE substr(prefix || name, 155) END, 100, chr(0)) || '0000644' || chr(0) || '0000000' || chr(0) || '0000000' || chr(0) || lpad(printf('%o', size), 11, '0') || chr(0) || '00000000000' || chr(0) AS a,
  '0' || repeat(chr(0), 100) || 'ustar' || chr(0) || '00' || repeat(chr(0), 80) || rpad(substr(prefix, 1, 153), 155, chr(0)) || repeat(chr(0), 12) AS b FROM e),
f AS (SELECT *, a || lpad(printf('%o', CAST(list_sum(list_transform(string_split(a || b, ''), lambda c: ascii(c))) + 256 AS BIGINT)), 6, '0') || chr(0) || ' ' || b AS head FROM h),
g AS (SELECT conv_id, bool_or(wrong) AS wrong, CAST(sum(512 + ceil(size / 512.0) * 512) + 1024 AS BIGINT) AS size,
  md5(string_agg(head || text || repeat(chr(0), CAST((512 - size % 512) % 512 AS INT)), '' ORDER BY turn) || repeat(chr(0), 1024)) AS digest FROM f GROUP BY conv_id)
SELECT conv_id AS archive_id, CASE WHEN NOT wrong THEN size END AS bytes, CASE WHEN NOT wrong THEN digest END AS digest, CASE WHEN wrong THEN 'UNSUPPORTED_INPUT' END AS error FROM g"""


@query(_TAR)
def tar_files_written(spark, sf_dir):
    """TAR files on disk, read again: names with folders before them, and names that do not fit."""
    folders = F.when(F.col("archive_id") % 7 == 3, "folder/" * 30).otherwise("")
    wrong = (F.col("archive_id") % 11 == 5) & (F.col("ord") == 1)
    name = F.concat(folders, F.when(wrong, F.lit("x" * 101)).otherwise(F.substring("name", 7, 100)))
    folder = shared_folder(spark)
    written = archives.tar_files(_entries(spark, sf_dir).withColumn("name", name), folder)
    return _read_again(spark, written, folder)


def _read_again(spark, written, folder):
    read = spark.read.format("binaryFile").load(folder)
    on_disk = read.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("digest"), F.octet_length("content").cast("long").alias("n"))
    both = written.join(on_disk, "name", "left")
    return both.select("archive_id", F.when(F.col("n") == F.col("bytes"), F.col("bytes")).alias("bytes"), "digest", "error")


@query("""
SELECT conv_id AS archive_id, CAST(turn AS INT) AS ord, CASE WHEN k = 1 THEN role || '.txt' ELSE role || '-' || CAST(k AS VARCHAR) || '.txt' END AS name, md5(text) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)""")
def zip_files_written(spark, sf_dir):
    folder = shared_folder(spark)
    written = archives.zip_files(_entries(spark, sf_dir), folder)
    read = spark.read.format("binaryFile").load(folder)
    named = read.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    entries = archives.zip_entries(written.select("archive_id", "name").join(named, "name").select("archive_id", "content"))
    return entries.select("archive_id", "ord", "name", F.md5("content").alias("digest"))


@query(f"""
WITH p AS ({_OLD}), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
w AS (SELECT doc_id, page0 AS ord, greatest(1, least(page0 + 1, length(text) % 5)) AS a, least(n, greatest(page0 + 1, length(text) % 5)) AS b FROM p JOIN n USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS part FROM w WHERE a <= b)
SELECT p.doc_id, p.page0, md5(text) AS content, CAST(part AS INT) AS part, CAST(page0 + 1 - a AS INT) AS part_page0
FROM p JOIN r ON p.doc_id = r.doc_id AND page0 + 1 BETWEEN a AND b""")
def split_range_relation(spark, sf_dir):
    """Ranges of each document as rows: from a turn's number to a number that its text gives."""
    found = _pages(spark, sf_dir)
    wanted = found.select("doc_id", F.col("page0").alias("ord"), (F.col("page0") + 1.5).alias("a"), (F.length("text") % 5).cast("double").alias("b"))
    return _moved(split.by_ranges(found, wanted), "part", "part_page0")


@query(f"""
WITH p AS ({_OLD}), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
w AS (SELECT doc_id, page0 AS ord, greatest(1, page0) AS a, least(n, page0 + 2) AS b FROM p JOIN n USING (doc_id) WHERE page0 % 2 = 1),
r AS (SELECT *, coalesce(sum(b - a + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w WHERE a <= b)
SELECT p.doc_id, p.page0, md5(text) AS content, CAST(1 AS INT) AS part, CAST(before + page0 + 1 - a AS INT) AS part_page0
FROM p JOIN r ON p.doc_id = r.doc_id AND page0 + 1 BETWEEN a AND b""")
def split_ranges_merged(spark, sf_dir):
    found = _pages(spark, sf_dir)
    wanted = found.where("page0 % 2 = 1").select("doc_id", F.col("page0").alias("ord"), (F.col("page0") + 2).alias("a"), F.col("page0").alias("b"))
    return _moved(split.by_ranges(found, wanted, merged=True), "part", "part_page0")


@query("""
WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, turn % 5 * 10 - turn AS ord,
    CASE WHEN role = 'user' THEN length(text) END AS box, CASE WHEN turn % 3 = 0 THEN turn * 90 % 360 END AS rotation FROM conversations),
t AS (SELECT conv_id, turn, [-ord] AS path, box, rotation FROM n WHERE parent IS NULL
  UNION ALL SELECT n.conv_id, n.turn, list_append(t.path, -n.ord), coalesce(n.box, t.box), coalesce(n.rotation, t.rotation)
  FROM n JOIN t ON n.conv_id = t.conv_id AND n.parent = t.turn)
SELECT conv_id AS doc_id, turn AS node, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS INT) AS page0, CAST(box AS INT) AS box, CAST(rotation AS INT) AS rotation
FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conv_id = t.conv_id AND n.parent = t.turn)""")
def page_tree(spark, sf_dir):
    """Turns as nodes of a page tree with inherited boxes and rotations; nodes without children are its pages."""
    turn = F.col("turn")
    parent = F.when(turn > 0, F.floor((turn - 1) / 2))
    nodes = _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), turn.alias("node"), parent.alias("parent"), (turn - turn % 5 * 10).alias("ord"),
        F.when(F.col("role") == "user", F.length("text")).alias("box"), F.when(turn % 3 == 0, (turn * 90 % 360).cast("int")).alias("rotation"),
    )
    inner = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
    marked = nodes.join(inner, ["doc_id", "node"], "left").withColumn("leaf", F.col("inner").isNull())
    return tree.pages_of_tree(marked, ["box", "rotation"])


@query("""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
s AS (SELECT doc_id, a, list_concat(list_filter(a, lambda x, i: i % 4 <> 0), ['added'], a[1:2]) AS b FROM l)
SELECT doc_id, md5(array_to_string(a, chr(10))) AS before, md5(array_to_string(b, chr(10))) AS after, CAST(len(b) - len(a) AS BIGINT) AS grown FROM s""")
def line_script_rebuilt(spark, sf_dir):
    """Both texts of each pair put together again from the script between them; where ids are shared, a pair for each text of an id."""
    found = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    alone = stored(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")).isEmpty()
    if not alone:
        copies = found.groupBy("key", F.xxhash64("text").alias("hash")).agg(F.first("text").alias("text"), F.count("*").cast("int").alias("n"))
        found = stored(copies.select(F.struct("key", "hash", "n").alias("key"), "text"))
    lines = F.split("text", "\n")
    changed = F.concat(F.filter(lines, lambda x, i: i % 4 != 3), F.array(F.lit("added")), F.slice(lines, 1, 2))
    docs = found.select("key", lines.alias("a"), changed.alias("b"))
    a, b = docs.select("key", F.posexplode("a").alias("i", "line")), docs.select("key", F.posexplode("b").alias("j", "line"))
    script = diff.line_script(a, b)
    listed = script.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("gap", "kind", "at", "op", "line"))).alias("rows"))  # a document's lines
    side = lambda other: F.md5(F.array_join(F.transform(F.filter("rows", lambda r: r["op"] != other), lambda r: r["line"]), "\n"))
    count = lambda op: F.size(F.filter("rows", lambda r: r["op"] == op))
    rebuilt = listed.select("key", side("+").alias("before"), side("-").alias("after"), (count("+") - count("-")).cast("long").alias("grown"))
    if not alone:
        rebuilt = rebuilt.withColumn("copy", F.explode(F.sequence(F.lit(1), "key.n"))).withColumn("key", F.col("key.key"))
    return rebuilt.select(F.col("key").alias("doc_id"), "before", "after", "grown")
