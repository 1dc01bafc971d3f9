"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has 64 bits, one per majority of the XXH64 hashes of the document's
shingles of four words. Two fingerprints that differ in at most MAX_BITS = 4 bits agree
in at least 8 - 4 = 4 of their 8 bytes at the same position: that is the guaranteed
minimum of matches. A list per single positional byte would hold 1/256 of all
documents, so the index keys are three positional bytes together. The 20 triples of
TRIPLES are chosen so that any four byte positions contain one of them (a Turan
system), so no pair above the minimum is lost. Candidates are pairs of distinct
fingerprints in a list; their shared positional bytes are tallied, pairs below the
minimum are dropped, the rest is verified by counting differing bits.

A list of more than LONG_LIST fingerprints would give pairs with the square of its
length. Its fingerprints are listed again under keys of four positional bytes, all 70
fours, of which any pair above the minimum shares one; those lists are shorter by a
factor of 256 and tallied in the same way. What fills even a list of four bytes, with over
LONG_LIST distinct fingerprints, is a dense group of near copies; only those are linked
through midpoints: two fingerprints differ in at most four bits exactly if some 64-bit
value differs from both in at most two, so each is listed under the 2081 values within two
bits, and every list is linked to its smallest member. Each step is exact, and the last one
linear in the fingerprints that reach it.

Defined results: null and empty texts have fingerprint 0 and are linked like any other;
equal fingerprints, hence exact copies, are one node; doc_ids may be of any type that has
an order, null or repeated: rows are linked by their fingerprints alone, so a shared doc_id
links nothing; a component is named by its smallest doc_id, null if it has only null ones;
keep_first() keeps one row of each component, the one of the smallest doc_id (null comes
last, then the hash of the text decides, and of rows equal in both any one stays); extra
columns are ignored by components() and kept by keep_first(); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, connected_components, cut, row_keys

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
LONG_LIST = 32
#: Shingles hashed at a time, which bounds the memory that a very long text takes.
BLOCK = 1 << 15


def _triples() -> list[tuple[int, int, int]]:
    """Three parts of the positions; triples within a part, or two in a part and one in the next."""
    parts = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [p for p in parts if len(p) == 3]
    for i, part in enumerate(parts):
        found += [tuple(sorted((*pair, c))) for pair in combinations(part, 2) for c in parts[(i + 1) % 3]]
    return found


TRIPLES = _triples()
FOURS = list(combinations(range(8), MIN_BYTES))


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as a signed 64-bit integer."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, BLOCK):
        hashes = b"".join([digest(b" ".join(words[j : j + SHINGLE]), SEED) for j in range(i, min(n, i + BLOCK))])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > n).tobytes()
    return int.from_bytes(packed, "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, k1 and k2 (row_keys) and fp (long) of each row of docs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prints = pa.array([fingerprint(t.as_py()) for t in batch.column("text")], pa.int64())
            own = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*own, prints], names=["doc_id", "k1", "k2", "fp"])

    k1, k2 = row_keys()
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, fp long")


def _byte(fp: Column, at: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * at).bitwiseAND(F.lit(255))


def _list_keys(fp: Column, places: Sequence[tuple[int, ...]]) -> Column:
    """The keys of the lists that hold fp, one for each tuple of places: its number and the bytes there."""
    keys = []
    for number, own in enumerate(places):
        packed = F.lit(number).cast("long")
        for at in own:
            packed = packed * 256 + _byte(fp, at)
        keys.append(packed)
    return F.array(*keys)


def shared_bytes(a: Column, b: Column) -> Column:
    """At how many of the eight positions a and b hold the same byte."""
    return sum((_byte(a.bitwiseXOR(b), at) == 0).cast("int") for at in range(8))


def _midpoints(fp: Column) -> Column:
    one = lambda i: F.expr(f"shiftleft(1L, {i})")
    flips = [F.lit(0).cast("long"), *[one(i) for i in range(64)]]
    single = F.array(*flips)
    # Flips i < j as sums of two entries of single; entry 0 flips nothing.
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.transform(
        F.slice(single, i + 1 + (i > 0).cast("int"), F.lit(65)),
        lambda m: F.get(single, i).bitwiseXOR(m),
    )))
    return F.transform(pairs, lambda m: fp.bitwiseXOR(m))


def _tallied(prints: DataFrame, places: Sequence[tuple[int, ...]]) -> tuple[DataFrame, DataFrame]:
    """The links a, b of pairs that share a short list, and the distinct fp in long lists."""
    entries = prints.select("fp", F.explode(_list_keys(F.col("fp"), places)).alias("key"))
    lists = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    listed = cut(entries.join(lists, "key"))
    short = listed.where(F.col("n") <= LONG_LIST)
    a, b = F.col("a"), F.col("b")
    pairs = short.select("key", F.col("fp").alias("a")).join(short.select("key", F.col("fp").alias("b")), "key").where("a < b")
    near = pairs.where((shared_bytes(a, b) >= MIN_BYTES) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS))
    return near.select("a", "b"), listed.where(F.col("n") > LONG_LIST).select("fp").distinct()


def links(prints: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all of each component.

    Between fingerprints that share a short list every link is returned.
    """
    near, long = _tallied(prints, TRIPLES)
    by_four, dense = _tallied(cut(long), FOURS)
    dense = cut(dense)
    around = dense.select("fp", F.explode(_midpoints(F.col("fp"))).alias("middle"))
    least = around.groupBy("middle").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    # Without the hint Spark takes around for as small as dense and broadcasts it.
    stars = around.hint("merge").join(least, "middle").where("fp > b").select(F.col("b").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(by_four).unionByName(stars).distinct()


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id, k1, k2 and fp of each row, and of_fp, component and component_id of each fp.

    component is the smallest fp of the component, which every component has.
    """
    printed = cut(fingerprints(docs))
    nodes = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(connected_components(links(nodes.select("fp"))))
    linked = cut(roots.join(nodes, F.col("node") == F.col("fp")).select("node", "root", "least"))
    # Written, so that the join has an exchange of its own on either side and a large component can be split.
    names = cut(linked.groupBy("root").agg(F.min("least").alias("name")))
    named = linked.select("node", "root").join(names, "root")
    return printed, cut(nodes.join(named, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("of_fp"), F.coalesce("root", "fp").alias("component"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id"),
    ))


def components(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id, the smallest doc_id reachable."""
    printed, named = grouped(docs)
    return printed.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def surplus(docs: DataFrame) -> DataFrame:
    """k1, k2 and again of rows that are not wanted: all rows of those keys, or with again all but one."""
    printed, named = grouped(docs)
    rows = printed.join(named, F.col("fp") == F.col("of_fp")).groupBy("component", "k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n")
    )
    rows = cut(rows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k2", "k1")))
    first = cut(rows.groupBy("component").agg(F.min("place").alias("first"), F.sum("n").alias("rows")).where("rows > 1"))
    both = rows.select("component", "k1", "k2", "place", "n").join(first.select("component", "first"), "component")
    return both.select("k1", "k2", (F.col("place") == F.col("first")).alias("again"), "n").where("n > 1 or not again").drop("n")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of docs, with all columns."""
    marks = cut(surplus(docs))
    k1, k2 = row_keys()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, k1.alias("k1"), k2.alias("k2"))
    kept = keyed.join(bounded(marks), ["k1", "k2"], "left_anti").select("row.*")
    repeated = marks.where("again").select("k1", "k2")
    if repeated.isEmpty():
        return kept
    one = keyed.join(bounded(repeated), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return kept.unionByName(one.select("row.*"))
