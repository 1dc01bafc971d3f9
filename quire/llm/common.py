"""Column helpers, lineage cuts and connected components shared by the operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast up to this size; beyond it Spark shuffles.
BROADCAST_BYTES = 8 << 20
#: The folders that stored() made inside of scratch(), of each scratch() that is open.
_scratch: list[list[str]] = []

#: Characters of a word: everything but the space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the faster built-in lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def space_words(text: Column) -> Column:
    """The runs of characters other than white space, in order; [] for null."""
    return F.array_remove(F.split(text_or_empty(text), SPACE_CLASS + "+"), "")


def n_space_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_keys() -> tuple[Column, Column]:
    """Two hashes, never null, of the doc_id (of any type) and the text of a row.

    They tell rows apart where doc_ids are null or repeated. Rows equal in both columns
    have equal keys, and whatever depends on id and text alone is the same for them.
    """
    doc_id, text = F.col("doc_id"), F.col("text")
    return F.xxhash64(doc_id.cast("string"), doc_id.isNull()), F.xxhash64(text, text.isNull())


def bounded(df: DataFrame, size: Column | int = 64) -> DataFrame:
    """df marked for broadcast if its rows of so many bytes, added up here, are at most BROADCAST_BYTES."""
    total = df.agg(F.sum(size if isinstance(size, Column) else F.lit(size)).cast("long")).head()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only on a single machine, as in tests, a temporary folder does where that is unset.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Runs df and continues from its copy in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node each node of the undirected edges can reach.

    Large-star and small-star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014) alternate until no edge changes. A round costs two
    aggregations of the edges; their number grows with the logarithm of the size of
    the largest component, so a chain of copies is no worse than a star. Nodes are
    longs; nulls, loops and repeated edges are dropped; no edges give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # Large star: every larger neighbour of u moves to the smallest of u and its neighbours.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours all move to the smallest of them.
        down = large.distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
    roots = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )


def stored(df: DataFrame, kept: bool = False) -> DataFrame:
    """Like cut(), but as a Parquet table: smaller on disk, for tables with many rows.

    kept saves it from the scratch() that is open.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    if _scratch and not kept:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what stored() writes inside of it; nothing that reads those tables may be left to run."""
    _scratch.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in _scratch.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
