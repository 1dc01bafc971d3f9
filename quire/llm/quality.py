"""Quality rules with host-level verdicts (DataFrame functions only).

Each document gets counts from its whole text. Failures of the rules are summed by
host (the source column), the hosts' failure rates are shrunk with a beta prior that
is itself fitted to all hosts, and the verdict of the host decides how many of the
soft rules a document may fail. Only counts by host are shuffled, pre-aggregated; texts
stay with their verdicts and never move.

Defined results: a null or empty text has no words and fails; a null source is a host
of its own; rows are judged one by one, whatever their doc_ids, so repeated rows get
equal verdicts and null or shared doc_ids harm no other row; extra columns are ignored by
judge() and kept by keep_good(), under whatever names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, bounded, cut, let, space_words, stored, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # in hundredths of the words
SYMBOLS = r"[#*$%&|<>]"
#: One graded rule: a document fails it once for each of these symbols per word that it goes beyond, as
#: with symbols in many words, symbols between the words (tables, menus), symbols everywhere.
SYMBOL_GRADES = (0.1, 0.3, 1.0)
#: A host is bad if its shrunken failure rate is above this.
BAD_HOST_RATE = 0.5
#: Soft rules that a document of a good and of a bad host may fail.
ALLOWED_GOOD, ALLOWED_BAD = 1, 0


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the array holds twice or more.

    Windows are compared by a 64-bit hash of their three words. Documents without a
    repeated window, nearly all, stop after a set insertion per word; the others sort
    (hash, position) once, so that the work stays n log n for very long texts.
    """

    def covered(hashes: Column) -> Column:
        keyed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            same = F.zip_with(
                F.slice(pairs, F.lit(1), F.size(pairs) - 1),
                F.slice(pairs, F.lit(2), F.size(pairs) - 1),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
            )
            return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

        step = lambda s, p: F.struct(
            (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last"))
        return F.aggregate(let(keyed, starts), start, step, lambda s: s["n"])

    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(words) < 4, 0).otherwise(let(words, count)).cast("long")


def features(docs: DataFrame, *own: Column | str) -> DataFrame:
    """The columns own (doc_id if none are given), host and the counts of each row of docs."""
    own = own or ("doc_id",)
    text = text_or_empty(F.col("text"))
    base = docs.select(
        *own,
        F.col("source").alias("host"),
        space_words(F.col("text")).alias("words"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return base.select(
        *base.columns[: len(own)],
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def rules(counts: DataFrame) -> DataFrame:
    """Adds base_failed and n_soft, how often soft rules fail."""
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * n)
    grade = sum((10 * F.col("n_symbols") > round(10 * g) * n).cast("int") for g in SYMBOL_GRADES)
    boilerplate = 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")
    no_words = (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)
    return counts.withColumns({"base_failed": base, "n_soft": grade + boilerplate.cast("int") + no_words.cast("int")})


def host_verdicts(ruled: DataFrame, bad_rate: float = BAD_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, rate and host_bad of each host.

    rate is the posterior mean (k + a) / (n + a + b), where a and b fit the mean and
    variance of the hosts' rates, each host weighted by its documents. Hosts that do
    not vary all get the common rate.
    """
    failed = (F.col("base_failed") | (F.col("n_soft") > 0)).cast("long")
    hosts = ruled.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(failed).alias("n_failed"))
    p = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("k"),
        F.sum(p * F.col("n_failed")).alias("second"),
    ).select("n", (F.col("k") / F.col("n")).alias("m"), (F.col("second") / F.col("n")).alias("second"))
    prior = total.select(
        "m", (F.col("m") * (1 - F.col("m"))).alias("binary"), (F.col("second") - F.col("m") * F.col("m")).alias("v")
    )
    # The prior is a single row by construction (an aggregate without keys).
    joined = hosts.crossJoin(F.broadcast(prior))
    s = F.col("binary") / F.col("v") - 1
    rate = F.when(F.col("v") < 1e-9, F.col("m")).otherwise(
        (F.col("n_failed") + F.col("m") * s) / (F.col("n_docs") + s)
    )
    return joined.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > bad_rate).alias("host_bad"))


def _with_verdicts(ruled: DataFrame, bad_rate: float) -> DataFrame:
    """ruled, which has been written, with host_rate, host_bad and kept."""
    hosts = cut(host_verdicts(ruled, bad_rate).select(
        F.col("host").alias("of_host"), F.col("rate").alias("host_rate"), "host_bad"
    ))
    hosts = bounded(hosts, F.coalesce(F.octet_length("of_host"), F.lit(0)) + 32)
    allowed = F.when(F.col("host_bad"), ALLOWED_BAD).otherwise(ALLOWED_GOOD)
    joined = ruled.join(hosts, F.col("host").eqNullSafe(F.col("of_host")))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("n_soft") <= allowed))


def judge(docs: DataFrame, bad_rate: float = BAD_HOST_RATE) -> DataFrame:
    """One row for each row of docs: doc_id, its counts, base_failed, n_soft, host_rate, host_bad, kept."""
    return _with_verdicts(cut(rules(features(docs))), bad_rate).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_soft", "host_rate", "host_bad",
    )


def keep_good(docs: DataFrame, bad_rate: float = BAD_HOST_RATE) -> DataFrame:
    """The rows of docs, all columns, without those that judge() rejects; each row falls by its own verdict."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ruled = rules(features(docs, row))
    ruled = stored(ruled.withColumn("row", F.when(~F.col("base_failed"), F.col("row"))))
    return _with_verdicts(ruled, bad_rate).where("kept").select("row.*")
