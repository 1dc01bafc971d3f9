"""Secret scans (DataFrame functions only).

Base spans come from three patterns; the method adds spans of kind "entropy": runs of
key characters in which a sliding window reaches the Shannon entropy set for its
character class. The allow-list suppresses what it covers and no more: allowed words are
taken out of a run before its windows are measured, and a run of which only words, numbers
or the like are left is none. Everything happens inside the row, nothing is shuffled.

Defined results: a null or empty text has no spans; offsets are code points with
exclusive ends; spans are sorted by start, then by kind in the order of KINDS; rows are
scanned one by one, so repeated rows get equal results; extra columns are ignored by
scan() and kept by redact(); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running_max, running_sum
from .common import let, text_or_empty

# Patterns whose spans must agree with the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a window must reach, by character class; the first class that fits the whole run counts. In the first four,
#: 2 % of random keys of one window stay below, fewer of longer ones; 5 % in the last, where words also come.
CLASSES = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)\z", 2.95),
    ("lower-case and digits", r"^(?:[a-z]*[0-9]){3}[a-z0-9]*\z", 3.44),
    ("upper-case and digits", r"^(?:[A-Z]*[0-9]){3}[A-Z0-9]*\z", 3.4),
    ("letters and digits", r"^(?:[A-Za-z]*[0-9]){2}[A-Za-z0-9]*\z", 3.68),
    ("base64", r"^.*\z", 3.78),
)
#: Words that count for nothing within a run.
ALLOWED_WORDS = r"(?i)example|sample|placeholder|changeme|dummy|x{4,}|0123456789|abcdefgh"
#: Runs of which what is left matches one of these are no secrets.
ALLOW = (
    r"^(?:[a-z_-]+|[A-Z_-]+|[A-Z][a-z]+)\z",  # words of one case, also joined by dashes
    r"^[0-9_=+/-]+\z",  # numbers and rulers
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z",  # UUIDs
    r"^(?:[A-Za-z]*/)+[A-Za-z]*\z",  # paths of plain words
)


def spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """array<struct<start, kind, end>> of the matches whose group, given to keep, passes.

    A text split at its matches gives the lengths between them, hence all offsets.
    """

    def of(v: Column) -> Column:
        lengths = F.transform(v["found"], F.length)
        ends = running_sum(F.zip_with(F.slice(v["parts"], F.lit(1), F.size(v["found"])), lengths, lambda p, n: F.length(p) + n))
        each = F.zip_with(ends, F.arrays_zip(lengths.alias("n"), v["tested"].alias("tested")), lambda end, m: F.struct(
            (end - m["n"]).cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), m["tested"].alias("tested"),
        ))
        kept = F.filter(each, lambda s: keep(s["tested"])) if keep else each
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    every = F.struct(
        F.split(text, pattern, -1).alias("parts"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("tested"),
    )
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")
    return F.when(~text.rlike(pattern), none).otherwise(let(every, of))


def peak_entropy(run: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of the windows of so many characters of run.

    Counts of the window's characters are kept up to date as one character enters and
    one leaves; sum(c * log2(c)) follows from the two counts that change.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def peak(v: Column) -> Column:
        codes, term = v["codes"], v["terms"]

        def step(s: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.coalesce(F.get(codes, F.when(i >= window, i - window)), F.lit(-1))
            c_in = F.get(s["counts"], enters)
            c_out = F.get(s["counts"], F.when(leaves >= 0, leaves)) + (enters == leaves).cast("int")
            gain = F.get(term, c_in + 1) - F.get(term, c_in)
            loss = F.coalesce(F.get(term, c_out) - F.get(term, c_out - 1), F.lit(0.0))
            total = s["total"] + gain - loss
            counts = F.transform(
                s["counts"], lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int")
            )
            bits = F.when(i >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.struct(
                counts.alias("counts"), total.alias("total"), F.greatest(s["peak"], bits).alias("peak")
            )

        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("peak")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: s["peak"])

    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(ALPHABET), ch) - 1)
    return let(F.struct(F.filter(codes, lambda c: c >= 0).alias("codes"), terms.alias("terms")), peak)


def is_secret(run: Column) -> Column:
    def judged(rest: Column) -> Column:
        allowed = F.char_length(rest) < WINDOW
        for pattern in ALLOW:
            allowed = allowed | rest.rlike(pattern)
        bits = F.lit(99.0)
        for _, pattern, least in reversed(CLASSES):
            bits = F.when(rest.rlike(pattern), F.lit(least)).otherwise(bits)
        return F.when(allowed, False).otherwise(peak_entropy(rest) >= bits)

    return let(F.regexp_replace(run, ALLOWED_WORDS, ""), judged)


def outside(base: Column, runs: Column) -> Column:
    """The runs that lie in no base span: both in the order of their starts, against the farthest end so far."""
    event = lambda s, is_run: F.struct(s["start"].alias("start"), F.lit(is_run).alias("run"), s["end"].alias("end"))
    events = F.array_sort(F.concat(F.transform(base, lambda b: event(b, 0)), F.transform(runs, lambda r: event(r, 1))))

    def kept(v: Column) -> Column:
        ends = running_max(F.transform(v, lambda e: F.when(e["run"] == 0, e["end"]).otherwise(0)))
        marked = F.zip_with(v, ends, lambda e, end: F.struct(
            e["start"].alias("start"), F.lit(3).alias("kind"), e["end"].alias("end"), ((e["run"] == 1) & (e["end"] > end)).alias("kept"),
        ))
        found = F.filter(marked, lambda e: e["kept"])
        return F.transform(found, lambda e: F.struct(e["start"].alias("start"), e["kind"].alias("kind"), e["end"].alias("end")))

    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(let(events, kept))


def all_spans(text: Column) -> Column:
    """struct<base, added>: sorted spans of the patterns, and those the entropy adds outside of them."""
    base = F.array_sort(F.concat(
        spans(text, ASSIGN, 0, lambda value: F.length(value) >= 6, 2), spans(text, ACCESS, 1), spans(text, HEX, 2)
    ))
    runs = spans(text, CANDIDATE, 3, is_secret)
    both = lambda v: F.struct(v["base"].alias("base"), outside(v["base"], v["runs"]).alias("added"))
    return let(F.struct(base.alias("base"), runs.alias("runs")), both)


def as_text(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, base and added, arrays of struct<start, kind, end>."""
    found = docs.select("doc_id", all_spans(text_or_empty(F.col("text"))).alias("found"))
    return found.select("doc_id", "found.base", "found.added")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs, all columns, with the spans in text replaced by mark; n_chars follows where there is one."""

    def replaced(v: Column) -> Column:
        def joined(w: Column) -> Column:
            ends = running_max(F.transform(w["spans"], lambda s: s["end"]))
            before = F.concat(F.array(F.lit(0).cast("long")), ends)  # where the spans up to one end
            piece = lambda at, n: F.array_join(F.slice(w["characters"], at + 1, F.greatest(n, F.lit(0))), "")
            kept = F.zip_with(F.slice(before, F.lit(1), F.size(w["spans"])), w["spans"], lambda at, s: F.when(
                s["start"] >= at, F.concat(piece(at.cast("int"), (s["start"] - at).cast("int")), F.lit(mark))
            ).otherwise(""))
            last = F.element_at(before, -1).cast("int")
            return F.concat(F.array_join(kept, ""), piece(last, F.size(w["characters"]) - last))

        spans = F.array_sort(F.concat(v["found"]["base"], v["found"]["added"]))
        # From an array of characters, so that no part of a text is passed over twice.
        characters = F.split(v["text"], "")
        return let(F.struct(spans.alias("spans"), characters.alias("characters")), joined)

    text = F.col("text")
    whole = F.struct(text.alias("text"), all_spans(text_or_empty(text)).alias("found"))
    clean = let(whole, lambda v: F.when(
        F.size(v["found"]["base"]) + F.size(v["found"]["added"]) == 0, v["text"]
    ).otherwise(replaced(v)))
    out = docs.withColumn("text", clean)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
