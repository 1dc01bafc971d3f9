"""Substring de-duplication by hashed lines and passages.

Every line with a word is a unit, however short (also one of a script without spaces).
Units are normalised (A-Z lower-cased, white space as one space), their digests are grouped
over all documents with map-side minima, the earliest ranked occurrence stays, and later
ones are removed. Documents rank by doc_id, null last, then by a hash of the text;
occurrences within a document by word position.

Passages that repeat within longer or differently broken lines are found by further units:
of all runs of PASSAGE words, those whose hash is the smallest among GUARANTEE neighbouring
runs ("winnowing", Schleimer et al., 2003), so that a passage of PASSAGE + GUARANTEE - 1 = 49
words or more always holds a unit, at the same place in each copy. Such a unit only points
at the place: the words around it are compared with those of the document that keeps it,
and the whole passage that both share is removed. Only documents with such a place are read
again for that. Lines and passages are reported apart, with offsets in code points of the
original text.

Defined results: null and empty texts have no units; rows equal in doc_id and text are one
document and share their removals, other rows never do, whatever their doc_ids (of any
type, null or shared); occurrences within a document count as repeats if they do not
overlap the first; extra columns are ignored, or kept by remove(), under whatever names;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, row_keys, stored
from .runhash import Powers, word_hashes, words

PASSAGE = 20
GUARANTEE = 30
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def word_offsets(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, in code points."""
    at = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with each byte
    return at[first] - 1, at[end - 1]


def winnowed(hashes: np.ndarray) -> np.ndarray:
    """The chosen runs. Of neighbours that are equal, as in a text that repeats one word, one in GUARANTEE."""
    if len(hashes) <= GUARANTEE:
        return np.array([int(hashes.argmin())])
    near = np.lib.stride_tricks.sliding_window_view(hashes, GUARANTEE)
    at = np.unique(near.argmin(axis=1) + np.arange(len(near)))
    new = np.flatnonzero(np.diff(hashes[at], prepend=~hashes[at[:1]]) != 0)
    block = (at - np.repeat(at[new], np.diff(new, append=len(at)))) // GUARANTEE
    return at[np.diff(block, prepend=-1) != 0] if len(new) == 1 else at[(np.diff(block, prepend=-1) != 0) | np.isin(np.arange(len(at)), new)]


def text_units(text: str | None, powers: Powers) -> tuple[np.ndarray, ...]:
    """digest, word position and number of words of the units of a text; the number is negative for passages."""
    raw, first, end = words(text)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    each = word_hashes(raw, first, end, powers)
    line = np.searchsorted(np.flatnonzero(raw == 10), first)
    a = np.flatnonzero(np.diff(line, prepend=-1))  # first word of each line
    b = np.concatenate((a[1:], [len(first)]))
    sign, n = np.ones(len(a), np.int64), len(first) - PASSAGE + 1
    if n > 0:
        p = np.arange(n)
        p = winnowed(powers.runs(each, p, p + PASSAGE))
        a, b = np.concatenate((a, p)), np.concatenate((b, p + PASSAGE))
        sign = np.concatenate((sign, np.full(len(p), -1)))
    return powers.runs(each, a, b), a, sign * (b - a)


def _doc_columns(docs: DataFrame) -> tuple[DataFrame, str]:
    """doc_id, k2 (the hash of the text, of row_keys) and text, and the type of doc_id."""
    rows = docs.where("text is not null").select("doc_id", row_keys()[1].alias("k2"), "text")
    return rows, rows.schema["doc_id"].dataType.simpleString()


def units(docs: DataFrame) -> DataFrame:
    """digest, doc_id, k2, word and n (words, negative for passages) of every unit of docs."""

    def run(batches: Iterator):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            parts = [text_units(t.as_py(), powers) for t in batch.column("text")]
            row = pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]))
            if len(row):
                digest, word, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
                own = [batch.column(c).take(row) for c in ("doc_id", "k2")]
                columns = [pa.array(digest.view(np.int64)), *own, pa.array(word.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "doc_id", "k2", "word", "n"])

    rows, kind = _doc_columns(docs)
    return rows.mapInArrow(run, f"digest long, doc_id {kind}, k2 long, word int, n int")


def shared_after(a: np.ndarray, b: np.ndarray) -> int:
    """How many words a and b begin with alike."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        other = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(other):
            return at + int(other[0])
        at, step = at + step, 2 * step
    return n


def extended(own: np.ndarray, kept: np.ndarray, matches: list[tuple[int, int]], same: bool) -> list[tuple[int, int]]:
    """The runs of own words, ends excluded, that hold a match (word of own, word of kept) and equal those of kept.

    In the same document the kept occurrence itself stays. A match inside a run found
    before is passed over, so that every word is compared about once.
    """
    found: list[tuple[int, int]] = []
    done = 0
    for at, there in sorted(matches):
        if at + PASSAGE > done:
            room = min(at - min(done, at), there, at - there - PASSAGE if same else there)
            left = shared_after(own[at - room : at][::-1], kept[there - room : there][::-1])
            right = shared_after(own[at + PASSAGE :], kept[there + PASSAGE :])
            found.append((at - left, at + PASSAGE + right))
            done = at + PASSAGE + right
    return found


def _word_ids(docs: DataFrame) -> DataFrame:
    """doc_id, k2 and ids (32-bit hashes of the words as bytes) of docs, a row for each document."""

    def run(batches: Iterator):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            ids = [word_hashes(*words(t.as_py()), powers).astype(np.uint32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k2"), pa.array(ids, pa.binary())], names=["doc_id", "k2", "ids"]
            )

    rows, kind = _doc_columns(docs)
    return rows.mapInArrow(run, f"doc_id {kind}, k2 long, ids binary")


def _same_doc(df: DataFrame, doc_id: str, k2: str):
    return df["doc_id"].eqNullSafe(F.col(doc_id)) & (df["k2"] == F.col(k2))


def passages(docs: DataFrame, later: DataFrame) -> DataFrame:
    """doc_id, k2 and passages, array<struct<start, end>> in words, of the documents in later.

    later has doc_id, k2, word and kept (struct of no_id, doc_id, k2 and word) of units.
    """
    pairs = cut(
        later.groupBy(
            F.col("doc_id").alias("own_id"), F.col("k2").alias("own_k2"),
            F.col("kept.doc_id").alias("kept_id"), F.col("kept.k2").alias("kept_k2"),
        ).agg(F.collect_list(F.struct("word", F.col("kept.word").alias("there"))).alias("matches"))
    )
    sides = [pairs.select(F.col(f"{s}_id").alias("of_id"), F.col(f"{s}_k2").alias("of_k2")) for s in ("own", "kept")]
    needed = cut(sides[0].unionByName(sides[1]).distinct())
    rows = _doc_columns(docs)[0]
    rows = rows.join(bounded(needed), _same_doc(rows, "of_id", "of_k2"), "left_semi")
    ids = stored(_word_ids(rows).dropDuplicates(["doc_id", "k2"]))
    joined = pairs
    for side in ("kept", "own"):
        one = ids.select(F.col("doc_id").alias("i"), F.col("k2").alias("k"), F.col("ids").alias(f"{side}_ids"))
        same = F.col(f"{side}_id").eqNullSafe(F.col("i")) & (F.col(f"{side}_k2") == F.col("k"))
        joined = joined.join(one, same).drop("i", "k")
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_k2") == F.col("kept_k2"))
    joined = joined.select("own_id", "own_k2", "matches", same.alias("same"), "own_ids", "kept_ids")

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            spans = []
            for matches, same, own, kept in zip(*(batch.column(c) for c in ("matches", "same", "own_ids", "kept_ids")), strict=True):
                ids = (np.frombuffer(x.as_py(), np.uint32) for x in (own, kept))
                found = extended(*ids, [(m["word"], m["there"]) for m in matches.as_py()], same.as_py())
                spans.append([{"start": a, "end": b} for a, b in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column("own_id"), batch.column("own_k2"), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k2", "spans"])

    kind = joined.schema["own_id"].dataType.simpleString()
    found = joined.mapInArrow(run, f"doc_id {kind}, k2 long, spans array<struct<start: int, end: int>>")
    return found.groupBy("doc_id", "k2").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("passages"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, k2, lines and passages, array<struct<start, end>> in words, to remove, of documents with any."""
    found = stored(units(docs))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k2", "word")
    # Written first, so that the join below has an exchange of its own on either side and
    # Spark can split the partition of a line that a third of the documents hold.
    firsts = cut(
        found.groupBy("digest").agg(F.count("*").alias("times"), F.min(place).alias("kept"))
        .where("times > 1").select("digest", "kept")
    )
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("k2") == F.col("kept.k2"))
    later = found.join(firsts, "digest").where(~same | (F.col("word") >= F.col("kept.word") + F.abs("n")))
    later = stored(later.select("doc_id", "k2", "word", "n", "kept"))
    lines = later.where("n > 0").select("doc_id", "k2", "word", "n").distinct().groupBy("doc_id", "k2").agg(
        F.sort_array(F.collect_list(F.struct(F.col("word").alias("start"), (F.col("word") + F.col("n")).alias("end")))).alias("lines")
    )
    within = passages(docs, later.where("n < 0").select("doc_id", "k2", "word", "kept").distinct())
    within = within.select(F.col("doc_id").alias("i"), F.col("k2").alias("k"), "passages")
    both = lines.join(within, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k2") == F.col("k")), "full")
    # Where k is null the row is of lines alone; a doc_id may be null itself.
    return cut(both.select(
        F.when(F.col("k2").isNull(), F.col("i")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.coalesce("k2", "k").alias("k2"), "lines", "passages",
    ))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones, and those a character apart, united."""
    found: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if found and start <= found[-1][1] + 1:
            found[-1] = (found[-1][0], max(found[-1][1], end))
        else:
            found.append((start, end))
    return found


def without(text: str, lines: list[tuple[int, int]], within: list[tuple[int, int]]) -> tuple[str, list, list, list]:
    """text less its spans, given in words, and in code points those of its lines, of its passages, and all merged."""
    if not lines and not within:
        return text, [], [], []
    raw, first, end = words(text)
    start, stop = word_offsets(raw, first, end)
    lines, within = ([(int(start[a]), int(stop[b - 1])) for a, b in spans] for spans in (lines, within))
    within = merged(within)
    every = merged(lines + within)
    ends = [0, *(end for _, end in every)]
    starts = [*(start for start, _ in every), len(text)]
    return "".join(text[a:b] for a, b in zip(ends, starts, strict=True)), lines, within, every


def cleaned(docs: DataFrame) -> DataFrame:
    """row (the columns of docs but text), text less the spans, n_removed, line_spans and passage_spans of each row."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    found = repeats(docs).select(F.col("doc_id").alias("i"), F.col("k2").alias("k"), "lines", "passages")
    keyed = docs.select(row, "doc_id", row_keys()[1].alias("k2"), "text")
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("k2") == F.col("k")), "left")

    def run(batches: Iterator):
        import pyarrow as pa

        pairs = lambda x: [(s["start"], s["end"]) for s in x.as_py() or []]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, removed, spans = [], [], ([], [])
            for text, lines, within in zip(*(batch.column(c) for c in ("text", "lines", "passages")), strict=True):
                text = text.as_py()
                own, lines, within, every = without(text or "", pairs(lines), pairs(within))
                texts.append(text if text is None else own)
                removed.append(sum(b - a for a, b in every))
                for out, found in zip(spans, (lines, within), strict=True):
                    out.append([{"start": a, "end": b} for a, b in found])
            columns = [batch.column("row"), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), *(pa.array(s, kind) for s in spans)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_removed", "line_spans", "passage_spans"])

    rows = joined.select("row", "text", "lines", "passages")
    out = T.StructType([
        rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()),
        T.StructField("line_spans", SPANS), T.StructField("passage_spans", SPANS),
    ])
    return rows.mapInArrow(run, out)


def remove(docs: DataFrame) -> DataFrame:
    """docs, all columns, with text less its repeated lines and passages."""
    done = cleaned(docs)
    return done.select(*[(F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_removed (code points), line_spans, passage_spans and the text that stays."""
    done = cleaned(docs.select("doc_id", "text"))
    return done.select(
        F.col("row")["doc_id"].alias("doc_id"), "n_removed", "line_spans", "passage_spans",
        F.coalesce("text", F.lit("")).alias("text"),
    )
