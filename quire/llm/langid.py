"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A language's profile is its PROFILE most frequent letter n-grams of one to three
characters, ranked. A document's own ranked n-grams are compared with every profile by
the out-of-place distance: the sum of the differences in rank, MISSING for an n-gram that
the profile lacks. The nearest profile names the language.

Profiles are fitted on at most about TRAIN_PER_LANG documents of a language, chosen by a
hash (the bound is that parameter; whole texts are counted); predictions count the
n-grams of every whole text, in blocks, so that memory is bounded for very long ones.

Defined results: a text that is null or has no letter is "und" with score 0; ties go to
the language that sorts first; with nothing to learn from all is "und"; lang, source and
doc_id of the predicted rows are never read but for held_out; repeated rows get equal
results; a null doc_id is not held out and not learned from; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded

PROFILE = 400
MISSING = PROFILE
TRAIN_PER_LANG = 2000
SEED = 7
#: Letters end below this code point.
LETTERS_END = 0x32400
BLOCK = 1 << 18
SPACE = 32
_letters: list = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(LETTERS_END)), bool, LETTERS_END))
    return _letters[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, each packed into an integer, and their counts; sorted by n-gram.

    Words are runs of letters, lower-cased, with a space on either side; n-grams of two
    and three characters may begin or end with that space but not span it.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[np.minimum(code, LETTERS_END - 1)] & (code < LETTERS_END)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after each word
    code = np.where(is_letter, code, SPACE)[keep].astype(np.int64)
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.array([SPACE], np.int64)
    code = np.concatenate((edge[: int(code[0] != SPACE)], code, edge[: int(code[-1] != SPACE)]))
    grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, len(code), BLOCK):
        c = code[i : i + BLOCK + 2]
        own = len(c) - 2 if i + BLOCK < len(code) else len(c)
        one = c[:own]
        two = (c[:-1] << 21 | c[1:])[:own]
        three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[: own if len(c) > 2 else 0]
        parts = [one[one != SPACE], two, three[c[1:-1][: len(three)] != SPACE]]
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        merged, at = np.unique(np.concatenate((grams, found)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((counts, n)), len(merged)).astype(np.int64) if i else n
        grams = merged if i else found
    return grams, counts


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams, the most frequent first, ties by n-gram."""
    return grams[np.lexsort((grams, -counts))[:PROFILE]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def profiles(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> list[tuple[str, list[int]]]:
    """(lang, ranked n-grams) of each language: at most PROFILE integers a language reach the driver."""
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(SEED)), 11) * F.lit(2.0**-53)
    # Texts are not shuffled by language, which would put most of them into a few tasks.
    chosen = known.join(bounded(sizes, F.octet_length("lang") + 40), "lang").where(draw * F.col("n") < per_lang).select("lang", "text")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            by_lang: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                by_lang.setdefault(lang, []).append(gram_counts(text.as_py()))
            for lang, each in by_lang.items():
                grams, at = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in each]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"]
                )

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE)
    found: dict[str, list] = {}
    for row in top.collect():
        found.setdefault(row["lang"], []).append((row["rank"], row["gram"]))
    return [(lang, [g for _, g in sorted(found[lang])]) for lang in sorted(found)]


def nearest(own: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> tuple[int, float]:
    """The nearest profile and the score 1 - distance / largest distance.

    keys are the sorted n-grams of all profiles; ranks[l, k] is the rank of keys[k] in
    profile l, or less than 0.
    """
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    rank = np.where(keys[at] == own, ranks[:, at], -1)
    apart = np.where(rank >= 0, np.abs(rank - np.arange(len(own))), MISSING).sum(axis=1)
    best = int(np.argmin(apart))
    return best, 1.0 - float(apart[best]) / (MISSING * len(own))


def predict(docs: DataFrame, learned: list[tuple[str, list[int]]]) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score."""
    langs = [lang for lang, _ in learned]
    keys = np.unique(np.concatenate([np.array(g, np.int64) for _, g in learned])) if learned else np.empty(0, np.int64)
    ranks = np.full((len(langs), len(keys)), -1)
    for i, (_, grams) in enumerate(learned):
        ranks[i, np.searchsorted(keys, grams)] = np.arange(len(grams))

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            names, scores = [], []
            for text in batch.column("text"):
                own = ranked(*gram_counts(text.as_py()))
                if len(own) and langs:
                    best, score = nearest(own, keys, ranks)
                    names.append(langs[best])
                    scores.append(score)
                else:
                    names.append("und")
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    return predict(docs, profiles(docs, per_lang))
