"""Line differences of texts of any length, as relations of lines.

A pair of up to GAP lines a side is collected into a row, by one shuffle, and gets a shortest
script there. In larger texts lines that stand once on both sides are anchors. The anchors of a
long increasing chain cut both texts into gaps, in which further lines stand once, and so on until
no gap gains an anchor; what is left of the gaps is compared in a row for each gap. All steps are
joins, running sums and groups of a bounded number of lines, so a pair of large texts is
spread over many tasks. The script of large texts is a valid one and, as with anchors in general,
not always the shortest.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html import edit_script
from .lineage import stored
from .prefix import sums_before

#: Anchors of a slice, and lines of one side of a gap or pair, that a task or row holds at most.
SLICE = 1 << 16
GAP = 4096
#: Bytes of lines of a pair that a row holds at most.
PAIR_BYTES = 4 << 20
#: Pairs of equal lines up to which their longest chain is sought; of more, as where a few lines fill both sides, scripts are shorter.
MEETINGS = 1 << 20
#: How often gaps are searched for new anchors at most; what is left goes to the last step.
ROUNDS = 8


def increasing(values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Places of a heaviest strictly increasing subsequence; the longest one without weights."""
    if weights is None:
        tops, ends, before = [], [], np.full(len(values), -1)
        for i, v in enumerate(values.tolist()):
            k = bisect_left(tops, v)
            before[i] = ends[k - 1] if k else -1
            tops[k : k + 1], ends[k : k + 1] = [v], [i]
        at = ends[-1] if ends else -1
    else:
        total, before = weights.astype(np.int64).copy(), np.full(len(values), -1)
        for i in range(1, len(values)):
            earlier = np.where(values[:i] < values[i], total[:i], 0)
            best = int(earlier.argmax())
            if earlier[best]:
                total[i], before[i] = total[i] + earlier[best], best
        at = int(total.argmax()) if len(values) else -1
    chain = []
    while at >= 0:
        chain.append(at)
        at = int(before[at])
    return np.array(chain[::-1], np.int64)


def border(left: np.ndarray, right: np.ndarray) -> int:
    """Where to part two increasing sequences: of left the values below it stay, of right those from it on, the most in all."""
    cuts = np.unique(np.concatenate([left + 1, right]))
    kept = np.searchsorted(left, cuts) + len(right) - np.searchsorted(right, cuts)
    return int(cuts[kept.argmax()])


def _typed(df: DataFrame, *names: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def chains(anchors: DataFrame) -> DataFrame:
    """The anchors (key, gap, i, j) of a long chain in which i and j increase, for each key and gap.

    Slices of SLICE anchors in the order of i find their own longest chains. Slices follow
    each other by their middle j, the heaviest such sequence stays, and between neighbours a
    border keeps the most anchors of both. Anchors out of order are lost to the chain, not to
    the result: they stay in gaps.
    """
    group = ["key", "gap"]
    ranked = sums_before(anchors, group, ["i", "j"], {"rank": F.lit(1).cast("long")})
    sliced = ranked.select("key", "gap", F.floor(F.col("rank") / SLICE).alias("slice"), "i", "j")

    def local(rows):
        rows = rows.sort_values("i")
        kept = rows.iloc[increasing(rows["j"].to_numpy())]
        return kept.assign(middle=int(kept["j"].iloc[len(kept) // 2]), n=len(kept))

    own = stored(sliced.groupBy(*group, "slice").applyInPandas(local, f"{_typed(sliced, 'key', 'gap', 'slice')}, i long, j long, middle long, n long"))
    parts = own.select(*group, "slice", "middle", "n").distinct()

    def heaviest(rows):
        rows = rows.sort_values("slice")
        kept = rows.iloc[increasing(rows["middle"].to_numpy(), rows["n"].to_numpy())][[*group, "slice"]]
        return kept.assign(place=range(len(kept)))

    # One row for each slice: a few thousand even for a pair of a hundred million lines.
    sequence = parts.groupBy(*group).applyInPandas(heaviest, f"{_typed(own, 'key', 'gap', 'slice')}, place long")
    placed = stored(_same(own, sequence, [*group, "slice"]).select(*group, "place", "i", "j"))
    several = sequence.where("place = 1").select(*group)
    both = F.explode(F.array(F.col("place"), F.col("place") - 1))  # each slice meets its successor and its predecessor
    meetings = _same(placed, several, group).select(*group, both.alias("pair"), "place", "j").where("pair >= 0")

    def parted(rows):
        pair = rows["pair"].iloc[0]
        left = np.sort(rows.loc[rows["place"] == pair, "j"].to_numpy())
        right = np.sort(rows.loc[rows["place"] == pair + 1, "j"].to_numpy())
        out = rows.iloc[:1][[*group, "pair"]]
        return out.assign(at=border(left, right)) if len(left) and len(right) else out.iloc[:0].assign(at=0)

    borders = meetings.groupBy(*group, "pair").applyInPandas(parted, f"{_typed(own, 'key', 'gap')}, pair long, at long")
    upto = Window.partitionBy(*group).orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)
    borders = stored(borders.select(*group, "pair", F.max("at").over(upto).alias("at")))
    low = borders.select(*group, (F.col("pair") + 1).alias("place"), F.col("at").alias("low"))
    high = borders.select(*group, F.col("pair").alias("place"), F.col("at").alias("high"))
    bounded = _same(_same(placed, low, [*group, "place"], "left"), high, [*group, "place"], "left")
    inside = (F.col("low").isNull() | (F.col("j") >= F.col("low"))) & (F.col("high").isNull() | (F.col("j") < F.col("high")))
    return bounded.where(inside).select(*group, "i", "j")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right by keys, of which nulls are equal."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"__{k}" for k in keys])


def _split(side: DataFrame, matches: DataFrame, at: str) -> DataFrame:
    """The lines (key, at, h) of a side that no match has, with gap, the number of matches before them."""
    marked = _same(side.select("key", at, "h"), matches.select("key", at, F.lit(1).cast("long").alias("hit")), ["key", at], "left")
    counted = sums_before(marked, ["key"], [at], {"gap": F.coalesce("hit", F.lit(0).cast("long"))})
    return stored(_same(marked.where("hit is null").drop("hit"), counted, ["key", at]))


def _once(side: DataFrame, at: str) -> DataFrame:
    return side.groupBy("key", "gap", "h").agg(F.count("*").alias("n"), F.min(at).alias(at)).where("n = 1").drop("n")


def common(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b, both increasing, of the most lines that both have in the same order."""
    places = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    own = [i for i, line in enumerate(a) if line in places]
    if sum(len(places[a[i]]) for i in own) <= MEETINGS:
        meetings = np.array([(i, j) for i in own for j in reversed(places[a[i]])], np.int64).reshape(-1, 2)
        kept = meetings[increasing(meetings[:, 1])]
        return kept[:, 0], kept[:, 1]
    known = {a[i] for i in own}
    other = [j for j, line in enumerate(b) if line in known]  # lines of one side only stay out of the search
    x = y = 0
    found = []
    for op, _ in edit_script([a[i] for i in own], [b[j] for j in other]):
        if op == " ":
            found.append((own[x], other[y]))
        x, y = x + (op != "+"), y + (op != "-")
    kept = np.array(found, np.int64).reshape(-1, 2)
    return kept[:, 0], kept[:, 1]


def _commons(firsts, hashes) -> Iterator[tuple]:
    """For each of hashes, lists of which the first so many are of a: where it begins, lines of a and of b, and what common() finds."""
    import pyarrow.compute as pc

    codes = pc.dictionary_encode(hashes.flatten()).indices.to_numpy()
    begin = 0
    for n, size in zip(firsts.to_pylist(), pc.list_value_length(hashes).to_pylist(), strict=True):
        own, other = codes[begin : begin + n].tolist(), codes[begin + n : begin + size].tolist()
        yield begin, len(own), len(other), *common(own, other)
        begin += size


def _lists(ends: list[int], names: list[str], columns: list[np.ndarray]):
    """Lists of structs from their values and ends."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names))


def _row_matches(firsts, hashes, places):
    """i and j, of the places, of the lines that stay."""
    at, found, ends = places.flatten().to_numpy(), [np.empty((0, 2), np.int64)], []
    for begin, n, _, x, y in _commons(firsts, hashes):
        found.append(np.column_stack([at[begin + x], at[begin + n + y]]))
        ends.append(len(x) + (ends[-1] if ends else 0))
    both = np.concatenate(found)
    return _lists(ends, ["i", "j"], [both[:, 0], both[:, 1]])


def _row_scripts(firsts, hashes):
    """For every line the number of matches before it, and its kind: 0 removed, 1 added, 2 and 3 matched in a and in b."""
    gaps, kinds, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    for begin, n, m, x, y in _commons(firsts, hashes):
        for size, hit, kind in ((n, x, 0), (m, y, 1)):
            gaps.append(np.searchsorted(hit, np.arange(size)))
            kinds.append(np.full(size, kind))
            kinds[-1][hit] += 2
        ends.append(begin + n + m)
    return _lists(ends, ["gap", "kind"], [np.concatenate(gaps), np.concatenate(kinds)])


def _row_lengths(firsts, hashes, places):
    """Length of the longest chain of places that increase on both sides, at which a line of a is one of b."""
    import pyarrow as pa
    import pyarrow.compute as pc

    codes, at = pc.dictionary_encode(hashes.flatten()).indices.to_pylist(), places.flatten().to_pylist()
    begin, found = 0, []
    for n, size in zip(firsts.to_pylist(), pc.list_value_length(hashes).to_pylist(), strict=True):
        own, other, tops = defaultdict(set), defaultdict(list), []
        for k in range(begin, begin + n):
            own[at[k]].add(codes[k])
        for k in range(begin + n, begin + size):
            other[codes[k]].append(at[k])
        for i in sorted(own):
            for j in sorted({j for code in own[i] for j in other.get(code, ())}, reverse=True):
                k = bisect_left(tops, j)
                tops[k : k + 1] = [j]
        found.append(len(tops))
        begin += size
    return pa.array(found, pa.int64())


def _collected(lines: DataFrame, *keys: str) -> DataFrame:
    """keys and rows, all other columns of lines in the order of side and at, and first, the number of rows of side 0."""
    rest = ["side", "at", *[c for c in lines.columns if c not in (*keys, "side", "at")]]
    return lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"), F.count_if(F.col("side") == 0).alias("first"))


def _gap_matches(a: DataFrame, b: DataFrame, most: int) -> DataFrame:
    """Matches (key, i, j) within gaps; one of more than most lines on a side is cut into as many pieces on both."""
    size = lambda side, at, n, first: side.groupBy("key", "gap").agg(F.count("*").alias(n), F.min(at).alias(first))
    sizes = _same(size(a, "i", "na", "fa"), size(b, "j", "nb", "fb"), ["key", "gap"])
    sizes = stored(sizes.withColumn("pieces", F.ceil(F.greatest("na", "nb") / most)))
    piece = lambda at, first, n: F.floor((F.col(at) - F.col(first)) * F.col("pieces") / F.col(n)).alias("piece")
    left = _same(a, sizes, ["key", "gap"]).select("key", "gap", piece("i", "fa", "na"), F.lit(0).alias("side"), F.col("i").alias("at"), "h")
    right = _same(b, sizes, ["key", "gap"]).select("key", "gap", piece("j", "fb", "nb"), F.lit(1).alias("side"), F.col("j").alias("at"), "h")
    pieces = _collected(left.unionByName(right), "key", "gap", "piece")
    matches = F.arrow_udf(_row_matches, "array<struct<i: bigint, j: bigint>>")
    return pieces.select("key", F.inline(matches("first", F.col("rows.h"), F.col("rows.at"))))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def line_matches(a: DataFrame, b: DataFrame, most: int = GAP) -> DataFrame:
    """key, i and j of the lines that stay: a has key, i and line, b key, j and line, numbered from 0 on."""
    digest = _digest(F.coalesce("line", F.lit("")))
    left = stored(a.select("key", F.col("i").cast("long").alias("i"), digest.alias("h")))
    right = stored(b.select("key", F.col("j").cast("long").alias("j"), digest.alias("h")))
    matches, open_a, open_b = None, left.withColumn("gap", F.lit(0).cast("long")), right.withColumn("gap", F.lit(0).cast("long"))
    for _ in range(ROUNDS):
        anchors = _same(_once(open_a, "i"), _once(open_b, "j"), ["key", "gap", "h"]).select("key", "gap", "i", "j")
        new = stored(chains(anchors).select("key", "i", "j"))
        if new.isEmpty():
            break
        matches = new if matches is None else stored(matches.unionByName(new))
        open_a, open_b = _split(left, matches, "i"), _split(right, matches, "j")
    rest = stored(_gap_matches(open_a, open_b, most))
    return rest if matches is None else matches.unionByName(rest)


def line_script(a: DataFrame, b: DataFrame, most: int = GAP) -> DataFrame:
    """key, gap, kind, at, op and line of an edit script from a (key, i, line) to b (key, j, line).

    op is " ", "-" or "+"; ordered by gap, kind and at the script reads from top to bottom,
    lines removed before lines added. Null keys are a pair; a null line is an empty one.
    """
    line = F.coalesce("line", F.lit("")).alias("line")
    own = a.select("key", F.col("i").cast("long").alias("i"), line)
    other = b.select("key", F.col("j").cast("long").alias("j"), line)
    both = own.select("key", F.lit(0).alias("side"), F.col("i").alias("at"), "line").unionByName(
        other.select("key", F.lit(1).alias("side"), F.col("j").alias("at"), "line")
    )
    sizes = both.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"), F.sum(F.octet_length("line")).alias("bytes"))
    large = stored(sizes.where((F.greatest("na", "nb") > most) | (F.col("bytes") > PAIR_BYTES)).select("key"))
    if large.isEmpty():
        return _small_scripts(both)
    of = lambda side, how: _same(side, large, ["key"], how)
    return _small_scripts(of(both, "left_anti")).unionByName(_large_scripts(of(own, "left_semi"), of(other, "left_semi"), most))


_OP = "case kind when 0 then '-' when 1 then '+' else ' ' end"


def _small_scripts(both: DataFrame) -> DataFrame:
    """Scripts of pairs of (key, side, at, line) that a row holds each."""
    scripts = F.arrow_udf(_row_scripts, "array<struct<gap: bigint, kind: bigint>>")
    coded = _collected(both, "key").select("key", "rows", scripts("first", F.transform("rows.line", _digest)).alias("codes"))
    lines = coded.select("key", F.inline(F.arrays_zip("rows", "codes"))).select("key", "codes.gap", F.col("codes.kind").cast("int").alias("kind"), "rows.at", "rows.line")
    return lines.where("kind < 3").select("key", "gap", "kind", "at", F.expr(_OP).alias("op"), "line")


def _large_scripts(own: DataFrame, other: DataFrame, most: int) -> DataFrame:
    matches = stored(line_matches(own, other, most))
    hit = lambda at: matches.select("key", at, F.lit(1).cast("long").alias("hit"))

    def placed(side: DataFrame, at: str) -> DataFrame:
        marked = _same(side, hit(at), ["key", at], "left")
        counted = sums_before(marked, ["key"], [at], {"gap": F.coalesce("hit", F.lit(0).cast("long"))})
        return _same(marked, counted, ["key", at])

    rows = lambda side, at, kind, op: side.select("key", "gap", F.lit(kind).alias("kind"), F.col(at).alias("at"), F.lit(op).alias("op"), "line")
    left, right = placed(own, "i"), placed(other, "j")
    return (
        rows(left.where("hit is null"), "i", 0, "-").unionByName(rows(right.where("hit is null"), "j", 1, "+"))
        .unionByName(rows(left.where("hit is not null"), "i", 2, " "))
    )


def common_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """key and n, the number of lines that a (key, i, line) and b (key, j, line) have in the same order.

    Several texts of a side may share a key: a place then holds the lines that any of them has there.
    A row holds the distinct lines of the texts of a key.
    """
    side = lambda df, k, at: df.select("key", F.lit(k).alias("side"), F.col(at).cast("long").alias("at"), _digest(F.coalesce("line", F.lit(""))).alias("h"))
    rows = _collected(side(a, 0, "i").unionByName(side(b, 1, "j")).distinct(), "key")
    return rows.select("key", F.arrow_udf(_row_lengths, "bigint")("first", F.col("rows.h"), F.col("rows.at")).alias("n"))
