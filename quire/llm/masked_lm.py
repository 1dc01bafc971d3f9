"""Language-model scores by masked pseudo-likelihood.

A window network, written in numpy, predicts every token of a document from the two
tokens on either side of it. The sum of the conditional log-probabilities scores the
document. Tokens are white-space words with A-Z lower-cased. The KNOWN most frequent words
of the whole corpus are classes of their own; the others share BUCKETS classes by a hash.
Within such a class the network predicts the word itself by the branches of a Huffman tree
(hierarchical softmax), whose leaves are the words that occur at least LEAST times, so that
they grow with the corpus, and one for all rarer words. The letters of a rarer word are
charged by a byte model of the corpus, so that every word has a probability. MOST bounds
the leaves: beyond it the least count rises. The words beside a token enter as INPUTS
classes, most of them single words. A branch has WIDTH + 1 weights, so that the network and
its slopes take 12 MB of a worker at most.

Counts and training cover all documents: every position trains once. A hash deals the
documents to ROUNDS rounds, and within a round to shards of about SHARD tokens; a copy of
the network trains on each shard, in an order that the hash fixes, and the copies are
averaged by how often each of their parts was trained, block by block, in a shuffle. The
averaged network and the counts of its words reach the driver, MOST rows at most. Neither
dealing nor averaging depends on the partitioning of the table, so scores agree between
layouts but for the rounding of 32-bit sums. Texts are coded once. A task holds one batch of
rows or one shard, and one network.

Defined results: a null or empty text has no tokens, score 0 and mean_score null; tokens
past either end are a mask of their own; repeated rows get equal scores but for rounding;
doc_ids may be of any type, null or shared; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_keys, stored
from .runhash import Powers, batch_words, word_hashes

KNOWN = 32
BUCKETS = 32
CLASSES = KNOWN + BUCKETS
#: Classes of the words beside a token; the last quarter of them are shared by a hash, PAD is beyond either end.
INPUTS = 1024
SINGLE = INPUTS * 3 // 4
PAD = INPUTS
#: A word has a leaf of its own from this count on, if there are no more than MOST such words.
LEAST = 16
MOST = 1 << 17
SIDES = (-2, -1, 1, 2)
WIDTH = 7
ROUNDS = 2
SHARD = 1 << 21
SEED = 3
STEP = 2048
RATE = 0.2
SHAPES = ((len(SIDES), INPUTS + 1, WIDTH), (WIDTH,), (WIDTH, CLASSES), (CLASSES,))
#: Tokens that are scored together.
TOGETHER = 1 << 18
#: Branches that are averaged together.
BLOCK = 1024
#: A partition's table of word counts is passed on at this size.
FLUSH = 1 << 22
#: Letters are charged in multiples of 1 / FINE, so that sums are exact.
FINE = 1 << 32


class Words(NamedTuple):
    """What the corpus says of its words, by leaf where there is one for each.

    known are the hashes of the words with leaves, the most frequent first; letters the
    log-probabilities of bytes and of a word's end, times FINE; kinds the classes of the
    leaves and inputs their classes beside a token; paths the ways to the leaves.
    """

    known: np.ndarray
    letters: np.ndarray
    kinds: np.ndarray
    inputs: np.ndarray
    paths: tuple[np.ndarray, ...]


def initial(seed: int = SEED) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for s in SHAPES]


def flat(net: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in net])


def shaped(values: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES])
    return [p.reshape(s).astype(np.float32) for p, s in zip(np.split(values, ends[:-1]), SHAPES, strict=True)]


def tree(kinds: np.ndarray, counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Huffman trees over the leaves of each class: (offsets, nodes, sides) of the way to each leaf, and the branches.

    A branch is WIDTH weights, 0 at first, and a bias, at first the log-odds of its two sides.
    """
    n = len(kinds)
    parent, side, bias = [-1] * n, [0] * n, []
    order = np.argsort(kinds, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(kinds[order])) + 1):
        heap = [(int(counts[i]), int(i)) for i in group]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, left), (b, right) = heapq.heappop(heap), heapq.heappop(heap)
            node = len(parent)
            parent.append(-1)
            side.append(0)
            parent[left] = parent[right] = node
            side[right] = 1
            bias.append(np.log(b / a))
            heapq.heappush(heap, (a + b, node))
    parent, side = np.array(parent, np.int64), np.array(side, bool)
    leaf = at = np.arange(n)
    steps = []
    while len(leaf):
        leaf, at = leaf[parent[at] >= 0], at[parent[at] >= 0]
        steps.append((leaf, parent[at] - n, side[at]))
        at = parent[at]
    leaf, nodes, sides = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(leaf, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(leaf, minlength=n))))
    branches = np.zeros((len(bias), WIDTH + 1), np.float32)
    branches[:, WIDTH] = bias
    return (offsets, nodes[order].astype(np.int32), sides[order]), branches


def context(inputs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of the stacked embeddings for each side of the positions at."""
    sides = np.arange(len(SIDES))[:, None] * (INPUTS + 1)
    return inputs[at[None, :] + np.array(SIDES)[:, None]] + sides


def hidden(net: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """tanh of the summed embeddings, and a last column of ones."""
    table = net[0].reshape(-1, WIDTH)
    found = np.ones((rows.shape[1], WIDTH + 1), np.float32)
    h = found[:, :WIDTH]
    h[:] = net[1]
    for side in rows:
        h += table.take(side, 0)
    np.tanh(h, out=h)
    return found


def class_weights(net: list[np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits of the classes, and their sums."""
    z = h @ np.concatenate((net[2], net[3][None, :]))
    np.minimum(z, 80, out=z)  # exp of more is no 32-bit number
    np.exp(z, out=z)
    return z, z @ np.ones(CLASSES, np.float32)


class Ways:
    """Positions in the order of the lengths of the ways to their leaves, the longest first.

    Those with more than d branches are then the first levels[d], so that a level of all
    trees is a slice.
    """

    def __init__(self, paths: tuple, leaves: np.ndarray, at: np.ndarray):
        offsets, self.nodes, self.sides = paths
        own = leaves[at]
        length = offsets[own + 1] - offsets[own]
        order = np.argsort((-length).astype(np.int16), kind="stable")
        self.at, length, self.first = at[order], length[order], offsets[own[order]]
        self.levels = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")

    def __iter__(self):
        """How many positions, and their nodes and sides, level by level."""
        for depth, n in enumerate(self.levels):
            step = self.first[:n] + depth
            yield n, self.nodes[step], self.sides[step]


def log_probabilities(
    net: list[np.ndarray], branches: np.ndarray, words: Words, leaves: np.ndarray, at: np.ndarray
) -> np.ndarray:
    """log P(leaves[i] | its window) for the positions at, which leave room for the window."""
    inputs, kinds = words.inputs[leaves], words.kinds[leaves]
    found = np.empty(len(leaves))
    for i in range(0, len(at), STEP):
        ways = Ways(words.paths, leaves, at[i : i + STEP])
        h = hidden(net, context(inputs, ways.at))
        z, total = class_weights(net, h)
        each = np.log(np.maximum(z[np.arange(len(z)), kinds[ways.at]], 1e-37) / total)
        for n, node, side in ways:
            z = np.einsum("ij,ij->i", branches.take(node, 0), h[:n])
            np.negative(z, out=z, where=side)
            np.minimum(z, 80, out=z)  # exp of more is no 32-bit number
            each[:n] -= np.log1p(np.exp(z, out=z), out=z)
        found[ways.at] = each
    return found[at]


class Trainer:
    """One copy of the network with AdaGrad steps."""

    def __init__(self, values: np.ndarray, branches: np.ndarray, words: Words):
        self.words = words
        self.net, self.branches = shaped(values), branches.astype(np.float32)
        self.squares = [np.full(p.shape, 1e-2, np.float32) for p in self.net]
        self.branch_squares = np.full(branches.shape, 1e-2, np.float32)
        self.visits, self.seen = np.zeros(len(branches), np.float32), 0

    def step(self, inputs: np.ndarray, leaves: np.ndarray, at: np.ndarray) -> None:
        """Moves the weights against the mean slope of the positions at."""
        n, ways = len(at), Ways(self.words.paths, leaves, at)
        rows = context(inputs, ways.at)
        h = hidden(self.net, rows)
        z, total = class_weights(self.net, h)
        z *= 1 / total[:, None]
        z[np.arange(n), self.words.kinds[leaves[ways.at]]] -= 1  # the slope of the logits
        dh = np.zeros_like(h)
        dh[:, :WIDTH] = z @ self.net[2].T
        self._branches(h, dh, ways)
        own = h[:, :WIDTH]
        dh = dh[:, :WIDTH] * ((1 - own * own) / n)
        size = len(SIDES) * (INPUTS + 1)
        below = rows.ravel()
        embeddings = np.stack([np.bincount(below, np.tile(d, len(SIDES)), size) for d in dh.T], axis=1)
        slopes = (embeddings.astype(np.float32).reshape(SHAPES[0]), dh.sum(axis=0), own.T @ z / n, np.ones(n, np.float32) @ z / n)
        for p, g, s in zip(self.net, slopes, self.squares, strict=True):
            s += g * g
            p -= RATE * g / np.sqrt(s)
        self.seen += n

    def _branches(self, h: np.ndarray, dh: np.ndarray, ways: Ways) -> None:
        """Moves the branches on the ways by the mean slope of their visits; adds the slopes of h to dh."""
        nodes, slopes, rows = [], [], []
        for n, node, side in ways:
            own = self.branches.take(node, 0)
            g = 1 / (1 + np.exp(-np.einsum("ij,ij->i", own, h[:n]))) - side
            own *= g[:, None]
            dh[:n] += own
            nodes.append(node)
            slopes.append(g)
            rows.append(np.arange(n))
        if not nodes:
            return
        node = np.concatenate(nodes)
        order = np.argsort(node)
        node = node[order]
        first = np.flatnonzero(np.diff(node, prepend=-1))
        at, n = node[first], np.diff(first, append=len(node)).astype(np.float32)
        each = h.take(np.concatenate(rows)[order], 0)
        each *= np.concatenate(slopes)[order][:, None]
        slope = np.add.reduceat(each, first, axis=0)
        slope /= n[:, None]
        squares = self.branch_squares.take(at, 0)
        squares += slope * slope
        self.branch_squares[at] = squares
        self.branches[at] -= RATE * slope / np.sqrt(squares)
        self.visits[at] += n


def keys(raw: np.ndarray, first: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of words, none of them from -256 to 0."""
    hashes = word_hashes(raw, first, end, powers).view(np.int64)
    return np.where((hashes >= -256) & (hashes <= 0), hashes + 1024, hashes)


class Coder:
    """Finds the leaves of words, and charges the letters of words that have none of their own."""

    SLOTS = 1 << 20

    def __init__(self, words: Words):
        self.words, self.powers = words, Powers()
        self.order = np.argsort(words.known)
        self.sorted = words.known[self.order]
        self.slots = np.full(self.SLOTS, -1, np.int32)  # a word for each value of some bits; few share one
        self.slots[words.known & (self.SLOTS - 1)] = np.arange(len(words.known))

    def leaves(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each word, and whether it is its own."""
        n = len(self.words.known)
        bucket = n + (hashes & (BUCKETS - 1))
        if not n:
            return bucket, np.zeros(len(hashes), bool)
        found = self.slots[hashes & (self.SLOTS - 1)]
        is_known = self.words.known[found] == hashes
        other = np.flatnonzero(~is_known & (found >= 0))
        at = np.minimum(np.searchsorted(self.sorted, hashes[other]), n - 1)
        same = self.sorted[at] == hashes[other]
        found[other[same]] = self.order[at[same]]
        is_known[other[same]] = True
        is_known &= found >= 0
        return np.where(is_known, found, bucket), is_known

    def code(self, column) -> tuple[list[np.ndarray], np.ndarray]:
        """The leaves of each text of an Arrow column, and the log-probability of the letters of its unknown words."""
        charges, texts, letters = np.zeros(len(column)), [], self.words.letters
        for raw, first, end, ends in batch_words(column):
            leaves, is_known = self.leaves(keys(raw, first, end, self.powers))
            sums = np.concatenate(([0], np.cumsum(letters[raw])))
            charge = np.where(is_known, 0, sums[end] - sums[first] + letters[256])
            sums = np.concatenate(([0], np.cumsum(charge)))
            charges[len(texts) : len(texts) + len(ends)] = np.diff(sums[ends], prepend=0) / FINE
            texts += np.split(leaves.astype(np.int32), ends[:-1])
        return texts, charges


def joined(texts: list[np.ndarray], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all coded texts: leaves between pairs of the last leaf, which stands for PAD, positions of tokens, their texts."""
    pad = np.full(2, len(words.kinds) - 1, np.int32)
    leaves = np.concatenate([pad] + [part for t in texts for part in (t, pad)])
    n = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), n)
    return leaves, np.arange(len(owner)) + 2 * owner + 2, owner


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and n over all of docs; the words -256 to 0 hold the counts of letters and of word ends."""

    def run(batches: Iterator):
        import pyarrow as pa

        powers, letters = Powers(), np.zeros(257, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def rows(values, n):
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for raw, first, end, _ in batch_words(batch.column("text")):
                letters[:256] += np.bincount(raw, minlength=256)
                letters[256] += len(first)
                waiting.append(keys(raw, first, end, powers))
                size += len(first)
                if size > FLUSH:
                    yield rows(*np.unique(np.concatenate(waiting), return_counts=True))
                    waiting, size = [], 0
        if size:
            yield rows(*np.unique(np.concatenate(waiting), return_counts=True))
        letters[[9, 10, 11, 12, 13, 32]] = 0
        yield rows(-np.arange(257, dtype=np.int64), letters)

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> tuple[Words, np.ndarray, int]:
    """The words, the first branches, and how many tokens there are."""
    counts = cut(word_counts(docs))
    small = F.col("word").between(-256, 0)
    own = counts.where(~small)
    # A row for each count that occurs; counts of 2**16 and more by their first 11 bits. That is 2**17 rows at most.
    step = F.pow(F.lit(2.0), F.floor(F.log2("n")) - 10)
    level = F.when(F.col("n") < 1 << 16, F.col("n")).otherwise((F.floor(F.col("n") / step) * step).cast("long")).alias("n")
    times = own.where(F.col("n") >= LEAST).groupBy(level).agg(F.count("*").alias("words")).collect()
    least, total = None, 0
    for row in sorted(times, reverse=True):
        total += row["words"]
        if total > MOST:
            break
        least = row["n"]
    found = {r["word"]: r["n"] for r in own.orderBy(F.desc("n"), "word").limit(KNOWN).collect()}
    if least is not None:
        more = own.where(F.col("n") >= least).toArrow()  # MOST rows at most
        found.update(zip(more.column("word").to_pylist(), more.column("n").to_pylist(), strict=True))
    known = np.array(sorted(found, key=lambda w: (-found[w], w)), np.int64)
    n = np.array([found[w] for w in known.tolist()], np.int64)
    letters, tokens = np.ones(257), 0
    for row in counts.where(small).collect():  # 257 rows
        letters[-row["word"]] += row["n"]
        tokens = row["n"] if row["word"] == -256 else tokens
    bucket, single = np.arange(BUCKETS), np.arange(len(known)) < SINGLE
    kinds = np.concatenate((KNOWN + (known & (BUCKETS - 1)), KNOWN + bucket, [0]))
    kinds[: min(KNOWN, len(known))] = np.arange(min(KNOWN, len(known)))
    shared = SINGLE + (known >> 8) % (INPUTS - SINGLE)
    inputs = np.concatenate((np.where(single, np.arange(len(known)), shared), SINGLE + bucket * (INPUTS - SINGLE) // BUCKETS, [PAD]))
    rest = np.zeros(BUCKETS, np.int64)
    for row in own.groupBy(F.pmod("word", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        rest[row["bucket"]] = row["n"]
    rest -= np.bincount(known & (BUCKETS - 1), n, BUCKETS).astype(np.int64)
    paths, branches = tree(kinds[:-1], np.concatenate((n, np.maximum(rest, 1))))
    charged = np.rint(np.log(letters / letters.sum()) * FINE).astype(np.int64)
    return Words(known, charged, kinds.astype(np.int32), inputs.astype(np.int32), paths), branches, tokens


def coded(docs: DataFrame, words: Words) -> DataFrame:
    """doc_id, deal (a hash of doc_id and text), leaves (int32 as bytes) and charge of every row of docs."""

    def run(batches: Iterator):
        import pyarrow as pa

        coder = Coder(words)
        for batch in batches:
            texts, charges = coder.code(batch.column("text"))
            leaves = pa.array([t.tobytes() for t in texts], pa.binary())
            columns = [batch.column("doc_id"), batch.column("deal"), leaves, pa.array(charges, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "deal", "leaves", "charge"])

    rows = docs.select("doc_id", F.xxhash64(*row_keys()).alias("deal"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, deal long, leaves binary, charge double")


def steps(at: np.ndarray) -> Iterator[np.ndarray]:
    """at in steps of STEP positions from all over it; one step takes the neighbours of what the last one took."""
    n = len(at) // STEP
    yield from at[: n * STEP].reshape(STEP, n).T
    if len(at) > n * STEP:
        yield at[n * STEP :]


def train_round(rows: DataFrame, words: Words, values: tuple, number: int, rounds: int, shards: int) -> tuple:
    """The average of the networks that the shards of a round train from values."""
    net, branches = values
    n_blocks = max(1, -(-len(branches) // BLOCK))
    across = WIDTH + 2  # the weights of a branch and its visits

    def run(table):
        import pyarrow as pa

        order = np.argsort(table.column("deal").to_numpy(), kind="stable")
        column = table.column("leaves").take(pa.array(order))
        leaves, at, _ = joined([np.frombuffer(x.as_py(), np.int32) for x in column], words)
        trainer, inputs = Trainer(net, branches, words), words.inputs[leaves]
        for own in steps(at):
            trainer.step(inputs, leaves, own)
        whole = np.concatenate((trainer.branches, trainer.visits[:, None]), axis=1)
        parts = [np.append(flat(trainer.net), np.float32(trainer.seen)), *np.split(whole, np.arange(BLOCK, len(whole), BLOCK))]
        shard = table.column("shard")[0].as_py()
        return pa.table({
            "block": pa.array(range(len(parts)), pa.int32()), "shard": pa.array([shard] * len(parts), pa.int32()),
            "data": pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary()),
        })

    def average(table):
        import pyarrow as pa

        block = table.column("block")[0].as_py()
        shares = sorted(zip(table.column("shard").to_pylist(), table.column("data").to_pylist(), strict=True))
        total: np.ndarray | float = 0.0
        for _, data in shares:  # in a fixed order, as sums of floats depend on it
            part = np.frombuffer(data, np.float32).astype(np.float64).reshape((1, -1) if block == 0 else (-1, across))
            total = total + np.concatenate((part[:, :-1] * part[:, -1:], part[:, -1:]), axis=1)
        mean = total[:, :-1] / np.maximum(total[:, -1:], 1)
        out = np.concatenate((mean, total[:, -1:]), axis=1).astype(np.float32)
        return pa.table({"block": pa.array([block], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    deal = F.col("deal")
    own = rows.where((F.pmod(deal, F.lit(rounds)) == number) & (F.octet_length("leaves") > 0))
    dealt = own.select(F.pmod(F.shiftright(deal, 8), F.lit(shards)).cast("int").alias("shard"), "deal", "leaves")
    if shards > 1:  # by ranges, as a hash of so few numbers would give some tasks several shards and others none
        dealt = dealt.repartitionByRange(shards, "shard")
    nets = dealt.groupBy("shard").applyInArrow(run, "block int, shard int, data binary")
    means = nets.groupBy("block").applyInArrow(average, "block int, data binary").toArrow()  # n_blocks + 1 rows
    net, branches = net.copy(), branches.copy()
    for block, data in zip(means.column("block").to_pylist(), means.column("data").to_pylist(), strict=True):
        part = np.frombuffer(data, np.float32)
        if block == 0:
            net = part[:-1]
        else:
            part, at = part.reshape(-1, across), (block - 1) * BLOCK
            own = branches[at : at + BLOCK]
            branches[at : at + BLOCK] = np.where(part[:, -1:] > 0, part[:, :-1], own)
    assert len(means) in (0, n_blocks + 1)
    return net, branches


def trained(rows: DataFrame, words: Words, branches: np.ndarray, tokens: int, rounds: int = ROUNDS) -> tuple:
    values = flat(initial()), branches
    shards = max(1, -(-tokens // (rounds * SHARD)))
    for number in range(rounds):
        values = train_round(rows, words, values, number, rounds, shards)
    return values


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Words, tuple]:
    words, branches, tokens = vocabulary(docs)
    return words, trained(stored(coded(docs, words)), words, branches, tokens, rounds)


def scored(rows: DataFrame, words: Words, values: tuple) -> DataFrame:
    """doc_id, n_tokens, score, mean_score for each of the coded rows."""

    def run(batches: Iterator):
        import pyarrow as pa

        net, branches = shaped(values[0]), values[1]
        for batch in batches:
            texts = [np.frombuffer(x.as_py(), np.int32) for x in batch.column("leaves")]
            tokens = np.array([len(t) for t in texts], np.int64)
            total = batch.column("charge").to_numpy().copy()
            together = np.cumsum(tokens) // TOGETHER  # texts are taken together up to about so many tokens
            for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(together)) + 1):
                leaves, at, owner = joined([texts[i] for i in own], words)
                each = log_probabilities(net, branches, words, leaves, at)
                total[own] += np.bincount(owner, each, len(own))
            mean = pa.array(total / np.maximum(tokens, 1), mask=tokens == 0)
            columns = [batch.column("doc_id"), pa.array(tokens), pa.array(total), mean]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "score", "mean_score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, score double, mean_score double")


def score(docs: DataFrame, words: Words, values: tuple) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, score, mean_score."""
    return scored(coded(docs, words), words, values)


def score_documents(docs: DataFrame) -> DataFrame:
    words, branches, tokens = vocabulary(docs)
    rows = stored(coded(docs, words))
    return scored(rows, words, trained(rows, words, branches, tokens))
