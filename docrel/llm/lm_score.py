"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | before) is a product of softmaxes of 16 outcomes each. The first two are over 256 classes: the end mark and the
191 most frequent words on their own, 32 classes of the next most frequent ones, 16 words each, and 32 classes of all
other words by a hash of their last three bytes. The word of a class of 16 is the outcome of a third softmax. In a class
of all other words, two more decide on bits of the word's hash, which makes 256 leaves a class; the words of a leaf are
told apart by add-one counts. All softmaxes use the same n-gram and skip features of the words before (1, 1+2 back; 2
back), hashed, together with what is decided so far, into one table of weights. Logits start from the log shares of the
outcomes.

All training documents count: word counts, and every token in the gradient updates. The training rows are dealt to
ROUNDS rounds. In each round, every task starts from the weights so far and moves its copy along the gradient of the
log likelihood, batch by batch (steps scaled per row by the squares of its gradients); what the tasks have moved is
averaged by row, weighted with how often a task met the row, in Spark, by slices of the table. The table has
ROWS_A_WORD rows for each distinct word up to WORD_ROWS, and beyond that at least one for every ROW_TOKENS training tokens
up to MOST_ROWS (64 MB, what tasks can hold), so it grows with the corpus until then; word counts grow without a bound. The KNOWN_WORDS most frequent words go to the tasks; counts of all rarer words
are joined in Spark, per document and word.

Null and empty texts are scored as their end mark alone. An empty training part leaves all counts 0 and leaves
equally likely. Unknown words count 0, as one type. Rows that repeat are scored each. A null doc_id is not held out.
Long texts are scored whole, BATCH tokens at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, replace
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_slices, materialize, mix, table

#: Outcomes of a softmax; classes: the end mark, single words, classes of SLOTS words, from REST on leaves.
SLOTS = 16
CLASSES, SINGLE, GROUPS = SLOTS**2, 191, 32
REST = 1 + SINGLE + GROUPS
#: Words sent to the tasks with their counts (some 15 MB); bytes of text whose words are counted before they are passed on.
KNOWN_WORDS, COUNT_BYTES = 150_000, 4 << 20
#: Rows of the weight table, each of SLOTS weights.
ROWS_A_WORD, LEAST_ROWS, WORD_ROWS = 32, 1 << 14, 1 << 19
ROW_TOKENS, MOST_ROWS = 128, 1 << 20
#: Rounds of training; tokens of one update; its step; slices of the table that are averaged apart.
ROUNDS, BATCH, STEP, SLICES = 3, 4096, 1.0, 512
#: A probability below it counts as this (32-bit floats end there).
LEAST_P = 1e-37
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Not a word, as words hold no white space.
END = b"\n"
#: Places back that each feature looks at.
FEATURES = ((1,), (2,), (1, 2))


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8").translate(LOWER).split(), END]


def word_lists(texts: pa.Array | list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of all texts but for the end marks, found in Arrow: the words, and how many each text has."""
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    found = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = found.flatten()
    is_word = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(is_word.to_numpy(zero_copy_only=False)))
    ends = found.offsets.to_numpy() - found.offsets[0].as_py()
    return words.filter(is_word).cast(pa.binary()), np.diff(before[ends])


def as_bytes(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes ten times as long


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def count(batches):
        for batch in batches:
            for low, high in byte_slices(batch, batch.num_rows, COUNT_BYTES):
                if high > low:
                    counted = pc.value_counts(word_lists(batch.column("text").slice(low, high - low))[0])
                    words, n = pa.array([END], pa.binary()), pa.array([high - low], pa.int64())
                    arrays = [pa.concat_arrays([counted.field("values"), words]), pa.concat_arrays([counted.field("counts"), n])]
                    yield pa.RecordBatch.from_arrays(arrays, ["word", "n"])
        pa.default_memory_pool().release_unused()  # idle workers stay

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rest_class(word: bytes) -> int:
    return REST + crc32(word[-3:]) % (CLASSES - REST)


def leaf(word: bytes) -> int:
    return crc32(word) % SLOTS**2


def leaf_sums(words: list[bytes], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and number of the words of each class and leaf that they have by hash."""
    of = np.array([rest_class(w) * SLOTS**2 + leaf(w) for w in words], np.int64)
    n = np.bincount(of, counts, CLASSES * SLOTS**2).astype(np.int64)
    return n.reshape(CLASSES, -1), np.bincount(of, minlength=CLASSES * SLOTS**2).reshape(CLASSES, -1)


@dataclass
class Vocabulary:
    """What tasks know of words: ids of the known ones, their counts, classes, slots and leaves (a last entry
    stands for all others)."""

    known: dict[bytes, int]
    counts: np.ndarray
    class_of: np.ndarray
    slot_of: np.ndarray
    leaf_of: np.ndarray

    def coded(self, texts: pa.Array | list[str | None]) -> tuple[Coded, pa.Array]:
        """The tokens of all texts, and each text's words that are not known, with how often they occur: a list a text."""
        words, lengths = word_lists(texts)
        words = words.dictionary_encode()
        # Each distinct word is looked up once; the end mark is the last of them.
        distinct = pa.concat_arrays([words.dictionary, pa.array([END], pa.binary())])
        own = np.fromiter(map(self.known.get, as_bytes(distinct), repeat(-1)), np.int64, len(distinct))
        classes, leaves, context = self.class_of[own], self.leaf_of[own], own.copy()
        at = np.flatnonzero(own < 0)
        others = as_bytes(distinct.take(pa.array(at)))
        hashed = np.array([crc32(w) for w in others], np.int64)
        classes[at], leaves[at], context[at] = [rest_class(w) for w in others], hashed % SLOTS**2, hashed + (1 << 32)
        of = np.insert(words.indices.to_numpy(), np.cumsum(lengths), len(distinct) - 1)
        lengths = lengths + 1
        unknown = np.flatnonzero(own[of] < 0)
        pairs, times = np.unique(np.repeat(np.arange(len(lengths)), lengths)[unknown] * len(distinct) + of[unknown], return_counts=True)
        rare = pa.StructArray.from_arrays([distinct.take(pa.array(pairs % len(distinct))), pa.array(times, pa.int64())], ["word", "n"])
        ends = np.searchsorted(pairs, np.arange(len(lengths) + 1) * len(distinct)).astype(np.int32)
        codes = (x.take(of) for x in (own, classes, self.slot_of[own], leaves, context))
        return Coded(*codes, lengths), pa.ListArray.from_arrays(pa.array(ends), rare)


@dataclass
class Coded:
    """Tokens of consecutive texts: word (-1: not known), class, slot, leaf, and what it is to the words after it."""

    ids: np.ndarray
    classes: np.ndarray
    slots: np.ndarray
    leaves: np.ndarray
    context: np.ndarray
    lengths: np.ndarray

    def batches(self):
        """Classes, slots, leaves and the codes of all features (tokens x features), BATCH tokens at a time."""
        begins = np.cumsum(self.lengths) - self.lengths
        place = np.arange(len(self.ids)) - np.repeat(begins, self.lengths)
        for low in range(0, len(self.ids), BATCH):
            at = np.arange(low, min(low + BATCH, len(self.ids)))
            back = {k: np.where(place[at] >= k, self.context[np.maximum(at - k, 0)] + 1, 0).astype(np.uint64) for k in (1, 2)}
            codes = np.empty((len(at), len(FEATURES)), np.uint64, order="F")
            for column, places in enumerate(FEATURES):
                code = np.full(len(at), column + 1, np.uint64)
                for k in places:
                    code = mix(code * _ODD + back[k])
                codes[:, column] = code
            yield self.classes[at], self.slots[at], self.leaves[at], codes


@dataclass
class Weights:
    """A table of rows x SLOTS weights, and the log shares that the logits of each softmax start from, by what is
    decided before it: nothing, a class's high digit, its class, its class, its class and the leaf's low digit."""

    table: np.ndarray
    starts: tuple[np.ndarray, ...]

    def decisions(self, classes: np.ndarray, slots: np.ndarray, leaves: np.ndarray, codes: np.ndarray):
        """For each softmax: the tokens that it is asked for, the rows of their features, their start and outcome."""
        every, inner, deep = np.arange(len(classes)), np.flatnonzero((classes > SINGLE) & (classes < REST)), np.flatnonzero(classes >= REST)
        last, first = np.divmod(leaves, SLOTS)
        high, low = np.divmod(classes, SLOTS)
        asked = (
            (every, np.zeros_like(classes), high), (every, high, low), (inner, classes, slots),
            (deep, classes, first), (deep, classes * SLOTS + first, last),
        )
        shift = np.uint64(65 - len(self.table).bit_length())
        for k, (at, decided, outcome) in enumerate(asked):
            if len(at):
                # The codes are mixed bits already: the upper bits of their products with each node's own odd number do.
                decided = decided[at]
                node = mix(((decided + 1) * 8 + k).astype(np.uint64)) | np.uint64(1)
                rows = (codes.T.take(at, 1) * node >> shift).view(np.int64).T
                yield at, rows, self.starts[k].take(decided, 0), outcome[at]

    def exps(self, rows: np.ndarray, start: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What the outcomes' probabilities are in proportion to, and their sums. held: a part of the table that rows
        point into."""
        table = self.table if held is None else held

        def logits(rows, start):
            out = table.take(rows[:, 0], 0)
            for k in range(1, rows.shape[1]):
                out += table.take(rows[:, k], 0)
            out += start
            return out

        ones, shares = np.ones(SLOTS, np.float32), logits(rows, start)
        with np.errstate(over="ignore", invalid="ignore"):
            total = np.exp(shares, out=shares) @ ones
        # Logits start from log shares, so their sums are mostly near 1; where they may have lost digits, from the most.
        far = np.flatnonzero(~((total > 1e-3) & (total < 1e30)))
        if len(far):
            again = logits(rows[far], start[far])
            shares[far] = np.exp(again - again.max(1, keepdims=True))
            total[far] = shares[far] @ ones
        return shares, total

    def softmax(self, rows: np.ndarray, start: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
        shares, total = self.exps(rows, start, held)
        shares /= total[:, None]
        return shares

    def log_p(self, *batch: np.ndarray) -> np.ndarray:
        """Log probability of each token's class, slot and leaf."""
        out = np.zeros(len(batch[0]))
        for at, rows, start, outcome in self.decisions(*batch):
            shares, total = self.exps(rows, start)
            out[at] += np.log(np.maximum(shares[np.arange(len(at)), outcome] / total, LEAST_P))
        return out


class MetRows:
    """The distinct rows of the table that tokens' features meet (ids), how often (times), and where each feature's row is
    among them (inner: tokens x features)."""

    def __init__(self, rows: np.ndarray):
        n, features = rows.shape
        # Row, feature and token packed into one number sort much faster than tokens by their rows.
        bits, place = max(1, (n - 1).bit_length()), max(1, (n - 1).bit_length()) + features.bit_length()
        packed = np.sort((rows.T << place | np.arange(features)[:, None] << bits | np.arange(n)).ravel())
        ids, at = packed >> place, packed & (1 << place) - 1
        new = np.append(True, ids[1:] != ids[:-1])
        self.first = np.flatnonzero(new)
        self.ids, self.times = ids[self.first], np.diff(np.append(self.first, len(ids)))
        self.token = at & (1 << bits) - 1
        inner = np.empty(features << bits, np.int64)
        inner[at] = np.cumsum(new) - 1
        self.inner = inner.reshape(features, -1)[:, :n].T


def row_gradient(rows: np.ndarray, p: np.ndarray, own: np.ndarray, met: MetRows | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that the tokens' features meet, how often, and the gradient of the log likelihood of ``own`` in them."""
    met = met or MetRows(rows)
    rest = -p
    rest[np.arange(len(own)), own] += 1
    out = rest.take(met.token[met.first], 0)
    more = np.flatnonzero(met.times > 1)  # mostly a row is met once
    if len(more):
        times = met.times[more]
        inner = np.repeat(met.times > 1, met.times)
        out[more] = np.add.reduceat(rest.take(met.token[inner], 0), np.cumsum(times) - times)
    return met.ids, met.times, out


def learn(own: Weights, squares_seen: np.ndarray, batch: tuple[np.ndarray, ...]) -> None:
    """Moves own's table along the gradient of one batch. squares_seen: of each row, the squares of its gradients and how
    often it was met; side by side, so that a row's two are one item."""
    pairs, whole_rows = squares_seen.view(np.int64).ravel(), own.table.view(f"V{4 * SLOTS}").ravel()  # set faster as one item each
    for _, rows, start, outcome in own.decisions(*batch):
        met = MetRows(rows)
        held = own.table.take(met.ids, 0)
        at, times, g = row_gradient(rows, own.softmax(met.inner, start, held), outcome, met)
        now = pairs.take(at).view(np.float32).reshape(-1, 2)
        now[:, 0] += np.einsum("rs,rs->r", g, g)
        now[:, 1] += times
        pairs[at] = now.view(np.int64).ravel()
        g *= (STEP / np.sqrt(now[:, 0] + 1))[:, None]
        g += held
        whole_rows[at] = g.view(whole_rows.dtype).ravel()


def train_weights(docs: DataFrame, vocabulary: Vocabulary, start: Weights, rounds: int = ROUNDS) -> Weights:
    """docs: the training documents. Rounds of gradient updates in all tasks, averaged in Spark after each."""
    spark, size = docs.sparkSession, len(start.table)
    slices = min(SLICES, size)
    texts = docs.select("text")
    tasks = max(spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // 8)
    weights, squares = start, np.zeros(size, np.float32)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((vocabulary, weights, squares))

        def part(batches):
            vocabulary, weights, before = sent.value
            own, squares_seen = replace(weights, table=weights.table.copy()), np.zeros((size, 2), np.float32)
            squares_seen[:, 0] = before
            for batch in batches:
                for low, high in byte_slices(batch, 1000, 1 << 20):
                    for some in vocabulary.coded(batch.column("text").slice(low, high - low))[0].batches():
                        learn(own, squares_seen, some)
            squares, seen = squares_seen.T
            if seen.any():
                for low in range(0, slices, 32):
                    numbers = range(slices)[low : low + 32]
                    at = [slice(k * size // slices, (k + 1) * size // slices) for k in numbers]
                    moved = ((own.table[x] - weights.table[x]).astype(np.float16).tobytes() for x in at)
                    cut = moved, ((squares[x] - before[x]).tobytes() for x in at), (seen[x].tobytes() for x in at)
                    arrays = [pa.array(numbers, pa.int32()), *(pa.array(list(c), pa.binary()) for c in cut)]
                    yield pa.RecordBatch.from_arrays(arrays, ["slice", "moved", "squares", "seen"])

        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).coalesce(tasks)
        moves = mine.mapInArrow(part, "slice int, moved binary, squares binary, seen binary")
        table, squares = weights.table.copy(), squares.copy()
        for r in moves.groupBy("slice").applyInPandas(averaged, "slice int, moved binary, squares binary").toLocalIterator():
            at = slice(r["slice"] * size // slices, (r["slice"] + 1) * size // slices)
            table[at] += np.frombuffer(r["moved"], np.float16).reshape(-1, SLOTS)
            squares[at] += np.frombuffer(r["squares"], np.float32)
        weights = replace(weights, table=table)
        sent.destroy()
    return weights


def averaged(parts: pd.DataFrame) -> pd.DataFrame:
    """One slice of the table: what its tasks have moved, by row, weighted with how often each met the row."""
    seen = [np.frombuffer(x, np.float32) for x in parts["seen"]]
    total = np.maximum(np.sum(seen, axis=0), 1)
    moved, squares = np.zeros((len(total), SLOTS), np.float32), np.zeros(len(total), np.float32)
    for n, m, s in zip(seen, parts["moved"], parts["squares"], strict=True):
        moved += (n / total)[:, None] * np.frombuffer(m, np.float16).reshape(-1, SLOTS)
        squares += n / total * np.frombuffer(s, np.float32)
    return pd.DataFrame({"slice": parts["slice"].iloc[:1], "moved": [moved.astype(np.float16).tobytes()], "squares": [squares.tobytes()]})


@dataclass
class LanguageModel:
    """rest: for each class and leaf, the log10 of what its words are divided by."""

    vocabulary: Vocabulary
    weights: Weights
    rest: np.ndarray
    tokens: int
    types: int
    word_counts: DataFrame | None = None

    def shipped(self):
        """What tasks need; it has no DataFrame."""
        return replace(self, word_counts=None)


def most_frequent(counts: DataFrame, most: int = KNOWN_WORDS) -> list[tuple[bytes, int]]:
    """The words of at least some count, the least for which they are no more than ``most``; most frequent first."""
    least, total = 1, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if (total := total + r["words"]) > most:
            least = r["n"] + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()
    order = sorted(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [(bytes(w), n) for w, n in order]


def train(docs: DataFrame) -> LanguageModel:
    """docs: the training documents."""
    counts = materialize(count_tokens(docs))
    top = most_frequent(counts)

    def per_leaf(batches):
        for batch in batches:
            arrays = leaf_sums(as_bytes(batch.column("word")), batch.column("n").to_pylist())
            at = np.flatnonzero(arrays[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(a.flat[at]) for a in arrays)], ["c", "n", "types"])

    # No more rows than leaves.
    sums = counts.mapInArrow(per_leaf, "c long, n long, types long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).toArrow()
    leaf_tokens, leaf_types = np.zeros((2, CLASSES, SLOTS**2), np.int64)
    leaf_tokens.flat[sums.column("c").to_numpy()] = sums.column("n").to_numpy()
    leaf_types.flat[sums.column("c").to_numpy()] = sums.column("types").to_numpy()
    model = start_model(top, leaf_tokens, leaf_types)
    return replace(model, weights=train_weights(docs, model.vocabulary, model.weights), word_counts=counts)


def table_rows(types: int, total: int) -> int:
    """Rows of the weight table for so many distinct words and tokens, a power of two."""
    by_words = min(WORD_ROWS, max(LEAST_ROWS, 1 << (ROWS_A_WORD * types).bit_length()))
    return min(MOST_ROWS, max(by_words, 1 << (total // ROW_TOKENS).bit_length()))


def start_model(top: list[tuple[bytes, int]], leaf_tokens: np.ndarray, leaf_types: np.ndarray) -> LanguageModel:
    """The model before training. top: the known words, most frequent first; counts of all words by class and leaf."""
    types, total = int(leaf_types.sum()), int(leaf_tokens.sum())
    known = {w: k for k, (w, _) in enumerate(top)}
    n = np.array([n for _, n in top], np.int64)
    leaf_of = np.array([leaf(w) for w in known], np.int64)
    class_of, slot_of = np.array([rest_class(w) for w in known], np.int64), np.zeros(len(top), np.int64)
    often = np.array([k for w, k in known.items() if w != END][: SINGLE + GROUPS * SLOTS], np.int64)
    own = np.append(often, known[END]) if END in known else often
    np.subtract.at(leaf_tokens, (class_of[own], leaf_of[own]), n[own])
    np.subtract.at(leaf_types, (class_of[own], leaf_of[own]), 1)
    place = np.arange(len(often)) - SINGLE
    class_of[often] = np.where(place < 0, place + SINGLE + 1, 1 + SINGLE + place // SLOTS)
    slot_of[often] = np.where(place < 0, 0, place % SLOTS)
    class_of[own[len(often) :]] = 0
    # Leaves hold the words that have no outcome of their own, each with one count more, and one for unseen words.
    held, slot_counts = leaf_tokens + leaf_types + 1.0, np.zeros((CLASSES, SLOTS))
    slot_counts[class_of[own], slot_of[own]] = n[own] + 1
    class_counts = np.where(np.arange(CLASSES) < REST, slot_counts.sum(1), held.sum(1))
    class_counts[0] = max(class_counts[0], 1)
    by_bits = held.reshape(CLASSES, SLOTS, SLOTS).transpose(0, 2, 1)  # class, first bits, last bits

    def shares(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, np.log(np.maximum(x, 1) / np.maximum(x.sum(-1, keepdims=True), 1)), -1e4).astype(np.float32)

    rows = table_rows(types, total)
    by_digit = class_counts.reshape(SLOTS, SLOTS)
    starts = shares(by_digit.sum(1)[None]), shares(by_digit), shares(slot_counts), shares(by_bits.sum(2)), shares(by_bits.reshape(-1, SLOTS))
    start = Weights(np.zeros((rows, SLOTS), np.float32), starts)
    vocabulary = Vocabulary(known, np.append(n, 0), np.append(class_of, REST), np.append(slot_of, 0), np.append(leaf_of, 0))
    return LanguageModel(vocabulary, start, np.log10(held), total, types)


def score_batch(model: LanguageModel, texts: pa.Array | list[str | None]) -> list[pa.Array]:
    """Columns, a row per text: tokens, known tokens, base and model log10 but for the counts of words that the task does
    not know, and those words with how often they occur."""
    coded, rare = model.vocabulary.coded(texts)
    log_p = np.concatenate([model.weights.log_p(*x) for x in coded.batches()]).astype(np.float64) / math.log(10)
    count = np.log10(model.vocabulary.counts + 1.0)[coded.ids]  # index -1: a rare word's count is added later
    line = np.repeat(np.arange(len(texts)), coded.lengths)
    base = count - math.log10(model.tokens + model.types + 1)
    score = log_p + np.where(coded.classes >= REST, count - model.rest[coded.classes, coded.leaves], 0.0)
    base, score = (np.bincount(line, x, len(texts)) for x in (base, score))
    seen = np.bincount(line, coded.ids >= 0, len(texts)).astype(np.int64)
    return [*map(pa.array, (coded.lengths, seen, base, score)), rare]


def score_texts(df: DataFrame, model: LanguageModel) -> DataFrame:
    """df without text, with n_tokens, n_known, train_tokens, base_score and score."""
    shipped = df.sparkSession.sparkContext.broadcast(model.shipped())
    from pyspark.sql import types as T

    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in df.columns if c != "text" and c not in results]
    fields = T._parse_datatype_string("n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, n: long>>")

    def run(batches):
        for batch in batches:
            for low, high in byte_slices(batch, 500, 1 << 20):
                part = batch.slice(low, high - low)
                made = score_batch(shipped.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], [*keep, *(f"__{f.name}" for f in fields)])

    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(f"__{f.name}", f.dataType) for f in fields)])
    first = materialize(df.select(*keep, "text").mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()))
    word = first.select("__row", F.explode("__rare").alias("r")).select("__row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    count = F.coalesce("n", F.lit(0))
    late = word.join(model.word_counts, "word", "left").groupBy("__row").agg(
        F.sum(F.col("times") * F.log10(count + 1.0)).alias("__more"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("__late")
    )
    more = F.coalesce("__more", F.lit(0.0))
    return first.drop("__rare").join(late, "__row", "left").select(
        *keep,
        F.col("__n_tokens").alias("n_tokens"),
        (F.col("__n_known") + F.coalesce("__late", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("__base") + more).alias("base_score"),
        (F.col("__score") + more).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return score_texts(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
