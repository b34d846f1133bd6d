"""N-gram Jaccard join by chosen paths: documents whose sets of five-word shingles have a similarity of 0.8 or more.

1. Each text becomes its set of shingle hashes; texts with equal sets are one node from here on, however many copies.
2. In each of RUNS runs a set picks each of its tokens with probability PICKS / size, by a hash that all sets share,
   and so goes to the buckets of its picked tokens: two similar sets pick a common token with high probability.
   Small buckets compare their sets by 64 minimum hashes, far below the threshold. In a bucket of more than BUCKET
   sets, the least of them is the pivot, and large buckets with the same pivot become one, whatever their runs. Sets that
   agree with the pivot in TIGHT of the hashes leave the bucket, linked to it, and so is every set that agrees in LOOSE
   of them, which stays. Agreement is transitive hash by hash, so whatever agrees in SKETCH_LEAST with a set that left
   agrees in LOOSE with the pivot: no pair is lost. (Where most links would be of sets that stay, all stay and none is
   linked.) The rest, if still large, is split by SPLITS of its minimum hashes for each run of its buckets (for
   SPLIT_RUNS of them, if there are more), other ones at each level; all large buckets of a set are followed, and every
   set has a part to go to. Buckets still large at the last level become candidates whole.
3. Connected candidates form components. Those of more than a block's size are parted by their sets' rarest shingles,
   which loses no pair (see ``rare_components``). The sets of each component are compared exactly, every pair once, in blocks
   of bounded size; a block pair gives each set its number of links and its least linked neighbour, never the pairs.
4. Links connect the classes; a class is named by its smallest doc_id.

With 10 runs of 2 picks a pair at similarity 0.8 shares a bucket with probability over 0.99999 (0.8 a run), and is kept
together by the splits of a large one with 0.96 a level: over 0.99999 too for a pair all of whose common buckets are
large. The sketch test (0.55) loses fewer than one pair in a million, and pairs of one component are compared whether or
not they met. Texts of 1 to 4 words are one shingle of all their words. Null,
empty and white texts have none: each is a class of its own without links. Row per row of the input; rows are told
apart by their file and their number in it, so repeated and null doc_ids are rows like any others (a table that is not
read straight from Parquet files is written to the shared folder first). A null doc_id names no class unless the class
has no other. Texts of any length are whole sets; of very large components every pair of sets is compared, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, files_for, likely_in, mark_likely, materialize, mix, numbered, small_batches, table, text_chunks
from .components import connected

SHINGLE, SIMILARITY = 5, 0.8
#: Runs are repeated until a pair at the threshold is missed with no more than MISS, as one run finds it with RUN_RECALL.
PICKS, RUN_RECALL, MISS = 2.0, 0.8, 1.1e-7
RUNS, LEVELS = math.ceil(math.log(MISS) / math.log(1 - RUN_RECALL)), 3
BUCKET = 256
SKETCH, SKETCH_LEAST = 64, 0.55
#: Agreement with the pivot of a large bucket, in hashes; and hashes by which its rest is split.
TIGHT, SPLITS = 48, 2
LOOSE = TIGHT + math.ceil(SKETCH * SKETCH_LEAST) - SKETCH
#: Runs whose hashes split one bucket: a pair at the threshold is parted in all of them with no more than MISS.
SPLIT_RUNS = math.ceil(math.log(MISS) / math.log(1 - (1 - (1 - SIMILARITY) ** SPLITS) ** (LEVELS - 1)))
#: A block of exact comparison: sets, and shingles.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000
#: Documents of one file of the tables between steps: some 400,000 picks.
DOCS_A_FILE = 20_000
#: Bytes of text whose shingles are found at once; some 50 times as much is held meanwhile.
CHUNK = 1 << 18
#: Rows of one batch of shingles.
SHINGLE_ROWS = 10_000

_ODD = mix(np.arange(1, RUNS * LEVELS + SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """The texts' distinct shingles: values ordered by text and value, and the first index of each text."""
    found = Words(data, offsets)
    at, value = found.grams(SHINGLE)
    doc = found.doc[at]
    short = np.flatnonzero((found.count > 0) & (found.count < SHINGLE))
    if len(short):
        for k in np.unique(found.count[short]):
            of = short[found.count[short] == k]
            starts, values = found.grams(int(k))
            own = np.isin(starts, found.first[of])
            doc, value = np.append(doc, found.doc[starts[own]]), np.append(value, values[own])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(offsets))), doc


def digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def features(docs: DataFrame) -> DataFrame:
    """docs: numbered. A row per document: doc_id, __file, __row, node (digest of its set, null if empty), n, sketch, picks.

    A pick packs run (4 bits) and the token's upper 60 bits."""

    def find(batches):
        for batch in batches:
            own = [batch.column(c) for c in ("doc_id", "__file", "__row")]
            for low, high, data, offsets in text_chunks(batch, "text", CHUNK):
                value, first, doc = shingle_sets(data, offsets)
                n = np.diff(first)
                some = n > 0
                at = first[:-1][some]
                sketch = np.zeros((high - low, SKETCH), np.uint32)
                if len(value):
                    for k in range(SKETCH):
                        sketch[some, k] = np.minimum.reduceat((value * _ODD[RUNS * LEVELS + k]) >> np.uint64(32), at)
                share = np.minimum(PICKS / np.maximum(n, 1), 1.0)
                limit = np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)[doc]
                limit[share[doc] == 1.0] = np.iinfo(np.uint64).max
                docs_at, picked = [], []
                for run in range(RUNS):
                    hit = np.flatnonzero(value * _ODD[run * LEVELS] <= limit)
                    docs_at.append(doc[hit])
                    picked.append((value[hit] >> np.uint64(4)) | np.uint64(run << 60))
                docs_at, picked = np.concatenate(docs_at), np.concatenate(picked)
                order = np.argsort(docs_at, kind="stable")
                cut = np.searchsorted(docs_at[order], np.arange(high - low + 1)).astype(np.int32)
                picks = pa.ListArray.from_arrays(pa.array(cut), pa.array(picked[order].view(np.int64)))
                nodes = [digest(value[first[d] : first[d + 1]]) if n[d] else None for d in range(high - low)]
                sketches = [s.tobytes() for s in sketch]
                yield pa.RecordBatch.from_arrays(
                    [*(x.slice(low, high - low) for x in own), pa.array(nodes, pa.binary()), pa.array(n.astype(np.int32)), pa.array(sketches, pa.binary()), picks],
                    ["doc_id", "__file", "__row", "node", "n", "sketch", "picks"],
                )
        pa.default_memory_pool().release_unused()  # idle workers stay

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__file", "__row", "text")
    return own.mapInArrow(find, "doc_id long, __file long, __row long, node binary, n int, sketch binary, picks array<long>")


def _components_of(near: np.ndarray) -> np.ndarray:
    """Least index reached from each row of a symmetric Boolean matrix."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def with_pivots(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """large: (node, run, pivot), for each set of a bucket. The least set of a bucket is its pivot; buckets with the same
    pivot (most of those of a group of copies) become one, so that a set meets its pivot once. Adds in how many hashes the
    two agree, and the runs of the pivot's buckets, as many as its splits need."""
    runs = large.groupBy("pivot").agg(F.slice(F.array_sort(F.collect_set("run")), 1, SPLIT_RUNS).alias("runs"))
    other = runs.join(sketches.select(F.col("node").alias("pivot"), F.col("sketch").alias("other")), "pivot")
    met = large.select("node", "pivot").distinct()
    joined = met.join(sketches.select("node", "sketch"), "node").join(other, "pivot").select("node", "pivot", "runs", "sketch", "other")

    def compare(batches):
        for batch in batches:
            own, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SKETCH) for c in ("sketch", "other"))
            same = pa.array((own == other).sum(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "other"), same], [*(c for c in batch.schema.names if c != "other"), "same"])

    return joined.mapInArrow(compare, "node binary, pivot binary, runs array<int>, sketch binary, same int")


def near_sets(rows: pa.RecordBatch) -> pa.RecordBatch:
    """rows: whole lists of sets (list, node, n, sketch), by list. Links (a, b) that connect the sets of each list that
    agree in SKETCH_LEAST of the hashes and whose sizes allow the similarity."""
    if not rows.num_rows:
        return pa.RecordBatch.from_arrays([pa.array([], pa.binary())] * 2, ["a", "b"])
    node, n = rows.column("node").to_pylist(), rows.column("n").to_numpy().astype(float)
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH)
    lists = rows.column("list").to_numpy()
    edges = np.r_[0, np.flatnonzero(np.diff(lists)) + 1, len(lists)]
    first, size = edges[:-1], np.diff(edges)
    alike = lambda a, b: ((sketch[a] == sketch[b]).mean(-1) >= SKETCH_LEAST) & (np.minimum(n[a], n[b]) >= SIMILARITY * np.maximum(n[a], n[b]) - 1e-9)
    pair = first[size == 2]
    pair = pair[alike(pair, pair + 1)]
    out = [(node[k], node[k + 1]) for k in pair]
    for low, count in zip(first[size > 2], size[size > 2], strict=True):
        of = slice(low, low + count)
        near = np.stack([alike(of, k) for k in range(low, low + count)])
        out += [(node[low + k], node[low + r]) for k, r in enumerate(_components_of(near)) if k != r]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])


def candidate_links(made: DataFrame, files: int) -> DataFrame:
    """(a, b): links that connect whatever may be similar. files: of the tables between its steps."""
    picks = made.where("node is not null").select("node", F.explode("picks").alias("p")).distinct()
    rows = picks.select("node", F.shiftrightunsigned("p", 60).cast("int").alias("run"), F.xxhash64("p").alias("bucket"))
    sketches = made.where("node is not null").select("node", "n", "sketch").dropDuplicates(["node"])
    small, sure, own = [], [], None
    for level in range(LEVELS):
        pivot = F.when(F.count("*") > BUCKET, F.min("node")).alias("pivot")
        counts = rows.groupBy("bucket").agg(F.count("*").alias("count"), pivot).where("count > 1")
        held = materialize(rows.join(counts, "bucket").coalesce(files))
        small.append(held.where(F.col("count") <= BUCKET).select("bucket", "node"))
        large = held.where(F.col("count") > BUCKET)
        if large.isEmpty():
            break
        if own is None:  # those of the large buckets; later levels have no other sets
            own = materialize(likely_in(made.select("node", "sketch"), large, "node").dropDuplicates(["node"]).coalesce(files))
        large = materialize(with_pivots(large, own).coalesce(files))
        tight, loose = (F.count_if(F.col("same") >= k) for k in (TIGHT, LOOSE))
        stats = large.groupBy("pivot").agg((2 * tight >= loose).alias("leave"), (F.count("*") - F.when(2 * tight >= loose, tight).otherwise(0)).alias("left"))
        large = materialize(large.join(stats, "pivot").coalesce(files))
        sure.append(large.where(F.col("leave") & (F.col("same") >= LOOSE)).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        rest = large.where(~F.col("leave") | (F.col("same") < TIGHT))
        small.append(rest.where(F.col("left") <= BUCKET).select(F.xxhash64("pivot", F.lit(level)).alias("bucket"), "node"))
        rest = rest.where(F.col("left") > BUCKET)
        if level == LEVELS - 1:
            sure.append(rest.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        else:
            rows = rest.select("node", "pivot", "sketch", F.explode("runs").alias("run"))
            slots = F.array(*(F.col("run") * (LEVELS - 1) * SPLITS + level * SPLITS + k for k in range(SPLITS)))
            rows = rows.select("node", "pivot", "sketch", "run", F.explode(slots).alias("slot"))
            # A table, as the next level counts its buckets and joins their sets: each part of a set is made once.
            rows = materialize(rows.select("node", "run", F.xxhash64("pivot", "slot", F.expr("substring(sketch, slot * 4 + 1, 4)")).alias("bucket")).coalesce(files))
    together = small[0]
    for more in small[1:]:
        together = together.unionAll(more)
    lists = together.groupBy("bucket").agg(F.array_sort(F.collect_set("node")).alias("nodes")).select("nodes").distinct()
    listed = lists.select(F.xxhash64("nodes").alias("list"), F.explode("nodes").alias("node")).join(sketches, "node")
    # Sets stream through a task list by list, so what it holds is one batch, however many lists there are.
    spread = listed.select("list", "node", "n", "sketch").repartition("list").sortWithinPartitions("list", "node")

    def compare(batches):
        held = None
        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            starts = np.flatnonzero(np.diff(batch.column("list").to_numpy(), prepend=np.int64(0)) != 0)
            last = int(starts[-1]) if len(starts) else 0
            yield near_sets(batch.slice(0, last))
            held = batch.slice(last)
        if held is not None:
            yield near_sets(held)

    links = spread.mapInArrow(compare, "a binary, b binary")
    for more in sure:
        links = links.unionAll(more)
    return links


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share: a product of 0/1 matrices over values that two or more hold."""
    k = len(sets)
    if k <= 4:
        out = np.zeros((k, k))
        for a in range(k):
            for b in range(a, k):
                out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    shared = np.cumsum(times > 1) - 1
    row, column = row[keep], shared[column[keep]]
    out, width = np.diag([float(len(s)) for s in sets]), 4096
    np.fill_diagonal(out, 0)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        m = np.zeros((k, width), np.float32)
        m[row[part], column[part] - low] = 1
        out += m @ m.T
    return out


def linked(rows: list[dict]) -> list[tuple]:
    """rows of one block pair: node, block, copies, values. Per node: links to other texts, and the least linked node."""
    rows = sorted({r["node"]: r for r in rows}.values(), key=lambda r: r["node"])
    n = np.array([len(r["values"]) for r in rows], float)
    shared = common_counts([r["values"] for r in rows])
    near = shared >= SIMILARITY * (n[:, None] + n[None] - shared) - 1e-9
    np.fill_diagonal(near, False)
    if rows[0]["i"] != rows[0]["j"]:
        block = np.array([r["block"] for r in rows])
        near &= block[:, None] != block[None]
    links = near @ np.array([r["copies"] for r in rows])
    root = _components_of(near)
    return [(r["node"], int(k), rows[x]["node"]) for r, k, x in zip(rows, links, root, strict=True)]


def sets_of(rows: DataFrame, docs: DataFrame, apart: bool = False) -> DataFrame:
    """rows: a table of __file, __row and more columns. The more columns, and values: the document's shingle hashes,
    packed; or, if ``apart``, a row for each of them: shingle. Only texts that are likely wanted are moved to the rows."""
    kept = [c for c in rows.columns if c not in ("__file", "__row")]

    def load(batches):
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch, "text", CHUNK):
                value, first, doc = shingle_sets(data, offsets)
                if apart:
                    for k in range(0, len(value), SHINGLE_ROWS):
                        at = pa.array(low + doc[k : k + SHINGLE_ROWS])
                        part = pa.array(value[k : k + SHINGLE_ROWS].view(np.int64))
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), part], [*kept, "shingle"])
                    continue
                sets = [value[first[k] : first[k + 1]].tobytes() for k in range(high - low)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in kept), pa.array(sets, pa.binary())], [*kept, "values"])
        pa.default_memory_pool().release_unused()

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    texts = likely_in(docs.select("__file", "__row", "text"), rows, "__file", "__row")
    return rows.join(texts, ["__file", "__row"]).select(*kept, "text").mapInArrow(load, kinds + (", shingle long" if apart else ", values binary"))


def in_parts(members: DataFrame) -> DataFrame:
    """members with parts: into how many blocks of bounded size the sets of their component go."""
    stats = members.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return members.join(stats.select("comp", parts.alias("parts")), "comp")


def rare_components(docs: DataFrame, members: DataFrame, files: int) -> DataFrame:
    """members: as of exact_links. Those of components of one block, and those of larger ones by the components of their
    rarest shingles; with parts (see in_parts).

    Two sets at the similarity t share one of their n - ceil(t * n) + 1 first shingles, whatever the order of all
    shingles is. In the order of their frequency in the component these are the rarest, so sets that have only a page's
    template or a licence in common part here, without a comparison, and no pair at the similarity does. Shingles of one
    set link nothing; a set without any other among its first ones has no link and leaves."""
    parted = materialize(in_parts(members).coalesce(files))
    large = parted.where("parts > 1")
    if large.isEmpty():
        return parted

    with small_batches(docs.sparkSession):
        held = materialize(sets_of(large.select("__file", "__row", "comp", "node", "n"), docs, apart=True).coalesce(files))
    times = held.groupBy("comp", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    shared = held.join(times, ["comp", "shingle"])
    by_node = Window.partitionBy("node")
    place = F.row_number().over(by_node.orderBy("times", "shingle")) + F.col("n") - F.count("*").over(by_node)
    first = shared.select("comp", "node", "n", "shingle", place.alias("place")).where(F.col("place") <= F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9) + 1)
    # The sets of a shingle link to their least one: as many links as sets and shingles at most, mostly far fewer.
    first = materialize(first.select("comp", "node", "shingle").coalesce(files))
    least = first.groupBy("comp", "shingle").agg(F.min("node").alias("least"), F.count("*").alias("times")).where("times > 1")
    fine = connected(first.join(least, ["comp", "shingle"]).select(F.col("node").alias("a"), F.col("least").alias("b")))
    fine = fine.select("node", F.col("root").alias("comp"))
    return materialize(parted.where("parts = 1").unionByName(in_parts(large.drop("comp", "parts").join(fine, "node"))).coalesce(files))


def exact_links(docs: DataFrame, members: DataFrame, files: int) -> DataFrame:
    """members: (node, comp, __file, __row, copies, n), with one document that holds the set. Returns (node, links, root, parts): one row per node and block pair."""
    dealt = rare_components(docs, members, files).withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    loaded = sets_of(dealt.select("__file", "__row", "node", "comp", "copies", "parts", "block"), docs)
    other = loaded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")

    def compare(batches):
        held, key, out = [], None, []
        for batch in batches:
            values = batch.column("values")
            for k, r in enumerate(batch.drop_columns("values").to_pylist()):
                r["values"] = np.frombuffer(values[k].as_buffer(), np.uint64)
                now = (r["comp"], r["i"], r["j"])
                if now != key and held:
                    out += [(*x, held[0]["parts"]) for x in linked(held)]
                    held = []
                key = now
                held.append(r)
            yield made(out)
            out = []
        if held:
            yield made([(*x, held[0]["parts"]) for x in linked(held)])

    def made(out):
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["node", "links", "root", "parts"])

    spread = pairs.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return spread.mapInArrow(compare, "node binary, links long, root binary, parts int")


def near_copies(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, class_id, n_links (other documents at or above the similarity, copies included),
    n_copies (documents with the same set, itself included), and class_node (its class, null without words), __file and
    __row (which document it is)."""
    docs = numbered(docs)
    with small_batches(docs.sparkSession):
        made = materialize(features(docs))
    files = files_for(made, DOCS_A_FILE)
    nodes = made.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct("__file", "__row")).alias("at"), F.count("*").alias("copies"), F.first("n").alias("n")
    )
    nodes = materialize(nodes.select("node", "doc_id", "at.__file", "at.__row", "copies", "n").coalesce(files))
    comps = connected(candidate_links(made, files)).select("node", F.col("root").alias("comp"))
    found = exact_links(docs, comps.join(nodes, "node"), files)
    with small_batches(docs.sparkSession):
        found = materialize(found.coalesce(files))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = found.where("parts = 1").select("node", "root")
    pieces = found.where("parts > 1").select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    if not pieces.isEmpty():
        roots = roots.unionAll(connected(pieces))
    root = F.coalesce("root", "node")
    named = nodes.join(links, "node", "left").join(roots, "node", "left").withColumn("root", root)
    named = materialize(named.select("node", "root", "doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")).coalesce(files))
    classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    of_node = materialize(named.join(classes, "root").select("node", F.col("root").alias("class_node"), "class_id", "n_links", "n_copies").coalesce(files))
    empty = F.col("node").isNull()
    return made.select("doc_id", "__file", "__row", "node").join(of_node, "node", "left").select(
        "doc_id",
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        "class_node",
        "__file",
        "__row",
    )


def keep_one(df: DataFrame) -> DataFrame:
    """df with one row of each class: of its least doc_id (null last), the first in the files. Rows without words stay."""
    rows = numbered(df)
    found = near_copies(rows).where("class_node is not null")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__file", "__row")).alias("least")
    first = found.groupBy("class_node").agg(least).select("class_node", "least.__file", "least.__row")
    # Rows that go are few, so those that stay are not moved.
    gone = materialize(found.select("class_node", "__file", "__row").join(first, ["class_node", "__file", "__row"], "left_anti").select("__file", "__row").coalesce(files_for(rows, DOCS_A_FILE)))
    marked = mark_likely(rows, gone, "__file", "__row", name="__row_may_go")
    stay = marked.where("__row_may_go").join(gone, ["__file", "__row"], "left_anti")
    return marked.where("not __row_may_go").select(*df.columns).unionAll(stay.select(*df.columns))


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_copies(docs).select("doc_id", "class_id", "n_links", "n_copies")


#: Components spread the least doc_id along links, a step at a time; DuckDB keeps every (document, name) it has met.
ORACLE = r"""
with recursive doc as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
gram as (select distinct k, array_to_string(w[p:p + 4], ' ') as s from (
    select k, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as p from doc where len(w) > 0)),
size as (select k, count(*) as n from gram group by k),
pair as (select a, b from (select x.k as a, y.k as b, count(*) as c from gram x join gram y using (s) where x.k <> y.k group by all)
  join size m on m.k = a join size o on o.k = b where 5 * c >= 4 * (m.n + o.n - c)),
reach as (select k, doc_id as name from doc union select b as k, name from reach join pair on a = reach.k),
class as (select k, min(name) as class_id from reach group by k),
links as (select a as k, count(*) as n from pair group by a),
same as (select k, count(*) over (partition by h) as n from (select k, md5(string_agg(s, '\n' order by s)) as h from gram group by k))
select doc_id, class_id, cast(coalesce(links.n, 0) as bigint) as n_links, cast(coalesce(same.n, 1) as bigint) as n_copies
from doc left join class using (k) left join links using (k) left join same using (k)
"""
