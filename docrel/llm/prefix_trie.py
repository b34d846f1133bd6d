"""A prefix trie of rebuilt conversations by composable monoid fingerprints.

A conversation is rebuilt from the head of a base conversation and its own turns after its head. Fingerprints of turn
sequences form a monoid: (v, n) * (w, m) = (v * B**m + w, n + m) modulo a prime, so the fingerprint of every prefix of a
rebuilt conversation follows from the stored products of the base's head and of its own prefixes; no rebuilt text
is ever built. Prefixes of equal fingerprint and depth form a node. Each node is then verified: its members must have one
parent, and where their last turns are different stored turns, these are fetched by reference and compared, role and
text. If any node fails, everything is repeated with another seed, so the result is exact.

Turns are sorted over all partitions, products run within a partition and are carried on for conversations that
straddle partitions (two rows a partition at most reach the driver), so one conversation may hold a third of all turns.
Sums over subtrees: every node belongs to its smallest member, so a subtree's sum is the sum, over the members of its
top, of what belongs to them from that depth on. Those run in blocks of ``RUN`` depths; nothing goes level by level.
The hash of a node's ids is fed in order with runs of at most ``RUN`` ids; no list of all ids is held.

Null roles and texts are empty, null turns come first, ties go by role and text, repeated rows are turns of their own.
Rows without a conv_id belong to no conversation and are left out. A base that is not there has no head; remainders of
negative ids are negative, as in SQL. An empty table gives no node. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, table

PRIME = (1 << 127) - 1
#: Turns of a head, at most; depths and ids of one run; code points of a text that tell ties apart when dealt out.
HEAD, RUN, TOLD = 5, 4096, 64
SEEDS = 4
NOTHING = bytes(16)


def base_of(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(b"base %d" % seed).digest()[:15], "big") | 1 << 100


def turn_hash(seed: int) -> Column:
    """32 hexadecimal digits of a turn's role and text."""
    return F.left(F.sha2(F.concat(F.lit(f"{seed} "), F.length("role").cast("string"), F.lit(" "), "role", "text"), 256), F.lit(32))


def with_columns(df: DataFrame, read: list[str], added: str, run) -> DataFrame:
    """df with columns more: ``run()`` gives a function for each partition, called with the lists of its columns
    ``read``, batch by batch in order, for the lists of the new ones."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T._parse_datatype_string(added)
    kinds = to_arrow_schema(fields)
    names = [*df.columns, *fields.names]

    def batches(each):
        step = run()
        for batch in each:
            values = step(*(batch.column(c).to_pylist() for c in read))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, f.type) for v, f in zip(values, kinds))], names)

    return df.mapInArrow(batches, T.StructType([*df.schema.fields, *fields.fields]))


def stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """A table of all turns in order: conv_id, role, text, chars, hash, part, k (number in the conversation within the
    part), v (product of those k turns)."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    long_role = F.length("role") > TOLD
    # Short keys in the order of the whole ones: what they leave equal goes to one part and is sorted there. Copies of
    # one turn are told apart by their place, as any of them may stand first.
    keys = [F.left("role", F.lit(TOLD)), long_role, F.when(long_role, "").otherwise(F.left("text", F.lit(TOLD))), F.when(long_role | (F.length("text") > TOLD), 0).otherwise(F.col("place"))]
    turns = turns.withColumn("place", F.monotonically_increasing_id())
    dealt = turns.repartitionByRange(shuffle_partitions(turns.sparkSession), "conv_id", "turn", *keys).sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = dealt.select("conv_id", "role", "text", F.length("text").cast("long").alias("chars"), turn_hash(seed).alias("hash"))
    base = base_of(seed)

    def run():
        part, at = TaskContext.get().partitionId(), [None, 0, 0]

        def step(conv_id, hashes):
            last, k, v = at
            numbers, products = [], []
            for c, h in zip(conv_id, hashes):
                if c != last:
                    last, k, v = c, 0, 0
                k, v = k + 1, (v * base + int(h, 16)) % PRIME
                numbers.append(k)
                products.append(v.to_bytes(16, "big"))
            at[:] = last, k, v
            return [part] * len(numbers), numbers, products

        return step

    return materialize(with_columns(dealt, ["conv_id", "hash"], "part int, k long, v binary", run))


def placed_turns(stored: DataFrame, seed: int) -> DataFrame:
    """Turns with pos in the whole conversation and v the product of all turns up to there; without texts."""
    tails = stored.groupBy("conv_id", "part").agg(F.max("k").alias("n"), F.max_by("v", "k").alias("v"))
    straddling = tails.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conv_id")
    carried, base, known = {}, base_of(seed), (None, 0, 0)
    for conv, part, n, v in sorted(tuple(r) for r in tails.join(straddling, "conv_id").select("conv_id", "part", "n", "v").collect()):
        known = known if known[0] == conv else (conv, 0, 0)
        carried[part, conv] = known[1:]
        known = (conv, known[1] + n, (known[2] * pow(base, n, PRIME) + int.from_bytes(v, "big")) % PRIME)

    def run():
        def step(conv_id, part, k, v):
            places, products = list(k), list(v)
            for i, key in enumerate(zip(part, conv_id)):
                if key in carried and carried[key][0]:
                    n, before = carried[key]
                    places[i] += n
                    products[i] = ((before * pow(base, k[i], PRIME) + int.from_bytes(v[i], "big")) % PRIME).to_bytes(16, "big")
            return places, products

        return step

    slim = stored.select("conv_id", "part", "k", "chars", "hash", "v")
    return materialize(with_columns(slim, ["conv_id", "part", "k", "v"], "pos long, product binary", run).drop("v").withColumnRenamed("product", "v"))


def prefixes(placed: DataFrame, rebuilds, seed: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, total turns when rebuilt), and a row per conversation and depth from 1: conv_id, depth,
    fp, parent_fp, chars, turn (reference), last (is it the whole conversation).

    rebuilds(conv_id column) gives columns: the base's id, and the turns of a head (HEAD at most)."""
    turn = F.struct("part", "k", "conv_id")
    head = F.when(F.col("pos") <= HEAD, F.struct("pos", "v", "chars", turn.alias("turn")))
    heads = placed.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(head)).alias("head"))
    base, size = rebuilds(F.col("conv_id"))
    heads = materialize(heads.select("*", base.cast("long").alias("base"), size.cast("int").alias("h")))
    bases = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    convs = heads.join(bases, "base", "left").withColumn("base_head", F.expr("slice(coalesce(base_head, array()), 1, h)"))
    convs = materialize(
        convs.select(
            "conv_id",
            "h",
            "base_head",
            F.size("base_head").cast("long").alias("hb"),
            (F.size("base_head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("total"),
            F.expr("coalesce(get(base_head, size(base_head) - 1).v, X'00')").alias("base_v"),
            F.expr("coalesce(get(head, h - 1).v, X'00')").alias("own_v"),
        )
    )
    b = base_of(seed)
    back = pow(b, -1, PRIME)
    rows = placed.join(convs.select("conv_id", "h", "hb", "total", "base_v", "own_v"), "conv_id").where("pos > h")

    def run():
        number = lambda x: int.from_bytes(x, "big")

        def step(*columns):
            found, parents = [], []
            for p, skipped, own, t, left, without in zip(*columns):
                # base head * (own prefix without its head): only products are combined.
                fp = (number(own) + (number(left) - number(without)) * pow(b, p - skipped, PRIME)) % PRIME
                found.append(fp.to_bytes(16, "big"))
                parents.append(((fp - int(t, 16)) * back % PRIME).to_bytes(16, "big"))
            return found, parents

        return step

    columns = ["conv_id", "depth", "fp", "parent_fp", "chars", "turn", "last"]
    own = with_columns(rows, ["pos", "h", "v", "hash", "base_v", "own_v"], "fp binary, parent_fp binary", run).withColumn("depth", F.expr("hb + pos - h"))
    own = own.select("*", turn.alias("turn"), (F.col("depth") == F.col("total")).alias("last")).select(*columns)
    lent = convs.select("conv_id", "total", "base_head", F.posexplode("base_head").alias("i", "t"))
    above = F.expr("case when i = 0 then cast(repeat(char(0), 16) as binary) else base_head[i - 1].v end")
    lent = lent.select("conv_id", F.col("t.pos").alias("depth"), F.col("t.v").alias("fp"), above.alias("parent_fp"), "t.chars", "t.turn", (F.col("t.pos") == F.col("total")).alias("last"))
    return convs.select("conv_id", "total"), materialize(own.unionAll(lent.select(*columns)))


def differing(nodes: DataFrame, rows: DataFrame, stored: DataFrame) -> bool:
    """Is there a node whose members aren't equal: two parents, or last turns that differ in role or text?"""
    if not nodes.where("parent_fp <> other_parent").isEmpty():
        return True
    several = nodes.where("turn <> other_turn").select("fp", "depth")
    turns = rows.join(several, ["fp", "depth"]).select("fp", "depth", "turn.*").distinct()
    said = turns.join(stored.select("part", "k", "conv_id", F.struct("role", "text").alias("said")), ["part", "k", "conv_id"])
    return not said.groupBy("fp", "depth").agg(F.min("said").alias("a"), F.max("said").alias("b")).where("a <> b").isEmpty()


def ends_hashes(ends: DataFrame) -> DataFrame:
    """fp, depth, ends_sha256 of rows (fp, depth, conv_id): runs of ids in order, each node's fed to one hash."""
    run_of = F.shiftright("conv_id", RUN.bit_length() - 1)
    texts = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = ends.groupBy("fp", "depth", run_of.alias("run")).agg(texts.alias("ids"))

    def feed(batches):
        key, digest, done = None, None, []

        def rows():
            fps, depths, hashes = zip(*done) if done else ((), (), ())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(depths, pa.int64()), pa.array(hashes, pa.string())], ["fp", "depth", "ends_sha256"])

        for batch in batches:
            for fp, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("fp", "depth", "ids"))):
                if (fp, depth) != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (fp, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield rows()
        if key:
            done.append((*key, digest.hexdigest()))
            yield rows()

    return runs.repartition("fp", "depth").sortWithinPartitions("fp", "depth", "run").select("fp", "depth", "ids").mapInArrow(feed, "fp binary, depth long, ends_sha256 string")


def subtree_sums(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """fp, depth, saved_tokens, n_leaves of rows (conv_id, depth, fp); owned: saved and leaf by (conv_id, depth)."""
    r = rows.select("conv_id", "depth", "fp", F.expr(f"depth div {RUN}").alias("run")).join(owned, ["conv_id", "depth"], "left")
    r = r.fillna(0, ["saved", "leaf"])
    runs = r.groupBy("conv_id", "run").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"deeper_{c}") for c in ("saved", "leaf")))
    onward = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = r.select("conv_id", "run", "depth", "fp", *(F.sum(c).over(onward).alias(c) for c in ("saved", "leaf"))).join(runs, ["conv_id", "run"])
    return sums.groupBy("fp", "depth").agg(F.sum(F.expr("saved + deeper_saved")).alias("saved_tokens"), F.sum(F.expr("leaf + deeper_leaf")).alias("n_leaves"))


def prefix_trie(conversations: DataFrame, rebuilds) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256. rebuilds: see ``prefixes``."""
    for seed in range(SEEDS):
        stored = stored_turns(conversations, seed)
        convs, rows = prefixes(placed_turns(stored, seed), rebuilds, seed)
        first = F.min(F.struct("conv_id", "chars"))
        nodes = rows.groupBy("fp", "depth").agg(
            first.alias("first"), F.count("*").alias("n_convs"), F.min("parent_fp").alias("parent_fp"), F.max("parent_fp").alias("other_parent"), F.min("turn").alias("turn"), F.max("turn").alias("other_turn")
        )
        nodes = materialize(nodes)
        if not differing(nodes, rows, stored):
            break
    else:
        raise RuntimeError(f"fingerprints of different turns are equal with {SEEDS} seeds")
    zero = F.lit(NOTHING)
    columns = ["fp", "depth", "conv_id", "n_convs", "saved", "parent_fp"]
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(zero.alias("fp"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("saved"), F.lit(None).cast("binary").alias("parent_fp"))
    nodes = nodes.select("fp", "depth", "first.conv_id", "n_convs", F.expr("(n_convs - 1) * first.chars").alias("saved"), "parent_fp")
    nodes = top.unionAll(nodes.select(*columns))
    children = nodes.where("depth > 0").groupBy(F.col("parent_fp").alias("fp"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, ["fp", "depth"], "left").fillna(0, ["n_children"]))
    owned = nodes.select("conv_id", "depth", "saved", F.expr("cast(n_children = 0 as bigint)").alias("leaf"))
    sums = subtree_sums(rows, owned.where("depth > 0"))
    all_sums = owned.agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves")).where("n_leaves > 0")
    sums = sums.unionAll(all_sums.select(zero.alias("fp"), F.lit(0).cast("long").alias("depth"), "saved_tokens", "n_leaves"))
    ends = rows.where("last").select("fp", "depth", "conv_id").unionAll(convs.where("total = 0").select(zero.alias("fp"), F.lit(0).cast("long").alias("depth"), "conv_id"))
    parents = nodes.select(F.col("fp").alias("parent_fp"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, ["fp", "depth"]).join(ends_hashes(ends), ["fp", "depth"], "left").join(parents, ["parent_fp", "depth"], "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )


def by_hundreds(conv_id: Column) -> tuple[Column, Column]:
    """The base is the first conversation of the hundred; the head has crc32(id) modulo 6 turns."""
    return conv_id - conv_id % 100, F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), by_hundreds)


ORACLE = """
with turns as (
  select conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as turn,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n
  from conversations where conv_id is not null
), original as (
  select conv_id, list(turn order by n) as said from turns group by conv_id
), hashed as (
  select conv_id, said, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(length(conv_id::varchar)),
      lambda k: list_transform(range(8), lambda j: (ascii(substr(conv_id::varchar, k + 1, 1)) >> j) & 1)::bigint[]))),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295) % 6 as h
  from original
), rebuilt as (
  select a.conv_id, list_concat(coalesce(b.said, [])[1:a.h], a.said[a.h + 1:]) as said
  from hashed a left join original b on b.conv_id = a.conv_id - a.conv_id % 100
), prefixes as (
  select conv_id, d as depth, said[1:d] as seq, d = len(said) as whole
  from (select *, unnest(range(len(said) + 1)) as d from rebuilt)
), nodes as (
  select depth, seq, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (whole), '')) as ends_sha256
  from prefixes group by depth, seq
), family as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.depth = n.depth + 1 and c.seq[1:n.depth] = n.seq) as n_children
  from nodes n left join nodes p on p.depth = n.depth - 1 and n.seq[1:p.depth] = p.seq
)
select f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children,
  count(*) filter (s.n_children = 0) as n_leaves,
  sum(case when s.depth = 0 then 0 else (s.n_convs - 1) * length(s.seq[s.depth].t) end)::bigint as saved_tokens,
  f.ends_sha256
from family f join family s on s.depth >= f.depth and s.seq[1:f.depth] = f.seq
group by all
"""
