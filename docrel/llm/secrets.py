"""Secret scans by a trigram inverted index, in DataFrame functions only.

From the parsed regular expression of each rule a Boolean query over trigrams is derived that every matching text must
satisfy. The index holds, for the trigrams that the rules ask for, posting lists of row numbers, a list per trigram and
block of a file's rows, so no list grows with the corpus. A rule's candidates are the rows in the intersection of its
trigrams' lists (united over alternatives), and only those are verified with the regular expression itself. A rule
without mandatory trigrams, like runs of hexadecimal digits, scans every document.

Offsets are code points, end exclusive. Matches of one kind are the leftmost non-overlapping ones; a match that fails
its rule's length test is dropped but still uses up its text. Null texts count as empty; rows are known by their file and
number, so null and repeated ids are rows like any others (a table that is not read straight from Parquet files is
written to the shared folder first); texts of any length are scanned whole. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table


@dataclass(frozen=True)
class Rule:
    """pattern: for Java and Python alike; group: the one whose length counts; least: characters it must have; probe: a
    pattern that every text with a long enough match has, where the pattern itself would be found nearly everywhere."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    probe: str | None = None


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16}"),
)
#: Public shapes of keys that the base rules miss.
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: Alternatives of one literal stretch that are kept apart before it is cut.
MOST_STRINGS = 64
#: Rows of a file that share posting lists; matches whose offsets are summed together.
BLOCK_ROWS, RUN = 1 << 14, 256
SPAN = "struct<start: int, end: int, rank: int, kind: string>"


class Parsed:
    """A regular expression of literals, classes, groups, alternatives and repeats, read from left to right.

    Every part is a pair: the lower-case strings it stands for if they are few, else None and the query (alternatives,
    each a set of trigrams) of what it must hold."""

    def __init__(self, pattern: str):
        self.rest = pattern
        self.found = self.alternatives()

    @staticmethod
    def cut(strings: set[str]) -> list[frozenset[str]]:
        return [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings]

    @staticmethod
    def both(a: list[frozenset], b: list[frozenset]) -> list[frozenset]:
        joined = {x | y for x in a for y in b}
        return [x for x in joined if not any(y < x for y in joined)]

    def query(self, part) -> list[frozenset[str]]:
        few, need = part
        return need if few is None else self.cut(few)

    def take(self, n: int) -> str:
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def alternatives(self):
        parts = [self.sequence()]
        while self.rest[:1] == "|":
            self.take(1)
            parts.append(self.sequence())
        if all(few is not None for few, _ in parts):
            return set().union(*(few for few, _ in parts)), []
        return None, [q for part in parts for q in self.query(part)]

    def sequence(self):
        strings, query, whole = {""}, [frozenset()], True
        while self.rest and self.rest[0] not in "|)":
            few, need = self.repeated(self.atom())
            if few is not None and len(strings) * len(few) <= MOST_STRINGS:
                strings = {a + b for a in strings for b in few}
            else:
                query = self.both(self.both(query, self.cut(strings)), self.query((few, need)))
                strings, whole = {""}, False
        return (strings, query) if whole else (None, self.both(query, self.cut(strings)))

    def character(self) -> str | None:
        """One character, or None for a class such as \\d."""
        c = self.take(1)
        if c != "\\":
            return c
        c = self.take(1)
        return chr(int(self.take(2), 16)) if c == "x" else None if c.isalnum() else c

    def atom(self):
        nothing = None, [frozenset()]
        if self.rest[0] == "(":
            self.take(1)
            if self.rest[0] == "?":
                _, mark, self.rest = self.rest.partition(":")  # (?: and (?i: alike, as strings are in lower case
            found = self.alternatives()
            self.take(1)
            return found
        if self.rest[0] == "[":
            self.take(1)
            out: set[str] | None = set() if self.rest[0] != "^" else None
            first = True
            while first or self.rest[0] != "]":
                c, first = self.character(), False
                if c is None or (self.rest[0] == "-" and self.rest[1] != "]"):
                    out = None
                if out is not None:
                    out.add(c.lower())
            self.take(1)
            return nothing if out is None else (out, [])
        if self.rest[0] in ".^$":
            self.take(1)
            return nothing
        c = self.character()
        return nothing if c is None else ({c.lower()}, [])

    def repeated(self, part):
        """What an atom and the quantifier after it, if any, stand for."""
        mark = self.rest[:1]
        if mark == "{":
            bounds, _, self.rest = self.rest[1:].partition("}")
            low, comma, high = bounds.partition(",")
            low, high = int(low), int(high) if high else None if comma else int(low)
        elif mark and mark in "?*+":
            self.take(1)
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        else:
            return part
        if self.rest[:1] == "?":
            self.take(1)
        few, _ = part
        if few is not None and low == high and len(few) ** low <= MOST_STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in few}
            return out, []
        if few is not None and (low, high) == (0, 1):
            return few | {""}, []
        return None, self.query(part) if low else [frozenset()]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The query as alternatives, each a set of lower-case trigrams that must all occur; None: no mandatory trigram."""
    parsed = Parsed(pattern)
    query = parsed.query(parsed.found)
    return None if any(not q for q in query) else query


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """docs: numbered. (__file, block, trigram, rows): for the given trigrams, the numbers of the rows of each block of
    BLOCK_ROWS rows of a file whose texts, with A-Z lower-cased, hold it."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    block = F.expr(f"__row div {BLOCK_ROWS}").alias("block")
    low = docs.select("__file", "__row", block, F.translate("text", upper, upper.lower()).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("__file", "__row", "block", F.explode(held).alias("trigram")).groupBy("__file", "block", "trigram").agg(F.collect_list("__row").alias("rows"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(__file, __row, kinds): for each document with any, the rules whose query it meets: block by block, the postings of
    an alternative's trigrams are intersected, and those of the alternatives united."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for part in q for t in part})
    lists = postings(docs, trigrams).groupBy("__file", "block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))
    none = F.array().cast("array<long>")

    def meets(query) -> Column:
        out = none
        for part in query:
            rows = None
            for t in sorted(part):
                own = F.coalesce(F.try_element_at("lists", F.lit(t)), none)
                rows = own if rows is None else F.array_intersect(rows, own)
            out = F.array_union(out, rows)
        return out

    met = F.array(*[F.struct(F.lit(k).alias("kind"), meets(q).alias("rows")) for k, q in queries.items()])
    each = lists.select("__file", F.explode(met).alias("m")).select("__file", F.explode("m.rows").alias("__row"), "m.kind")
    return each.groupBy("__file", "__row").agg(F.collect_set("kind").alias("kinds"))


def let(value: Column, body) -> Column:
    """body(value), where the value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans: the lengths of what lies between matches, and of the matches, give every offset. They are summed
    in runs of RUN matches, so that no array is copied more than that often."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start: int, end: int>>")

    def lengths(matches: Column) -> Column:
        """For each match the characters before it (since the one before), its own, and those that are tested."""
        tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else F.transform(matches, F.length)
        between = F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))
        return F.zip_with(between, tested, lambda x, t: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), t.alias("tested")))

    def of_run(run: Column) -> Column:
        """Where the run ends, and its spans, from its own start."""
        start = lambda at, x: (at + x["gap"]).cast("int")
        end = lambda at, x: (at + x["gap"] + x["size"]).cast("int")
        return F.aggregate(
            run,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                end(acc["at"], x).alias("at"),
                F.when(x["tested"] >= rule.least, F.concat(acc["out"], F.array(F.struct(start(acc["at"], x).alias("start"), end(acc["at"], x).alias("end"))))).otherwise(acc["out"]).alias("out"),
            ),
        )

    def runs(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda k: F.slice(parts, k * RUN + 1, RUN))

    def joined(done: Column) -> Column:
        begins = F.aggregate(done, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array((F.element_at(acc, -1) + r["at"]).cast("int"))))
        moved = lambda r, at: F.transform(r["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind")).cast(SPAN))
        return F.flatten(F.zip_with(done, F.slice(begins, F.lit(1), F.size(done)), moved))

    found = let(let(F.regexp_extract_all(text, pattern, F.lit(0)), lengths), lambda parts: let(F.transform(runs(parts), of_run), joined))
    return F.when(F.rlike(text, F.lit(rule.probe or rule.pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): every span of every rule as (start, end, rank, kind), by start, then in the rules' order."""
    docs = numbered(df).select("__file", "__row", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = docs.join(candidates(docs, rules), ["__file", "__row"], "left")
    found = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, rank)
        if trigram_query(rule.pattern) is not None:
            asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
            spans = F.when(asked, spans).otherwise(F.array().cast(f"array<{SPAN}>"))
        found.append(spans.alias(f"found{rank}"))
    each = joined.select("doc_id", *found)
    # Sorting structs goes by start first; of equal starts the rank decides before the end, as one rule has one match there.
    order = F.transform(F.concat(*[F.col(f"found{k}") for k in range(len(rules))]), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))
    return each.select("doc_id", F.array_sort(order).alias("spans"))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_said(F.filter(spans, lambda s: s["rank"] < len(BASE))).cast("binary"), 256).alias("base_sha256"),
        _said(spans).alias("spans"),
    )


def _oracle() -> str:
    """The same spans in DuckDB: split and extract by each pattern, offsets from the lengths of what lies before."""
    fold = lambda p: p.replace("(?i:password|passwd|secret|token|api_?key)", "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
    parts = []
    for rank, r in enumerate(RULES):
        p = fold(r.pattern).replace("'", "''").replace(r"\x20", " ")
        parts.append(f"""select k, '{r.kind}' as kind, {rank} as rank, start, start + length(m) as stop from (
  select k, m, t, cast(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as bigint) as start
  from (select k, i, ms[i] as m, ts[i] as t, ms, b from (
    select k, ms, ts, b, unnest(range(1, len(ms) + 1)) as i from (
      select k, regexp_extract_all(text, '{p}') as ms, regexp_extract_all(text, '{p}', {r.group}) as ts, string_split_regex(text, '{p}') as b from doc))))
  where length(t) >= {r.least}""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) filter (where kind = '{r.kind}') as n_{r.kind}" for r in BASE)
    return f"""with doc as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
span as ({" union all ".join(parts)}),
said as (select k, {counts}, string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) filter (where kind in ({base})) as base,
  string_agg(concat(kind, ':', start, ':', stop), ',' order by start, rank) as spans from span group by k)
select doc_id, {", ".join(f"cast(coalesce(n_{r.kind}, 0) as bigint) as n_{r.kind}" for r in BASE)},
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from doc left join said using (k)"""


ORACLE = _oracle()
