"""Substring dedup: passages that recur across documents, located by sharded Aho-Corasick automata.

0. Of rows with one text only the first (least doc_id, then place in the files) takes part from here on: its copies with
   a larger doc_id lose every word.
1. Every window of 13 words is represented by the smallest hash of its runs of 5 words (its anchor): equal windows
   have equal anchors, wherever they stand. Anchors seen in one text only rule out all their windows, so one
   aggregation of anchors, a fifth as many as words, finds where recurring passages can be at all.
2. Texts are cut into stretches of windows with one recurring anchor, of at most 21 words, which are dealt out by anchor.
   A task takes a bounded number of stretches of whole anchors at a time, confirms the windows that may occur in two
   documents, compiles a shard's automaton over their words, and streams all the stretches through it.
3. Windows of anchors of more than HOT_DOCS texts, or HOT_STRETCHES stretches, are dealt out by window instead: they are confirmed by an aggregation,
   their occurrences, gathered over the texts of a batch, are joined with the confirmed ones (a join that Spark deals anew
   where it is skewed, so a passage of a third of all documents lies in many tasks), and each task compiles the automaton
   of the windows that it meets and streams their occurrences through it.
4. What the automata report, compared word by word, gives each window's first document and every place where it occurs.
   All documents stream by once more to lose the words covered by windows that start in a document with a smaller doc_id.

Windows are judged on the input. Null and empty texts have no words. A null doc_id is neither smaller nor larger than
another, so such rows lose nothing and take nothing away. Rows with one doc_id but different texts are judged each by
itself. Texts with fewer than 13 words lose nothing. Very long texts are cut like others; a stretch that a text repeats
is sent once. Step 1 takes texts for equal whose 64-bit hashes agree. Other columns pass through; one named like the
result is replaced.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, materialize, mix, numbered, spans_hash, table, text_chunks, with_result, words

WINDOW, GRAM = 13, 5
#: Texts from which on an anchor is dealt out by window: what one task may gather of an anchor, some 3 MB of stretches.
HOT_DOCS = 20_000
#: The same of an anchor's stretches, so that few very long texts count too.
HOT_STRETCHES = 100_000
#: Word numbers that have a character of their own; automata over more words take them as sequences of numbers.
CHARACTERS = 0x110000 - 0x800
#: Stretches that one automaton serves, unless one anchor has more.
AUTOMATON_ROWS = 4_000
PLACED = "route long, h binary, doc_id long, places array<int>, stretch binary"
GATHERED = "route long, hs array<binary>, docs array<long>, places array<int>, stretch binary"


def stretches(found: Words, window: int, gram: int):
    """Runs of windows with one anchor, cut so that none has more windows than a window has grams.

    first word, number of windows, anchor (all arrays)."""
    n, grams = len(found.start), window - gram + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    at, value = found.grams(gram)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    least[at] = value
    width = 1
    while width < grams:
        step = min(width, grams - width)
        least[: n - step] = np.minimum(least[: n - step], least[step:])
        width += step
    start = np.arange(n - window + 1)
    start = start[found.doc[start] == found.doc[start + window - 1]]
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (found.doc[start[1:]] != found.doc[start[:-1]])
    begin = np.flatnonzero(new)
    run = np.arange(len(start)) - np.repeat(begin, np.diff(np.append(begin, len(start))))
    begin = np.flatnonzero(run % grams == 0)
    return start[begin], np.diff(np.append(begin, len(start))), anchor[begin]


def anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """texts: (t, text). (anchor, t, n), once per text; n: the text's stretches of the anchor."""

    def find(batches):
        for batch in batches:
            ids = batch.column("t").to_numpy()
            for low, high, data, offsets in text_chunks(batch, "text"):
                found = Words(data, offsets)
                first, _, anchor = stretches(found, window, gram)
                doc = found.doc[first]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                n = np.diff(np.append(np.flatnonzero(new), len(doc)))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), pa.array(ids[low:high][doc[new]]), pa.array(n)], ["anchor", "t", "n"])

    return texts.mapInArrow(find, "anchor long, t long, n long")


def chosen(batch: pa.RecordBatch, column: str, window: int, gram: int):
    """The stretches of a batch's texts whose anchor is in the text's list. Per run of rows: its first row; text, anchor,
    first word and number of windows of each stretch (arrays); the words; the bytes."""
    for low, high, data, offsets in text_chunks(batch, "text"):
        found = Words(data, offsets)
        first, count, anchor = stretches(found, window, gram)
        doc = found.doc[first]
        row_of = mix(np.arange(high - low, dtype=np.uint64) + np.uint64(1))
        lists = batch.column(column).slice(low, high - low)
        sizes = np.fromiter((len(x) for x in lists.to_pylist()), np.int64, high - low)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        keep = np.isin(anchor ^ row_of[doc], values ^ np.repeat(row_of, sizes))
        yield low, doc[keep], anchor[keep], first[keep], count[keep], found, data.tobytes()


def group_starts(raw: bytes, start: np.ndarray, stop: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Where groups begin in an order in which ``same`` says what has the hash of the one before: only equal words are
    grouped."""
    new = ~same
    for k in np.flatnonzero(same).tolist():
        new[k] = raw[start[k] : stop[k]].split() != raw[start[k - 1] : stop[k - 1]].split()
    return new


def placed(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """marked: (h, doc_id, text, anchors). The texts' stretches with those anchors, each once per text with its places."""

    def find(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for low, row, anchor, at, count, found, raw in chosen(batch, "anchors", window, gram):
                end = at + count + window - 1
                digest = spans_hash(found.hash, at, end)
                order = np.lexsort((at, digest, row))
                at, end, anchor, row, digest = at[order], end[order], anchor[order], row[order], digest[order]
                start, stop = found.start[at], found.end[end - 1]
                same = np.zeros(len(at), bool)
                same[1:] = (row[1:] == row[:-1]) & (digest[1:] == digest[:-1])
                new = group_starts(raw, start, stop, same)
                cut = np.append(np.flatnonzero(new), len(at))
                places = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((at - found.first[row]).astype(np.int32)))
                some = pa.array([raw[s:e] for s, e in zip(start[new].tolist(), stop[new].tolist(), strict=True)], pa.binary())
                texts = batch.column("h").take(pa.array(low + row[new]))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), texts, pa.array(ids[low + row[new]]), places, some], ["route", "h", "doc_id", "places", "stretch"])

    return marked.where(F.size("anchors") > 0).select("h", "doc_id", "text", "anchors").mapInArrow(find, PLACED)


def gathered_windows(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """marked: (h, doc_id, text, hot). The windows of those anchors, dealt out by a hash of their words, with the texts and
    places of each gathered over the texts that a task sees together."""

    def find(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for low, row, _, at, count, found, raw in chosen(batch, "hot", window, gram):
                row = np.repeat(row, count)
                at = np.repeat(at, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                digest = spans_hash(found.hash, at, at + window)
                order = np.lexsort((at, digest))
                at, row, digest = at[order], row[order], digest[order]
                start, stop = found.start[at], found.end[at + window - 1]
                same = np.zeros(len(at), bool)
                same[1:] = digest[1:] == digest[:-1]
                new = group_starts(raw, start, stop, same)
                cut = pa.array(np.append(np.flatnonzero(new), len(at)).astype(np.int32))
                lists = (batch.column("h").take(pa.array(low + row)), pa.array(ids[low + row]), pa.array((at - found.first[row]).astype(np.int32)))
                some = pa.array([raw[s:e] for s, e in zip(start[new].tolist(), stop[new].tolist(), strict=True)], pa.binary())
                lists = [pa.ListArray.from_arrays(cut, x) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array(digest[new].view(np.int64)), *lists, some], ["route", "hs", "docs", "places", "stretch"])

    return marked.where(F.size("hot") > 0).select("h", "doc_id", "text", "hot").mapInArrow(find, GATHERED)


def word_codes(stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number from 1 for each word, equal where the words are, with a 0 after each stretch; where each stretch begins."""
    raw = stretches.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    found = Words(data, offsets - offsets[0])
    code, distinct = pd.factorize(found.hash)
    first = np.empty(len(distinct), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    size, like = found.end - found.start, first[code]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    if (size != size[like]).any() or (data[np.repeat(found.start, size) + inner] != data[np.repeat(found.start[like], size) + inner]).any():
        all_bytes = data.tobytes()  # words with one hash
        code = pd.factorize(np.array([all_bytes[s:e] for s, e in zip(found.start.tolist(), found.end.tolist(), strict=True)], object))[0]
    out = np.zeros(len(code) + len(raw), np.int64)
    out[np.arange(len(code)) + found.doc] = code + 1
    return out, found.first[:-1] + np.arange(len(raw))


def as_string(codes: np.ndarray) -> str:
    """A character for each number below CHARACTERS, past the surrogates."""
    return (codes + 0x800 * (codes >= 0xD800)).astype("<u4").tobytes().decode("utf-32-le")


def occurrences(codes: np.ndarray, patterns: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Compiles the automaton of the windows that begin at ``patterns`` and streams all codes through it: for every
    occurrence, where it begins and which pattern it is (of equal patterns the first)."""
    import ahocorasick

    if codes.max(initial=0) < CHARACTERS:
        text, automaton = as_string(codes), ahocorasick.Automaton(ahocorasick.STORE_INTS)
    else:
        text, automaton = tuple(codes.tolist()), ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, p in enumerate(patterns.tolist()):
        key = text[p : p + window]
        if key not in automaton:
            automaton.add_word(key, k)
    automaton.make_automaton()
    hits = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
    return hits[:, 0] - window + 1, hits[:, 1]


def by_text(texts: list[bytes], text: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """(h, starts): the starts of each text; text: its number in texts."""
    code, distinct = pd.factorize(np.array([texts[k] for k in text.tolist()], object)) if len(text) else (text, [])
    order = np.lexsort((starts, code))
    cut = np.searchsorted(code[order], np.arange(len(distinct) + 1)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(starts[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(list(distinct), pa.binary()), lists], ["h", "starts"])


def inner_index(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def starts_of(part: pa.RecordBatch, begin: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """(h, starts) for occurrences at ``place`` of the codes, in stretches that begin at ``begin``."""
    row = np.searchsorted(begin, place, "right") - 1
    lists = part.column("places")
    sizes = np.diff(lists.offsets.to_numpy())
    firsts = np.cumsum(sizes) - sizes
    flat, times = lists.flatten().to_numpy(zero_copy_only=False), sizes[row]
    starts = flat[np.repeat(firsts[row], times) + inner_index(times)] + np.repeat(place - begin[row], times)
    return by_text(part.column("h").to_pylist(), np.repeat(row, times), starts)


def located(part: pa.RecordBatch, window: int) -> pa.RecordBatch | None:
    """part: stretches of whole anchors. Confirms what may recur, and reports where the automaton finds windows that a
    smaller doc_id has too."""
    codes, begin = word_codes(part.column("stretch"))
    if len(codes) < window:
        return None
    doc_ids = part.column("doc_id").to_numpy()
    stop = np.append(begin[1:], len(codes)) - 1
    count = np.maximum(stop - begin - window + 1, 0)
    at = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc = np.repeat(doc_ids, count)
    like, distinct = pd.factorize(spans_hash(mix(codes.astype(np.uint64)), at, at + window))
    least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, like, doc)
    np.maximum.at(most, like, doc)
    recurs = (least < most)[like]
    if not recurs.any():
        return None
    at, like = at[recurs], like[recurs]
    _, first = np.unique(like, return_index=True)
    one = np.empty(len(distinct), np.int64)
    one[like[first]] = at[first]
    # Windows with one hash but other words are patterns of their own.
    other = np.zeros(len(at), bool)
    for k in range(window):
        other |= codes[at + k] != codes[one[like] + k]
    place, pattern = occurrences(codes, np.concatenate([at[first], at[other]]), window)
    doc = doc_ids[np.searchsorted(begin, place, "right") - 1]
    first_doc = np.full(int(pattern.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first_doc, pattern, doc)
    return starts_of(part, begin, place[first_doc[pattern] < doc])


def run_automata(stretches: DataFrame, window: int) -> DataFrame:
    """stretches as ``placed`` gives them, dealt out by anchor. (h, starts)."""

    def run(batches):
        held, rows = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if not rows or (batch is not None and rows < AUTOMATON_ROWS):
                continue
            everything = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            route = everything.column("route").to_numpy()
            # Whole anchors only: the last one may go on in the next batch.
            edges = np.flatnonzero(np.append(route[1:] != route[:-1], batch is None)) + 1
            low = 0
            while len(edges) and low < edges[-1]:
                high = int(edges[min(np.searchsorted(edges, low + AUTOMATON_ROWS), len(edges) - 1)])
                if (out := located(compact(everything.slice(low, high - low)), window)) is not None:
                    yield out
                low = high
            held = [compact(everything.slice(low))]
            rows = held[0].num_rows

    dealt = stretches.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(run, "h binary, starts array<int>")


def compact(part: pa.RecordBatch) -> pa.RecordBatch:
    """The same rows without the buffers of others."""
    return part.take(pa.array(np.arange(part.num_rows)))


def run_hot_automata(windows: DataFrame, confirmed: DataFrame, window: int) -> DataFrame:
    """windows as ``gathered_windows`` gives them; confirmed: (route, pattern, first). (h, starts)."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, AUTOMATON_ROWS):
                part = compact(batch.slice(low, AUTOMATON_ROWS))
                n = part.num_rows
                codes, begin = word_codes(pa.concat_arrays([part.column("pattern"), part.column("stretch")]))
                place, pattern = occurrences(codes, begin[:n], window)
                own = place >= begin[n]
                row, first = np.searchsorted(begin[n:], place[own], "right") - 1, part.column("first").to_numpy()[pattern[own]]
                sizes = np.diff(part.column("docs").offsets.to_numpy())
                begins, times = (np.cumsum(sizes) - sizes)[row], sizes[row]
                at = np.repeat(begins, times) + inner_index(times)
                at = at[np.repeat(first, times) < part.column("docs").flatten().to_numpy()[at]]
                yield by_text(part.column("hs").flatten().to_pylist(), at, part.column("places").flatten().to_numpy()[at])

    return windows.join(confirmed, "route").mapInArrow(run, "h binary, starts array<int>")


def text_table(df: DataFrame, window: int, gram: int) -> DataFrame:
    """df: numbered, with doc_id, text, h and t. (t, firsts, anchors, hot): per text its first row, and its anchors that
    recur, those of very many texts apart. A table."""
    docs = df.where("doc_id is not null and text is not null")
    first = F.min(F.struct("doc_id", "__file", "__row")).alias("first")
    firsts = docs.groupBy("t", "h").agg(first).groupBy("t").agg(F.collect_list(F.struct("h", "first.doc_id", "first.__file", "first.__row")).alias("firsts"))
    found = materialize(anchors(docs.select("t", "text"), window, gram))
    many = found.groupBy("anchor").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("texts"), F.sum("n").alias("n")).where("low < high")
    # Written first, so that the join with anchors of many texts is dealt anew where it is skewed.
    recurring = materialize(many.select("anchor", ((F.col("texts") > HOT_DOCS) | (F.col("n") > HOT_STRETCHES)).alias("is_hot")))
    lists = [F.collect_set(F.when(which, F.col("anchor"))).alias(name) for name, which in (("anchors", ~F.col("is_hot")), ("hot", F.col("is_hot")))]
    listed = found.join(recurring, "anchor").groupBy("t").agg(*lists)
    return materialize(firsts.join(listed, "t", "left"))


def repeats(marked: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """marked: (h, doc_id, text, anchors, hot), a row per text. (h, starts): for each text with any, the places (word
    numbers from 0) of windows that also start in a document with a smaller doc_id. A table; a text may have more rows."""
    starts = run_automata(placed(marked, window, gram), window)
    many = marked.where(F.size("hot") > 0)
    if not many.isEmpty():
        windows = gathered_windows(many, window, gram)
        # One space between words, whatever white space stood there; what follows compares words.
        confirmed = windows.groupBy("route", F.regexp_replace(F.decode("stretch", "ISO-8859-1"), "[ \\t-\\r]+", " ").alias("words")).agg(
            F.first("stretch").alias("pattern"), F.min(F.array_min("docs")).alias("first"), F.max(F.array_max("docs")).alias("last")
        )
        confirmed = materialize(confirmed.where("first < last").select("route", "pattern", "first"))
        starts = starts.unionAll(run_hot_automata(windows, confirmed, window))
    return materialize(starts)


def remove_repeats(df: DataFrame, name: str = "dedup", window: int = WINDOW, gram: int = GRAM, keep: list[str] | None = None) -> DataFrame:
    """df with a struct: n_words, n_removed, kept (the words that stay, joined by one space)."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != name]
    if df.schema["doc_id"].dataType.simpleString() != "bigint":
        df = df.withColumn("doc_id", F.col("doc_id").cast("long"))
    if name in ("doc_id", "text"):
        raise ValueError(name)
    rows = numbered(df).withColumn("__h", F.unhex(F.md5("text")))
    rows = rows.withColumn("__t", F.xxhash64("__h", F.when(F.col("text").isNull(), F.struct("__file", "__row"))))
    own = rows.select("doc_id", "text", "__file", "__row", F.col("__h").alias("h"), F.col("__t").alias("t"))
    about = text_table(own, window, gram)
    joined = rows.join(about.withColumnRenamed("t", "__t"), "__t", "left")
    is_first = F.exists("firsts", lambda f: (f["h"] == F.col("__h")) & (f["__file"] == F.col("__file")) & (f["__row"] == F.col("__row")))
    none = F.array().cast("array<long>")
    marked = joined.where(is_first).select(F.col("__h").alias("h"), "doc_id", "text", F.coalesce("anchors", none).alias("anchors"), F.coalesce("hot", none).alias("hot"))
    # A table, as up to three jobs read it: the texts are dealt out once for it and once for the result.
    marked = materialize(marked.where((F.size("anchors") > 0) | (F.size("hot") > 0)))
    starts = repeats(marked, window, gram)
    starts = starts.groupBy(F.xxhash64("h").alias("__t")).agg(F.collect_list(F.struct("h", "starts")).alias("__windows"))
    # One join with the texts, which Spark deals anew where one text has very many copies.
    known = materialize(about.select(F.col("t").alias("__t"), F.expr("transform(firsts, f -> struct(f.h, f.doc_id))").alias("firsts")).join(starts, "__t", "left"))
    least = F.element_at(F.filter("firsts", lambda f: f["h"] == F.col("__h")), 1)["doc_id"]
    copied = F.coalesce((F.size("firsts") > 0) & (least < F.col("doc_id")), F.lit(False)).alias("__copied")
    final = rows.join(known, "__t", "left").withColumn("__copied", copied).select(*dict.fromkeys([*keep, "doc_id", "text"]), "__h", "__copied", "__windows")

    def compute(batch):
        out = []
        columns = (batch.column(c).to_pylist() for c in ("text", "doc_id", "__h", "__copied", "__windows"))
        for text, doc_id, h, copied, windows in zip(*columns, strict=True):
            w = words(text)
            kept = w
            if copied:
                kept = w if len(w) < window else []
            elif windows and doc_id is not None:
                covered = np.zeros(len(w) + 1, np.int64)
                for part in windows:
                    if part["h"] == h:
                        starts = np.array(part["starts"])
                        np.add.at(covered, starts, 1)
                        np.add.at(covered, starts + window, -1)
                kept = [x for x, c in zip(w, np.cumsum(covered)[:-1].tolist(), strict=True) if not c]
            out.append({"n_words": len(w), "n_removed": len(w) - len(kept), "kept": b" ".join(kept).decode("utf-8")})
        return out

    return with_result(final, name, "struct<n_words: long, n_removed: long, kept: string>", compute, keep)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, keep=["doc_id"]).select(
        "doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = r"""
with doc as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select k, doc_id, p, array_to_string(w[p:p + 12], ' ') as s from (select k, doc_id, w, unnest(range(1, len(w) - 11)) as p from doc)),
first as (select s, min(doc_id) as d from win group by s),
gone as (select distinct k, q from (select k, unnest(range(p, p + 13)) as q from win join first using (s) where d < doc_id)),
word as (select k, q, w[q] as x from (select k, w, unnest(range(1, len(w) + 1)) as q from doc)),
kept as (select k, count(*) as n, string_agg(x, ' ' order by q) as s from word anti join gone using (k, q) group by k)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from doc left join kept using (k)
"""
