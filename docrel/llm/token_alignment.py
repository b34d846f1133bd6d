"""Cross-tokenizer alignment: which tokens of tokenizer A and of tokenizer B cover the same bytes of a text.

Tokens become rows, and bytes columns, of incidence matrices in hand-built CSR. Gustavson's row products A * B' give the
overlap links, each with the number of bytes that both tokens cover. Bytes where tokens of both end cut a text into
groups; products of token-group incidences give the shared-group links. Links that end together are the overlap links
whose ranges end at one byte. ``align_tokens`` returns links of any of the three kinds, row by row.

``link_digest`` counts the pairs of ids over the whole corpus. Tasks align their texts in blocks of ``BLOCK_BYTES`` (a
longer text is a block of its own) and write each block once, its links as numbers of the block's distinct pairs.
Only those pairs are shuffled: they are summed for the corpus, ranked within their B id (at most A's vocabulary of
rows) and brought back to their blocks, so a pair that a third of all links have is one row per block, not per link.

A text that is null or empty, or whose tokens' bytes are not a space and the text, has no tokens. Null and repeated ids
are rows like any others; an empty table gives no rows; a table's further columns are ignored by the digest and kept by
``align_tokens``, whose own columns replace those of the same name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, materialize, table

#: Bytes of text of one product, and of a block; rows of tokens of a product of groups.
CHUNK_BYTES, BLOCK_BYTES, GROUP_ROWS = 1 << 20, 1 << 24, 1 << 14
#: How byte-level tokenizers cut texts before merging: fixed, as their files only name it.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Csr:
    """A 0/1 matrix by rows: row i has ones in columns indices[indptr[i]:indptr[i + 1]]."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray, columns: int):
        self.indptr, self.indices, self.columns = indptr, indices, columns

    @classmethod
    def ranges(cls, start: np.ndarray, end: np.ndarray, columns: int) -> Csr:
        """Row i has the columns from start[i] to end[i] - 1."""
        indptr = np.concatenate([[0], np.cumsum(end - start)])
        return cls(indptr, np.arange(indptr[-1]) + np.repeat(start - indptr[:-1], end - start), columns)

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(self.rows), np.diff(self.indptr))
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.columns))])
        return Csr(indptr, row[np.argsort(self.indices, kind="stable")], self.rows)

    def times(self, other: Csr, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows low to high of the product: row, column and value of its nonzeros, in their order. Row i is the sum of
        the rows k of ``other`` over the columns k of row i."""
        high = self.rows if high is None else high
        k = self.indices[self.indptr[low] : self.indptr[high]]
        row = np.repeat(np.arange(low, high), np.diff(self.indptr[low : high + 1]))
        size = other.indptr[k + 1] - other.indptr[k]
        if len(size) and size.min() == size.max() == 1:
            key = row * other.columns + other.indices[other.indptr[k]]
        else:
            first = np.cumsum(size) - size
            brought = np.arange(size.sum()) + np.repeat(other.indptr[k] - first, size)
            key = np.repeat(row, size) * other.columns + other.indices[brought]
        if (key[1:] < key[:-1]).any():
            key.sort()
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        return key[new] // max(1, other.columns), key[new] % max(1, other.columns), np.diff(np.append(new, len(key)))


class ByteTokens:
    """A byte-level BPE file of the tokenizers library: ids, and bytes of each id.

    Where its ids are the ranks of its merges, as checked entry by entry, tiktoken gives the same ids faster."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in set(kept)]
        byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, k in vocab.items():
            self.bytes[k] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.fast = self._ranks(spec)

    def _ranks(self, spec: dict):
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec["normalizer"]
        if not plain or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"):
            return None
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        results = [model["vocab"].get(a + b) for a, b in merges]
        if results != list(range(256, 256 + len(merges))):
            return None
        ranks = {self.bytes[k]: k for k in range(256 + len(merges))}
        texts = [(b.decode(), k) for b, k in ranks.items() if _is_text(b)]
        own = self.tokenizer.encode_batch_fast([t for t, _ in texts], add_special_tokens=False)
        if len(ranks) != 256 + len(merges) or any(e.ids != [k] for e, (_, k) in zip(own, texts)):
            return None
        return tiktoken.Encoding("ranks", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # its search gives up, or panics, on extreme runs
            if not (isinstance(e, ValueError) or type(e).__name__ == "PanicException"):
                raise
            return self.tokenizer.encode(text, add_special_tokens=False).ids


def _is_text(data: bytes) -> bool:
    try:
        return bool(data.decode())
    except UnicodeDecodeError:
        return False


class PieceTokens:
    """A sentencepiece model: ids, and bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Tables(NamedTuple):
    """Two tokenizers with byte lengths by id, and ids as they stand in a text of groups (before a comma, or last)."""

    a: ByteTokens
    b: PieceTokens
    a_size: np.ndarray
    b_size: np.ndarray
    written: list[str]


@lru_cache(maxsize=2)
def tables(path_a: str, path_b: str) -> Tables:
    a, b = ByteTokens(path_a), PieceTokens(path_b)
    n = max(len(a.bytes), len(b.bytes))
    written = [f"{k}{mark}" for mark in ",|;" for k in range(n)]
    return Tables(a, b, *(np.array([len(x) for x in t.bytes], np.int64) for t in (a, b)), written)


class Aligned:
    """The tokens of some texts over one run of bytes, with their products. doc_end: byte where each text ends; texts
    without tokens cover no byte."""

    def __init__(self, texts: list[str | None], t: Tables):
        self.tables = t
        at = [k for k, x in enumerate(texts) if x]
        ids_a, ids_b = t.a.encode([" " + texts[k] for k in at]), t.b.encode([texts[k] for k in at])
        size, good_a, good_b = np.zeros(len(texts), np.int64), [], []
        self.n_a, self.n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for k, a, b in zip(at, ids_a, ids_b):
            whole = b" " + texts[k].encode()
            if b"".join(map(t.a.bytes.__getitem__, a)) == whole == b"".join(map(t.b.bytes.__getitem__, b)):
                size[k], self.n_a[k], self.n_b[k] = len(whole), len(a), len(b)
                good_a += a
                good_b += b
        self.a, self.b = np.array(good_a, np.int64), np.array(good_b, np.int64)
        self.a_end, self.b_end, self.doc_end = np.cumsum(t.a_size[self.a]), np.cumsum(t.b_size[self.b]), np.cumsum(size)
        self.bytes = int(size.sum())

    def overlap(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token of A, token of B and the bytes that both cover, for each overlapping pair."""
        a = Csr.ranges(self.a_end - self.tables.a_size[self.a], self.a_end, self.bytes)
        b = Csr.ranges(self.b_end - self.tables.b_size[self.b], self.b_end, self.bytes)
        return a.times(b.transposed())

    def ending(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Overlapping pairs that end together."""
        i, j, n = self.overlap()
        here = self.a_end[i] == self.b_end[j]
        return i[here], j[here], n[here]

    def groups(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group of each token of A and of B, the groups ending at ``ends``."""
        return np.searchsorted(ends, self.a_end), np.searchsorted(ends, self.b_end)

    def grouped(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs that share a group, ``GROUP_ROWS`` tokens of A at a time, so that a long group isn't held whole."""
        ends = self.a_end[self.ending()[0]]
        a, b = (Csr.ranges(g, g + 1, len(ends)) for g in self.groups(ends))
        by_group = b.transposed()
        for low in range(0, a.rows, GROUP_ROWS):
            yield a.times(by_group, low, min(a.rows, low + GROUP_ROWS))

    def written(self, ends: np.ndarray) -> list[str]:
        """For each text its groups as ``a1,a2|b1;a3|b2``."""
        group_a, group_b = self.groups(ends)
        n = len(self.tables.written) // 3
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)], np.append(group_b[1:] != group_b[:-1], True)[: len(group_b)]
        before_a, before_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(ends)))]) for g in (group_a, group_b))
        entry = np.zeros(len(group_a) + len(group_b), np.int64)
        entry[np.arange(len(group_a)) + before_b[group_a]] = self.a + n * last_a
        entry[np.arange(len(group_b)) + before_a[group_b + 1]] = self.b + 2 * n * last_b
        cuts, words = np.cumsum(self.n_a + self.n_b).tolist(), list(map(self.tables.written.__getitem__, entry.tolist()))
        return ["".join(words[low:high])[:-1] for low, high in zip([0, *cuts], cuts)]


LINK = "a_pos long, b_pos long, a_id int, b_id int, a_start long, a_end long, b_start long, b_end long, shared long"


def align_tokens(df: DataFrame, path_a: str, path_b: str, links: str = "overlap", column: str = "text") -> DataFrame:
    """One row per link of each text: df's columns with positions, ids and byte ranges (of space and text) of both
    tokens; shared: bytes that both cover (overlap, end), or 1 (group)."""
    from pyspark.sql import types as T

    if links not in ("overlap", "group", "end"):
        raise ValueError(f"no such links: {links}")
    kind = T._parse_datatype_string(LINK)
    kept = [c for c in df.columns if c not in kind.names]
    if column not in kept:
        raise ValueError(f"the texts cannot be named like a column of links: {column}")

    def run(batches):
        t = tables(path_a, path_b)
        for batch in batches:
            for k, text in enumerate(batch.column(column).to_pylist()):
                x = Aligned([text], t)
                for i, j, n in x.grouped() if links == "group" else [x.ending() if links == "end" else x.overlap()]:
                    for low in range(0, len(i), 1 << 16):
                        a, b, shared = i[low : low + (1 << 16)], j[low : low + (1 << 16)], n[low : low + (1 << 16)]
                        spans = [x.a_end[a] - t.a_size[x.a[a]], x.a_end[a], x.b_end[b] - t.b_size[x.b[b]], x.b_end[b]]
                        values = [a, b, x.a[a].astype(np.int32), x.b[b].astype(np.int32), *spans, shared]
                        rows = pa.array(np.full(len(a), k))
                        yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in kept] + [pa.array(v) for v in values], [*kept, *kind.names])

    return df.select(*kept).mapInArrow(run, T.StructType([df.schema[c] for c in kept] + kind.fields))


DOC = ("n_a", "n_b", "n_groups", "n_links")
BLOCK = f"block long, doc_id array<long>, {', '.join(f'{c} array<long>' for c in DOC)}, groups_sha256 array<string>, links binary, pairs array<long>, counts array<long>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Block:
    """What is known of a run of texts until it is written."""

    def __init__(self) -> None:
        self.bytes, self.docs, self.sha, self.pairs = 0, [], [], []
        self.numbers: list[list[np.ndarray]] = [[] for _ in DOC]

    def add(self, ids: list, texts: list[str | None], t: Tables) -> None:
        x = Aligned(texts, t)
        i, j, _ = x.ending()
        ends = x.a_end[i]
        per_doc = np.bincount(np.searchsorted(x.doc_end, ends), minlength=len(texts))
        # Each end of both is one group and, as tokens don't overlap their own kind, one link.
        for known, more in zip(self.numbers, (x.n_a, x.n_b, per_doc, per_doc)):
            known.append(more)
        self.pairs.append(x.b[j] << 32 | x.a[i])
        self.sha += [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in x.written(ends)]
        self.docs += ids
        self.bytes += x.bytes

    def row(self, block: int) -> dict:
        pairs, inverse, counts = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # small numbers for frequent pairs
        number = np.empty(len(order), "<u4")
        number[order] = np.arange(len(order), dtype="<u4")
        links = zstandard.ZstdCompressor(level=1).compress(number[inverse].tobytes())
        known = dict(zip(DOC, (np.concatenate(x) for x in self.numbers)))
        return known | {"block": block, "doc_id": self.docs, "groups_sha256": self.sha, "links": links, "pairs": pairs[order], "counts": counts[order]}


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of (doc_id, text) rows; see ``BLOCK``."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(BLOCK))

    def run(batches):
        t, made, block = tables(path_a, path_b), 0, Block()
        first = TaskContext.get().partitionId() << 32

        def done():
            row = block.row(first + made)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for low, high in byte_slices(batch, 1 << 20, CHUNK_BYTES):
                part = batch.slice(low, high - low)
                size = pa.compute.sum(pa.compute.binary_length(part.column("text"))).as_py() or 0
                if block.docs and block.bytes + size > BLOCK_BYTES:
                    yield done()
                    made, block = made + 1, Block()
                block.add(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), t)
        if block.docs:
            yield done()

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK)


def link_digest(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of docs (doc_id, text) its counts of tokens, groups and links that end together, and how frequent its
    links' pairs of ids are in the corpus; see ``DIGEST``."""
    blocks = materialize(aligned_blocks(docs, path_a, path_b))
    total = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    known = total.select("pair", "n", (F.col("n") == most).alias("best"))
    asked = blocks.select("block", F.posexplode("pairs").alias("number", "pair"))
    answers = asked.join(known, "pair").select("block", "number", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right.column("number").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        out = []
        for k in range(left.num_rows):
            row = {c: left.column(c)[k].values for c in ("doc_id", *DOC, "groups_sha256")}
            links = np.frombuffer(zstandard.ZstdDecompressor().decompress(left.column("links")[k].as_py()), "<u4")
            first = np.concatenate([[0], np.cumsum(row["n_links"].to_numpy())])
            sums = [np.diff(np.concatenate([[0], np.cumsum(v[links])])[first]) for v in (best, n)]
            out.append(pa.table([row["doc_id"], *(row[c] for c in DOC), *sums, row["groups_sha256"]], names=[x.split()[0] for x in DIGEST.split(", ")]))
        return pa.concat_tables(out) if out else pa.table({x.split()[0]: pa.array([], pa.string() if x.endswith("string") else pa.int64()) for x in DIGEST.split(", ")})

    left = blocks.select(*[F.col(c).alias(c) for c in blocks.columns if c not in ("pairs", "counts")])
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, DIGEST)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_digest(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
