"""Token-ID output: one zstandard frame per document, a trailing seek table, a checksum per frame.

File layout (the public zstd seekable format, so the zstd tool can read it too): a frame per document with its ids as
little-endian unsigned integers of 2 or 4 bytes; a skippable frame with the width and the doc_ids; a skippable frame
with the seek table, whose entries hold compressed size, plain size and the low 32 bits of XXH64 of the plain bytes.
A reader opens the table at the end and decompresses only the frames that it is asked for.

Rows are range-partitioned and sorted by doc_id (null first), one file per partition, written under a temporary name
and renamed, so a retried or lost task leaves no half file. Null and empty texts hold the end id only; repeated
doc_ids stay as rows of their own, ordered by text; an empty table gives no file and no row; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_values, shared_dir, shuffle_partitions, spans_hash, table, text_chunks

#: Magic numbers of the public formats.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_DOC = -(2**63)
MANIFEST = "file string, part int, docs long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Tokens, and words, with their ids that a Python process keeps in a generation; there are two of each.
CACHED = 400_000


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class TokenFileWriter:
    """Writes documents one by one; ``close`` adds the tables and moves the file to its name."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = filesystem(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.width, self.docs, self.table = width, [], []
        self.compressor = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)

    def write(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.docs.append(NO_DOC if doc_id is None else doc_id)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))

    def close(self) -> None:
        docs = struct.pack("<B", self.width) + np.array(self.docs, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(docs)) + docs)
        entries = np.array([*self.table, (len(docs) + 8, 0, 0)], "<u4").tobytes()
        footer = struct.pack("<IBI", len(self.table) + 1, 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        self.fs.move(self.temporary, self.path)


class TokenFileReader:
    """Random access: ``ids(k)`` reads and decompresses the k-th document alone."""

    def __init__(self, path: str):
        system, name = filesystem(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        self.table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(-1, 3)[:-1]
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = self.file.read_at(9 + 8 * len(self.table), int(self.at[-1]))
        self.width, self.docs = index[8], np.frombuffer(index[9:], "<i8")
        self.decompressor = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.docs)

    def doc_id(self, k: int) -> int | None:
        return None if self.docs[k] == NO_DOC else int(self.docs[k])

    def ids(self, k: int) -> np.ndarray:
        plain = self.decompressor.decompress(self.file.read_at(int(self.table[k, 0]), int(self.at[k])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != int(self.table[k, 2]):
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, f"<u{self.width}")

    def find(self, doc_id: int) -> list[int]:
        """Positions of a document; the ids ascend."""
        low, high = np.searchsorted(self.docs, [doc_id, doc_id + 1])
        return list(range(low, high))


#: How the pattern of tokens must end; before it only short endings after an apostrophe.
TOKENS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WHITE, LETTER, NUMBER, MARK, OTHER = range(5)


def _byte_classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of single bytes, and of the characters U+0080 to U+00BF (after 0xC2) and U+00C0 to U+00FF (after 0xC3)."""
    import unicodedata

    def kind(code: int) -> int:
        if code in (*range(9, 14), 0x20, 0x85, 0xA0):
            return WHITE
        return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(code))[0], MARK)

    one = np.full(256, OTHER, np.uint8)
    one[:128] = [kind(k) for k in range(128)]
    after = [np.full(256, OTHER, np.uint8) for _ in range(2)]
    for k in range(64):
        after[0][0x80 + k], after[1][0x80 + k] = kind(0x80 + k), kind(0xC0 + k)
    return one, *after


ONE, AFTER_C2, AFTER_C3 = _byte_classes()
LOWER_ASCII = np.frombuffer(LOWER, np.uint8)
#: Second bytes of the capital letters U+00C0 to U+00DE; their small letters are 0x20 further on.
CAPITAL = np.isin(np.arange(256), [k for k in range(0x80, 0x9F) if k != 0x97])


def token_runs(data: np.ndarray, offsets: np.ndarray, endings: list[bytes]):
    """Cuts texts of characters up to U+00FF into runs of letters, single numbers and runs of other marks, where an
    apostrophe takes one of ``endings`` that follows it. Lower-case bytes; start, end and text of each run."""
    low = LOWER_ASCII[data]
    kind = ONE[data]
    head = kind < OTHER
    for lead, table_of in ((0xC2, AFTER_C2), (0xC3, AFTER_C3)):
        at = np.flatnonzero(data == lead)
        if len(at):
            second = data[at + 1]
            kind[at] = kind[at + 1] = table_of[second]
            head[at] = True
            if lead == 0xC3:
                low[at + 1] = np.where(CAPITAL[second], second + np.uint8(0x20), second)
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    new[:-1] |= (kind == NUMBER) & head
    cut = np.flatnonzero(new)
    start, end = cut[:-1], cut[1:]
    full = kind[start] != WHITE
    start, end = start[full], end[full].copy()
    if endings and len(start) > 1:
        quote = np.flatnonzero((low[start[:-1]] == 39) & (end[:-1] == start[:-1] + 1) & (start[1:] == end[:-1]) & (kind[start[1:]] == LETTER))
        quote = quote[np.searchsorted(offsets, start[quote], "right") == np.searchsorted(offsets, start[quote + 1], "right")]
        for k in quote.tolist():
            after = low[start[k + 1] : min(end[k + 1], start[k + 1] + 8)].tobytes()
            if taken := next((len(e) for e in endings if after.startswith(e)), 0):
                end[k] += taken
                start[k + 1] += taken
        full = start < end
        start, end = start[full], end[full]
    return low, start, end, np.searchsorted(offsets, start, "right") - 1


def normal_steps(parts: dict) -> list[dict]:
    normal = parts["normalizer"]
    return normal.get("normalizers", [normal]) if normal else []


def white_is_dropped(parts: dict) -> bool:
    """Whether a tokenizer (its file as a dict) gives the words of a text the ids they have alone, and white space none."""
    steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"] or steps[1].get("use_regex", True):
        return False
    pattern = steps[0]["pattern"].get("Regex", "")
    if not pattern.endswith(TOKENS) or not re.fullmatch(r"('[a-z]{1,8}\|)*", pattern[: -len(TOKENS)]) or (steps[0]["behavior"], steps[0]["invert"]) != ("Removed", True):
        return False
    for s in normal_steps(parts):
        if s["type"] not in ("NFC", "Lowercase") and (s["type"], s.get("pattern"), s.get("content")) != ("Replace", {"Regex": r"\s+"}, " "):
            return False
    return not (parts["truncation"] or parts["padding"] or any(re.search(r"\s", t["content"]) for t in parts["added_tokens"]))


class TextEncoder:
    """Ids of texts as bytes, by the tokenizers library.

    Where the tokenizer's file shows that white space ends every token and has no id, each word is encoded once and kept,
    and a text is the join of its words' ids. Where the file also has NFC and Lowercase, texts of characters up to
    U+00FF (which NFC leaves alone) are cut into the pattern's tokens in numpy, and those are encoded once and kept,
    without normaliser and pattern. Other tokenizers, and texts with an added token's string, are encoded whole."""

    def __init__(self, tokenizer: str, width: int):
        from tokenizers import Tokenizer

        self.whole, self.type = Tokenizer.from_file(tokenizer), {2: "H", 4: "I"}[width]
        self.width = width
        parts = json.loads(self.whole.to_str())
        self.by_word = white_is_dropped(parts)
        self.added = [t["content"].encode("utf-8") for t in parts["added_tokens"]]
        self.bare = None
        if self.by_word and {"NFC", "Lowercase"} <= {s["type"] for s in normal_steps(parts)}:
            steps = parts["pre_tokenizer"]["pretokenizers"]
            self.bare = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": steps[-1], "added_tokens": []}))
            self.endings = [e.encode() for e in steps[0]["pattern"]["Regex"][: -len(TOKENS)].replace("'", "").split("|") if e]
        self.runs, self.words = ({}, {}), ({}, {})

    def _encode(self, tokenizer, new: list[str]) -> list[bytes]:
        coded = [array(self.type, c.ids) for c in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        if sys.byteorder == "big":
            for ids in coded:
                ids.byteswap()
        return [ids.tobytes() for ids in coded]

    def _look_up(self, which: str, tokenizer, keys: list[bytes]) -> list[bytes]:
        """Ids of each key, from what is kept (two generations of at most CACHED entries each) or newly encoded."""
        kept, old = getattr(self, which)
        if len(kept) > CACHED:
            kept, old = {}, kept
            setattr(self, which, (kept, old))
        found = list(map(kept.get, keys))
        missing = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for k in missing:
            if (ids := old.get(keys[k])) is None:
                new.append(k)
            else:
                found[k] = kept[keys[k]] = ids
        for k, ids in zip(new, self._encode(tokenizer, [keys[k].decode("utf-8") for k in new]), strict=True):
            found[k] = kept[keys[k]] = ids
        return found

    def _by_word(self, text: bytes) -> bytes:
        w = text.split()
        return b"".join(self._look_up("words", self.whole, w)) if w else b""

    def _by_runs(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes] | None:
        low, start, end, text = token_runs(data, offsets, self.endings)
        if not len(start):
            return [b""] * (len(offsets) - 1)
        code, distinct = pd.factorize(spans_hash(byte_values()[low], start, end))
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        size, like = end - start, first[code]
        if (size != size[like]).any():
            return None
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if (low[np.repeat(start, size) + inner] != low[np.repeat(start[like], size) + inner]).any():
            return None
        raw = low.tobytes()
        coded = self._look_up("runs", self.bare, [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        ids = np.frombuffer(b"".join(coded), f"<u{self.width}")
        count = np.fromiter(map(len, coded), np.int64, len(coded)) // self.width
        begin = np.cumsum(count) - count
        times = count[code]
        stop = np.cumsum(times)
        out = ids[np.repeat(begin[code] - stop + times, times) + np.arange(stop[-1])].tobytes()
        edge = (np.append(0, stop)[np.searchsorted(text, np.arange(len(offsets)))] * self.width).tolist()
        return [out[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of the texts that lie in one byte buffer."""
        n, raw = len(offsets) - 1, data.tobytes()
        cut = offsets.tolist()
        texts = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if not self.by_word:
            return self._encode(self.whole, [t.decode("utf-8") for t in texts])
        lower = raw.translate(LOWER)
        special = set()
        if any(a in raw or a.translate(LOWER) in lower for a in self.added):
            special = {k for k, t in enumerate(texts) if any(a in t or a.translate(LOWER) in t.translate(LOWER) for a in self.added)}
        wide = set(range(n)) if self.bare is None else set((np.searchsorted(offsets, np.flatnonzero(data >= 0xC4), "right") - 1).tolist())
        odd = special | wide
        if odd:
            plain = [k for k in range(n) if k not in odd]
            own = np.frombuffer(b"".join(texts[k] for k in plain), np.uint8)
            coded = self._by_runs(own, np.cumsum([0, *(len(texts[k]) for k in plain)])) if plain else []
        else:
            plain, coded = range(n), self._by_runs(data, offsets)
        coded = [self._by_word(texts[k]) for k in plain] if coded is None else coded
        out = dict(zip(plain, coded, strict=True))
        out |= {k: self._encode(self.whole, [texts[k].decode("utf-8")])[0] if k in special else self._by_word(texts[k]) for k in odd}
        return [out[k] for k in range(n)]

    def many(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode("utf-8") for t in texts]
        return self.chunk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=1)
def text_encoder(tokenizer: str, width: int) -> TextEncoder:
    """One per Python process, so that it serves all the tasks that run there."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextEncoder(tokenizer, width)


def write_token_files(df: DataFrame, tokenizer: str, out: str, end_id: int = 2, files: int | None = None) -> DataFrame:
    """Writes df (doc_id, text) to files of ``out``; a row per file: its name, order, documents and ids."""
    from tokenizers import Tokenizer

    files = files or shuffle_partitions(df.sparkSession)
    width = 2 if max(end_id, Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else 4

    def write(batches):
        part, writer, ids = TaskContext.get().partitionId(), None, 0
        encode, end = text_encoder(tokenizer, width), np.array([end_id], f"<u{width}").tobytes()
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for low, high, data, offsets in text_chunks(batch, "text"):
                writer = writer or TokenFileWriter(f"{out}/ids-{part:06d}.zst", width)
                for doc, coded in zip(doc_ids[low:high], encode.chunk(data, offsets), strict=True):
                    writer.write(doc, coded + end)
                    ids += len(coded) // width + 1
        if writer is not None:
            writer.close()
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict(
                {"file": [f"{out}/ids-{part:06d}.zst"], "part": pa.array([part], pa.int32()), "docs": [len(writer.docs)], "ids": [ids]}
            )

    ranged = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(files, "doc_id")
    return ranged.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)


def read_token_files(spark: SparkSession, manifest: list) -> DataFrame:
    """Reads every document back: its id, the number of ids before it, its number of ids and their crc32.

    manifest: the rows of ``write_token_files`` (one a file, so small)."""
    start, rows = 0, []
    for r in sorted(manifest, key=lambda r: r["part"]):
        rows.append((r["file"], start))
        start += r["ids"]

    def read(batches):
        for batch in batches:
            for file, at in zip(batch.file, batch.start, strict=True):
                reader, out = TokenFileReader(file), []
                for k in range(len(reader)):
                    ids = reader.ids(k)
                    out.append((reader.doc_id(k), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                doc, first, n, crc = zip(*out, strict=True)
                yield pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "start": first, "n_tokens": n, "ids_crc32": crc})

    files = spark.createDataFrame(rows, "file string, start long")
    return files.repartition(max(1, len(rows)), "file").mapInPandas(read, READ)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark))
    return read_token_files(spark, written.collect())
