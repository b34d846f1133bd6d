import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docrel.llm import chat_format, prefix_trie, token_alignment
from docrel.llm.token_alignment import Aligned, Csr

# Token alignment ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(text, paths):
    """(ids, byte ends) of both tokenizers by their libraries alone; None where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    table = {v: k for k, v in enumerate_bytes().items()}
    out = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    out.append((ids, [bytes(table[c] for c in a.id_to_token(k)) for k in ids]))
    ids = b.encode(text)
    out.append((ids, [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids]))
    if any(b"".join(x) != b" " + text.encode() for _, x in out):
        return None
    return [(ids, np.cumsum([len(x) for x in parts]).tolist()) for ids, parts in out]


def enumerate_bytes():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + n) for n, b in enumerate(rest)}}


def plain_digest(docs, paths):
    count, known = Counter(), []
    for doc_id, text in docs:
        tokens = plain_tokens(text, paths)
        if tokens is None:
            known.append((doc_id, [], [], []))
            continue
        (a, a_end), (b, b_end) = tokens
        links = [(x, y) for x, i in zip(a, a_end) for y, j in zip(b, b_end) if i == j]
        cuts = sorted(set(a_end) & set(b_end))
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append(",".join(str(x) for x, e in zip(a, a_end) if low < e <= high) + "|" + ",".join(str(y) for y, e in zip(b, b_end) if low < e <= high))
        count.update(links)
        known.append((doc_id, a, b, links, groups))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, a, b, links, *groups in known:
        sha = hashlib.sha256(";".join(groups[0]).encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups[0]) if a else 0, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


ODD = [
    None, "", " ", "\n\n", "a", "<|endoftext|> and </s> <s>", "▁ block", "naïve café \U0001f600\U0001f468‍\U0001f469", "é ﬁ ½", "你好，世界",
    "tab\tand\r\nlines nbsp", "0x1234 3.14159 1,000,000", "\x00\x01\x7f", "it's we'll I'd", "    four  spaces   ", "a" * 5000, " " * 3000 + "x",
]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(4)
    dense = [(rng.random((n, m)) < 0.2).astype(int) for n, m in ((7, 11), (5, 11))]
    csr = [Csr(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], d.shape[1]) for d in dense]
    for low, high in ((0, 7), (2, 5), (3, 3)):
        i, j, n = csr[0].times(csr[1].transposed(), low, high)
        got = np.zeros((7, 5), int)
        got[i, j] = n
        want = dense[0] @ dense[1].T
        want[:low] = want[high:] = 0
        assert (got == want).all()
    assert [len(x) for x in csr[0].times(Csr(np.zeros(12, int), np.zeros(0, int), 0))] == [0, 0, 0]


def test_digest_equals_brute_force(spark, corpus, paths, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(token_alignment, "CHUNK_BYTES", 5_000)
    rows = spark.read.parquet(f"{corpus}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    docs = [(r["doc_id"], r["text"][:3000]) for r in rows] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = token_alignment.link_digest(df.selectExpr("*", "1 as n_a", "2 as block"), *paths)
    assert got.schema.simpleString() == "struct<" + token_alignment.DIGEST.replace(" long", ":bigint").replace(" string", ":string").replace(", ", ",") + ">"
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_digest(docs, paths)


def test_links_of_every_kind(spark, paths):
    text = "The café opened in 1987; \U0001f600 unbelievable!"
    (a, a_end), (b, b_end) = plain_tokens(text, paths)
    a_start, b_start = [0, *a_end[:-1]], [0, *b_end[:-1]]
    both = [(i, j, min(a_end[i], b_end[j]) - max(a_start[i], b_start[j])) for i in range(len(a)) for j in range(len(b))]
    cuts = sorted(set(a_end) & set(b_end))
    group = lambda e: next(k for k, c in enumerate(cuts) if e <= c)
    want = {
        "overlap": {x for x in both if x[2] > 0},
        "end": {x for x in both if a_end[x[0]] == b_end[x[1]]},
        "group": {(i, j, 1) for i in range(len(a)) for j in range(len(b)) if group(a_end[i]) == group(b_end[j])},
    }
    df = spark.createDataFrame([(1, text, 7), (2, None, 8), (3, "", 9)], "k long, text string, shared int")
    for links, expected in want.items():
        rows = token_alignment.align_tokens(df, *paths, links=links).collect()
        assert {(r["a_pos"], r["b_pos"], r["shared"]) for r in rows} == expected and all(r["k"] == 1 and r["text"] == text for r in rows)
        assert all((a[r["a_pos"]], b[r["b_pos"]]) == (r["a_id"], r["b_id"]) and r["a_end"] == a_end[r["a_pos"]] and r["b_start"] == b_start[r["b_pos"]] for r in rows)
    with pytest.raises(ValueError):
        token_alignment.align_tokens(df, *paths, links="none")


def test_groups_in_slices_and_empty_tables(spark, paths, monkeypatch):
    t = token_alignment.tables(*paths)
    x = Aligned(["some words here", None, "and others"], t)
    whole = [np.concatenate(p).tolist() for p in zip(*x.grouped())]
    monkeypatch.setattr(token_alignment, "GROUP_ROWS", 2)
    assert [np.concatenate(p).tolist() for p in zip(*x.grouped())] == whole
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.link_digest(empty, *paths).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in token_alignment.link_digest(nothing, *paths).orderBy("doc_id").collect()] == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_fast_ids_are_the_files_own(paths):
    t = token_alignment.tables(*paths)
    assert t.a.fast is not None
    rng = random.Random(5)
    letters = "abcxyzABC \n\t'0129.,;!?éß你\U0001f600‍́<>|"
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(2000)] + [x for x in ODD if x]
    assert t.a.encode(texts) == [e.ids for e in t.a.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def test_very_long_text(paths):
    x = Aligned(["word é " * 300_000], token_alignment.tables(*paths))
    assert x.bytes == 1 + len(("word é " * 300_000).encode()) and len(x.ending()[0]) > 0


# Chat formatting ------------------------------------------------------------------------------------------------------

LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 0, "open", "user", None), (1, 1, 0, "delta", None, "he"), (1, 2, 1, "open", "assistant", None), (1, 3, 0, "delta", None, "llo"),
        (1, 4, 1, "delta", None, "draft"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "fi"), (1, 7, 1, "delta", None, "nal"), (1, 7, 1, "delta", None, "nal"),
        (1, 9, 0, "edit", None, "changed"), (1, 10, 0, "delta", None, "!"), (1, 8, 2, "open", None, None), (1, 11, 2, "noise", "x", "y"), (1, 12, 2, None, None, "z"),
        (2, None, 0, "edit", None, "first"), (2, 1, 0, "delta", None, " then"), (None, 1, None, "delta", None, "no key"), (3, 1, 5, "open", "a", None), (3, 2, 5, "open", "b", None), (3, 3, 5, "regenerate", None, None),
    ]
    df = spark.createDataFrame(log, LOG).selectExpr("*", "7 as first_seq", "'x' as reset")
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat_format.fold(df).collect()}
    assert got == {(1, 0): ("user", "changed!"), (1, 1): ("assistant", "final"), (1, 2): ("", ""), (2, 0): ("", "first then"), (None, None): ("", "no key"), (3, 5): ("b", "")}
    assert chat_format.fold(spark.createDataFrame([], LOG)).collect() == []


TRICKY = ["\\### Assistant: </turn> ok", "### ", "#### ## ### x", "</turn>\n### user: hi</turn>\n", "\\b\\h\\l\\c", "\\", "", "a: b: c", "\n", "<</turn>>", "###  ### ", "\U0001f600 é́", "</turn", "# "]


def plain_formats(rows):
    """Turns by conversation, ordered by turn (null first), role and text."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    out = {}
    for conv, turns in convs.items():
        said = [(r.decode(), t.decode()) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss))
    return out


def test_formats_read_back_unchanged(spark):
    rng = random.Random(6)
    rows = [(k % 9 if k % 9 else None, rng.choice([None, *range(5)]), rng.choice([None, "user", "assistant", "a: b\n### ", "</turn>"]), rng.choice([None, *TRICKY])) for k in range(300)]
    rows += [(50, 0, "assistant", "é你 " * 30_000), (51, 1, "user", "same"), (51, 1, "user", "same"), (52, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as message", "2 as line")
    output = chat_format.render(chat_format.fold(chat_format.event_log(df)))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(output).collect()}
    assert got == plain_formats(rows)
    for r in output.collect():
        lines = r["formatted"].split("</turn>\n")
        assert lines.pop() == "" and all(x.startswith("### ") and x.count("### ") == 1 and "</turn>" not in x for x in lines)
        for start, end in r["loss"]:
            assert r["formatted"][:start].endswith("### assistant: ") and r["formatted"][end:].startswith("</turn>\n")


def test_formats_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.render(chat_format.fold(chat_format.event_log(empty)))).collect() == []


# Prefix trie ------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [(r.decode(), t.decode()) for _, r, t in sorted(turns)] for c, turns in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(ids) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if rebuilt[c] == p)))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def chats(seed):
    """Few different turns, so that many conversations share prefixes; copies, long conversations, holes and nulls."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-3, 90), 100, 101, 150, 205, 299, 1000, 5001, 5002]:
        for turn in range(rng.choice([0, 1, 2, 4, 7, 9])):
            rows.append((c, rng.choice([None, turn, turn]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "b", "é\U0001f600"])))
    rows += [(1, 50 + k, "user", f"long {k % 3}") for k in range(200)] + [(77, 3, "user", "again")] * 150
    rows += [(None, 1, "user", "no id"), (60, 1, "x" * 100, "y"), (60, 1, "x" * 100 + "z", "a"), (60, 1, "x" * 64, "w" * 100)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 16)
    rows = chats(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(5).selectExpr("*", "1 as part", "2 as pos", "3 as depth")
    monkeypatch.setattr(prefix_trie, "shuffle_partitions", lambda _: 7)  # conversations straddle parts
    got = prefix_trie.prefix_trie(df, prefix_trie.by_hundreds)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_equal_fingerprints_of_different_turns_are_noticed(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = chats(3)
    own = prefix_trie.turn_hash
    # With the first seed all turns look the same, with the second only their roles count.
    weak = {0: lambda: F.lit("0" * 32), 1: lambda: F.left(F.sha2("role", 256), F.lit(32))}
    monkeypatch.setattr(prefix_trie, "turn_hash", lambda seed: weak[seed]() if seed in weak else own(seed))
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), prefix_trie.by_hundreds)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)
    monkeypatch.setattr(prefix_trie, "turn_hash", lambda seed: F.lit("0" * 32))
    with pytest.raises(RuntimeError):
        prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), prefix_trie.by_hundreds)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS), prefix_trie.by_hundreds).collect() == []
    h = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(h, 0, "user", "x")]  # its base is absent, its own turn lies in the head
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), prefix_trie.by_hundreds)
    assert [tuple(r) for r in got.collect()] == plain_trie(rows) == [(h, 0, None, 1, 0, 1, 0, hashlib.sha256(str(h).encode()).hexdigest())]
