"""Encoders against their libraries, codes and files by exact round trips."""

import random
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pytest

from slotframe.llm import sentence_pieces, token_file
from slotframe.llm.queries import BYTES, PIECES
from slotframe.llm.token_file import BLOCK_IDS, Codes, canonical, code_lengths, decode_bits, encode_bits

TEXTS = [
    "", " ", "  ", "a", "Hello, world!  How's it?\n\n  two   spaces", "tab\there\r\nline", " leading", "trailing ", "\n", "a\n b", "a \n", "x\u00a0y \u3000 z", "日本語 テスト 🙂🙂 é e\u0301", "▁ ▁▁x▁", "\x00 a\x00b",
    "<|endoftext|> </s> <unk> <0x41>", "a" * 500, "ab" * 400 + " " + "x" * 100, "🙂" * 70, "the the the 1234567890 don't I'll we've", "ﬁ½ ℌ", "\x1c \x1d", "word " * 300,
]
SCHEMA = "doc_id long, text string, ids string, start long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)


def rows():
    r = random.Random(6)
    syllables = ["th", "er", "ion", "ä", "ció", "ß", "que", "ing", ".", ",", "!!", "###", "A"]
    more = [" ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 200))) for _ in range(60)]
    return [*enumerate(TEXTS + more), (900, None), (901, "long " * 60_000), (5, "repeated id"), (None, "no id"), (None, "no id")]


def test_pieces_against_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for _, t in rows()]
    for batch in (texts, texts[::-1], texts[:3]):  # the second time from the words kept
        got = [x.tolist() for ids, counts in sentence_pieces.encode_texts(pa.array(batch), PIECES) for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == sp.encode(batch)
    for ids in sp.encode(texts):
        assert sentence_pieces.decode_ids(ids, PIECES) == sp.decode(ids)


def test_pieces_in_columns(spark):
    data = rows()
    coded = sentence_pieces.encode(docs(spark, data), PIECES)
    back = sentence_pieces.decode(coded, PIECES).collect()
    assert len(back) == len(data)
    texts = {i: t for i, t in data if i is not None and i != 5}
    for r in back:
        if r["doc_id"] in texts and "▁" not in (texts[r["doc_id"]] or ""):
            assert r["text"] == (texts[r["doc_id"]] or "")
    digests = {r["doc_id"]: r for r in sentence_pieces.round_trip(docs(spark, data), PIECES).collect()}
    assert (digests[900]["n_tokens"], digests[900]["ids_crc32"], digests[900]["restored"]) == (0, 0, True)
    for r in coded.collect():
        if r["doc_id"] in texts:
            assert digests[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4"))
    assert sentence_pieces.round_trip(docs(spark, []), PIECES).collect() == []


def whole_ids(text, special=True):
    return tokenizer(special).encode(text or "", add_special_tokens=False).ids + [2]


@cache
def tokenizer(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    t.encode_special_tokens = not special
    return t


def test_token_files(spark, tmp_path):
    data = rows()
    path = f"file://{tmp_path}/tokens"
    token_file.write_token_files(docs(spark, data), path, BYTES)
    got = sorted(token_file.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((i for i, _ in data), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4"))
        start += r["n_tokens"]
    want = sorted(((i, whole_ids(t)) for i, t in data), key=str)
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want


def test_digest_of_special_tokens(spark):
    """Their strings in a text get the ids that the library gives by default."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    texts = ["plain words", "end <|endoftext|>", "end<|endoftext|>next one", "<|endoftext|>", "a  b <|endoftext|> c", "x <|endoftext|>, <|endoftext |>", "end again"]
    got = token_file.token_digest(docs(spark, list(enumerate(texts))), BYTES).orderBy("doc_id").collect()
    start = 0
    for text, r in zip(texts, got, strict=True):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
    assert t.encode(texts[1], add_special_tokens=False).ids[-2:] == [220, 50256]


def test_token_files_of_nothing(spark):
    assert token_file.token_digest(docs(spark, []), BYTES).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_codes(seed):
    g = np.random.default_rng(seed)
    n = int(g.integers(2, 300))
    counts = (g.pareto(0.4, n) * 10).astype(np.int64) % 10**9
    limit = max(9, 16 - 2 * seed)
    lengths = code_lengths(counts, limit)
    used = counts > 0
    assert (lengths[~used] == 0).all() and lengths.max(initial=0) <= limit
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
    codes = canonical(lengths)
    text = [format(int(codes[i]), f"0{lengths[i]}b") for i in np.flatnonzero(lengths)]
    assert not any(a != b and b.startswith(a) for a in text for b in text)


def test_code_lengths_are_least():
    """Without a binding limit the total is that of Huffman's tree; with one, no worse code fits."""
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    heap = counts.tolist()
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((counts * code_lengths(counts, 16)).sum()) == total
    assert code_lengths(np.array([1, 1, 2, 4]), 2).tolist() == [2, 2, 2, 2]


@pytest.mark.parametrize("n", [0, 1, BLOCK_IDS - 1, BLOCK_IDS, BLOCK_IDS + 1, 5 * BLOCK_IDS, 12_345])
def test_bits(n):
    g = np.random.default_rng(n)
    ids = np.minimum(g.geometric(0.05, n), 400).astype(np.uint16)
    c = Codes.of(code_lengths(np.bincount(ids, minlength=500), 16))
    bits, offsets, _ = encode_bits(ids, c)
    assert decode_bits(bits, offsets, n, BLOCK_IDS, c).tolist() == ids.tolist()


def test_words_are_kept_in_two_generations():
    from slotframe.llm.word_cache import WordCache

    c, asked = WordCache(generation=3), []

    def learn(new):
        asked.extend(new)
        return [w.upper() for w in new]

    for batch in ([b"a", b"b"], [b"c", b"d"], [b"a", b"e"], [b"a", b"f"], [b"g", b"h", b"i"], [b"a"]):
        assert c.encode(batch, learn) == [w.upper() for w in batch]
        assert len(c.known) <= 3 + len(batch)
    assert asked.count(b"a") == 1
    c.encode([b"b", b"x" * 300, b"x" * 300], learn)
    assert asked.count(b"b") == 2 and b"x" * 300 not in c.known


PARTS = ["ab", "Ünd", "é", "×", "1", "12a", ",", "'s", "'", "...", "&&&", "\n", "\r\n", "\t", " ", "  ", "\u00a0", "\u2009", "\u3000", "…", "“x”", "日本", "🙂", "a\nb", ".\nAb", "\x1c", "\x00", "<|endoftext|>", "à", "ß,"]


@pytest.mark.parametrize("seed", range(60))
def test_texts_are_cut_where_the_tokenizer_cuts(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(PARTS) + r.choice(["", "", " ", "\n"]) for _ in range(r.randrange(30))) for _ in range(50)]
    for special in (True, False):
        for _ in range(2):  # the second time from the words kept
            got = [x.tolist() for ids, counts in token_file.encode_texts(pa.array(texts), BYTES, 2, np.uint16, special) for x in np.split(ids, np.cumsum(counts)[:-1])]
            assert got == [whole_ids(t, special) for t in texts]
    want = [x.tolist() for ids, counts in sentence_pieces.encode_texts(pa.array(texts), PIECES) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert want == processor().encode(texts)


def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_other_models_are_refused(monkeypatch):
    from dataclasses import replace

    real = sentence_pieces.load(PIECES)
    swapped = replace(real, rank=real.rank[::-1].copy())
    monkeypatch.setattr(sentence_pieces, "load", lambda path: swapped)
    monkeypatch.setattr(sentence_pieces, "_caches", {})
    with pytest.raises(ValueError, match="pair-merge"):
        sentence_pieces.check.__wrapped__(PIECES)
