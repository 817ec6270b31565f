"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from linehaul.llm import bpe as B
from linehaul.llm import kernels as K
from linehaul.llm.mapped import Probed

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "\n\n a", "a \n", "it's we'll they'RE I'd  'tis !'s ''s x's's 've", " 's", "\t's  'll", "don't", "a<|endoftext|>b <|endoftext|> <|endoftext|>", "<|endoftext|>'s", "x <|endof text|>", "1234 five6 ٣٤", "é ß  x　 y",
    "日本語 текст 🙂🙂 ﷽", "a" * 700, "ab" * 400 + " " + "z" * 300, "\x00\x1c\x1f \x85", "word  two   three    ", "\r\n\r\n", "Ⅷ½ ²x", "'", " '", "'ſ", "ſ's", "̀a", "…—'s",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(PATH)


def noise(rng, n):
    some = "aeiourstlnmd'’ \n\t.,!#0189éßñЖ語🙂 "
    return "".join(rng.choice(some) for _ in range(n))


def test_encoder_equals_library(library, vocabulary):
    rng = random.Random(5)
    texts = TEXTS + [noise(rng, rng.randrange(200)) for _ in range(400)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for words in ([], sorted({w.encode() for t in texts for w in t.split()[:3]} - {b"<|endoftext|>b"}), [b" ", b"a", b"don", b"'t"]):
        e = B.Encoder(B.compiled(vocabulary, sorted(words)))
        data, offsets = K.text_bytes(pa.array(texts))
        ids, edge = e.encode(data, offsets)
        for k, t in enumerate(texts):
            assert ids[edge[k] : edge[k + 1]].tolist() == want[k], t
            assert e.decode(ids[edge[k] : edge[k + 1]]).decode() == t == library.decode(want[k], skip_special_tokens=False)


def test_classes_of_all_code_points_equal_library(library, vocabulary):
    e = B.Encoder(B.compiled(vocabulary, []))
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for between in ("x", "7", "!"):  # what a character is shows in what it joins
        texts = [between.join(chars[k : k + 2000]) for k in range(0, len(chars), 2000)]
        data, offsets = K.text_bytes(pa.array(texts))
        start, end, _ = e.cut(data, offsets)
        raw = data.tobytes()
        got = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        assert got == [t[a:b].encode() for t in texts for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]


def test_transducer_is_minimal_and_numbers_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))).encode() for _ in range(400)})
    keys, values, final, start = B.transducer(words)
    step = dict(zip(keys.tolist(), values.tolist(), strict=True))
    for k, w in enumerate(words):
        state, total = start, 0
        for b in w:
            v = step[state << 8 | b]
            state, total = v >> 32, total + (v & 0xFFFFFFFF)
        assert final[state] and total == k
    endings = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(final) == len(endings)  # one state for each set of endings
    assert B.transducer([])[3] == 0


def test_probed_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 60, 5000).astype(np.uint64))
    t = Probed.build(keys, np.arange(len(keys)))
    assert (t.get(keys, -1) == np.arange(len(keys))).all() and (t.get(keys + np.uint64(1 << 61), -1) == -1).all()


def test_stretches_keep_words_whole(vocabulary):
    rng = random.Random(9)
    e = B.Encoder(B.compiled(vocabulary, []))
    text = noise(rng, 5000) + "x" * 900 + noise(rng, 5000)
    data = np.frombuffer(text.encode(), np.uint8)
    whole = e.encode(data, np.array([0, len(data)]))[0].tolist()
    parts = [data[a:b] for a, b in B.stretches(data, 300)]
    assert len(parts) > 10 and b"".join(p.tobytes() for p in parts) == data.tobytes()
    assert [i for p in parts for i in e.encode(p, np.array([0, len(p)]))[0].tolist()] == whole


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, b"z") for r in rows], "doc_id long, text string, ids string, n long, word binary")


@pytest.mark.parametrize("most", [4, 1 << 17])
def test_encoding_digest(spark, library, most, monkeypatch):
    monkeypatch.setattr(B, "_STRETCH", 2000)
    rng = random.Random(7)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "again again again"), (3, "again again again"), (None, "no id"), (99, None), (100, " ".join(noise(rng, 30) for _ in range(200)))]
    got = sorted(tuple(r) for r in B.encoding_digest(frame(spark, rows), PATH, most).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").fillna(-1).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    assert got == sorted((-1 if i is None else i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(library.decode(ids[t], skip_special_tokens=False))) for i, t in rows)
    assert B.encoding_digest(frame(spark, []), PATH).count() == 0


def test_encode_and_decode_frames(spark, library):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50, None)]
    uri = B.lexicon(frame(spark, rows), PATH)
    encoded = B.encode(frame(spark, rows), uri)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in B.decode(encoded, uri).collect()} == {i: t or "" for i, t in rows}
