import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textweave.llm import byte_bpe
from textweave.llm.token_counts import default_path, token_counts

BITS = ["'s", "'", "ll", "'re", "'ve", "'ll", " ", "  ", "\n", "\t", "a", "Don", "é", "ß", "１", "5", " 12", "!", "?!", "<|endoftext|>", "<|endof", " ", "　", "日本", "🙂", "\x1c", "\x00", "'t", "S", "the", "m", "d", "\r\n", "verylongwordwithoutanybreakatall"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def ids(bpe, texts):
    data, offsets = byte_bpe.buffers(pa.array(texts, pa.string()))
    out = []
    for _, all_ids, per in bpe.encode(data, offsets):
        out += [x.tolist() for x in np.split(all_ids, np.cumsum(per)[:-1])]
    return out


def test_every_code_point(library):
    bpe = byte_bpe.ByteBpe(default_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):
        texts = [f"a{chr(c)}1 {chr(c)} {chr(c)}{chr(c)}x" for c in points[k : k + 50_000 : 3]]
        assert ids(bpe, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("sub", [64, 1 << 20])
def test_random_texts(library, monkeypatch, sub):
    monkeypatch.setattr(byte_bpe, "SUB_BYTES", sub)
    draw = random.Random(sub)
    bpe = byte_bpe.ByteBpe(default_path(), slot_bits=8)  # the table is soon full
    texts = ["".join(draw.choice(BITS) for _ in range(draw.randint(0, 60))) for _ in range(4000)]
    assert ids(bpe, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts(spark, library):
    rows = [(1, "hello world", 1), (2, None, 2), (3, "", 3), (None, "x <|endoftext|> y", 4), (1, "hello world", 1), (9, "long word " * 300_000, 9), (10, "é" * 700, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs).collect())
    want = sorted((i or 0, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in rows)
    assert got == want
    assert token_counts(docs.where("false")).count() == 0
