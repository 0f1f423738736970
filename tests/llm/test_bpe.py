import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quiverlane.llm import encode
from quiverlane.llm.bpe import ByteBPE

PATH = encode.vocabulary_path()


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def ids(model, texts):
    return [x for chunk in model.encode(pa.array(texts, pa.string())) for x in chunk.to_pylist()]


ODD = [
    "", None, " ", "  ", " \n", "\n\n a", "don't we'll'll 'sfoo ''s 's I'VE they've'd x'", "'", "a'l", "'re've", "'" * 50 + "s", "\r\n\r\n x", "  x   y", "​x", "a  b   c\t\td \n e",
    "x" * 1000, "-" * 3001, "ab" * 5000, " " * 700 + "x", "<|endoftext|>", "\0\0a\0", "\x85a \x85", "　　z", "٣٤ 12½ Ⅷ", "日本語 テキスト", "é́", "🙂🙂 👨‍👩‍👧", "﻿abc", "\x1c\x1d x", "a" * 23 + " " + "b" * 24 + " " + "c" * 25,
]


def test_odd_texts(public):
    assert ids(ByteBPE(PATH), ODD) == public(ODD)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(public, seed):
    rnd = random.Random(seed)
    parts = ["'", "s", "ll", "e", " ", "\n", "\t", "1", "é", "re", "ve", "d", "-", "X", "日", ".", "'t", " ", "\\", "{", "the", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x250, 0x3000), rnd.randrange(0xE000, 0xFFFF), rnd.randrange(0x10000, 0x1F900)])) for _ in range(20)) for _ in range(300)]
    model = ByteBPE(PATH)
    assert ids(model, texts) == public(texts)
    assert list(model.count(pa.array(texts))) == [len(x) for x in public(texts)]


def test_long_pieces(public):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(alphabet) for _ in range(n)) for alphabet in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "-=_#*", "0123456789", "日本語あ") for n in (25, 63, 64, 65, 255, 257, 1025, 4097, 20_000)]
    texts += [t * 2 for t in texts[:20]] + texts[:30]
    model = ByteBPE(PATH)
    assert model.together
    for _ in range(2):  # the second time from the table
        assert ids(model, texts) == public(texts)
    model.together = False
    model._empty()
    short = [t for t in texts if len(t) < 5000]
    assert ids(model, short) == public(short)


def test_pieces_of_one_hash(public, monkeypatch):
    from quiverlane.llm import bpe

    monkeypatch.setattr(bpe, "_hash_bytes", lambda data, starts, lengths: bpe.np.zeros(len(starts), bpe.np.uint64))
    texts = [f"{c * 30} {c * 40} {c * 3}" for c in "abcabc"]
    model = ByteBPE(PATH)
    assert ids(model, texts) == public(texts) and ids(model, texts) == public(texts)


def test_documents(public, data):
    texts = pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist()
    assert ids(ByteBPE(PATH), texts) == public(texts)


def test_full_tables_are_emptied(public, monkeypatch):
    from quiverlane.llm import bpe

    monkeypatch.setattr(bpe, "SLOTS_LOG2", 6)
    monkeypatch.setattr(bpe, "LONG_KEPT", 2)
    texts = [f"word{i} {'long' * 10}{i} x" for i in range(300)]
    model = ByteBPE(PATH)
    assert [ids(model, texts[i : i + 20]) for i in range(0, 300, 20)] == [public(texts[i : i + 20]) for i in range(0, 300, 20)]


def test_over_a_table(spark):
    df = spark.createDataFrame([(1, "a b", "clash"), (1, "a b", "clash"), (2, None, "x"), (3, "", "x"), (None, "z", "x")], "doc_id long, text string, ids string")
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.ids) for r in encode.encode_texts(df, "doc_id", "text", PATH).collect())
    assert [len(x) for _, x in found] == [2, 2, 0, 0, 1]
    sizes = encode.count_tokens(df, "text", PATH, ["doc_id", "ids"]).collect()
    assert sorted(r.n_tokens for r in sizes) == [0, 0, 1, 2, 2]
    assert encode.encode_texts(df.limit(0), "doc_id", "text", PATH).collect() == []


def test_path_is_a_parameter(monkeypatch):
    monkeypatch.setenv("TOKENIZERS_DIR", "/somewhere")
    assert encode.vocabulary_path("x.json") == os.path.join("/somewhere", "x.json")
