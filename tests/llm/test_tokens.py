"""Token files: the same ids as the tokenizer gives for whole texts, and an exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from equiloom.llm import tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "Bc", "don't", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "é", "中", "12", "--", "'", "'s", "!", "\u200b", "\U0001F600", "<|endoftext|>", "_", "\x85", "\u2028", "e\u0301"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(11)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    words = [x for x in SIGNS if not x.isspace()]
    for _ in range(2000):  # words one blank or line break apart
        texts.append("".join(rng.choice(words) + rng.choice(words) + rng.choice([" ", " ", "\n"]) for _ in range(rng.randint(0, 12))) + rng.choice(words))
    encode, kind = tokenfile.encoder(PATH)
    found = encode(pa.array([t.encode() for t in texts], pa.binary()))
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["The  cat\nsat", "", "É x"]
    encode, kind = tokenfile.encoder(path)
    whole = Tokenizer.from_file(path)
    assert [np.frombuffer(x, kind).tolist() for x in encode(pa.array([t.encode() for t in texts], pa.binary()))] == [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_few_remembered_pieces_give_the_same(monkeypatch, tokenizer):
    monkeypatch.setattr(tokenfile, "KEPT_PIECES", 3)
    monkeypatch.setattr(tokenfile, "WORDS_IN_A_ROW", 2)
    encode, kind = tokenfile.encoder(PATH)
    for text in ("a b c d e f", "the cat\nsat on it", "a  b", "c d"):
        assert np.frombuffer(encode(pa.array([text.encode()], pa.binary()))[0], kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_round_trip(spark, tokenizer, tmp_path):
    rng = random.Random(4)
    rows = [(n if n % 10 else None, " ".join(rng.choice(["the", "cat", "naïve", "zzz"]) for _ in range(rng.choice([0, 3, 900]))), n) for n in range(120)]
    rows += [(3, None, 0), (3, "twice", 0), (3, "twice", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    folder = f"file://{tmp_path}/out"
    shards = tokenfile.write_tokens(docs, PATH, folder, sequence=16, shards=5)
    found = sorted(map(tuple, tokenfile.read_tokens(shards, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i))
    assert [r[1] for r in found] == list(np.cumsum([0, *(r[2] for r in found)])[:-1])
    expected = sorted((i or -1, zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((r[0] or -1, r[3]) for r in found) == expected
    for row in shards.collect():
        shard = tokenfile.Shard(fs.LocalFileSystem(), f"{tmp_path}/out/{row['file']}")
        whole = np.concatenate([shard.document(s, n) for s, n in zip(shard.index["start"].to_pylist(), shard.index["n_tokens"].to_pylist(), strict=True)])
        count = -(-row["n_tokens"] // 16)
        lines = [shard.sequence(n) for n in range(count)]
        assert np.array_equal(np.concatenate([i[m] for i, m in lines]), whole)
        assert all(len(i) == 16 for i, _ in lines)
        assert shard.file.schema == tokenfile.schema(np.dtype("<u2"), 16)


def test_many_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "ROWS_A_BATCH", 2)
    writer = tokenfile.Writer(fs.LocalFileSystem(), f"{tmp_path}/x", np.dtype("<u4"), 4)
    docs = [np.arange(n, dtype="<u4") + 100 for n in (0, 3, 50, 1, 8)]
    for n, ids in enumerate(docs):
        writer.add(n, ids.tobytes())
    writer.close()
    shard = tokenfile.Shard(fs.LocalFileSystem(), f"{tmp_path}/x")
    for start, ids in zip(shard.index["start"].to_pylist(), docs, strict=True):
        assert np.array_equal(shard.document(start, len(ids)), ids)
    assert shard.file.num_record_batches > 5


def test_sequences_are_not_copied(tmp_path):
    writer = tokenfile.Writer(fs.LocalFileSystem(), f"{tmp_path}/x", np.dtype("<u2"), 64)
    writer.add(1, np.arange(640, dtype="<u2").tobytes())
    writer.close()
    shard = tokenfile.Shard(fs.LocalFileSystem(), f"{tmp_path}/x")
    before = pa.total_allocated_bytes()
    kept = [shard.sequence(n)[0] for n in range(10)] + [shard.document(3, 600)]
    assert pa.total_allocated_bytes() == before and len(kept) == 11


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.token_digests(docs, PATH).count() == 0


def test_bytes_that_are_no_text(tokenizer):
    encode, kind = tokenfile.encoder(PATH)
    odd = [b"a \xff b", None, b"plain words\nstand here", b""]
    for raw, ids in zip(odd, encode(pa.array(odd, pa.binary())), strict=True):
        assert np.frombuffer(ids, kind).tolist() == [*tokenizer.encode((raw or b"").decode("utf-8", "replace"), add_special_tokens=False).ids, 0]


def test_equal_rows_are_dealt_to_several_shards(spark, tmp_path):
    rows = spark.range(30_000).select(F.when(F.col("id") >= 10_000, F.col("id")).alias("doc_id"), F.when(F.col("id") >= 10_000, "some words").alias("text"))
    folder = f"file://{tmp_path}/out"
    shards = tokenfile.write_tokens(rows, PATH, folder, shards=8)
    sizes = [r["n_docs"] for r in shards.collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 2 * 30_000 / 8
    found = sorted(map(tuple, tokenfile.read_tokens(shards, folder).collect()), key=lambda r: r[1])
    assert [r[1] for r in found] == list(np.cumsum([0, *(r[2] for r in found)])[:-1])
    assert [r[0] for r in found] == [None] * 10_000 + list(range(10_000, 30_000))
