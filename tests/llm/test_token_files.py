import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from waymark.llm import token_files as K

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_chars long"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_encode_as_whole_texts_do(tokenizer):
    rng, encode = random.Random(7), K.PieceEncoder(PATH, 1)
    parts = [*"aAbzé ÉßİΣς.,!'\"<|>/\\#019 \t\n\x1c\x85…»×÷😀語‍$%", "̱", "́", "H̱", "　", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "'S", "'ll", "..", "a.", "1.", "É.", "a.b", "x,,y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    for text, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == ids_of(tokenizer, text), ascii(text)


def expected(tokenizer, rows):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(tokenizer, text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_over_files(spark, tokenizer, monkeypatch):
    rows = [(i, f"Word{i} " * (i % 50) + "end.") for i in range(3000)] + [(5000, None), (5001, ""), (5002, "long " * 200_000), (None, "null id")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(5)
    manifest = K.write_tokens(docs, PATH)
    got = sorted(K.read_documents(manifest).collect(), key=lambda r: r["start"])
    assert [tuple(r) for r in got] == expected(tokenizer, rows)
    # The sequences are whole and of equal length; the masks cover exactly the ids.
    sequences = K.read_sequences(spark, manifest).collect()
    assert {len(r["tokens"]) for r in sequences} == {K.SEQUENCE} == {len(r["mask"]) for r in sequences}
    assert sum(sum(r["mask"]) for r in sequences) == sum(r["n_tokens"] for r in got)


def test_repeated_rows_and_ties(spark, tokenizer):
    docs = spark.createDataFrame([(1, "same", 0), (1, "same", 0), (1, "other words", 0), (2, "x", 0)], SCHEMA)
    got = K.read_documents(K.write_tokens(docs, PATH)).collect()
    assert len(got) == 4 and len({r["start"] for r in got}) == 4
    assert sum(r["n_tokens"] for r in got) == sum(len(ids_of(tokenizer, t)) for t in ("same", "same", "other words", "x"))


def test_empty_table(spark):
    assert K.read_documents(K.write_tokens(spark.createDataFrame([], SCHEMA), PATH)).collect() == []


def test_reader_copies_nothing_within_a_batch(tmp_path):
    import pyarrow.fs as pafs

    with open(tmp_path / "x.arrow", "wb") as f:
        w = K.SequenceWriter(f, np.dtype("<u2"), length=4, rows=2)
        w.add(np.arange(21, dtype="<u2").tobytes())
        w.close()
    r = K.SequenceReader(pafs.LocalFileSystem(), str(tmp_path / "x.arrow"))
    assert r.batches == 3 and r.size == 8
    assert r.ids(3, 15).tolist() == list(range(3, 18)) and r.ids(0, 0).tolist() == []
    assert not r.batch(0).flags.owndata
