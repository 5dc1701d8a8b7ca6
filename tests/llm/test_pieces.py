"""The agenda against the sentencepiece library."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from feedspark.llm import pieces
from feedspark.llm.common import lists
from feedspark.llm.tokenizer_files import path

from .conftest import odd_documents


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=path(pieces.MODEL))


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(path(pieces.MODEL))


def texts(n):
    rng = random.Random(8)
    pool = list("ab  ▁\n\t é日本\U0001f600\x00́ſßxyz.,1") + ["the", " of", "  ", "▁▁", "x" * 5, " " * 9, "<s>", "</s>", "<0x41>"]
    return ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(n)] + ["", " ", "▁", "a" * 5000, " " * 300, "日本語" * 200]


def test_encode_equals_library(own, library):
    all_ = texts(3000)
    got = [np.frombuffer(own.encode(t), "<u4").tolist() for t in all_]
    own.check()
    assert got == library.encode(all_)


def test_decode_equals_library(own, library):
    rng = random.Random(9)
    ids = library.encode(texts(500), add_bos=True, add_eos=True)
    ids += [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32000), 29871, 259]) for _ in range(rng.randint(0, 6))] for _ in range(5000)]
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    got = own.decode(lists(offsets, pa.array(np.array(sum(ids, []), "<i4"))))
    assert got.to_pylist() == library.decode(ids)


def test_a_difference_is_an_error(own):
    own.fresh.append(("▁the", b"\0\0\0\0"))
    with pytest.raises(ValueError, match="library"):
        own.check()


def test_other_vocabularies_are_refused(tmp_path):
    whole = open(path(pieces.MODEL), "rb").read()
    assert whole.count(b"\x12\x06tok_v0\x18\x02") == 1
    other = tmp_path / "unigram.model"
    other.write_bytes(whole.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01"))
    with pytest.raises(ValueError):
        pieces.Pieces(str(other))


@pytest.mark.parametrize("folder", ["sf", "odd_dir"])
def test_query(spark, request, library, folder):
    d = request.getfixturevalue(folder)
    docs = [(r["doc_id"], r["text"] or "") for r in (odd_documents() if folder == "odd_dir" else spark.read.parquet(f"{d}/documents.parquet").collect())]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in docs:
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append(str((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))))
    got = [str((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in pieces.op13(spark, d).collect()]
    assert sorted(got) == sorted(want)


def test_large_texts_are_taken_in_small_batches():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 6, None, "b" * 9, "c"])], names=["i", "t"])
    before = pieces.BYTES_AT_ONCE
    try:
        pieces.BYTES_AT_ONCE = 7
        assert [b.num_rows for b in pieces.by_bytes(batch)] == [2, 1, 1]
    finally:
        pieces.BYTES_AT_ONCE = before
