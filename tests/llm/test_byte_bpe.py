import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from varimesh.llm import byte_bpe


@pytest.fixture(scope="module")
def public():
    with open(byte_bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(public, text):
    ids = public.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(public.decode_bytes(ids)).hexdigest()


def test_query_equals_the_public_library(spark, docs, public):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = byte_bpe.query(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(public, texts[r.doc_id]), r.doc_id


def test_odd_rows_and_clashing_columns(spark, odd, none, public):
    want = sorted((r.doc_id or 0, *digests(public, r.text)) for r in odd.collect())
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.query(odd).collect())
    assert got == want
    assert byte_bpe.query(none).count() == 0


def test_every_code_point_and_border(public):
    v = byte_bpe.ranks(byte_bpe.default_path())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(5)
    letters = np.array(list("ab ' tsre\n\t12é中🙂.,ll\x1c\x85　"))
    texts = ["".join(every[i : i + 60]) for i in range(0, len(every), 60)] + [f"a{c} b {c}{c}x1" for c in every[::41]]
    texts += ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)] + ["", "x" * 70000, " " * 5000 + "a", "ab" * 30000]
    ids, ends = v.encode_all(texts)
    raw, cuts = v.decode_all(ids, ends)
    raw = raw.tobytes()
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == public.encode_ordinary(text), text[:60]
        assert raw[cuts[k] : cuts[k + 1]].decode() == text


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        place = byte_bpe.PerfectHash(keys)
        assert place.size == n and sorted(place(keys).tolist()) == list(range(n))
        assert len(place(keys + np.uint64(1))) == n


def test_ids_as_arrays(spark, public):
    df = spark.createDataFrame([(1, "some plain text"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in byte_bpe.id_array(byte_bpe.encode(df)).collect()}
    assert got == {1: public.encode_ordinary("some plain text"), 2: []}
    cut = byte_bpe.encode(df).where("doc_id = 1").withColumn("ids", F.lit(None).cast("binary"))
    assert byte_bpe.decode(cut).first().decoded == b""
