"""BPE and packing against the public library and brute force."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from varimesh.llm import bpe, packing


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(bpe.default_path())


def test_encoding_equals_library(spark, docs, odd, lib):
    for df in (docs.select("doc_id", "text"), odd):
        for r in bpe.decode(bpe.encode(df)).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
            want = lib.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["ids"] == want and r["decoded"] == lib.decode(want, skip_special_tokens=False)


def test_random_texts(lib):
    v, rng = bpe.Vocabulary(bpe.default_path()), random.Random(4)
    letters = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0xA0, 0x3B1, 0x4E2D, 0x1F600, 0x2028, 0xE9, 0x300, 0xBD, 0]]
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert v.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids == packing._tokenizer(bpe.default_path()).encode(text, allowed_special="all")
        assert v.decode(v.encode(text).tolist()) == text


def test_long_word_is_linear(lib):
    v = bpe.Vocabulary(bpe.default_path())
    word = "ab" * 20000
    assert v.encode(word).tolist() == lib.encode(word, add_special_tokens=False).ids


def test_query_columns(odd, none):
    rows = bpe.query(odd).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert bpe.query(none).count() == 0


def best_fit(lengths, size):
    """Best-fit decreasing by a scan over all open bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda i: (rooms[i], i))
            rooms[i] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    lengths = rng.integers(1, size + 1, int(rng.integers(1, 300))).tolist()
    if seed % 3 == 0:
        lengths += [1] * 100
    hist = {n: lengths.count(n) for n in set(lengths)}
    used, ranks = {}, {}
    for length, first, n, per, bin0, offset in packing.plan(hist, size):
        assert first == ranks.get(length, 0)
        ranks[length] = first + n
        for k in range(n):
            used.setdefault(bin0 + k // per, []).append((offset + k % per * length, length))
    assert ranks == hist
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(size - sum(n for _, n in own) for own in used.values()) == best_fit(lengths, size)


def test_packing_query(docs, odd, none, lib):
    for df in (docs.select("doc_id", "text"), odd.where("doc_id <> 5 and doc_id is not null")):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        rows = packing.query(df).collect()
        ids = {d: [*lib.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
        by_doc, by_seq = {}, {}
        for r in rows:
            part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
            by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
            by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert set(by_doc) == set(ids)
        for d, own in by_doc.items():
            own.sort()
            assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for *_, n in own) == len(ids[d])
            assert all(n == 1024 for *_, n in own[1:]) and (len(own) == 1 or len(ids[d]) > 1024)
        for own in by_seq.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 1024
        assert len(by_seq) == len(best_fit([r["length"] for r in rows], 1024))
    assert packing.query(none).count() == 0
    assert packing.query(odd).count() >= odd.count()
