import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from varimesh.llm import alignment


@pytest.fixture(scope="module")
def public():
    a, b = alignment.default_paths()
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=b)


def tokens(public, text):
    """Both encodings as (id, end) by the public libraries, or none."""
    first, second = public
    if not text:
        return [], []
    a = first.encode(" " + text, add_special_tokens=False)
    letters = {c: i for i, c in _letters().items()}
    spelled = [bytes(letters[c] for c in t) for t in a.tokens]
    ids = second.encode(text)
    pieces = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, second.id_to_piece(i)) for i in ids)]
    raw = (" " + text).encode()
    if b"".join(spelled) != raw or b"".join(pieces) != raw:
        return [], []
    return [list(zip(i, np.cumsum([len(b) for b in s]).tolist(), strict=True)) for i, s in ((a.ids, spelled), (ids, pieces))]


def _letters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def brute(public, rows):
    """Rows of the query, by loops over all links."""
    found, held = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(public, text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, i, j = [], 0, 0
        for cut in cuts:
            left, right = [], []
            while i < len(a) and a[i][1] <= cut:
                left.append(a[i][0])
                i += 1
            while j < len(b) and b[j][1] <= cut:
                right.append(b[j][0])
                j += 1
            groups.append((left, right))
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        held.update(set(links))
        found.append((doc_id, len(a), len(b), groups, links))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    for doc_id, n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        yield (doc_id, n_a, n_b, len(groups), sum(links.values()), sum(k for p, k in links.items() if held[p] == best[p[0]]), sum(k * held[p] for p, k in links.items()), digest)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_the_public_libraries(docs, public):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert plain(alignment.query(docs)) == sorted(brute(public, rows), key=str)


def test_odd_texts(spark, odd, none, public):
    more = ["a  b   c ", "   ", " ", "▁", "a▁b", "<s> x </s> <unk> <0x0A>", "tab\tnl\n\nx", "\x00nul", "=" * 997, "中文" * 50, "ﬁ Å Å", "x y　z", "é" * 101, "🙂" * 33]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    assert plain(alignment.query(df)) == sorted(brute(public, [(r.doc_id, r.text) for r in df.collect()]), key=str)
    assert plain(alignment.query(odd)) == plain(alignment.query(odd.select("doc_id", "text")))
    assert alignment.query(none).count() == 0


def test_large_groups_go_by_different_ids(public, monkeypatch):
    both = alignment.aligner(*alignment.default_paths())
    texts = ["=" * 997, "中文" * 50, "some words here", "a" * 1001 + "b" * 777]
    want = list(both(texts))
    monkeypatch.setattr(alignment, "WRITTEN_OUT", 0)
    for w, g in zip(want, both(texts), strict=True):
        assert w[:5] == g[:5] and (w[5] == g[5]).all() and (w[6] == g[6]).all()


def test_partial_counts_and_shards_of_any_size(spark, docs, monkeypatch):
    rows = alignment.align(docs).cache()
    whole = alignment.pair_counts(rows)
    want = Counter(k for r in rows.select("keys").collect() for k in r.keys)
    keys = np.array(sorted(want))
    assert whole(keys).tolist() == [want[k] for k in keys.tolist()]
    with pytest.raises(LookupError):
        whole(np.array([keys[0] + 1 if keys[0] + 1 not in want else -1]))
    import pyarrow as pa

    monkeypatch.setattr(alignment, "COLLECTED", 1000)
    monkeypatch.setattr(alignment, "HELD", 1500)
    flat = [r.keys for r in rows.select("keys").collect()]
    got = Counter()
    for batch in alignment._partial(iter([pa.RecordBatch.from_arrays([pa.array(flat, pa.list_(pa.int64()))], ["keys"])])):
        for k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[k] += n
    assert got == want
