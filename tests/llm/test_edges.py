"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for the scoring operators and every stage of the pipeline."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from varimesh.llm import quality_model, secret_scan, toxicity

DATA = "/root/testdata/sf0.001"


def by_id(df, column):
    return Counter((r["doc_id"], r[column]) for r in df.collect())


def test_toxicity(odd, none):
    lexicon = toxicity.Lexicon({"trash ": 3.0, "idio": 2.0, "same ": 1.0}, [-1.0, 1.0, 1.0, 0.0, 0.0, 0.1])
    got = by_id(toxicity.score(odd, lexicon), "score")
    assert got == Counter((r["doc_id"], lexicon.score(r["text"] or "")) for r in odd.collect())
    assert got[5, lexicon.score("Same text here with seven words inside")] == 2
    assert toxicity.score(none, lexicon).count() == 0 and toxicity.keep_clean(none, lexicon).columns == odd.columns
    kept = toxicity.keep_clean(odd, lexicon)
    assert kept.columns == odd.columns and by_id(kept, "text") == Counter((r["doc_id"], r["text"]) for r in odd.collect() if lexicon.score(r["text"] or "") < 0.5)


def test_quality_model(spark, odd, none):
    rows = [("clean words that read well and vary quite a bit here %d" % i, 1) for i in range(40)] + [("bad%%% junk### junk### junk###", 0)] * 40
    model = quality_model.learn(spark.createDataFrame(rows, "text string, label int"))
    got = quality_model.score(odd, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.collect()) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5)}) == 1 and quality_model.score(none, model).count() == 0


def test_secret_scan(odd, none):
    net = secret_scan.Network.fresh()
    net.threshold = 0.0  # every candidate counts
    got = {(r["doc_id"], r["spans"]) for r in secret_scan.scan(odd, net).collect()}
    assert (7, "") in got and len(got) == odd.select("doc_id").distinct().count()
    out = secret_scan.redact(odd, net)
    assert out.columns == odd.columns and by_id(out, "text") == Counter((r["doc_id"], None if r["text"] is None else secret_scan.masked(r["text"], net)) for r in odd.collect())
    assert secret_scan.scan(none, net).count() == 0 and secret_scan.redact(none, net).count() == 0


@pytest.mark.parametrize("name", [name for name, _ in cp.STAGES])
def test_stages(spark, odd, none, name):
    """Each stage takes odd rows and no rows; all but the last give the columns they got."""
    stage = dict(cp.STAGES)[name]
    got = stage(spark, odd, DATA)
    rows = got.collect()
    assert stage(spark, none, DATA).count() == 0
    if name == "packing":
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in odd.collect())
    else:
        assert got.columns == odd.columns and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in odd.collect()}
    if name in ("line dedup", "secret scan"):
        assert len(rows) == odd.count()
