"""Time in proportion to the length, on two million characters of the shapes that are worst for a scan."""

import time

import pytest

from varimesh.llm import secret_scan, toxicity

N = 2_000_000
SHAPES = {
    "digits and commas": "1 " + "a," * (N // 2),
    "no spaces": "a1b" * (N // 3),
    "letters": "a" * N,
    "signs": "a_" * (N // 2) + "9",
    "hits and exceptions": "trash can trash " * (N // 16),
    "findings and candidates": "password=abcdefgh1234 Abc1Def2Ghi3Jkl4 " * (N // 40),
    "one key": "Ab1" * (N // 3),
}


@pytest.mark.parametrize("name", SHAPES)
def test_long_texts(name):
    text = SHAPES[name]
    lexicon = toxicity.Lexicon({"trash ": 3.0, "idio": 2.0}, [0.0] * 6)
    start = time.process_time()
    assert 0 <= lexicon.score(text) <= 1 and len(toxicity.patterns(text)) < 100
    base = secret_scan.base_findings(text)
    found = secret_scan.candidates(text, base)
    assert time.process_time() - start < 20
    if name == "findings and candidates":
        assert len(base) == len(found) == N // 40
    if name == "hits and exceptions":
        assert len(lexicon.hits(toxicity.folded(text))) == N // 16


def test_folding_reads_only_words_with_letters():
    assert toxicity.folded("1d10t 2024 a1 x99999 b@d $hit under_5core") == "idiot 2024 ai x99999 bad shit under_score"


def test_candidates_are_those_apart_from_findings():
    text = "x password=abcdefgh1234 Abc1Def2Ghi3Jkl4 plainwordsonlyhere camelCaseWordsHere 0123456789abcdef0/tail12345678901234"
    base = secret_scan.base_findings(text)
    got = [text[s:e] for s, e in secret_scan.candidates(text, base)]
    brute = [(m.start(), m.end()) for m in secret_scan.CANDIDATE.finditer(text)]
    brute = [text[s:e] for s, e in brute if secret_scan._keylike.search(text, s, e) and not any(a < e and s < b for a, _, b in base)]
    assert got == brute == ["Abc1Def2Ghi3Jkl4", "camelCaseWordsHere"]
