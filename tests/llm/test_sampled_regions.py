"""Sampled segmentations: one random number a region and not one a decision; the third sample and the threshold are exact."""

import math
import re

import pytest

from pathloom.llm import pieces
from pathloom.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def test_what_a_path_leaves_takes_no_number_a_decision(monkeypatch):
    v, taken, mixed = pieces.vocabulary_of(MODEL), [], pieces.mixed
    monkeypatch.setattr(pieces, "mixed", lambda x: (taken.append(x.size), mixed(x))[1])
    found = pieces.sampled(v, [5], ["another wordlike passage of unlikely strings\n" * 200], 3)[0]
    tokens = sum(len(x[0]) for x in found)
    assert len(found) == 3 and tokens > 3 * 1400
    assert sum(taken) < tokens + 100  # one for each step of the walks; twice that with one for each decision too


def test_third_sample_and_threshold_are_exact():
    v, text, n = pieces.vocabulary_of(MODEL), "ab it", 6000
    full = pieces.sampled(v, [1], [text], 1000)[0]
    p = {x[0].tobytes(): math.exp(x[1]) for x in full}
    assert len(p) == len(full) > 3 and sum(p.values()) == pytest.approx(1) and all(x[3] == 1 for x in full)
    want = dict.fromkeys(p, 0.0)
    for a, x in p.items():
        for b, y in p.items():
            for c, z in p.items():
                if len({a, b, c}) == 3:
                    want[c] += x * y / (1 - x) * z / (1 - x - y)
    seen, weighted = dict.fromkeys(p, 0), 0.0
    for own in pieces.sampled(v, list(range(n)), [text] * n, 3):
        assert own[0][2] > own[1][2] > own[2][2] and len({x[0].tobytes() for x in own}) == 3
        assert all(math.exp(x[1]) == pytest.approx(p[x[0].tobytes()]) for x in own)
        seen[own[2][0].tobytes()] += 1
        weighted += sum(math.exp(x[1]) / x[3] for x in own)
    assert all(seen[c] / n == pytest.approx(want[c], abs=0.025) for c in p)
    assert weighted / n == pytest.approx(1, abs=0.02)


def test_few_segmentations_beside_a_long_text():
    """Small masses don't drown in the costs of the texts before them."""
    v = pieces.vocabulary_of(MODEL)
    alone = pieces.sampled(v, [7], ["able"], 100)[0]
    beside = pieces.sampled(v, [3, 7], ["long unlikely strings " * 3000, "able"], 100)[1]
    assert [x[0].tolist() for x in beside] == [x[0].tolist() for x in alone] and len(alone) > 10
    assert [y for x in beside for y in x[1:]] == pytest.approx([y for x in alone for y in x[1:]], rel=1e-9)


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a  b", "a \n b", "\n", "\n\na\n", "a▁b ▁ c", "a\0b c", "naïve 漢字\n x", "a \n", "\n "])
def test_chunks_are_those_of_the_marked_text(text):
    marked = re.findall("▁*[^▁\n]+|▁+|\n", pieces.normal(text))
    assert [c.replace(" ", "▁") for c in pieces.chunked(text)] == marked
    (ids, *_), *_ = pieces.sampled(pieces.vocabulary_of(MODEL), [1], [text], 1)[0]
    assert pieces.vocabulary_of(MODEL).decode([ids]) == [pieces.normal(text).encode()]
