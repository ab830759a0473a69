"""Places of licenses, and alignments against brute force."""

import itertools
import random

import pytest

from pathloom.llm import license
from pathloom.llm.decontam import words_of

MIT = "Released under the MIT License."


@pytest.mark.parametrize("text, places", [(f"Copyright. {MIT} {MIT} End", [(1, 5), (6, 10)]), (f"{MIT} some words between them {MIT}", [(0, 4), (9, 13)]), (f"A {MIT} b {MIT} c {MIT} d", [(1, 5), (7, 11), (13, 17)]), (f"A {MIT} b", [(1, 5)])])
def test_every_adjacent_notice_is_found(text, places):
    found = license.Scanner(license.TEMPLATES).scan(words_of(text.encode()))
    assert sorted((a, b) for name, share, a, b in found if name == "MIT-notice" and share == 1) == places


def test_a_notice_with_many_inserted_words_is_still_found():
    text = "x Released a b c d e f g under the h i j MIT License y"
    assert ("MIT-notice", 1.0) in [x[:2] for x in license.Scanner(license.TEMPLATES).scan(words_of(text.encode()))]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for k, y in enumerate(b):
            row.append(before[k] + 1 if x == y else max(before[k + 1], row[-1]))
    return row[-1]


def test_alignments_are_increasing_and_never_beyond_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        template = [rng.choice(b"abcdefghijklmnop") for _ in range(rng.randrange(1, 16))]
        text = [x for x in template if rng.random() < 0.9] + [rng.choice(b"abcxyz") for _ in range(rng.randrange(5))]
        pairs = license.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))
        assert len(pairs) <= longest_common(text, template)
        if len(set(template)) == len(template) and set(text) <= set(template):  # anchors only
            assert len(pairs) == longest_common(text, template) or len(set(text)) < len(text)


def test_piles_give_the_longest_increasing_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        ys = rng.sample(range(30), rng.randrange(9))
        want = max((n for n in range(len(ys) + 1) for c in itertools.combinations(ys, n) if list(c) == sorted(c)), default=0)
        got = license.increasing(list(enumerate(ys)))
        assert len(got) == want and [y for _, y in got] == sorted(y for _, y in got)


@pytest.mark.parametrize("name", sorted(license.templates()))
def test_every_template_is_found_in_its_own_text_whatever_stands_around(name):
    scanner, rng = license.Scanner({name: license.templates()[name]}), random.Random(3)
    words = words_of(license.templates()[name].encode())
    stuffed = [w for k, w in enumerate(words) for w in ([w, b"qqqq"] if k % 3 == 0 and len(words) < 500 else [w])]
    noise = [b"lorem"] * 40
    shares = [[round(x[1], 6) for x in scanner.scan(t)] for t in (stuffed, noise + stuffed + noise, stuffed + noise + stuffed)]
    assert shares[0] == shares[1] == [1.0] and shares[2] == [1.0, 1.0]
