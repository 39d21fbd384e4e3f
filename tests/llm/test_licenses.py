"""Operator 10 against the longest common subsequence of every passage, and over damaged, doubled and neighbouring notices."""

import random
import re

import pytest

from extremes.llm.licenses import TEMPLATES, Scanner, align, common_subsequence, rising

WORD = re.compile(r"[^\W_]+")
SCANNER = Scanner(TEMPLATES)
LONG = [k for k, w in SCANNER.templates.items() if len(w) >= 20]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def filler(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def names(words):
    return [h[0] for h in SCANNER.scan(" ".join(words))]


def test_common_subsequence_is_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = common_subsequence(a, b)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs) and rising([j for _, j in pairs]) == list(range(len(pairs)))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len({i for i, _ in pairs}) == len(pairs) == len(rising([j for _, j in pairs]))


@pytest.mark.parametrize("seed", range(6))
def test_nothing_that_reaches_the_coverage_is_lost(seed):
    """Texts of shuffled, halved, damaged and joined copies: a hit exactly if some passage's longest common subsequence reaches the coverage."""
    rng = random.Random(seed)
    template = [f"t{rng.randrange(9)}" for _ in range(rng.randint(4, 24))]
    scanner = Scanner({"x": " ".join(template)})
    for _ in range(40):
        words = []
        for _ in range(rng.randint(1, 5)):
            part = list(template)
            kind = rng.randrange(5)
            if kind == 0:
                rng.shuffle(part)
            elif kind == 1:
                part = part[: len(part) // 2]
            elif kind == 2:
                part = [w if rng.random() < 0.85 else "z" for w in part]
            elif kind == 3:
                part = filler(rng, rng.randint(0, 6))
            words += part
        reach, need = scanner.reach["x"], scanner.need["x"]
        best = max((lcs(template, words[i : i + reach]) for i in range(len(words))), default=0)
        hits = scanner.scan(" ".join(words))
        assert bool(hits) == (best >= need), (template, words)
        assert all(h[1] >= 0.8 - 1e-9 for h in hits) and (not hits or max(h[1] for h in hits) >= need / len(template))


@pytest.mark.parametrize("name", list(SCANNER.templates))
def test_whole_notices_have_their_names(name):
    """Alone, inside of other words, twice in a row, behind a half of itself."""
    rng, words = random.Random(name), SCANNER.templates[name]
    assert SCANNER.scan(TEMPLATES[name])[0][:2] == (name, 1.0)
    assert names(filler(rng, 30) + words + filler(rng, 30)) == [name]
    assert names(words + words) == [name, name]
    assert names(words + filler(rng, 3) + words + filler(rng, 200) + words) == [name] * 3
    got = SCANNER.scan(" ".join(words[: len(words) // 2] + words))
    assert (name, 1.0) in [h[:2] for h in got]


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15])
@pytest.mark.parametrize("name", list(SCANNER.templates))
def test_damaged_notices_have_their_names(name, share):
    """Whenever the coverage is reached and words remain that tell the notice from its siblings."""
    rng, words = random.Random(f"{name}{share}"), SCANNER.templates[name]
    for _ in range(25):
        gone = set(rng.sample(range(len(words)), int(share * len(words))))
        text = [f"z{rng.randrange(999)}" if i in gone else w for i, w in enumerate(words)]
        left = [w for i, w in enumerate(words) if i not in gone]
        if len(left) < SCANNER.need[name] or any(lcs(t, left) >= len(left) and len(t) <= len(words) and lcs(t, words) < len(words) and len(left) - lcs(t, left) < (len(words) - len(t)) / 2 for k, t in SCANNER.templates.items() if k != name):
            continue
        rest = [k for k, t in SCANNER.templates.items() if k != name and lcs(t, left) == len(left)]
        got = names(filler(rng, 20) + text + filler(rng, 20))
        assert got == [name] or (rest and len(got) == 1 and got[0] in rest), (name, got, rest)


@pytest.mark.parametrize("seed", range(8))
def test_a_notice_between_shuffled_copies_is_found(seed):
    for name in LONG:
        rng = random.Random(f"{seed}{name}")
        words = SCANNER.templates[name]
        around = [rng.sample(words, len(words)) for _ in range(2)]
        assert (name, 1.0) in [h[:2] for h in SCANNER.scan(" ".join([*around[0], *words, *around[1]]))], name


def test_siblings_side_by_side():
    pairs = [("BSD-2-Clause-text", "BSD-3-Clause-text"), ("Apache-2.0", "Apache-2.0-header"), ("GPL-2.0", "GPL-3.0"), ("LGPL-3.0", "GPL-3.0"), ("CC-BY-4.0", "CC-BY-NC-4.0"), ("CC-BY-4.0-notice", "CC-BY-SA-4.0-notice")]
    for a, b in pairs:
        rng = random.Random(a)
        for x, y in ((a, b), (b, a)):
            assert names(SCANNER.templates[x] + filler(rng, 40) + SCANNER.templates[y]) == [x, y]


def test_templates_without_words_and_none_at_all():
    assert Scanner({"a": "", "b": " -- "}).scan("any text") == [] and Scanner({}).scan("any text") == [] and SCANNER.scan(None) == []
    assert [h[0] for h in Scanner({"a": "", "b": "One two"}).scan("say ONE two")] == ["b"]
