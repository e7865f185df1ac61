"""The occurrence index against plain regular expressions."""

import random
import re
from collections import Counter

from quire.functions import occurrences as o

WORDS = ["alpha", "Alpha", "ALPHA", "beta", "Beta", "c++", "x", "a", "A", "b", "été", "Été", "u_1", "u_1x", "42"]
SEPARATORS = [" ", " ", " ", "  ", ". ", "! ", ": ", "\n", ", ", "-", "(", ".", "\n\t", " "]
KEYS = ["alpha", "beta", "alpha beta", "a b", "a b a", "b a", "c++", "++", "x-a", "été", "été beta", "u_1", "42", "a", "beta.", "nowhere", "a a", ""]


def texts(n=400):
    rng = random.Random(3)
    for _ in range(n):
        yield "".join(rng.choice(WORDS) + rng.choice(SEPARATORS) for _ in range(rng.randrange(30)))


def pattern(k, flags=0):
    return re.compile(rf"(?<!\w){re.escape(k)}(?!\w)", flags)


def test_counts_and_capitals_equal_patterns():
    keywords = o.Keywords(KEYS + KEYS)
    assert keywords.names == KEYS
    for x in texts():
        seen = o.Occurrences(x)
        want = {i: len(pattern(k).findall(x.lower())) for i, k in enumerate(KEYS) if k}
        assert seen.counts(keywords) == {i: n for i, n in want.items() if n}
        for k in filter(None, KEYS):
            found = [m.group() for m in pattern(k, re.I).finditer(x)]
            assert [x[a:b] for a, b in seen.uses(k)] == found
            assert seen.capitals(k) == (len(found), sum(f[:1].isupper() for f in found))


def slow_surface(x, k):
    start = re.compile(r"(?:^|[.!?:]\s+|\n\s*)$")
    found = list(pattern(k, re.I).finditer(x))
    inner = Counter(m.group() for m in found if not start.search(x[: m.start()]))
    if inner:
        first = {f: i for i, f in reversed([*enumerate(inner)])}
        return sorted(inner, key=lambda f: (f != f.lower() and not f.isupper(), -inner[f], first[f]))[0]
    caps = Counter(m.group() for m in found if m.group().isupper())
    return caps.most_common(1)[0][0] if caps else k if found else None


def test_surface_forms_equal_patterns():
    for x in texts():
        seen = o.Occurrences(x)
        for k in filter(None, KEYS):
            assert seen.surface(k) == slow_surface(x, k), (x, k)


def test_terms_of_the_best_domains():
    keywords = o.Keywords(["alpha", "beta", "été", "x"])
    got = o.lexicon_terms("The Alpha and alpha, ALPHA. Beta is beta! x", keywords, [[0, 1], [2], [3, 0]], 0.9)
    assert got == ["alpha", "beta"]
    assert o.lexicon_terms(None, keywords, [[0]], 0.25) == [] and o.lexicon_terms("none", keywords, [[0]], 0.25) == []


def test_odd_letters():
    for x in ("İstanbul istanbul", "ΣΑΣ σας", "ǅ ǆ", "ß SS"):
        seen = o.Occurrences(x)
        assert sum(map(len, seen.at.values())) == len(seen.spans)
        seen.counts(o.Keywords(["c++", "istanbul"]))
