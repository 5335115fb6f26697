"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

BLANKS = r"[^\x20\x09-\x0D]+"
BENCHMARK_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def removed(texts: list[str | None], match: int = 35) -> list[tuple[int, int, str]]:
    """n_words, n_removed and the kept words of each text."""
    words = [re.findall(BLANKS, t or "") for t in texts]
    seen = Counter(tuple(w[i : i + match]) for w in words for i in range(len(w) - match + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - match + 1):
            if seen[tuple(w[i : i + match])] > 1:
                gone[i : i + match] = [True] * match
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text: str | None, size: int = 3) -> frozenset:
    w = re.findall(BLANKS, lower(text))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)] if w else [])


def linked(rows: list[tuple[int, str | None]], similarity: int = 90, size: int = 3) -> dict[int, tuple[int, int]]:
    """n_shingles and component of each id."""
    sets = {i: shingles(t, size) for i, t in rows}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= similarity * len(x | y):
            a, b = root(i), root(j)
            least[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def leaks(texts: list[str | None], items: list[tuple[object, str | None]], window: int = 10) -> list[tuple[int, int, list[str]]]:
    """n_words, n_hit and the sorted items of each text."""
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(BENCHMARK_WORDS, lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            if i is not None:
                windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for t in texts:
        w = re.findall(BENCHMARK_WORDS, lower(t))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit[k : k + n] = [1] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out
