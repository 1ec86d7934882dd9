"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_counts(text: str | None, size: int = 5) -> Counter:
    w = words(text)
    size = min(size, len(w))
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def reachable(ids: list, links: list[tuple]) -> dict:
    """The smallest id that links reach."""
    least = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                moved = True
    return least


def classes_of_rows(ids: list, pairs: list[tuple[int, int]]) -> list:
    """For every row the smallest id among the rows that linked pairs of rows reach."""
    root = reachable(list(range(len(ids))), pairs)
    least: dict = {}
    for k, r in root.items():
        least[r] = min(least.get(r, ids[k]), ids[k])
    return [least[root[k]] for k in range(len(ids))]


def near_classes(rows: list[tuple[int, str | None]], least: float = 0.8) -> list:
    sets = [shingle_counts(t) for _, t in rows]
    pairs = [(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) if similarity(a, sets[j]) >= least]
    return classes_of_rows([d for d, _ in rows], pairs)


def covered(rows: list[tuple[int | None, str | None]], size: int) -> list[list[bool]]:
    """For every row, which of its words lie in a window that a smaller doc_id has."""
    first: dict = {}
    for d, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if d is not None and first[tuple(w[k : k + size])] < d:
                gone[k : k + size] = [True] * size
        out.append(gone)
    return out


def without_repeats(rows: list[tuple], size: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256), sorted."""
    out = []
    for (d, t), gone in zip(rows, covered(rows, size), strict=True):
        kept = " ".join(w for w, g in zip(words(t), gone, strict=True) if not g)
        out.append((d, len(gone), sum(gone), sha(kept)))
    return sorted(out, key=repr)


def repeated_words(w: list[str]) -> int:
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(hit)
