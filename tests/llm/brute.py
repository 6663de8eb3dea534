"""Plain versions of the operators, to hold their results against."""

from __future__ import annotations

import math
from collections import Counter, defaultdict


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_classes(texts: dict[int, str | None], least: float = 0.8) -> dict[int, int]:
    """The smallest id of each id's class; compares all pairs."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        if words:
            sets[i] = Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    df = Counter(s for c in sets.values() for s in c)
    weights = {
        i: {
            s: n * (1 + 0.25 * math.log((1 + len(sets)) / (1 + df[s])) / math.log(1 + len(sets)))
            for s, n in c.items()
        }
        for i, c in sets.items()
    }
    union = Union(texts)
    for a, wa in weights.items():
        for b, wb in weights.items():
            if a < b:
                both = sum(min(w, wb[s]) for s, w in wa.items() if s in wb)
                if both / (sum(wa.values()) + sum(wb.values()) - both) >= least - 1e-9:
                    union.join(a, b)
    return {i: union.find(i) for i in texts}


def deduplicated(
    texts: dict[int, str | None], least: float = 0.8, chars: int = 5
) -> dict[int, str | None]:
    """The texts with one line kept of each class; ids ascend."""
    first = {}
    for i, text in texts.items():
        for place, line in enumerate((text or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, place))
    cut = {x: {x[k : k + chars] for k in range(len(x) - chars + 1)} for x in first}
    union = Union(first)
    lines = list(first)
    for n, a in enumerate(lines):
        for b in lines[:n]:
            both = len(cut[a] & cut[b])
            if both and both >= least * (len(cut[a]) + len(cut[b]) - both) - 1e-9:
                union.join(a, b)
    kept = defaultdict(lambda: (math.inf, 0))
    for line in lines:
        root = union.find(line)
        kept[root] = min(kept[root], first[line])
    stays = set(kept.values())
    return {
        i: None
        if text is None
        else "\n".join(
            line
            for place, line in enumerate(text.split("\n"))
            if not line.strip() or (i, place) in stays
        )
        for i, text in texts.items()
    }


def merged(symbols: list[str], merges: list[tuple[str, str]]) -> list[str]:
    """Byte-pair encoding by its definition: each merge in turn, from the left."""
    for pair in merges:
        at = 0
        while at < len(symbols) - 1:
            if (symbols[at], symbols[at + 1]) == pair:
                symbols[at : at + 2] = ["".join(pair)]
            at += 1
    return symbols
