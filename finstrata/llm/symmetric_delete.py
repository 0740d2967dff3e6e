"""Bounded edit-distance lookups by symmetric deletes, ranked by a weighted Damerau-Levenshtein distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from finstrata.llm.confusions import CONFUSIONS

#: Cost of one edit; what a keyboard, a scanner or a missing accent does often costs less.
PLAIN, SWAP, CONFUSED, ACCENT = 1.0, 0.8, 0.4, 0.2
_ACCENTS = dict(zip("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿæœß", "aaaaaaceeeeiiiinoooooouuuuyyaos"))
#: ª stands for an @ within a word, see page_noise.
_CONFUSED = {frozenset(p) for p in CONFUSIONS if len(p[0]) == len(p[1]) == 1} | {frozenset("aª")}
#: (one character, two characters), whichever of them was printed
_PAIRS = {(a, b) for a, b in CONFUSIONS if len(b) == 2} | {(b, a) for a, b in CONFUSIONS if len(a) == 2}


def deletes(text: str, most: int) -> set[str]:
    """text and every text that is left of it when up to `most` characters are deleted."""
    found = last = {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        found = found | last
    return found


def substitution(a: str, b: str) -> float:
    if a == b:
        return 0.0
    if _ACCENTS.get(a, a) == _ACCENTS.get(b, b):
        return ACCENT
    return CONFUSED if frozenset((a, b)) in _CONFUSED else PLAIN


def weighted_distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein with the costs above; a pair read for one character counts as one confusion. most + 1 if beyond most."""
    n, m = len(a), len(b)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        rows[i][0] = i * PLAIN
    for j in range(1, m + 1):
        rows[0][j] = j * PLAIN
    for i in range(1, n + 1):
        row, above = rows[i], rows[i - 1]
        for j in range(1, m + 1):
            x = min(above[j - 1] + substitution(a[i - 1], b[j - 1]), above[j] + PLAIN, row[j - 1] + PLAIN)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, rows[i - 2][j - 2] + SWAP)
            if i > 1 and (b[j - 1], a[i - 2 : i]) in _PAIRS:
                x = min(x, rows[i - 2][j - 1] + CONFUSED)
            if j > 1 and (a[i - 1], b[j - 2 : j]) in _PAIRS:
                x = min(x, rows[i - 1][j - 2] + CONFUSED)
            row[j] = x
        if min(row) > most + 1:
            return most + 1
    return rows[n][m]


class SymmetricDeleteIndex:
    """entries: (text, key, weight). Small enough to be broadcast: the caller checks the number of entries."""

    def __init__(self, entries: Iterable[tuple[str, str, float]], most: int = 2):
        self.most, self.entries, self.slots = most, list(entries), defaultdict(list)
        for at, (text, _, _) in enumerate(self.entries):
            for d in deletes(text, most):
                self.slots[d].append(at)

    def lookup(self, text: str, limit: float) -> list[tuple[float, float, str]]:
        """(distance, -weight, key) of all entries within `limit`, nearest and then heaviest first."""
        most = min(self.most, max(1, int(limit + 0.999)))
        near = {at for d in deletes(text, most) for at in self.slots.get(d, ())}
        ranked = ((weighted_distance(text, self.entries[at][0], limit), -self.entries[at][2], self.entries[at][1]) for at in near)
        return sorted(x for x in ranked if x[0] <= limit)
