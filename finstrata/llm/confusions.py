"""Characters that optical recognition takes for one another, and a spelling free of the difference.

Two readings of one word that differ only by these confusions have the same folded form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What was printed -> what is read.
CONFUSIONS = [
    ("e", "c"), ("n", "ri"), ("o", "0"), ("i", "l"), ("t", "f"), ("s", "5"), ("l", "1"), ("d", "cl"),
    ("u", "ii"), ("g", "9"), ("h", "b"), ("m", "rn"), ("b", "6"), ("w", "vv"), ("z", "2"), ("i", "1"), ("é", "c"), ("a", "@"),
    ("li", "h"),
]
# Letters that stand where a digit was printed (lower case).
DIGIT_LOOKALIKES = {"o": "0", "l": "1", "i": "1", "z": "2", "s": "5", "b": "8", "g": "9", "q": "9"}
# Each character's class by one representative; then a character that is read as a pair becomes that pair.
# Only ever one character is rewritten to a longer text, so where a confusion happened can't matter.
_FROM, _TO = "c0l1f59b62@ªéèêëíìî", "eoiitsghhzaaeeeeiii"
_WIDER = [("d", "ei"), ("u", "ii"), ("h", "ii"), ("m", "rn"), ("n", "ri"), ("w", "vv")]


def fold(text: Column) -> Column:
    """Lower case, each class of confusable characters as one representative. Line ends stay."""
    folded = F.translate(F.lower(text), _FROM, _TO)
    for single, pair in _WIDER:
        folded = F.replace(folded, F.lit(single), F.lit(pair))
    return folded


def fold_str(text: str) -> str:
    """fold() for one Python string."""
    folded = text.lower().translate(str.maketrans(_FROM, _TO))
    for single, pair in _WIDER:
        folded = folded.replace(single, pair)
    return folded
