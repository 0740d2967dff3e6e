"""Evaluation passages inside corpus texts, found by the q-gram lemma and verified by banded alignment.

Texts and items are compared as their words (runs of a-z and 0-9 of the lower-cased text) joined by one
blank. A stretch of w characters with at most e edits shares at least w + 1 - q(e + 1) of its q-grams
with the item on diagonals at most e apart. So a text is first scanned for windows with that many
q-grams of any item; there the q-grams, as runs along a diagonal, are counted by item and by overlapping
bands of diagonals; regions of a band that meet the item's bound are aligned within the band, and reported if
they are as long as a window.

The items are a stated query set: they are broadcast in blocks of at most ITEM_BLOCK characters and
every text is scanned once a block. Long texts are cut into overlapping pieces, the overlap longer than
any item, so no shared run is lost.

Edge cases: null or empty texts and items have no regions; an item shorter than min_words words can't
leak; repeated texts each get their own rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 12
ITEM_BLOCK = 8_000_000
PIECE = 1 << 17
_BITS = 22
_P = np.uint64(0x9E3779B97F4A7C15)
#: Each byte as itself (lower case), a blank for anything that is no letter or digit, 0 as the end of a text.
_BYTES = np.full(256, 32, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _BYTES[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _BYTES[_c] = _c + 32
_BYTES[0] = 0


def plain(data: np.ndarray) -> np.ndarray:
    """Bytes of texts parted by 0 -> words parted by one blank, texts still parted by 0."""
    a = _BYTES[data]
    gap = a <= 32
    keep = ~gap | (a == 0)
    # a blank stays if it follows a word character
    keep[1:] |= (a[1:] == 32) & ~gap[:-1]
    return a[keep]


def _hashes(a: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each position on, by doubling: Q is 12 = 8 + 4."""
    with np.errstate(over="ignore"):
        p2 = _P * _P
        p4 = p2 * p2
        h = a.astype(np.uint64) + np.uint64(1)
        h2 = h[:-1] * _P + h[1:]
        h4 = h2[:-2] * p2 + h2[2:]
        h8 = h4[:-4] * p4 + h4[4:]
        h12 = h8[:-4] * p4 + h4[8:]
        return h12 ^ (h12 >> np.uint64(29))


class ItemIndex:
    """The q-grams of all items of a block."""

    def __init__(self, items: list[tuple[str, str]], min_words: int, edits: int):
        self.ids, self.texts, self.min_words, self.edits = [], [], min_words, edits
        windows = []
        for item_id, text in items:
            t = plain(np.frombuffer(text.lower().encode().replace(b"\0", b" "), np.uint8)).tobytes().strip()
            words = t.split(b" ")
            if len(words) < min_words or not t:
                continue
            ends = np.cumsum([len(w) + 1 for w in words])
            runs = np.diff(np.concatenate(([0], ends)))
            windows.append(max(Q, int(min(np.convolve(runs, np.ones(min_words, int), "valid")) - 1)))
            self.ids.append(item_id)
            self.texts.append(t)
        #: the fewest characters of min_words words of each item, and how many q-grams they keep through `edits` edits
        self.windows = np.array(windows or [Q])
        self.bounds = np.maximum(1, self.windows + 1 - Q * (edits + 1))
        self.window, self.bound = int(self.windows.min()), int(self.bounds.min())
        self.longest = max(map(len, self.texts), default=0)
        hashes, of, at, before, after = [], [], [], [], []
        for k, t in enumerate(self.texts):
            if len(t) >= Q:
                h = _hashes(np.frombuffer(t, np.uint8))
                hashes.append(h)
                of.append(np.full(len(h), k, np.int32))
                at.append(np.arange(len(h), dtype=np.int32))
                # the neighbours' hashes; at an item's ends, what differs from any neighbour is found by has_before and has_after
                before.append(np.concatenate((h[:1], h[:-1])))
                after.append(np.concatenate((h[1:], h[-1:])))
        if hashes:
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            self.hash, self.of, self.at = h[order], np.concatenate(of)[order], np.concatenate(at)[order]
            self.before, self.after = np.concatenate(before)[order], np.concatenate(after)[order]
            sizes = np.array([max(0, len(t) + 1 - Q) for t in self.texts])
            self.is_first, self.is_last = self.at == 0, self.at == sizes[self.of] - 1
            # by distinct q-gram: its first slot, and whether all its occurrences go on from, and to, one and the same q-gram
            self.grams, self.slots = np.unique(self.hash, return_index=True)
            self.counts = np.diff(np.concatenate((self.slots, [len(self.hash)])))
            alone = lambda own, edge: (np.minimum.reduceat(own, self.slots) == np.maximum.reduceat(own, self.slots)) & ~np.logical_or.reduceat(edge, self.slots)
            self.one_before, self.one_after = alone(self.before, self.is_first), alone(self.after, self.is_last)
        else:
            self.hash, self.of, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def runs(self, a: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, diagonal, first, last) of the runs of consecutive shared q-grams in windows that hold enough q-grams of any item."""
        nothing = (np.zeros(0, np.int64),) * 4
        if len(a) < Q or not len(self.hash):
            return nothing
        h = _hashes(a)
        hit = self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)]
        # windows of `window` characters hold window + 1 - Q q-grams
        width = min(self.window + 1 - Q, len(hit))
        sums = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
        starts = sums[width:] - sums[:-width] >= min(self.bound, width)
        if not starts.any():
            return nothing
        near = np.zeros(len(hit) + 1, np.int32)
        near[: len(starts)] += starts
        near[width : width + len(starts)] -= starts
        where = np.flatnonzero((np.cumsum(near[:-1]) > 0) & hit)
        gram = np.minimum(np.searchsorted(self.grams, h[where]), len(self.grams) - 1)
        known = self.grams[gram] == h[where]
        where, gram = where[known], gram[known]
        # a run goes on where text and item have the same next q-gram; the text's neighbours must be looked at as well
        looked = np.zeros(len(h) + 2, bool)
        looked[where + 1] = True
        ends = []
        for step, one, own, edge in ((-1, self.one_before, "before", "is_first"), (1, self.one_after, "after", "is_last")):
            other = h[np.clip(where + step, 0, len(h) - 1)]
            goes_on = looked[where + 1 + step]
            # where all occurrences go on like the text, no run ends: most of a shared passage
            open_ = ~(one[gram] & goes_on & (getattr(self, own)[self.slots[gram]] == other))
            at, n, lo = np.flatnonzero(open_), self.counts[gram[open_]], self.slots[gram[open_]]
            which = np.repeat(at, n)
            slot = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
            mask = getattr(self, edge)[slot] | ~goes_on[which] | (other[which] != getattr(self, own)[slot])
            which, slot = which[mask], slot[mask]
            i, p = self.of[slot].astype(np.int64), where[which]
            d = p - self.at[slot]
            order = np.lexsort((p, d, i))
            ends.append((i[order], d[order], p[order]))
        return ends[0][0], ends[0][1], ends[0][2], ends[1][2]

    def regions(self, a: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(item, text start, text end, item start, item end, edits) of each verified region of a piece."""
        item, diagonal, first, last = self.runs(a)
        if not len(item):
            return
        grams = last - first + 1
        text = a.tobytes()
        # overlapping bands: every two diagonals at most `edits` apart share one; the item is part of the key
        half = self.edits + 1
        known = set()
        for shift in range(2 if self.edits else 1):
            band = (diagonal + self.longest + shift * half) // (2 * half if self.edits else 1)
            key = item * (len(a) + 2 * self.longest + 4 * half) + band
            # a band without as many q-grams as its item's bound holds nothing
            _, group = np.unique(key, return_inverse=True)
            enough = np.bincount(group, grams)[group] >= self.bounds[item]
            order = np.flatnonzero(enough)[np.lexsort((first[enough], key[enough]))]
            if not len(order):
                continue
            k, it, p, e, g, d = key[order], item[order], first[order], last[order], grams[order], diagonal[order]
            # regions: runs of one band whose next one is less than a window away
            cut = np.flatnonzero((k[1:] != k[:-1]) | (p[1:] - e[:-1] > self.windows[it[1:]])) + 1
            todo = list(zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(k)])).tolist()))
            while todo:
                s, stop = todo.pop()
                own = int(it[s])
                if int(g[s:stop].sum()) < self.bounds[own]:
                    continue
                p0, p1 = int(p[s]), int(e[s:stop].max()) + Q
                q0, q1 = p0 - int(d[s:stop].max()), p1 - int(d[s:stop].min())
                q0, q1 = max(0, min(q0, p0 - int(d[s]))), min(len(self.texts[own]), max(q1, int(e[stop - 1]) + Q - int(d[stop - 1])))
                if stop - s == 1:
                    edits = 0
                else:
                    q0, q1 = p0 - int(d[s]), int(e[stop - 1]) + Q - int(d[stop - 1])
                    p1 = int(e[stop - 1]) + Q
                    edits = banded_distance(text[p0:p1], self.texts[own][q0:q1], self.edits * max(1, (p1 - p0) // int(self.windows[own]))) if q1 > q0 else None
                if edits is None:  # beyond the budget as a whole: its parts on either side of the widest gap may be within it
                    widest = int((p[s + 1 : stop] - e[s : stop - 1]).argmax())
                    todo += [(s, s + 1 + widest), (s + 1 + widest, stop)]
                    continue
                found = (own, *self._stretched(text, own, p0, p1, q0, q1, edits)) if p1 - p0 < self.windows[own] else (own, p0, p1, q0, q1, edits)
                if found[2] - found[1] >= self.windows[own] - self.edits and found not in known:
                    known.add(found)
                    yield found

    def _stretched(self, text: bytes, own: int, p0: int, p1: int, q0: int, q1: int, edits: int) -> tuple[int, int, int, int, int]:
        """A region shorter than a window, grown at both ends by the edits that are left to it."""
        t, left = self.texts[own], self.edits - edits
        best = None
        for right in range(max(0, left) + 1):
            p2, q2, n = grown(text, p1, t, q1, right)
            back = grown(text[: p0][-2 * self.windows[own] :][::-1], 0, t[:q0][::-1], 0, max(0, left) - right)
            x = (p0 - back[0], p2, q0 - back[1], q2, edits + n + back[2])
            best = x if best is None or x[1] - x[0] > best[1] - best[0] else best
        return best


def grown(a: bytes, p: int, b: bytes, q: int, edits: int) -> tuple[int, int, int]:
    """How far a and b go on alike from p and q with at most `edits` edits: the places they reach, and the edits that it took."""
    n = common_prefix(a, p, b, q)
    p, q = p + n, q + n
    best = (p, q, 0)
    if edits and p < len(a) and q < len(b) and a[p]:
        for x, y in ((p + 1, q + 1), (p + 1, q), (p, q + 1)):
            further = grown(a, x, b, y, edits - 1)
            if further[0] - p > 1 and further[0] > best[0]:
                best = (further[0], further[1], further[2] + 1)
    return best


def common_prefix(a: bytes, p: int, b: bytes, q: int) -> int:
    """How many characters from p in a and q in b are the same."""
    n, step = 0, 16
    while a[p + n : p + n + step] == b[q + n : q + n + step] and p + n < len(a) and q + n < len(b):
        n += min(step, len(a) - p - n, len(b) - q - n)
        step *= 2
    for x, y in zip(a[p + n : p + n + step], b[q + n : q + n + step]):
        if x != y:
            break
        n += 1
    return n


def banded_distance(a: bytes, b: bytes, most: int) -> int | None:
    """Edit distance of a and b along a band of `most` diagonals on either side; None if beyond most.

    Along each diagonal of the band, how far one gets with 0, 1, 2, ... edits.
    """
    if a == b:
        return 0
    goal = len(b) - len(a)
    if abs(goal) > most:
        return None
    reach = {0: common_prefix(a, 0, b, 0)}
    for edits in range(1, most + 1):
        last, reach = reach, {}
        for d in range(-edits, edits + 1):  # d = place in b - place in a
            p = max(last.get(d, -2) + 1, last.get(d + 1, -2) + 1, last.get(d - 1, -2))
            p = min(p, len(a), len(b) - d)
            if p >= 0 and p + d >= 0:
                reach[d] = p + common_prefix(a, p, b, p + d)
        if reach.get(goal, -1) >= len(a):
            return edits
    return None


def _whole_words(text: bytes, start: int, end: int) -> int:
    """Words of text that lie wholly within start..end."""
    part = text[start:end]
    words = len(part.split())
    if part and start > 0 and text[start - 1 : start] not in (b" ", b"\0", b"") and part[:1] != b" ":
        words -= 1
    if part and end < len(text) and text[end : end + 1] not in (b" ", b"\0", b"") and part[-1:] != b" ":
        words -= 1
    return words


def longest_run(a: bytes, p0: int, p1: int, t: bytes, q0: int, q1: int) -> int:
    """Most whole words in a row that text and item share on a diagonal of the region."""
    best = 0
    for d in range(min(p0 - q0, p1 - q1), max(p0 - q0, p1 - q1) + 1):
        # grow over the region's ends: the item may go on where the text does
        s, e = max(0, d), min(len(a), len(t) + d)
        x = np.frombuffer(a[s:e], np.uint8) == np.frombuffer(t[s - d : e - d], np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], x.view(np.int8), [0]))))
        for u, v in zip(edges[::2], edges[1::2]):
            if v - u >= 2 * 1 and s + v > p0 and s + u < p1:
                n = min(_whole_words(a, int(s + u), int(s + v)), _whole_words(t, int(s + u - d), int(s + v - d)))
                best = max(best, n)
    return best


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("item_start", pa.int32()), ("item_end", pa.int32()), ("edits", pa.int32()), ("run_words", pa.int32())])


def _pieces(text_ids: list, data: np.ndarray, ends: np.ndarray, overlap: int) -> Iterator[tuple[list, np.ndarray]]:
    """Groups of texts of about PIECE bytes; a longer text in overlapping pieces of its own."""
    start, n = 0, len(ends) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + PIECE, "right")) - 1)
        lo, hi = int(ends[start]), int(ends[stop])
        if stop == start + 1 and hi - lo > PIECE:
            step = max(PIECE - overlap, PIECE // 2)
            for at in range(lo, hi, step):
                yield [text_ids[start]], data[at : min(hi, at + max(PIECE, step + overlap))]
        else:
            yield text_ids[start:stop], np.insert(data[lo:hi], ends[start + 1 : stop] - lo, 0)
        start = stop


def leak_regions(texts: DataFrame, items: DataFrame, id_col: str = "doc_id", min_words: int = 13, edits: int = 1) -> DataFrame:
    """doc_id, item_id, the region in text and item (of their plain forms), edits, and run_words, the longest run of shared words."""
    spark = texts.sparkSession
    known = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    chars = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(chars) // ITEM_BLOCK))
    found = None
    for block in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else known
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in mine.select("item_id", "text").collect()])

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, min_words, edits)
            # whatever an item shares with a text is within a stretch this long, blanks and marks between the words included
            overlap = 4 * index.longest + 4096
            for batch in batches:
                out = []
                ids, column = batch.column(0).to_pylist(), batch.column(1)
                column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
                ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
                raw = column.buffers()[2]
                data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
                for own, piece in _pieces(ids, data, ends, overlap):
                    a = plain(piece)
                    borders = np.flatnonzero(a == 0)
                    for it, p0, p1, q0, q1, n in index.regions(a):
                        k = int(np.searchsorted(borders, p0, "right"))
                        s = int(borders[k - 1]) + 1 if k else 0
                        e = int(borders[k]) if k < len(borders) else len(a)
                        run = longest_run(a[s:e].tobytes(), p0 - s, p1 - s, index.texts[it], q0, q1)
                        out.append((own[k], index.ids[it], p0 - s, p1 - s, q0, q1, n, run))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 8, _FOUND)], schema=_FOUND)

        part = texts.where(F.col("text").isNotNull() & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("doc_id"), F.lower(F.replace("text", F.lit("\x00"), F.lit(" "))).alias("text")
        ).mapInArrow(scan, "doc_id long, item_id string, text_start int, text_end int, item_start int, item_end int, edits int, run_words int")
        found = part if found is None else found.unionByName(part)
    return found


def leaked_items(texts: DataFrame, items: DataFrame, id_col: str = "doc_id", min_words: int = 13, edits: int = 1) -> DataFrame:
    """doc_id, item_id of each pair that shares a run of at least min_words consecutive words."""
    return leak_regions(texts, items, id_col, min_words, edits).where(F.col("run_words") >= min_words).select("doc_id", "item_id").distinct()
