"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

A window of a benchmark item that occurs in a document with at most k edits shares at least
window + 1 - q * (k + 1) of its q-grams with the place, all within k + 1 neighbouring diagonals. So shared q-grams are
counted in diagonal bands that overlap by k; in a band with enough of them, the window at every start of the item is
counted, and one whose count is large enough is aligned with that place. The count also tells how many edits there are at
least, so windows that can't be better than the best one so far aren't aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import materialize
from .rows import computed, unused

Q, WINDOW, EDITS = 12, 64, 4
BAND = 16
# Windows of an item that are aligned before the rest of them, and windows aligned in one go.
FIRST, TOGETHER = 2, 4096
# Characters of text whose q-grams exist at once, or of one text.
PARCEL = 400_000
# Characters of benchmark text whose index a task holds at once, and slots of its first filter.
SLICE = 1_000_000
SLOTS = 22
_PRIME = 0x9E3779B97F4A7C15
_NONE = np.uint32(0xFFFFFFFF)


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """A hash for each run of ``q`` characters: runs of powers of two are put together."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    part, size = x.astype(np.uint64) + np.uint64(1), 1
    total, done = None, 0
    left = q
    while True:
        if left & 1:
            if total is None:
                total = part
            else:
                total = total[:len(total) - size] * np.uint64(pow(_PRIME, size, 1 << 64)) + part[done:done + len(total) - size]
            done += size
        left >>= 1
        if not left:
            break
        part = part[:-size] * np.uint64(pow(_PRIME, size, 1 << 64)) + part[size:]
        size *= 2
    total = total * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def budget(length: int, q: int, window: int, edits: int) -> int:
    """Edits allowed in a window of this length: in proportion, and so few that a shared q-gram is certain."""
    allowed = length * edits // window
    while allowed and length + 1 - q * (allowed + 1) < 1:
        allowed -= 1
    return allowed


def windows(length: int, window: int) -> int:
    """How many windows an item has: one at each start."""
    return max(0, length - window) + 1


@dataclass
class Index:
    """Q-grams and windows of some items. Items shorter than a q-gram have no windows; they are looked up whole."""

    ids: list
    texts: list[np.ndarray]
    q: int
    window: int
    edits: int

    def __post_init__(self):
        hashes = [gram_hashes(x, self.q) for x in self.texts]
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, int)])
        flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.hashes, self.item, self.place = flat[order], item[order], place[order]
        self.filter = np.zeros(1 << SLOTS, bool)
        self.filter[(flat >> np.uint64(64 - SLOTS)).astype(np.int64)] = True
        self.length = np.array([min(len(x), self.window) for x in self.texts], np.int64)
        self.allowed = np.array([budget(n, self.q, self.window, self.edits) for n in self.length.tolist()], np.int64)
        self.least = self.length + 1 - self.q * (self.allowed + 1)
        self.starts = np.array([windows(len(x), self.window) if len(x) >= self.q else 0 for x in self.texts], np.int64)
        self.flat = np.concatenate([*self.texts, np.zeros(1, "<u4")])
        self.origin = np.cumsum([0, *map(len, self.texts[:-1])])
        self.short: dict[int, dict[int, list[int]]] = {}
        for number, x in enumerate(self.texts):
            if 0 < len(x) < self.q:
                self.short.setdefault(len(x), {}).setdefault(int(gram_hashes(x, len(x))[0]), []).append(number)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of every shared q-gram."""
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - SLOTS)).astype(np.int64)])
        low = np.searchsorted(self.hashes, hashes[at], "left")
        count = np.searchsorted(self.hashes, hashes[at], "right") - low
        source = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(at, count), self.item[source], self.place[source]

    def regions(self, pair: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, start of a window, band, fewest edits that its count allows) where enough q-grams are shared. A pair is
        the number of a text times that of items, plus an item."""
        diagonal = at - place + (1 << 30)
        band = diagonal // BAND
        below = diagonal % BAND < self.edits
        pair, place = np.r_[pair, pair[below]], np.r_[place, place[below]]
        key = pair << 36 | np.r_[band, band[below] - 1]
        kinds, kind, count = np.unique(key, return_inverse=True, return_counts=True)
        full = count >= self.least[(kinds >> 36) % len(self.texts)]
        keep = full[kind]
        rank = (np.cumsum(full) - 1)[kind[keep]]
        flat = np.sort(rank << 32 | place[keep])
        kinds = kinds[full]
        item = (kinds >> 36) % len(self.texts)
        each = self.starts[item]
        group = np.repeat(np.arange(len(kinds)), each)
        start = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        low = np.searchsorted(flat, group << 32 | start)
        count = np.searchsorted(flat, group << 32 | (start + self.length[item[group]] - self.q + 1)) - low
        good = count >= self.least[item[group]]
        pair, item, count = (kinds >> 36)[group[good]], item[group[good]], count[good]
        fewest = -(-(self.length[item] - self.q + 1 - count).clip(0) // self.q)
        return pair, start[good], (kinds & (1 << 36) - 1)[group[good]] - (1 << 30) // BAND, fewest

    def reach(self) -> int:
        """Characters beyond a window that its alignment may look at."""
        return BAND + 3 * self.edits + 1

    def align(self, text: np.ndarray, pad: int, item: np.ndarray, start: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Fewest edits that turn each window into a part of the text near its band; ``pad`` characters lie around the text."""
        wide = self.reach()
        base = np.clip(start + band * BAND - self.edits + pad, 0, len(text) - wide - self.window - 1)
        offsets = np.arange(wide, dtype=np.int32)
        cost = np.zeros((len(item), wide), np.int32)
        final = np.full(len(item), 1 << 20)
        origin = self.origin[item] + start
        for row in range(self.window):
            active = np.minimum(origin + row, len(self.flat) - 1)
            step = cost + (self.flat[active][:, None] != text[base[:, None] + row + offsets])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - offsets, axis=1) + offsets
            ended = self.length[item] == row + 1
            if ended.any():
                final[ended] = cost[ended].min(axis=1)
        return final

    def matches(self, x: np.ndarray, pair: np.ndarray, at: np.ndarray, place: np.ndarray) -> dict[int, int]:
        """Edits of the best window of every pair of a text and an item that occurs in it."""
        pair, start, band, fewest = self.regions(pair, at, place)
        order = np.lexsort((start, fewest, pair))
        pair, start, band, fewest = pair[order], start[order], band[order], fewest[order]
        numbers, pair = np.unique(pair, return_inverse=True)
        item = numbers % len(self.texts)
        best = np.full(len(numbers), 1 << 20)
        pad = self.window + self.reach() + BAND
        text = np.concatenate([np.full(pad, _NONE), x, np.full(pad + self.window, _NONE)])
        # The most promising windows of each pair first; they rule most others out.
        heads = np.r_[0, np.flatnonzero(pair[1:] != pair[:-1]) + 1] if len(pair) else np.zeros(0, int)
        first = np.arange(len(pair)) - np.repeat(heads, np.diff(np.r_[heads, len(pair)])) < FIRST
        for some in (first, ~first):
            left = np.flatnonzero(some & (fewest < best[pair]))
            for part in np.array_split(left, max(1, len(left) // TOGETHER)):
                np.minimum.at(best, pair[part], self.align(text, pad, item[pair[part]], start[part], band[part]))
        good = best <= self.allowed[item]
        return dict(zip(numbers[good].tolist(), best[good].tolist()))

    def whole(self, joined: np.ndarray, starts: np.ndarray) -> list[set[int]]:
        """The items shorter than a q-gram that each text holds."""
        out: list[set[int]] = [set() for _ in range(len(starts) - 1)]
        for size, known in self.short.items():
            hashes = gram_hashes(joined, size)
            for at in np.flatnonzero(np.isin(hashes, np.array(list(known), np.uint64))).tolist():
                number = int(np.searchsorted(starts, at, "right")) - 1
                if number < len(out):
                    out[number].update(i for i in known[int(hashes[at])] if (joined[at:at + size] == self.texts[i]).all())
        return out

    def search(self, texts: list[str]) -> list[dict[int, int]]:
        """The items that occur in each text, with the edits of their best window."""
        out, first = [], 0
        ends = np.cumsum([len(text) for text in texts])
        while first < len(texts):
            stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PARCEL, "right")))
            out += self.search_together(texts[first:stop])
            first = stop
        return out

    def search_together(self, texts: list[str]) -> list[dict[int, int]]:
        """``search``; so many characters that never match lie between the texts that no alignment reaches another one."""
        gap = np.full(max(self.q, self.window + self.reach()), _NONE)
        each = [codes(normal(text)) for text in texts]
        joined = np.concatenate([part for x in each for part in (x, gap)] or [gap])
        starts = np.cumsum([0, *[len(x) + len(gap) for x in each]])
        at, item, place = self.hits(gram_hashes(joined, self.q))
        number = np.searchsorted(starts, at, "right") - 1
        enough = np.bincount(number, minlength=len(texts) + 1) >= (self.least.min() if len(self.least) else 1)
        keep = enough[number]
        out: list[dict[int, int]] = [{} for _ in texts]
        pairs = number[keep] * len(self.texts) + item[keep]
        for pair, edits in self.matches(joined, pairs, at[keep], place[keep]).items():
            out[pair // len(self.texts)][pair % len(self.texts)] = edits
        for found, more in zip(out, self.whole(joined, starts) if self.short else []):
            found.update(dict.fromkeys(more, 0))
        return out


def indexes(benchmark: DataFrame, id_column: str, text_column: str, q: int, window: int, edits: int, size: int = SLICE) -> Iterator[Index]:
    """Indexes of at most ``size`` characters, or of one item; the driver holds one at a time."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col(id_column).cast("long"), F.col(text_column)).filter(F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
    for key, text in rows.distinct().toLocalIterator():
        x = codes(normal(text))
        if ids and held + len(x) > size:
            yield Index(ids, texts, q, window, edits)
            ids, texts, held = [], [], 0
        ids.append(key)
        texts.append(x)
        held += len(x)
    if ids:
        yield Index(ids, texts, q, window, edits)


def leaks(docs: DataFrame, benchmark: DataFrame, *, name: str, text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
          q: int = Q, window: int = WINDOW, edits: int = EDITS, size: int = SLICE) -> DataFrame:
    """``docs`` with a column ``name``: an array of (item_id, edits) for the items of which a window occurs in the text.

    Texts are compared in lower case with white space as single spaces. A window is ``window`` characters of an item from
    any start, or the whole item if it is shorter; it occurs where at most ``edits`` characters are replaced, left out or
    put in (fewer in shorter windows, in proportion). Items below ``q`` characters occur where they stand unchanged,
    empty ones never. Null texts hold nothing; items with a null id or text are left out; repeated items count once.

    One pass over the documents without a shuffle for each ``size`` characters of benchmark. An index is about 30 bytes
    a character; that is all that is sent to the tasks.
    """
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType())]))
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))
    out = docs.withColumn(name, F.array().cast(kind))
    for number, index in enumerate(indexes(benchmark, item_column, item_text, q, window, edits, size)):
        def start(index=index):
            def make(texts):
                found = [sorted((index.ids[i], n) for i, n in match.items()) for match in index.search(texts)]
                return [pa.array([[{"item_id": i, "edits": n} for i, n in some] for some in found], arrow)]

            return make

        if number:
            out = materialize(out, "leaks")
        more = unused(out, "more")
        out = computed(out, text_column, [T.StructField(more, kind)], start).withColumn(name, F.concat(name, more)).drop(more)
    return out


def leaked_documents(docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Per row: its id, contaminated, n_items, min_edits (null without items), item_ids in order."""
    plain = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    found = leaks(plain, benchmark, name="found", text_column="text", **options)
    ids = F.array_sort(F.array_distinct(F.col("found.item_id")))
    return found.select(
        id_column, (F.size("found") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"),
        F.array_min("found.edits").alias("min_edits"), ids.alias("item_ids"),
    )
