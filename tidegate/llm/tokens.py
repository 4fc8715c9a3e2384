"""Token ids of whole texts by the tokenizers library, with ids of repeated stretches remembered within a worker.

A byte-level pre-tokenizer joins a space to what follows it, if that isn't white space, and to nothing before it. So a
text may be cut before every such space; each piece then gets the ids that it has inside the text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces remembered by a worker, and the longest of them in characters; other pieces are encoded where they occur.
KEEP, LONGEST = 400_000, 64
# Characters of text handled at once, and bytes of new pieces encoded by one call: the library is fastest on few.
STEP, CALL = 1_000_000, 4_000
# Bytes of text that are split at once, and pieces whose ids are put together at once.
SLICE, TOGETHER = 8_000_000, 100_000
# A space before a character that isn't white space by any definition.
JOINED_SPACE = re.compile(r" (?=\S)")

_ENCODERS: dict[str, "Encoder"] = {}


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def cuts_at_spaces(tok) -> bool:
    """Whether texts may be cut at single spaces: plain byte-level BPE, and no added token with white space."""
    spec = json.loads(tok.to_str())
    first = spec.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    loose = any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added)
    return bool(plain and spec.get("normalizer") is None and not loose and spec["model"]["type"] == "BPE")


def odd(piece: str) -> bool:
    """Whether the text may not be cut before the space in front of this piece."""
    return not piece or piece[0].isspace()


def pieces_of(text: str) -> list[str]:
    """The text, cut wherever it may be; every piece but the first has lost its space."""
    return JOINED_SPACE.split(text)


def odd_ones(pieces: pa.Array) -> np.ndarray:
    """``odd`` of each piece, asked once for each first character."""
    coded = pc.utf8_slice_codeunits(pieces, 0, 1).dictionary_encode()
    return np.array([odd(start) for start in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all stretches of ``flat`` one after another, where each ends)."""
    ends = np.cumsum(sizes)
    # An Arrow batch has less than 2**31 bytes of text, so places fit 32 bits.
    place = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
    place += np.arange(len(place), dtype=np.int32)
    return flat[place], ends


class Encoder:
    """Encodes texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        self.cuts = cuts_at_spaces(self.tok)
        # Remembered pieces, all their ids, and where those of each piece start and how many they are.
        self.keys, self.flat = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        special = {i: a.content for i, a in self.tok.get_added_tokens_decoder().items()}
        # A character of a byte-level token stands for one byte; added tokens are literal.
        self.bytes_of = np.array([len((special[i].encode()) if i in special else (self.tok.id_to_token(i) or "")) for i in range(size)])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number for each piece) of " " + piece. Many pieces go into one call; byte lengths tell where the ids of each end."""
        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        bounds = np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
        calls = [0, *(np.flatnonzero(np.diff(bounds // CALL)) + 1).tolist(), len(pieces)]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(calls, pa.int64()), pieces), pa.scalar(" ", pa.large_string()))
        ids = np.concatenate([self.whole([f" {group.as_py()}"])[0] for group in joined])
        ends = np.cumsum(self.bytes_of[ids])
        stops = np.searchsorted(ends, bounds) + 1
        if stops[-1] > len(ends) or not np.array_equal(ends[stops - 1], bounds):
            raise ValueError("pieces don't end where tokens end")
        return ids, np.diff(stops, prepend=0)

    def found(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, numbers) of " " + piece for different pieces, none for odd ones; new pieces are remembered."""
        starts, sizes, fresh = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), ~odd_ones(pieces)
        # There are more keys than pieces as a rule, and a table of the fewer is made faster.
        place = pc.index_in(self.keys, value_set=pieces)
        hit = place.is_valid().to_numpy(zero_copy_only=False)
        place = place.drop_null().to_numpy()
        starts[place], sizes[place], fresh[place] = self.starts[hit], self.sizes[hit], False
        fresh = np.flatnonzero(fresh)
        new = pieces.take(pa.array(fresh))
        ids, numbers = self.spaced(new)
        starts[fresh] = len(self.flat) + np.cumsum(numbers) - numbers
        sizes[fresh] = numbers
        flat = np.concatenate([self.flat, ids])
        self.remember(new, flat, starts[fresh], numbers)
        return flat, starts, sizes

    def remember(self, pieces: pa.Array, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        room = KEEP - len(self.keys)
        if room <= 0:
            return
        kept = np.flatnonzero(pc.utf8_length(pieces).to_numpy() <= LONGEST)[:room]
        ids, ends = gathered(flat, starts[kept], sizes[kept])
        self.keys = pa.concat_arrays([self.keys, pieces.take(pa.array(kept))])
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - sizes[kept]])
        self.sizes = np.concatenate([self.sizes, sizes[kept]])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; arrow splits the texts and gathers equal pieces, so Python sees only new ones."""
        if not self.cuts:
            return self.whole(texts.to_pylist())
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string())
        lists = pc.split_pattern(texts, " ")
        bounds, coded = lists.offsets.to_numpy().copy(), lists.values.dictionary_encode()
        pieces, index = coded.dictionary, coded.indices.to_numpy().copy()
        del lists, coded
        first = bounds[:-1]
        heads = self.whole(pieces.take(pa.array(index[first])).to_pylist())
        index[first] = len(pieces) + np.arange(len(heads))
        strange = np.concatenate([odd_ones(pieces), np.zeros(len(heads), bool)])
        flat, starts, sizes = self.found(pieces)
        lengths = np.fromiter(map(len, heads), np.int64, len(heads))
        starts = np.concatenate([starts, len(flat) + np.cumsum(lengths) - lengths])
        sizes = np.concatenate([sizes, lengths])
        flat, out = np.concatenate([flat, *heads]), []
        runs = [0, *(np.flatnonzero(np.diff(first // TOGETHER)) + 1).tolist(), len(texts)]
        for start, stop in zip(runs, runs[1:]):
            some = index[bounds[start]:bounds[stop]]
            ids, ends = gathered(flat, starts[some], sizes[some])
            out += np.split(ids, ends[bounds[start + 1:stop] - bounds[start] - 1])
        uneven = np.unique(np.searchsorted(bounds, np.flatnonzero(strange[index]), "right") - 1)
        for number, ids in zip(uneven.tolist(), self.uneven(texts.take(pa.array(uneven)).to_pylist())):
            out[number] = ids
        return out

    def uneven(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with a space before other white space or at their end."""
        if not texts:
            return []
        lists = list(map(pieces_of, texts))
        coded = pa.array([piece for _, *rest in lists for piece in rest], pa.large_string()).dictionary_encode()
        flat, starts, sizes = self.found(coded.dictionary)
        index = coded.indices.to_numpy()
        ids, ends = gathered(flat, starts[index], sizes[index])
        stops = np.concatenate([[0], ends])[np.cumsum([len(pieces) - 1 for pieces in lists])]
        heads = self.whole([pieces[0] for pieces in lists])
        return [np.concatenate(parts) for parts in zip(heads, np.split(ids, stops[:-1]))]


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def stretches(rows: Iterable[tuple], text: int) -> Iterator[list[tuple]]:
    """Consecutive rows in lists of about STEP characters; ``text`` is the place of the text in a row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text])
        if size >= STEP:
            yield held
            held, size = [], 0
    if held:
        yield held


def slices(batch, text: str, size: int = SLICE) -> Iterator:
    """An Arrow batch in slices of about ``size`` bytes of text, of one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, size + (ends[start - 1] if start else 0))))
        yield batch.slice(start, stop - start)
        start = stop


def rows_of(batch, *columns: str) -> Iterator[tuple]:
    """Rows of an Arrow batch, few at a time, so that Python objects exist for a part of the batch only."""
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        yield from zip(*(part.column(name).to_pylist() for name in columns))
