"""Token counts of whole texts: a pre-token that is one token by itself needs no merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import KEEP, LONGEST, cuts_at_spaces, odd, pieces_of, rows_of, stretches, tokenizer

LIMIT = 512
SCHEMA = "id LONG, n_bytes LONG, n_tokens LONG"


def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that the model, given alone, encodes as exactly that one token; tried one by one."""
    tok = tokenizer(path)
    if not cuts_at_spaces(tok):
        return frozenset()
    added = {a.content for a in tok.get_added_tokens_decoder().values()}
    proven = set()
    for text, number in tok.get_vocab(with_added_tokens=False).items():
        if text not in added and [t.id for t in tok.model.tokenize(text)] == [number]:
            proven.add(text)
    return frozenset(proven)


class Counter:
    """Counts tokens; ``single`` holds the proven pre-tokens."""

    def __init__(self, path: str, single: frozenset[str]):
        self.tok, self.single = tokenizer(path), single
        self.cuts = cuts_at_spaces(self.tok)
        self.added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.memo: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def whole(self, text: str) -> int:
        """One stretch of text: proven pre-tokens count one, the model merges the others."""
        if any(a in text for a in self.added):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        total = 0
        for word, _ in self.tok.pre_tokenizer.pre_tokenize_str(text):
            if word in self.single:
                total += 1
                continue
            count = self.merged.get(word)
            if count is None:
                count = len(self.tok.model.tokenize(word))
                if len(self.merged) < KEEP and len(word) <= LONGEST:
                    self.merged[word] = count
            total += count
        return total

    def spaced(self, piece: str) -> int:
        count = self.memo.get(piece)
        if count is None:
            count = self.whole(" " + piece)
            if len(self.memo) < KEEP and len(piece) <= LONGEST:
                self.memo[piece] = count
        return count

    def count(self, text: str) -> int:
        if not self.cuts:
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        counts = list(map(self.memo.get, rest))
        if None in counts:
            if any(odd(p) for p, c in zip(rest, counts) if c is None):
                first, *rest = pieces_of(text)
                return self.whole(first) + sum(map(self.spaced, rest))
            counts = [self.spaced(p) if c is None else c for p, c in zip(rest, counts)]
        return self.whole(first) + sum(counts)


def token_counts(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: its id, n_bytes (UTF-8), n_tokens (as the tokenizers file at ``path`` gives them), over_limit.

    ``path`` must exist on every executor. A null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows stay.
    Other columns are ignored, so their names can't clash. No shuffle; memory per worker is bounded by KEEP pieces.
    """
    single = whole_tokens(path)

    def run(batches):
        counter = Counter(path, single)
        for batch in batches:
            for part in stretches(rows_of(batch, "id", "text"), 1):
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([row[0] for row in part], pa.int64()),
                    "n_bytes": pa.array([len(row[1].encode()) for row in part], pa.int64()),
                    "n_tokens": pa.array([counter.count(row[1]) for row in part], pa.int64()),
                })

    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    counted = plain.mapInArrow(run, SCHEMA)
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
