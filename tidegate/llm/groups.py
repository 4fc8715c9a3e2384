"""Groups of rows that lie together in a sorted partition."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def by_group(answer: Callable[[pa.Table], pa.RecordBatch], keys: list[str]):
    """A function for mapInArrow that gives ``answer`` each run of rows with equal whole-number ``keys``."""

    def run(batches):
        held, last = [], None
        for batch in batches:
            values = np.stack([batch.column(name).to_numpy() for name in keys], 1)
            starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(1)]) if len(values) else []
            for start, stop in zip(starts, [*starts[1:], len(values)]):
                mark = tuple(values[start])
                if held and mark != last:
                    yield answer(pa.Table.from_batches(held))
                    held = []
                last = mark
                held.append(batch.slice(start, stop - start))
        if held:
            yield answer(pa.Table.from_batches(held))

    return run
