"""Runs of equal keys in a sorted stream of Arrow batches."""

from itertools import chain

import numpy as np


def runs(batches, limit: int):
    """``(columns, over)`` for each run of at least two rows with equal first columns.

    The stream must be sorted by its first column. A run over ``limit`` rows is handed on in
    parts as they come, each with ``over`` set, so that a task holds ``limit`` rows and one
    batch at most.
    """
    held, open_key = None, None
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(p) for p in zip(held, columns, strict=True)]
        elif held is None:
            return
        else:
            columns = held
        key, held = columns[0], None
        edges = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts, ends = np.append(0, edges), np.append(edges, len(key))
        flagged = ends - starts > limit
        if open_key is not None and key[0] == open_key:
            flagged[0] = True
        if batch is not None:
            open_key = key[-1] if flagged[-1] else None
            if not flagged[-1]:
                held = [c[starts[-1]:].copy() for c in columns]
                starts, ends, flagged = starts[:-1], ends[:-1], flagged[:-1]
        for i in np.flatnonzero(flagged | (ends - starts > 1)):
            yield [c[starts[i]:ends[i]] for c in columns], bool(flagged[i])
