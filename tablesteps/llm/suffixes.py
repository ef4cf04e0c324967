"""Suffix arrays over numbered words, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(tokens: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` ordered by the ``depth`` numbers that follow (0 ends a text).

    Ranks are refined three numbers at a time, and only suffixes that still tie are sorted again.
    ``tokens`` needs ``depth`` + 3 zeros at its end.
    """
    order = at
    rank = np.zeros(len(at), dtype=np.int64)
    ties = np.arange(len(at))
    for step in range(0, depth, 3):
        part = order[ties]
        key = [tokens[part + step + j] for j in (2, 1, 0)]
        turn = np.lexsort((*key, rank[ties]))
        order[ties] = part[turn]
        part = order[ties]
        same = rank[ties][1:] == rank[ties][:-1]
        live = tokens[part[1:] + step] != 0
        for j in range(3):
            same &= tokens[part[1:] + step + j] == tokens[part[:-1] + step + j]
        heads = np.concatenate([[True], ~same])
        rank[ties] = ties[np.maximum.accumulate(np.where(heads, np.arange(len(ties)), 0))]
        more = np.zeros(len(ties), dtype=bool)
        more[1:] |= same & live
        more[:-1] |= same & live
        ties = ties[more]
        if not len(ties):
            break
    return order
