"""The order rule inside one bucket of cells: visits in order, each kept or dropped.

A bucket holds the first open visits of its cells. Whether a visit is kept may
hang on a visit outside the bucket that is not decided yet; such a visit stays
undecided, and so does what hangs on it. What is decided is what the scan of
all visits would decide.
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Ship the function below by value, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MICROS_PER_DAY = 86_400_000_000
LAST = np.iinfo(np.int64).max


def _match(earlier: int | None, later: int | None, near: bool, far: bool) -> bool:
    """Match of two visits of linked cells, given their moments (None: undated)."""
    if earlier is None or later is None:
        return near
    gap = abs((earlier - later) // MICROS_PER_DAY)
    return near if gap == 0 else far if gap == 1 else False


def sweep(visits: pd.DataFrame, links: pd.DataFrame, cliques: bool) -> pd.DataFrame:
    """Decided visits of a bucket: ``year``, ``cell``, ``no`` and ``kept``.

    ``visits``: year, cell, no, at, dated, ``outside`` (first open visit of
    linked cells in other buckets) and ``rest`` (first open visit of the cell
    that was not sent); both are ``LAST`` if there is none. ``links``: year,
    cell, other, near, far, both ways, inside the bucket. The visits of a cell
    are linked with each other as well.
    """
    # Cells get numbers, and the links stand in arrays ordered by cell, of a few
    # bytes each: only the links of the visit at hand become Python values.
    cells = pd.MultiIndex.from_arrays([visits["year"], visits["cell"]]).drop_duplicates()
    own_at = cells.get_indexer(pd.MultiIndex.from_arrays([links["year"], links["cell"]]))
    other_at = cells.get_indexer(pd.MultiIndex.from_arrays([links["year"], links["other"]])).astype(np.int32)
    flags = links["near"].to_numpy(dtype=np.int8) + 2 * links["far"].to_numpy(dtype=np.int8)
    there = np.flatnonzero((own_at >= 0) & (other_at >= 0))
    order = there[np.argsort(own_at[there], kind="stable")]
    starts = np.searchsorted(own_at[order], np.arange(len(cells) + 1)).tolist()
    other_at, flags = other_at[order], flags[order]
    place = cells.get_indexer(pd.MultiIndex.from_arrays([visits["year"], visits["cell"]]))
    rest = np.full(len(cells), LAST)
    rest[place] = visits["rest"].to_numpy()
    rest = rest.tolist()
    kept, open_ = defaultdict(list), defaultdict(list)
    out = []
    ordered = visits.assign(place=place).sort_values(["year", "no"])
    columns = [ordered[c].tolist() for c in ("year", "cell", "no", "at", "dated", "outside", "place")]
    for year, cell, no, at, dated, outside, own in zip(*columns):
        at = at if dated else None
        some = slice(starts[own], starts[own + 1])
        around = [(own, True, cliques)]
        around += [(other, bool(f & 1), bool(f & 2)) for other, f in zip(other_at[some].tolist(), flags[some].tolist())]
        if any(_match(a, at, near, far) for other, near, far in around for a in kept.get(other, ())):
            out.append((year, cell, no, False))
            continue
        waits = outside < no or any(
            rest[other] < no or any(_match(a, at, near, far) for a in open_.get(other, ()))
            for other, near, far in around
        )
        if waits:
            open_[own].append(at)
        else:
            kept[own].append(at)
            out.append((year, cell, no, True))
    return pd.DataFrame(out, columns=["year", "cell", "no", "kept"]).astype(
        {"year": "int32", "cell": "int64", "no": "int64", "kept": "bool"}
    )
