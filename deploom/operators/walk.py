"""The printed tree along single ways: which import of a package opens the next one, and on which line, in one pass over sorted rows.

The packages below a root stand along its way, and each reaches all behind it.  A walk that takes imports
in the order of their ids, and opens each package where it comes first, goes from one package to its
first import, and from there through all that stands behind; what is left lies between the two, and so on.
So what a package opens is a stretch of the way, known by its two ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Columns of a row: an import, in the order of (root, idx, id of the import).
GIVEN = ("root", "idx", "base", "edges", "nth", "cut", "cut_before", "to", "to_before")
_NONE = 1 << 62


def walker(kept: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches to their ``kept`` columns with line, depth and opened (whether the import is opened here).

    root, idx: the importer's place, idx from 0 along its root's way; base: the root's line; edges: all
    imports along the way; nth: the import's place among its importer's, from 1; to: its idx (null: on
    another root's way); ``_before``: imports of the packages before; cut: the least idx among the
    importer's imports before this one.  Only what is opened and not yet reached is held.  The function
    needs no module of this package where it runs.
    """

    def run(batches):
        root, idx, waiting = None, None, {}
        last = before = line = depth = 0
        for b in batches:
            cells = [b.column(c).fill_null(-1).to_numpy(zero_copy_only=False).tolist() for c in GIVEN]
            at, deep, opened = [], [], []
            for r, i, base, edges, nth, cut, cut_before, to, to_before in zip(*cells):
                if r != root:
                    root, idx = r, None
                    waiting = {0: (_NONE, edges, base, 0)}
                if i != idx:
                    idx = i
                    # the last place that this package opens, imports before the place behind it, its line and depth
                    last, before, line, depth = waiting.pop(i)
                if 0 <= cut <= last:
                    end, ahead = cut - 1, cut_before
                else:
                    end, ahead = last, before
                here = line + nth + before - ahead
                opens = 0 <= to <= end
                if opens:
                    waiting[to] = (end, ahead, here, depth + 1)
                at.append(here)
                deep.append(depth + 1)
                opened.append(opens)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(at, pa.int64()), pa.array(deep, pa.int64()), pa.array(opened, pa.bool_())], names=[*kept, "line", "depth", "opened"])

    return run
