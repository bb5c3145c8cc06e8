"""Declarations, syntax nodes and errors of source files, read in Arrow batches, a file at a time."""

from __future__ import annotations

import sys
from contextlib import contextmanager
from itertools import repeat

from pyspark.sql import DataFrame

from .syntax import DECLS, TOKENS, Syntax

COLUMNS = (*DECLS, *TOKENS)
#: Calls that nested syntax may take.
_DEPTH = 20_000
_NOTHING = (None,) * len(COLUMNS)


@contextmanager
def _deep():
    held = sys.getrecursionlimit()
    sys.setrecursionlimit(_DEPTH)
    try:
        yield
    finally:
        sys.setrecursionlimit(held)


def _syntax(source: str | bytes | None) -> Syntax:
    return Syntax(source.decode("utf-8", "replace") if isinstance(source, (bytes, bytearray)) else source or "")


def read_source(source: str | bytes | None) -> Syntax:
    """A file's syntax; bytes that are no UTF-8 become replacement characters."""
    with _deep():
        return _syntax(source)


def spread(files: DataFrame, key: str) -> DataFrame:
    """``files`` dealt out by ``key``: reading a file's syntax costs far more than its bytes, so few or small splits must not be few tasks."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def declarations(files: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """Per file: key, func, type, const, var, other, code, comment, basic, parsed, errors (line, column in bytes, message).

    ``text`` is a string or binary column.  A grouped declaration counts once, imports are other;
    literals are basic nodes, comment groups of declarations and fields comment nodes, all others
    code.  Counts of a file with errors are those of the parts that could be read.  A null text is an
    empty file, which is an error.
    """
    return counted(spread(files.select(key, text), key), text)


def counted(files: DataFrame, text: str, source: str | None = None) -> DataFrame:
    """``files`` without their ``text``, with what ``declarations`` counts; nulls where ``source``, a column, is not true."""
    import pyarrow as pa

    mistakes = pa.list_(pa.struct([("line", pa.int64()), ("column", pa.int64()), ("message", pa.string())]))
    kept = [c for c in files.columns if c != text]

    def run(batches):
        for b in batches:
            texts = b.column(text).to_pylist()
            wanted = b.column(source).to_pylist() if source else repeat(True)
            with _deep():
                got = [_syntax(t) if own else None for t, own in zip(texts, wanted)]
            counts = zip(*[s.numbers if s else _NOTHING for s in got]) if got else [()] * len(COLUMNS)
            parsed = pa.array([not s.errors if s else None for s in got], pa.bool_())
            errors = pa.array([[dict(zip(("line", "column", "message"), e)) for e in s.errors] if s else None for s in got], mistakes)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(c, pa.int64()) for c in counts], parsed, errors], names=[*kept, *COLUMNS, "parsed", "errors"])

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != text]
    return files.mapInArrow(run, ", ".join([*own, *(f"`{c}` bigint" for c in COLUMNS)]) + ", parsed boolean, errors array<struct<line:bigint,column:bigint,message:string>>")
