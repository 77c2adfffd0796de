"""Arrow helpers: a row-wise operator adds columns to a frame without moving
any other column through a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of text that one numpy pass takes at a time; a longer text makes
# a pass of its own.
PASS_CHARS = 2_000_000


def ensure_text(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns as strings (a void column of an empty table too)."""
    return docs.withColumns({n: F.col(n).cast("string") for n in names})


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or it with underscores, such that ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str):
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def passes(texts: list[str], limit: int = PASS_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's values; a null is the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def add_columns(docs: DataFrame, text: str, schema: T.StructType,
                make: Callable[[], Callable[[list[str | None]], list[list]]]) -> DataFrame:
    """``docs`` with the columns of ``schema`` computed from ``text`` alone.

    ``make()`` runs once in each task and returns a function from a list of
    texts (nulls kept) to one list of values per new column.  A column of
    ``docs`` that has a new column's name is replaced.  No shuffle.
    """
    kept = docs.drop(*schema.names)
    out = T.StructType(kept.schema.fields + schema.fields)

    def run(batches):
        step = make()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for lo, hi in passes([t or "" for t in texts]):
                new = step(texts[lo:hi])
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                columns += [pa.array(v, type=arrow_type(f.dataType)) for v, f in zip(new, schema.fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names + schema.names)

    return kept.mapInArrow(run, out)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def record(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A batch of ``schema`` from lists or numpy arrays."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=arrow_type(f.dataType))
              for c, f in zip(columns, schema.fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)
