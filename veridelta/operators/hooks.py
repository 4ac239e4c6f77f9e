"""Models as batched hooks: one model a worker, bounded batches, each distinct input scored once, errors kept by row.

A model is given by a function that builds it; what it builds takes a list of input tuples and gives a list of values, one
for each. A batch that fails is tried again row by row, so that one bad input costs no other its value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veridelta.session import written

#: Models that this worker has built, by the call that they belong to.
_BUILT: dict[str, Callable] = {}
ERROR = "error struct<kind: string, message: string>"


def _model(call: str, build: Callable[[], Callable]):
    if call not in _BUILT:
        _BUILT.clear()  # one at a time
        _BUILT[call] = build()
    return _BUILT[call]


def tried(model: Callable, rows: list[tuple]) -> list[tuple]:
    """(value, error) of each row: the batch at once, or row by row where that fails or gives too few values."""
    try:
        values = list(model(rows))
        if len(values) != len(rows):
            raise ValueError(f"{len(values)} values for {len(rows)} inputs")
        return [(v, None) for v in values]
    except Exception as e:  # whatever a model raises belongs to the row
        if len(rows) == 1:
            return [(None, {"kind": type(e).__name__, "message": str(e)})]
        return [pair for row in rows for pair in tried(model, [row])]


def _calls(call: str, build: Callable, inputs: list[str], schema: pa.Schema, batch: int):
    def flushed(model, rows: list[tuple]) -> pa.RecordBatch:
        values, errors = zip(*tried(model, rows))
        columns = [*zip(*rows), values, errors]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def calls(batches):
        model, waiting = _model(call, build), []
        for table in batches:
            for row in zip(*(table.column(n).to_pylist() for n in inputs)):
                waiting.append(row)
                if len(waiting) == batch:
                    yield flushed(model, waiting)
                    waiting = []
        if waiting:
            yield flushed(model, waiting)

    return calls


def scored(df: DataFrame, inputs: list[str], build: Callable[[], Callable], kind: str, name: str = "value", batch: int = 64) -> DataFrame:
    """``df`` with ``name``, of the type ``kind``, and ``error``: a model's value for the columns ``inputs``.

    Only distinct inputs are scored, in batches of ``batch`` that may span Arrow's; the values are written once, so that no
    model is called again, and joined back. Nulls are inputs like others. A row whose input failed has a null value;
    ``records.split_errors`` and ``raise_failures`` part these from the rest."""
    columns = [f"__in{k}" for k in range(len(inputs))]
    asked = df.select(*(F.col(c).alias(n) for c, n in zip(inputs, columns))).distinct()
    schema = StructType([*asked.schema, *StructType.fromDDL(f"value {kind}, {ERROR}")])
    calls = _calls(uuid.uuid4().hex, build, columns, to_arrow_schema(schema), batch)
    values = written(asked.mapInArrow(calls, schema), "scored")
    same: Column = F.xxhash64(*(df[c] for c in inputs)) == F.xxhash64(*columns)
    for c, n in zip(inputs, columns):
        same = same & df[c].eqNullSafe(F.col(n))
    return df.join(values.withColumnsRenamed({"value": "__value", "error": "__error"}), same, "left").select(
        *(df[c] for c in df.columns), F.col("__value").alias(name), F.col("__error").alias("error")
    )
