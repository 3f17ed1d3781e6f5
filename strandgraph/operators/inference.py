"""A model applied to a table: the hook for taggers, embedders, scorers and judges that live outside this library.

Rows stay where they are. Each worker builds the model once and is given bounded
batches; a row that the model fails on becomes a row that says so; rows that an
earlier run has finished are left out before anything is sent to a worker.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Model = Callable[[list[Any]], Sequence[Any]]

#: The model of this worker and the call it was made for; the next call replaces it.
_MODEL: dict[str, Model] = {}


def with_model_output(
    df: DataFrame,
    key: str,
    inputs: str | Sequence[str],
    make_model: Callable[[], Model],
    output: str,
    batch_rows: int = 32,
    batch_chars: int = 1 << 18,
    done: DataFrame | None = None,
) -> DataFrame:
    """key, output, error for every row of ``df``.

    ``make_model()`` gives a function from a list of inputs to as many outputs of the
    type ``output`` (a DDL type). With one input column the inputs are its values, with
    several they are dicts. It is called for at most ``batch_rows`` rows and, beyond a
    single row, ``batch_chars`` characters of strings at a time, in the order of the
    rows of a task. A null in all inputs gives a null output without a call. If a call
    raises or returns another number of outputs, its rows are tried one by one, and
    those that fail alone get a null output and the error as text. ``done`` is an
    earlier result: its rows without an error are returned as they are and not
    computed again, rows with an error are tried anew. Keys should be unique and not
    null; a null key is never taken as done.
    """
    names = [inputs] if isinstance(inputs, str) else list(inputs)
    kind = T.StructType.fromDDL(f"output {output}")["output"].dataType
    schema = T.StructType([df.schema[key], T.StructField("output", kind), T.StructField("error", T.StringType())])
    arrow = to_arrow_type(kind)
    call = uuid.uuid4().hex

    def load() -> Model:
        if call not in _MODEL:
            _MODEL.clear()
            _MODEL[call] = make_model()
        return _MODEL[call]

    def asked(model: Model, values: list[Any]) -> list[Any]:
        out = list(model(values))
        if len(out) != len(values):
            raise ValueError(f"{len(out)} outputs for {len(values)} inputs")
        return out

    def answers(values: list[Any]) -> list[tuple[Any, str | None]]:
        model = load()
        try:
            return [(value, None) for value in asked(model, values)]
        except Exception as error:  # noqa: BLE001  any failure of a model is a result
            if len(values) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
        return [answer for value in values for answer in answers([value])]

    def cut(values: list[Any], chars: list[int]) -> Iterator[list[int]]:
        part, size = [], 0
        for i, value in enumerate(values):
            if value is None:
                continue
            if part and (len(part) == batch_rows or size + chars[i] > batch_chars):
                yield part
                part, size = [], 0
            part.append(i)
            size += chars[i]
        if part:
            yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in names]
            chars = [sum(len(v) for v in row if isinstance(v, str)) for row in zip(*columns)]
            if isinstance(inputs, str):
                values = columns[0]
            else:
                values = [None if all(v is None for v in row) else dict(zip(names, row)) for row in zip(*columns)]
            outputs: list[Any] = [None] * len(values)
            errors: list[str | None] = [None] * len(values)
            for part in cut(values, chars):
                for i, (value, error) in zip(part, answers([values[i] for i in part])):
                    outputs[i], errors[i] = value, error
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(outputs, arrow), pa.array(errors, pa.string())], names=schema.names)

    if done is None:
        return df.select(key, *names).mapInArrow(run, schema)
    finished = done.where("error IS NULL").select(key, "output", F.lit(None).cast("string").alias("error"))
    rest = df.select(key, *names).join(finished.select(key), key, "left_anti")
    return rest.mapInArrow(run, schema).union(finished.join(df.select(key), key, "left_semi"))
