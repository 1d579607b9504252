"""Models called from tasks: built once a worker, called with batches, a failed batch again row by row, rows that are done left out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

_BUILT: dict[str, Callable] = {}  # of one Python worker, which Spark uses for many tasks


def called(rows: DataFrame, keys: list[str], inputs: list[str], make: Callable[[], Callable[[list], list]], output: str, kind: str, batch: int = 64, done: DataFrame | None = None) -> DataFrame:
    """keys, output (of DDL type kind) and error of every row: `make()` gives a model that takes a list of inputs (tuples, if a row has several) and returns a list.

    A batch that fails is called again one row at a time, so that only rows that fail themselves have an error (and no output). done: rows with these
    keys and an output, of an earlier call, are not called again; they come back as they are.
    """
    token = uuid.uuid4().hex

    def run(batches):
        from verdance.operators.backends import _BUILT  # the worker's own: this function travels by value, with copies of what it names

        model = _BUILT.get(token) or _BUILT.setdefault(token, make())
        for b in batches:
            told, errors = [], []
            asked = list(b[inputs[0]]) if len(inputs) == 1 else list(zip(*(b[c] for c in inputs), strict=True))
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                try:
                    out = list(model(part))
                    if len(out) != len(part):
                        raise ValueError(f"{len(out)} outputs of {len(part)} inputs")
                    told += out
                    errors += [None] * len(part)
                except Exception:
                    for one in part:
                        try:
                            told.append(list(model([one]))[0])
                            errors.append(None)
                        except Exception as e:
                            told.append(None)
                            errors.append(f"{type(e).__name__}: {e}")
            yield b[keys].assign(**{output: pd.Series(told, dtype=object, index=b.index), "error": pd.Series(errors, dtype=object, index=b.index)})

    todo = rows if done is None else rows.join(done.filter(f"`{output}` is not null").select(*keys), keys, "left_anti")
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), f"`{output}` {kind}", "error string"])
    out = todo.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, schema)
    return out if done is None else out.unionByName(done.filter(f"`{output}` is not null").selectExpr(*(f"`{c}`" for c in keys), f"`{output}`", "cast(null as string) as error"))
