"""Run a kernel over stored series, key by key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cadence.kernels.base import BATCH_VALUES, Kernel, weight
from cadence.session import bound_arrow, keep_repartition

#: Rows of a batch that are Python values at a time; a pose takes ten times its Arrow bytes.
SLICE_ROWS = 256


def _records(batch: pa.RecordBatch) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, SLICE_ROWS):
        yield from zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns], strict=True)


def replay(df: DataFrame, keys: list[str], order: list[str], kernel: Kernel, names: dict[str, str] | None = None, carried: str = "") -> DataFrame:
    """(keys, kernel.output): the kernel's rows for each key, its input rows in the given order.

    Rows are brought together by key and sorted in the shuffle; a task then streams through its keys with one state at a
    time, so memory holds an Arrow batch, Python values of a few of its rows, as many of the rows made, and a state however
    long a series is. `names` maps kernel inputs to columns;
    `carried` declares columns that a kernel passes through before its one value.
    """
    bound_arrow(df.sparkSession)
    keep_repartition(df.sparkSession)
    column = {i: (names or {}).get(i, i) for i in kernel.inputs}
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", " + (f"{carried}, v double" if carried else kernel.output)
    inputs = [df[k].alias(f"_k{n}") for n, k in enumerate(keys)] + [df[o].alias(f"_o{n}") for n, o in enumerate(order)] + [df[column[i]].alias(f"_i{n}") for n, i in enumerate(kernel.inputs)]
    n_keys, first = len(keys), len(keys) + len(order)
    made = to_arrow_schema(StructType.fromDDL(schema))
    wide = any(pa.types.is_nested(f.type) for f in made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows, size = None, None, [], 0
        started = False

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)
            rows.clear()
            return batch

        for b in batches:
            for record in _records(b):
                now = record[:n_keys]
                if not started or now != key:
                    if started:
                        last = kernel.finish(state)
                        rows += [(*key, *r) for r in last]
                        size += sum(map(weight, last))
                    key, state, started = now, kernel.start(), True
                state, found = kernel.step(state, record[first:])
                if found:
                    rows += [(*key, *r) for r in found]
                    size += sum(map(weight, found)) if wide else 0
                if len(rows) >= 4096 or size >= BATCH_VALUES:
                    yield flush()
                    size = 0
        if started:
            rows += [(*key, *r) for r in kernel.finish(state)]
        if rows:
            yield flush()

    names_k, names_o = [f"_k{n}" for n in range(n_keys)], [f"_o{n}" for n in range(len(order))]
    return df.select(*inputs).repartition(*names_k).sortWithinPartitions(*names_k, *names_o).mapInArrow(run, schema)
