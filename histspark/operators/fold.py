"""The one ordered fold: rows of an entity in order, constant memory, state carried across Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from histspark.session import with_package

#: Output rows of one batch.
ROWS = 4096


def values(column: pa.Array) -> list:
    """The values of a column as Python ones. Texts, and structs in lists, are turned column by column: what Arrow makes of
    them one by one takes many times as long."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        inner = column.values
        names = [f.name for f in kind.value_type]
        items = [dict(zip(names, row, strict=True)) for row in zip(*[values(inner.field(i)) for i in range(len(names))], strict=True)]
        if inner.null_count:
            items = [x if there else None for x, there in zip(items, inner.is_valid().to_pylist(), strict=True)]
        ends = column.offsets.to_pylist()
        there = column.is_valid().to_pylist() if column.null_count else repeat(True)
        return [items[a:b] if has else None for a, b, has in zip(ends, ends[1:], there)]  # noqa: B905  (there may be endless)
    return column.to_pylist()


def sorted_fold(
    df: DataFrame, keys: list[str], order: list, new_state: Callable[[], object], step: Callable, schema: str, finish: Callable | None = None, taken: Iterable[str] = (), unread: Iterable[str] = (),
) -> DataFrame:
    """Fold each key's rows in order.

    Columns in ``taken`` go from a row to what the step makes of it as they are, and the step need not give them (not with
    ``finish``, whose rows come from no row of their own); those of them in ``unread`` are never turned to Python.

    ``step(state, row) -> list of output rows (dicts)`` may change ``state``, which ``new_state()`` makes per key;
    ``finish(state)`` gives the rows behind a key's last one. One shuffle on the key; a partition is read once in key order, so no key's rows are ever gathered.
    """
    spark = with_package(df.sparkSession)
    out_type: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(out_type)

    taken, unread = set(taken), set(unread)
    made = pa.schema([f for f in arrow if f.name not in taken])

    def built(rows: list[dict], source: pa.RecordBatch | None, at: list[int]) -> pa.RecordBatch:
        new = dict(zip(made.names, pa.RecordBatch.from_pylist(rows, schema=made).columns, strict=True))
        if taken:
            places = pa.array(at, pa.int64())
            new |= {c: source.column(c).take(places).cast(arrow.field(c).type) for c in arrow.names if c in taken}
        return pa.RecordBatch.from_arrays([new[c] for c in arrow.names], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows, at = None, None, [], []
        for batch in batches:
            read = [c for c in batch.schema.names if c not in unread]
            for i, row in enumerate(zip(*[values(batch.column(c)) for c in read], strict=True)):
                row = dict(zip(read, row, strict=True))
                own = tuple([row[k] for k in keys])
                if own != key or state is None:
                    rows += finish(state) if finish and state is not None else []
                    key, state = own, new_state()
                more = step(state, row)
                if more:
                    rows += more
                    at += [i] * len(more)
                if len(rows) >= ROWS:
                    yield built(rows, batch, at)
                    rows, at = [], []
            if taken and rows:  # the columns taken over are those of this batch
                yield built(rows, batch, at)
                rows, at = [], []
        rows += finish(state) if finish and state is not None else []
        if rows:
            yield built(rows, None, at)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_type)
