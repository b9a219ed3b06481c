"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch that a task sends back.
OUT_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: their Python need not have it.

    The archive is made in the driver's temporary folder and fetched by Spark's own means.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).parents[1]
        archive = Path(tempfile.mkdtemp(prefix="panelspark-")) / "panelspark-code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the frame has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def text_column(name: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_rows(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[..., tuple]],
) -> DataFrame:
    """One output row for each input row, computed in Arrow batches.

    ``make`` runs once per task and returns a function of the input columns that
    returns a tuple in the order of ``schema``.
    """
    arrow = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            yield from batched((one(*values) for values in zip(*columns)), arrow)

    return df.mapInArrow(run, schema)


def batched(rows, schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows (tuples) as Arrow batches of a schema."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def to_arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def spans_of(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes each, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(column).to_pylist()
    low = total = 0
    for row, size in enumerate(sizes):
        if row > low and total + (size or 0) > limit:
            yield low, row
            low, total = row, 0
        total += size or 0
    if low < len(sizes):
        yield low, len(sizes)
