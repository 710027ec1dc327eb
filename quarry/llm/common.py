"""What the corpus operators share: shared-folder tables, scratch names and Arrow column appenders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a batch whose texts Python holds at a time.
ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (one machine, as in tests) gets a
    temporary folder once; on a cluster that is an error, as executors would each write
    to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps read it, nothing reruns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that no later step reads, and what the driver still holds of the steps before.

    Plans, broadcasts and shuffles of a finished step stay until the driver's garbage is collected,
    and the heap grows over a chain of many steps; a collection gives both back.
    """
    for df in tables:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if file.startswith(("file:", "/")) or "://" in file:
                path = spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def unused(names: list[str], base: str) -> str:
    """``base``, lengthened until it clashes with none of ``names`` in any case."""
    low = {n.lower() for n in names}
    while base.lower() in low:
        base += "_"
    return base


def columns_but(df: DataFrame, taken: list[str]) -> list[str]:
    """Columns of ``df`` whose names don't clash (in any case) with ``taken``."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def quoted(names: list[str]) -> list:
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def with_text_columns(
    df: DataFrame,
    fields: list[T.StructField],
    maker: Callable[[], Callable[[list], list[list]]],
    text: str = "text",
    binary: bool = True,
) -> DataFrame:
    """``df`` with columns computed from its text column, batch by batch in Arrow.

    ``maker()`` runs once per task and gives a function from a list of texts (UTF-8
    bytes, or str if not ``binary``; null is None) to one list per new field. Columns
    of ``df`` that clash with a new field are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep = columns_but(df, [f.name for f in fields])
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    arrow = to_arrow_schema(schema)
    source, n = df.select(*quoted(keep), F.col(text).alias(unused(keep, "text"))), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = maker()
        for big in batches:
            for lo in range(0, big.num_rows, ROWS):
                b = big.slice(lo, ROWS)
                t = b.column(n)
                t = (t.cast(pa.binary()) if binary else t).to_pylist()
                made = [pa.array(v, type=arrow.field(n + i).type) for i, v in enumerate(fn(t))]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=arrow.names)

    return source.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string_field(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())
