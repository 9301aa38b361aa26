"""What the training-data operators share: reading tables, words, batches and shared folders."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows and bytes of a frame handed to an operator's Python code; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 500, 16_000_000
#: Integers stay whole numbers in pandas beside nulls.
WHOLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of ``sf_dir``; any file system that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """For applications: Arrow batches of ``BATCH_ROWS`` in this session, which keeps the
    memory of Python workers low.  Operators leave the session's settings alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def parts(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes."""
    if batch.num_rows > rows or (batch.num_rows > 1 and batch.nbytes > size):
        half = rows if batch.num_rows > rows else batch.num_rows // 2
        yield from parts(batch.slice(0, half), rows, size)
        yield from parts(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch


def joined(batches: Iterator[pa.RecordBatch], size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Successive batches as one of about ``size`` bytes; a longer text comes alone."""
    held, held_bytes = [], 0
    for batch in batches:
        for part in parts(batch, batch.num_rows, size):
            if held and held_bytes + part.nbytes > size:
                yield pa.concat_batches(held)
                held, held_bytes = [], 0
            held.append(part)
            held_bytes += part.nbytes
    if held:
        yield pa.concat_batches(held)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInPandas`` with short, never empty frames in which nullable integers keep
    every digit; frames of no rows that ``run`` yields are left out."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = (part.to_pandas(types_mapper=WHOLE.get) for batch in batches for part in parts(batch, rows))
        for pdf in run(frames):
            if len(pdf):
                yield pa.RecordBatch.from_pandas(pdf[arrow.names], schema=arrow, preserve_index=False)

    return df.mapInArrow(over, kind)


def filter_texts(df: DataFrame, keeps: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows whose ``text`` is kept; no column passes through pandas."""
    place = df.columns.index("text")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield part.filter(pa.array(keeps(part.column(place).to_pylist()), pa.bool_()))

    return df.mapInArrow(over, df.schema)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below the one that driver and executors share
    (``spark.checkpoint.dir``); all that the operators write there may go when it ends.

    On one machine, as in tests, a folder below the warehouse serves where that is unset.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not given:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{given.rstrip('/')}/{sc.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the shared folder.

    Unlike a checkpoint's, the plan read back knows the table's true size, so estimates
    don't multiply up over rounds of joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` as UTF-8; ``bytes.split`` cuts at exactly these six."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z in lower case and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def fold_of(doc_id: int, folds: int) -> int:
    """crc32 of the id as text, modulo ``folds``."""
    return zlib.crc32(str(doc_id).encode()) % folds


def fold_column(doc_id: str, folds: int):
    """``fold_of`` as a column."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds)
