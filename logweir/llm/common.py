"""Settings, tables and scratch data shared by the operators of this package."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import logweir
from logweir.session import configure, shared_folder

# Rows and bytes of one Arrow batch: texts may be very long, so a batch is bounded by both.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

_SHIPPED: dict[str, str] = {}

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def tuned(spark: SparkSession) -> SparkSession:
    """The session settings these operators rely on, and this library on the executors."""
    configure(spark)
    _ship(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, by way of the shared folder."""
    context = spark.sparkContext
    if _SHIPPED.get("context") == context.applicationId:
        return
    home = Path(logweir.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent))
    folder, path = pafs.FileSystem.from_uri(f"{shared_path(spark, 'code')}")
    folder.create_dir(path, recursive=True)
    with folder.open_output_stream(f"{path}/logweir.zip") as out:
        out.write(packed.getvalue())
    context.addPyFile(f"{shared_folder(spark)}/{path.rpartition('/')[2]}/logweir.zip")
    _SHIPPED["context"] = context.applicationId


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder in ``spark.checkpoint.dir``, which every executor and the driver can reach."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again: whatever came of them must be stored itself."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove_path(df.sparkSession, folder)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def pieces(rows: float, each: int) -> int:
    """Into how many pieces of about ``each`` rows ``rows`` go: a power of two."""
    return 1 << max(0, (max(1, -(-int(rows) // each)) - 1).bit_length())


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


Batches = Iterator[pa.RecordBatch]


def runs(batches: Batches) -> Iterator[list[pa.RecordBatch]]:
    """Batches sorted by ``cell``, cut so that no cell is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        cells = b["cell"].to_numpy(zero_copy_only=False)
        new = np.flatnonzero(cells != cells[-1])
        cut = int(new[-1]) + 1 if new.size else 0
        if held and (cut or cells[0] != held[-1]["cell"][-1].as_py()):
            if cut:
                held.append(b.slice(0, cut))
            yield held
            held = []
        elif cut:
            yield [b.slice(0, cut)]
        held.append(b.slice(cut))
    if held:
        yield held
