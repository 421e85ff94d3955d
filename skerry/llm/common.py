"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Maps every byte of a UTF-8 text so that ``bytes.split`` yields its words:
#: A-Z are lower-cased, 0-9, a-z and all bytes from 0x80 stay, the rest
#: become blanks. Exact for whole code points, because every byte of a
#: non-ASCII character is 0x80 or above.
WORD_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

#: Rows and bytes per Arrow batch for operators that ship whole texts to Python.
TEXT_BATCH_ROWS = 1024
TEXT_BATCH_BYTES = 32 << 20

_OWN: dict[str, str] = {}
_PATHS: dict = {}


def words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return text.translate(WORD_FOLD).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Only where the session names none and runs on this machine alone (tests) a
    temporary folder is used; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='skerry-')}")
    return f"{base.rstrip('/')}/skerry-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: later stages reread the table after an executor is
    lost, instead of computing it again.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = (weakref.ref(table), path)
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Delete the folders of tables that :func:`cut` returned and no later step reads."""
    for table in tables:
        kept, path = _PATHS.pop(id(table), (None, None))
        if kept is not None and kept() is table:
            drop_folder(table.sparkSession, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this run through Spark's own file-system layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, in rows and in bytes.

    A plan reads these settings when it is run, which may be long after it was
    made, so they stay set for the session; smaller ones are left as they are.
    """
    for name, bound in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH_BYTES),
    ):
        now = spark.conf.get(name).rstrip("b")  # "256MB" and the like are set anew
        if not (now.isdigit() and 0 < int(now) <= bound):
            spark.conf.set(name, str(bound))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for the actions inside; the session's own
    setting afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


class Own:
    """Columns of ``df`` to hand on: ``carry`` or all, without those that clash
    (in any letter case) with the columns an operator makes.

    Inside an operator they go by the position (``names``), so that no name of
    the input meets one of the operator's.
    """

    def __init__(self, df: DataFrame, carry: Iterable[str] | None, made: Iterable[str]):
        taken = {m.lower() for m in made}
        kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]
        self.names = [f"own_{k}" for k in range(len(kept))]
        self.staged = [named(c).alias(n) for c, n in zip(kept, self.names)]
        self.restored = [F.col(n).alias(c) for c, n in zip(kept, self.names)]


def fields(df: DataFrame, names: Iterable[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
