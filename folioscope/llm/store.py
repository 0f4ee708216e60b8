"""Shared working folders, eager parquet hand-offs and Hadoop file-system calls.

Everything a job writes goes below the folder that the cluster names in
``spark.checkpoint.dir``; only where that is unset (a single-machine session)
a temporary folder stands in for it.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}

#: Rows and bytes of text handed to a Python worker at once: bounds its memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small. Call before building a plan that runs Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """In a worker: give memory that is no longer used back to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_held: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None]) -> None:
    """In a worker: this operator works now, so what others remember goes. Workers outlive the stages that they serve."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    _held[name] = forget
    if others:
        trim()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    return _own_dir[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """Write df once and read it back, which cuts its lineage and survives lost executors."""
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Free what finished steps left behind.

    Spark drops the shuffles and broadcasts of a finished step, and the driver its
    plans and task records, when the driver's JVM next collects its garbage; a job
    of many small steps should not wait until its heap is full.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Exception):  # only some JVMs offer it
        gateway = spark.sparkContext._gateway
        params, kinds = gateway.new_array(jvm.Object, 1), gateway.new_array(jvm.String, 1)
        params[0], kinds[0] = gateway.new_array(jvm.String, 0), "[Ljava.lang.String;"
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", params, kinds)


def unused(table: DataFrame, name: str) -> str:
    """A column name that the table hasn't."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def integer_key(table: DataFrame, key: str) -> None:
    """Refuse keys that aren't integers, which a cast would turn into nulls."""
    kind = dict(table.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is {kind}; ids must be integers")


class FileStore:
    """The few Hadoop FileSystem calls needed on the driver, for any scheme Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        full = name if "://" in name or name.startswith("file:") else f"{self.root}/{name}".rstrip("/")
        return self.jvm.org.apache.hadoop.fs.Path(full)

    def list(self, name: str) -> list[tuple[str, int]]:
        """(path, bytes) of the files directly below name, in name order; none if it is missing."""
        at = self.path(name)
        if not self.fs.exists(at):
            return []
        return sorted((str(x.getPath().toString()), int(x.getLen())) for x in self.fs.listStatus(at) if x.isFile())

    def below(self, name: str) -> list[tuple[str, int]]:
        """(path, milliseconds since 1970 when it was written) of all files below name, at any depth."""
        at = self.path(name)
        out, left = [], self.fs.listFiles(at, True) if self.fs.exists(at) else None
        while left is not None and left.hasNext():
            x = left.next()
            out.append((str(x.getPath().toString()), int(x.getModificationTime())))
        return out

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def publish(self, source: str, target: str) -> bool:
        """Rename source to target in one step; False if target is there already."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
        options[0] = kind.NONE
        try:
            context.rename(self.path(source), self.path(target), options)
            return True
        except Exception as error:  # py4j wraps the Java exception
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
