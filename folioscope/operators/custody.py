"""Custody of source files, and the trace log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S


def ingest(arrivals: DataFrame, registry: DataFrame | None = None, content: str = "content", key: str = "file") -> DataFrame:
    """Files with their hash; a content that is registered, or came before in this batch, is a duplicate."""
    hashed = arrivals.select(key, F.octet_length(content).alias("bytes"), F.sha2(F.col(content), 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min(key).alias("first"))
    out = hashed.join(first, "hash")
    status = F.when(F.col(key) != F.col("first"), "DUPLICADO").otherwise("INGRESADO")
    if registry is not None:
        known = registry.select("hash", F.lit(True).alias("known")).distinct()
        out = out.join(known, "hash", "left")
        status = F.when(F.col("known"), "YA_REGISTRADO").otherwise(status)
    return out.select(key, "bytes", "hash", status.alias("estado"))


def with_copies(ingested: DataFrame, copies: DataFrame, content: str = "content", key: str = "file") -> DataFrame:
    """Files that were taken in, against their copies hashed anew: a copy that differs or is missing isn't taken in."""
    again = copies.select(key, F.sha2(F.col(content), 256).alias("copied"))
    both = ingested.join(again, key, "left")
    bad = (F.col("estado") == "INGRESADO") & ~F.col("hash").eqNullSafe(F.col("copied"))
    return both.withColumn("estado", F.when(bad, "COPIA_ALTERADA").otherwise(F.col("estado"))).drop("copied")


def verify(registry: DataFrame, now: DataFrame, key: str = "file") -> DataFrame:
    """Registered hashes against today's: OK, ALTERADO, NO_ENCONTRADO or NO_REGISTRADO."""
    a, b = registry.select(key, F.col("hash").alias("expected")), now.select(key, F.col("hash").alias("actual"))
    both = a.join(b, key, "full_outer")
    return both.select(key, S.first_of((F.col("expected").isNull(), "NO_REGISTRADO"), (F.col("actual").isNull(), "NO_ENCONTRADO"), (F.col("expected") != F.col("actual"), "ALTERADO"), default="OK").alias("estado"))


def custody_stats(ingested: DataFrame) -> DataFrame:
    return ingested.agg(F.count("*").alias("registros"), F.count_if(F.col("estado") == "INGRESADO").alias("unicos"), F.sum("bytes").alias("bytes"))


def weight(level: Column) -> Column:
    return S.first_of(*[(level == k, v) for k, v in P.LEVELS.items()])


def trace_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("entradas"), F.count_distinct("trace_id").alias("trazas"), *[F.count_if(F.col("level") == k).alias(k.lower()) for k in P.LEVELS])


def recent(log: DataFrame, least: str, n: int) -> DataFrame:
    """The latest n entries of at least a level, in order of time."""
    few = log.where(weight(F.col("level")) >= P.LEVELS[least]).orderBy(F.desc("moment"), F.desc("entry")).limit(n)
    return few.orderBy("moment", "entry")


def durations(log: DataFrame) -> DataFrame:
    """First and last entry of each trace, and the seconds between them."""
    d = log.groupBy("trace_id").agg(F.min("moment").alias("inicio"), F.max("moment").alias("fin"), F.count("*").alias("entradas"))
    second = lambda c: F.date_trunc("second", F.col(c))
    return d.withColumn("segundos", F.timestamp_diff("SECOND", second("inicio"), second("fin")))


def inherited(log: DataFrame, field: str) -> DataFrame:
    """An entry's own value, or else the last one of its trace."""
    w = Window.partitionBy("trace_id").orderBy("moment", "entry").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("heredado", F.last(F.nullif(F.col(field), F.lit("")), ignorenulls=True).over(w))


def lifecycle(log: DataFrame) -> DataFrame:
    """Each entry's phase in its trace: the first starts it, the last ends it, with ERROR if any entry was one."""
    w = Window.partitionBy("trace_id").orderBy("moment", "entry")
    last = F.lead("entry").over(w).isNull()
    failed = F.max(F.col("level").isin("ERROR", "CRITICAL").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    phase = S.first_of((F.row_number().over(w) == 1, "INICIO"), (last, "FIN"), default="ACTIVA")
    return log.withColumns({"fase": phase, "cierre": F.when(last, F.when(failed, "ERROR").otherwise("OK"))})


def by_trace(log: DataFrame) -> DataFrame:
    """Entries with their place in their trace."""
    return log.withColumn("paso", F.row_number().over(Window.partitionBy("trace_id").orderBy("moment", "entry")))


def changed_files(before: DataFrame, after: DataFrame, key: str, version: str) -> DataFrame:
    """Snapshot difference: NUEVO, MODIFICADO or BORRADO."""
    a, b = before.select(key, F.col(version).alias("old")), after.select(key, F.col(version).alias("new"))
    both = a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select(key, S.first_of((F.col("old").isNull(), "NUEVO"), (F.col("new").isNull(), "BORRADO"), default="MODIFICADO").alias("cambio"))
