"""Readers and writers of case files, logs, dimensions and scanned folders.

Parsers of PDF, OCR engines and models are plug-ins: a function from a pandas
batch to a pandas batch, given by the caller, run by mapInPandas.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The evidence cell: a value is a string, and never without where it comes from.
EVIDENCE = "struct<nombre_campo:string,valor:string,archivo:string,pagina:int,confianza:double,metodo:string,snippet:string,regla_aplicada:string,valor_normalizado:string,tipo_campo:string,status:string,bbox:array<double>,motor_ocr:string>"
VOUCHER = f"sinad string, pos int, ruc_emisor {EVIDENCE}, serie {EVIDENCE}, numero {EVIDENCE}, fecha_emision {EVIDENCE}, importe_total {EVIDENCE}, igv_monto {EVIDENCE}, subtotal {EVIDENCE}, items array<struct<descripcion:string,cantidad:string,importe:string>>"
TRACE = "timestamp timestamp, trace_id string, level string, logger string, message string, agent_id string, operation string, sinad string, context map<string,string>, duration_ms double, error string"
OCR_LINE = "doc string, page int, line_no int, texto string, x0 double, y0 double, x1 double, y1 double, confianza double, motor string"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; a temporary one only on a single machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files of a folder in name order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content").orderBy("path")


def page_texts(files: DataFrame, parse: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "path string, page int, texto string") -> DataFrame:
    """Pages of files, by a parser from (path, content) rows to rows of schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield parse(batch)

    return files.select("path", "content").mapInPandas(run, schema)


def document_texts(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """Each document's pages as one text, with its characters and words."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda p: p["t"]), "\n")
    words = F.size(F.filter(F.split("texto", r"\s+"), lambda w: w != ""))
    return pages.groupBy(doc).agg(whole.alias("texto"), F.count("*").alias("paginas")).select(doc, "paginas", "texto", F.length("texto").cast("long").alias("chars"), words.cast("long").alias("palabras"))


Engine = Callable[[dict], list[tuple[str, float, float, float, float, float]]]


def ocr_lines(images: DataFrame, engines: dict[str, Engine]) -> DataFrame:
    """Lines of images (doc, page and what the engines need) by the first engine that doesn't fail.

    An engine takes an image's row and gives (texto, x0, y0, x1, y1, confianza) tuples. An image that
    none can read has one row, without a text and an engine.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in OCR_LINE.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for image in batch.to_dict("records"):
                here = (str(image["doc"]), int(image["page"]))
                for name, engine in engines.items():
                    try:
                        rows += [(*here, n, *line, name) for n, line in enumerate(engine(image))]
                        break
                    except RuntimeError:
                        continue
                else:
                    rows.append((*here, 0, None, None, None, None, None, 0.0, None))
            yield pd.DataFrame(rows, columns=columns)

    return images.mapInPandas(run, OCR_LINE)


def sampled_ocr(images: DataFrame, engines: dict[str, Engine], pages: int = 3, angle: str | None = None) -> DataFrame:
    """Text, words and mean confidence of each document's first pages; angle: a column by which the engines turn an image first."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page"))
    few = images.withColumn("place", place).where(F.col("place") <= pages).drop("place")
    lines = ocr_lines(few if angle is None else few.withColumn("angulo", F.coalesce(F.col(angle), F.lit(0))), engines)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("texto").isNotNull(), F.struct("page", "line_no", "texto")))), lambda x: x["texto"]), "\n")
    found = lines.groupBy("doc").agg(text.alias("texto"), F.round(F.avg(F.when(F.col("texto").isNotNull(), F.col("confianza"))), 4).alias("confianza"), F.count_distinct("page").alias("muestra"))
    return found.withColumn("palabras", F.size(F.filter(F.split("texto", r"\s+"), lambda w: w != "")).cast("long"))


def read_cases(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Case files as JSON: unknown keys are dropped, missing ones are null, broken files are kept apart by _corrupt_record."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def read_log(spark: SparkSession, path: str, schema: str = TRACE, **equal: str) -> DataFrame:
    """JSON lines, without corrupt ones; equal: columns that must have a value."""
    log = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for column, value in equal.items():
        log = log.where(F.col(column) == value)
    return log


def append_log(entries: DataFrame, folder: str, time: str = "timestamp") -> None:
    """JSON lines in a folder for each day."""
    entries.withColumn("date", F.to_date(time)).write.mode("append").partitionBy("date").json(folder)


def latest_state(records: DataFrame, events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Records with the last event of each: what an update in place would have left, without rewriting a file."""
    last = events.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in columns])
    return records.join(last, key, "left")


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Result tables side by side: parquet for machines and CSV with a header for people."""
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        flat = sheet.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in sheet.dtypes])
        flat.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}.csv")


def model_answers(prompts: DataFrame, ask: Callable[[str], str], retries: int = 2) -> DataFrame:
    """Answers of a model to (id, prompt) rows, with a telemetry row's worth of columns. An answer that is no JSON is asked for again; a lost connection isn't."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import time

        for batch in batches:
            rows = []
            for key, prompt in zip(batch["id"], batch["prompt"], strict=True):
                began, answer, error, tries = time.monotonic(), None, None, 0
                while tries <= retries:
                    tries += 1
                    try:
                        answer = ask(prompt)
                        json.loads(answer[answer.index("{") : answer.rindex("}") + 1])
                        error = None
                        break
                    except ConnectionError as lost:
                        error = f"connection: {lost}"
                        break
                    except ValueError:
                        error = "json corrupto"
                rows.append((key, answer, error, tries, time.monotonic() - began))
            yield pd.DataFrame(rows, columns=["id", "answer", "error", "tries", "seconds"])

    return prompts.select(F.col("id").cast("long"), "prompt").mapInPandas(run, "id long, answer string, error string, tries int, seconds double")
