"""Vouchers, pages, evidence cells, findings and logs derived from the order tables.

The tables hold orders, not case files, so the queries view them as such: an order
is a voucher, its lines are the voucher's items, its customer is the case. Every
derivation is one portable SELECT, used by Spark (through parameters that name
DataFrames) and by the SQL that results are compared with. Money is decimal, so
that sums don't depend on their order; verdicts are mixed by shifting amounts by
a few cents or soles that depend on the key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RUC = "concat(CASE WHEN o_custkey % 11 = 0 THEN '30' WHEN o_custkey % 3 = 0 THEN '10' ELSE '20' END, lpad(concat(o_custkey), CASE WHEN o_custkey % 13 = 0 THEN 8 ELSE 9 END, '0'))"
SERIE = "concat(CASE o_orderkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'B' WHEN 2 THEN 'E' ELSE 'F' END, lpad(concat(o_orderkey % 7 + 1), 3, '0'))"
DAY = "concat(lpad(concat(extract(day FROM o_orderdate)), 2, '0'), '/', lpad(concat(extract(month FROM o_orderdate)), 2, '0'), '/', concat(extract(year FROM o_orderdate)))"

SQL: dict[str, str] = {}

SQL["items"] = """
    SELECT l_orderkey AS voucher, l_linenumber AS line, l_partkey AS part,
           CAST(l_quantity AS DECIMAL(18,2)) AS cantidad, CAST(l_extendedprice AS DECIMAL(18,2)) AS importe,
           CAST(l_shipdate AS DATE) AS shipped
    FROM {lineitem}"""

SQL["sums"] = """
    SELECT voucher, count(*) AS n_items, CAST(sum(importe) AS DECIMAL(18,2)) AS items FROM {items} GROUP BY voucher"""

SQL["vouchers"] = f"""
    SELECT o_orderkey AS voucher, o_custkey AS sinad, {RUC} AS ruc, {SERIE} AS serie, lpad(concat(o_orderkey), 6, '0') AS numero,
           CASE o_orderkey % 4 WHEN 0 THEN 'FACTURA' WHEN 1 THEN 'BOLETA DE VENTA' WHEN 2 THEN 'RECIBO POR HONORARIOS' ELSE 'FACTURA' END AS tipo,
           CAST(o_orderdate AS DATE) AS fecha, {DAY} AS fecha_texto, n_items, items,
           CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN CAST(items + 0.5 AS DECIMAL(18,2)) ELSE items END AS subtotal,
           CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN o_orderkey % 7 = 0 THEN CAST(round(items * 0.10, 2) AS DECIMAL(18,2))
                WHEN o_orderkey % 8 = 0 THEN CAST(round(items * 0.18, 2) + 3 AS DECIMAL(18,2)) ELSE CAST(round(items * 0.18, 2) AS DECIMAL(18,2)) END AS igv,
           CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN CAST(round(items * 1.18, 2) + 1 AS DECIMAL(18,2)) ELSE CAST(round(items * 1.18, 2) AS DECIMAL(18,2)) END AS total,
           CASE WHEN o_orderkey % 10 = 0 THEN CAST(o_orderkey % 4 AS INT) END AS noches, o_orderpriority AS prioridad,
           o_orderkey, o_custkey, o_orderdate
    FROM {{orders}} LEFT JOIN {{sums}} ON voucher = o_orderkey"""

SQL["pages"] = f"""
    SELECT o_orderkey AS page,
           CASE o_orderkey % 9
             WHEN 0 THEN concat('CONSULTA DE COMPROBANTE', chr(10), 'SUNAT', chr(10), 'Resultado de la consulta', chr(10), 'Estado: VALIDO')
             WHEN 1 THEN concat('FACTURA ELECTRÓNICA', chr(10), {SERIE}, '-', lpad(concat(o_orderkey), 6, '0'), chr(10), CASE WHEN o_orderkey % 2 = 0 THEN 'COMERCIAL LOS ANDES S.A.C.' ELSE 'Av. Lima 123' END, chr(10), 'R.U.C.: ', {RUC}, chr(10), 'FECHA DE EMISION: ', {DAY}, chr(10), 'CANT UNID DESCRIPCION', chr(10), CASE WHEN o_orderkey % 2 = 0 THEN '2 UND almuerzo ejecutivo 25.00' ELSE concat('1 UND taxi y vino 10.50', chr(10), '-----', chr(10), '2 UND IGV 1.00') END, chr(10), 'OP. GRAVADA S/ ', coalesce(concat(items), ''), chr(10), 'IGV (18%): S/ ', coalesce(concat(igv), ''), chr(10), 'IMPORTE TOTAL: S/ ', coalesce(concat(total), ''), chr(10), 'DIRECCION: Jr. Puno 45', chr(10), 'TEL 987654321', chr(10), 'CONDICION DE PAGO', chr(10), CASE o_orderkey % 4 WHEN 0 THEN 'credito a 30 dias' WHEN 1 THEN 'contado, YAPE' ELSE 'otra' END)
             WHEN 2 THEN concat('BOLETA DE VENTA', chr(10), 'Serie: B00', concat(o_orderkey % 7), ' - ', lpad(concat(o_orderkey), 7, '0'), chr(10), 'RUC ', {RUC}, chr(10), 'Fecha: ', {DAY}, chr(10), 'hotel dos noches', chr(10), 'RECARGO AL CONSUMO 10% 5.00', chr(10), 'propina 3.00', chr(10), 'ICBPER 0.50', chr(10), 'TOTAL A PAGAR S/ ', coalesce(concat(total), ''), chr(10), CASE WHEN o_orderkey % 2 = 0 THEN 'FORMA DE PAGO: EFECTIVO' ELSE 'EFECTIVO' END)
             WHEN 3 THEN concat('DECLARACION JURADA', chr(10), 'Yo declaro bajo juramento, DJ-', concat(o_orderkey), chr(10), 'movilidad local taxi ', {DAY})
             WHEN 4 THEN concat('  ', chr(10), ' ')
             WHEN 5 THEN concat('ANEXO N 3', chr(10), 'LISTADO', chr(10), 'F001-', lpad(concat(o_orderkey), 6, '0'), chr(10), 'B002-', lpad(concat(o_orderkey + 1), 6, '0'), chr(10), 'TOTAL ', coalesce(concat(total), ''))
             WHEN 6 THEN concat('CONSULTA RUC', chr(10), 'ESTADO DEL CONTRIBUYENTE: ACTIVO', chr(10), {RUC}, chr(10), 'Fecha consulta: 1')
             WHEN 7 THEN concat('RECIBO POR HONORARIOS', chr(10), 'E001-', concat(o_orderkey), chr(10), 'Ruc: ', {RUC}, chr(10), 'almuerzo menú y vino', chr(10), 'Valor venta ', coalesce(concat(items), ''), chr(10), 'Total: ', coalesce(concat(total), ''))
             ELSE concat('Memorando ', concat(o_orderkey), ' sobre viáticos', chr(10), 'correo: area', concat(o_orderkey % 50), '@example.org', chr(10), 'www.example.org/', concat(o_orderkey)) END AS texto
    FROM {{vouchers}}"""
SQL["cells"] = """
    SELECT voucher, sinad, 'ruc_emisor' AS campo, 'ruc' AS tipo_campo, ruc AS valor, CAST((70 + voucher % 31) / 100.0 AS DECIMAL(4,2)) AS confianza, ruc AS snippet, CAST(voucher % 12 AS INT) AS pagina FROM {vouchers}
    UNION ALL SELECT voucher, sinad, 'importe_total', ' Monto ', CAST(total AS VARCHAR(30)), CAST((85 + voucher % 16) / 100.0 AS DECIMAL(4,2)), CASE WHEN voucher % 14 = 0 THEN ' ' ELSE 'IMPORTE TOTAL' END, CAST(1 + voucher % 12 AS INT) FROM {vouchers}
    UNION ALL SELECT voucher, sinad, 'fecha_emision', 'fecha', CASE WHEN voucher % 15 = 0 THEN NULL ELSE fecha_texto END, CAST((80 + voucher % 21) / 100.0 AS DECIMAL(4,2)), fecha_texto, CAST(1 + voucher % 12 AS INT) FROM {vouchers}
    UNION ALL SELECT voucher, sinad, 'descripcion', 'texto', prioridad, CAST(CASE WHEN voucher % 16 = 0 THEN 0 ELSE (60 + voucher % 40) / 100.0 END AS DECIMAL(4,2)), prioridad, CAST(1 + voucher % 12 AS INT) FROM {vouchers}"""

SQL["trace"] = """
    SELECT event_id AS entry, ts AS moment, user_id AS trace_id, event_type AS operation,
           CASE event_type WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'INFO' WHEN 'cart' THEN 'WARNING' WHEN 'purchase' THEN 'ERROR' ELSE 'CRITICAL' END AS level,
           CAST(value AS DECIMAL(18,2)) AS duration_ms
    FROM {events}"""

SQL["boxes"] = f"""
    SELECT o_custkey AS page, o_orderkey AS line, CASE o_orderkey % 6 WHEN 0 THEN 'IMPORTE TOTAL 118.00' WHEN 1 THEN concat('R.U.C. ', {RUC}) WHEN 2 THEN '10.00 1.80 11.80' WHEN 3 THEN 'gracias' ELSE concat('F001-', lpad(concat(o_orderkey), 6, '0')) END AS texto,
           CAST((o_orderkey * 37) % 1000 AS INT) AS x0, CAST((o_orderkey * 91) % 1400 AS INT) AS y0, CAST((o_orderkey * 37) % 1000 + 20 + o_orderkey % 60 AS INT) AS x1,
           CAST((o_orderkey * 91) % 1400 + 12 AS INT) AS y1, CAST((20 + o_orderkey % 80) / 100.0 AS DECIMAL(4,2)) AS conf
    FROM {{orders}}"""

SQL["outcomes"] = """
    SELECT l.doc_id, CASE l.doc_id % 4 WHEN 0 THEN 'ruc' WHEN 1 THEN 'total' WHEN 2 THEN 'fecha' ELSE 'serie_numero' END AS campo,
           CASE WHEN l.doc_id % 10 = 9 THEN 'SKIP_GT_NULL' WHEN l.doc_id % 7 = 0 THEN 'NO_EXTRAIDO' WHEN l.doc_id % 11 = 0 THEN 'MATCH_PARCIAL' WHEN l.quality = 1 THEN 'MATCH' ELSE 'ERROR' END AS resultado,
           CAST((60 + l.doc_id % 40) / 100.0 AS DECIMAL(4,2)) AS confianza
    FROM {labels} l"""

NEEDS = {name: tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", text))) for name, text in SQL.items()}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a stored one if no derivation has that name."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name], **{n: load(spark, sf_dir, n) for n in NEEDS[name]})


def with_clause(*names: str) -> str:
    """The derivations, as common table expressions in the order in which they need each other."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in SQL and name not in order:
            for n in NEEDS[name]:
                visit(n)
            order.append(name)

    for name in names:
        visit(name)
    return ",\n".join(f"{n} AS ({SQL[n].format(**{m: m for m in NEEDS[n]})})" for n in order)
