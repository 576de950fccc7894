"""Notes and invoices made of the delivery lines, as cells and as words on pages, read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents
from ..sources import tables
from .registry import register
from .views import using

#: Tasks of words for one of lines, which have nine each.
WORD_TASKS = 3
_SENT = "CASE WHEN k = 2 THEN requested_qty WHEN line_no % 3 = 0 THEN 0 WHEN line_no % 3 = 1 THEN requested_qty ELSE requested_qty // 2 END"


@register(using("dn", f"""SELECT 'file' || dn_no AS file, line_no + 9 AS row, CASE k WHEN 2 THEN 'KIT' || product_id ELSE 'P' || product_id END AS sku, CASE k WHEN 2 THEN 'kit ' || product_id ELSE 'a thing' END AS description, requested_qty,
    {_SENT} AS sent_qty, CASE k WHEN 0 THEN 'SM-' || dn_no || '/A' WHEN 1 THEN '900000' || dn_no END AS number, CASE k WHEN 2 THEN NULL ELSE branch END AS branch, CASE k WHEN 2 THEN NULL ELSE doc_date END AS doc_date
    FROM (SELECT *, dn_no % 3 AS k FROM dn) WHERE requested_qty > 0"""))
def documents_from_cells(spark, sf_dir):
    """Each note a file: with a labelled number and headers of one kind, with a bare number and others, or as an invoice."""
    lines, heads = tables.delivery_lines(spark, sf_dir, product=False), tables.notes(spark, sf_dir).select("dn_no", "branch", "doc_date")
    k, text = F.col("dn_no") % 3, lambda c: F.col(c).cast("string")
    file = F.concat(F.lit("file"), text("dn_no")).alias("file")
    of = lambda *kinds: F.when(k == 0, F.array(*kinds[0])).when(k == 1, F.array(*kinds[1])).otherwise(F.array(*kinds[2]))
    lit = lambda *values: [F.lit(v).cast("string") for v in values]
    code, asked = F.concat(F.lit(" P"), text("product_id")), text("requested_qty")
    sent = F.when(F.col("line_no") % 3 == 0, "").when(F.col("line_no") % 3 == 1, (F.col("requested_qty") + 5).cast("string")).otherwise(F.floor(F.col("requested_qty") / 2).cast("string"))
    cells = of([code, *lit("a thing"), asked, sent], [code, asked, sent, *lit("a thing")], [text("line_no"), F.concat(text("line_no"), F.lit(". Model: kit "), text("product_id")), F.concat(asked, F.lit("sets"))])
    body = lines.select(file, (F.col("line_no") + 9).cast("long").alias("row"), cells.alias("cells"))
    number = F.when(k == 0, F.concat(F.lit("SM-"), text("dn_no"), F.lit("/A"))).otherwise(F.concat(F.lit("900000"), text("dn_no")))
    slashed = F.date_format("doc_date", "d/M/yyyy")
    top = [
        of([F.concat(F.lit("Stock  Movement No: "), number)], [F.concat(F.lit("Date: "), F.date_format("doc_date", "yyyy-MM-dd")), *lit(None)], lit("An invoice")),
        of([*lit("Receiving branch", ""), F.col("branch")], [F.concat(F.lit("Destination: "), F.col("branch"))], lit("")),
        of([*lit("Dated"), slashed], [*lit(""), number], lit(None, "", "")),
        of(lit("Item Code", "Description", "Order Qty", "Dispatched"), lit("SKU", "Req. Qty", "Sent", "Name"), lit("No", "Description", "QTY (set)")),
    ]
    sheets = heads.join(lines.select("dn_no").distinct(), "dn_no", "left_semi").select(file, F.posexplode(F.array(*top)).alias("row", "cells"))
    return documents.from_cells(sheets.withColumn("row", F.col("row").cast("long")).unionByName(body))


@register(using("dn", """SELECT file, row, sku, description, requested_qty, sent_qty FROM (
    SELECT 'note' || dn_no AS file, ((n - 1) // 4 + 1) * 1000000 + (n - 1) % 4 + CASE WHEN n <= 4 THEN 2 ELSE 1 END AS row, 'P' || product_id || '-X' AS sku, 'a thing no. ' || product_id AS description, requested_qty,
      CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN requested_qty ELSE requested_qty // 2 END AS sent_qty, ROW_NUMBER() OVER (PARTITION BY dn_no, product_id, requested_qty ORDER BY n) AS k
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dn_no ORDER BY line_no, product_id, requested_qty) AS n FROM dn)) WHERE k = 1 AND requested_qty > 0"""))
def documents_from_words(spark, sf_dir):
    """Notes of up to four lines a page as words in boxes, a little out of line; the header stands on the first page only."""
    order = Window.partitionBy("dn_no").orderBy("line_no", "product_id", "requested_qty")
    lines = tables.delivery_lines(spark, sf_dir, product=False).withColumn("n", F.row_number().over(order))
    begun = lines.filter("n = 1").select("dn_no")
    text, place = lambda c: F.col(c).cast("string"), (F.col("n") - 1) % 4
    page = F.floor((F.col("n") - 1) / 4) + 1
    word = lambda t, x0, x1, lift: F.struct(F.concat(t).alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), F.lit(float(lift)).alias("lift"))
    sent = F.when(F.col("n") % 3 == 0, " ").when(F.col("n") % 3 == 1, (F.col("requested_qty") + 5).cast("string")).otherwise(F.floor(F.col("requested_qty") / 2).cast("string"))
    said = F.array(
        word(F.concat(F.lit("P"), text("product_id")), 10, 40, 0), word(F.lit("-X"), 41, 55, 1.5), word(text("requested_qty"), 104, 118, -2), word(F.lit("a"), 160, 168, 2),
        word(F.lit("thing"), 170, 200, 0), word(F.lit("no."), 202, 215, 1), word(text("product_id"), 220, 250, -1), word(sent, 404, 416, 2.5), word(F.lit("ok"), 520, 530, 0),
    )
    body = lines.select(F.concat(F.lit("note"), text("dn_no")).alias("file"), page.alias("page"), (F.lit(140.0) + place * 14).alias("y"), F.explode(said).alias("w"))
    top = F.array(
        word(F.lit("Item"), 10, 30, 0), word(F.lit("No"), 32, 45, 0), word(F.lit("Req."), 95, 112, 1), word(F.lit("Qty"), 114, 128, 1), word(F.lit("Description"), 190, 240, 0),
        word(F.lit("Sent"), 400, 420, -1), word(F.lit("Received"), 500, 540, 0),
    )
    head = begun.select(F.concat(F.lit("note"), text("dn_no")).alias("file"), F.lit(1).cast("long").alias("page"), F.lit(120.0).alias("y"), F.explode(top).alias("w"))
    words = body.unionByName(head).select("file", "page", "w.text", "w.x0", "w.x1", (F.col("y") + F.col("w.lift")).alias("top"), (F.col("y") + F.col("w.lift") + 10).alias("bottom"))
    tasks = WORD_TASKS * tables.tasks(tables.table(spark, sf_dir, "lineitem"))
    return documents.from_words(words, max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
