"""Uploaded files, made of the star schema's tables as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import parsed_date, parsed_int
from ..operators import files
from ..sources import tables
from ..streaming import jobs
from .registry import register
from .views import using

_MONTH_NAMES = ", ".join(f"'{m}'" for m in files.MONTHS)
#: Monthly files of each nation: some names have the year, some the days, some an unknown branch.
_NAMES = f"""SELECT branch_id, branch, m, list_element([{_MONTH_NAMES}], month(m)) || CASE WHEN month(m) % 3 = 0 THEN '' ELSE ' ' || year(m) END || ' ' ||
    CASE WHEN branch_id % 8 = 3 THEN 'ELSEWHERE' ELSE replace(branch, '_', ' ') END || CASE month(m) % 4 WHEN 0 THEN ' 1 TO 12' WHEN 1 THEN ' 5-31' ELSE '' END || ' SALES.csv' AS file
    FROM (SELECT DISTINCT branch_id, branch, CAST(date_trunc('month', doc_date) AS DATE) AS m FROM dn)"""
_READ = """SELECT file, branch_id, m, CASE WHEN branch_id % 8 <> 3 THEN 'B' || branch_id END AS branch_code, CASE WHEN branch_id % 8 <> 3 THEN period END AS period,
    CASE WHEN branch_id % 8 <> 3 THEN CASE month(m) % 4 WHEN 1 THEN 5 ELSE 1 END END AS day_from, CASE WHEN branch_id % 8 <> 3 THEN LEAST(CASE month(m) % 4 WHEN 0 THEN 12 ELSE 31 END, day(period)) END AS day_to
    FROM (SELECT *, last_day(make_date(CASE WHEN month(m) % 3 = 0 THEN 2003 ELSE year(m) END, month(m), 1)) AS period FROM names)"""


def _with_lines(spark, sf_dir):
    return tables.notes(spark, sf_dir).join(tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dn_no")), "dn_no", "left_semi")


def _branches(spark, sf_dir):
    """The known names and codes: 25 nations."""
    return [(r.branch.replace("_", " "), f"B{r.branch_id}") for r in tables.branches(spark, sf_dir).orderBy("branch_id").collect()]


def _names(rows):
    month = F.month("m")
    text = lambda c: F.when(c[0], c[1])
    days = F.when(month % 4 == 0, " 1 TO 12").when(month % 4 == 1, " 5-31").otherwise("")
    return rows.withColumn("file", F.concat(
        F.element_at(F.array(*map(F.lit, files.MONTHS)), month), text((month % 3 == 0, "")).otherwise(F.concat(F.lit(" "), F.year("m").cast("string"))), F.lit(" "),
        F.when(F.col("branch_id") % 8 == 3, "ELSEWHERE").otherwise(F.replace("branch", F.lit("_"), F.lit(" "))), days, F.lit(" SALES.csv")))


@register(using("dn", "SELECT DISTINCT file, branch_code, period, CAST(day_from AS INTEGER) AS day_from, CAST(day_to AS INTEGER) AS day_to FROM read", names=_NAMES, read=_READ))
def sales_file_names(spark, sf_dir):
    notes = _with_lines(spark, sf_dir).select("branch_id", "branch", F.trunc("doc_date", "month").alias("m")).distinct()
    return _names(notes).select("file").distinct().select("file", *(v.alias(k) for k, v in files.sales_file(F.col("file"), _branches(spark, sf_dir), 2003).items()))


_CATEGORY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(item, '{words}', 'i') THEN '{label}'" for label, words in files.CATEGORIES) + f" ELSE '{files.OTHER_CATEGORY}' END"
_UPLOADED = f"""SELECT branch_code, sku, period, item, qty, turnover, profit, gp_pct, day_from, day_to, {_CATEGORY_SQL} AS category FROM (
    SELECT branch_code, sku, period, arg_min(description, (file, place, description)) AS item, CAST(SUM(requested_qty) AS DOUBLE) AS qty, CAST(SUM(sent_qty) AS DOUBLE) AS turnover, CAST(SUM(backorder_qty) AS DOUBLE) AS profit,
      round_even(AVG(line_no), 6) AS gp_pct, CAST(MIN(day_from) AS INTEGER) AS day_from, CAST(MIN(day_to) AS INTEGER) AS day_to FROM (
      SELECT r.*, l.brand AS sku, l.description, l.requested_qty, l.sent_qty, l.backorder_qty, l.line_no, l.dn_no * 10 + l.line_no AS place FROM lines l JOIN read r ON l.branch_id = r.branch_id AND date_trunc('month', l.doc_date) = r.m)
    WHERE period IS NOT NULL GROUP BY branch_code, sku, period)"""


def _uploaded(spark, sf_dir):
    """Each nation's lines of a month as a file with a header, a row a line and a totals row without a sku. The files are
    named after the notes, so that lines are read once; one without lines gives nothing."""
    lines = tables.delivery_lines(spark, sf_dir).withColumn("m", F.trunc("doc_date", "month"))
    named = _names(lines)
    text = lambda *cs: F.array(*(F.col(c).cast("string") for c in cs))
    rows = named.select("file", (F.col("dn_no") * 10 + F.col("line_no")).alias("row"), text("brand", "description", "requested_qty", "line_no", "sent_qty", "backorder_qty").alias("cells"))
    months = tables.notes(spark, sf_dir).select("branch_id", "branch", F.trunc("doc_date", "month").alias("m")).distinct()
    each = jobs.kept(_names(months).select("file").distinct(), "files")  # stored, or what is asked of names would be asked of each note
    header = each.select("file", F.lit(0).cast("long").alias("row"), F.array(*map(F.lit, ("Item No", "Name", "Qty", "GP %", "Turnover (USD)", " Profit "))).alias("cells"))
    totals = each.select("file", F.lit(1 << 40).alias("row"), F.array(F.lit(None).cast("string"), *map(F.lit, ("Total", "1", "2", "3", "4"))).alias("cells"))
    found = files.monthly_panel(rows.unionByName(header).unionByName(totals), _branches(spark, sf_dir), 2003)
    return found.withColumn("gp_pct", F.bround("gp_pct", 6))


@register(using("lines", _UPLOADED, names=_NAMES, read=_READ))
def uploaded_month_panel(spark, sf_dir):
    return _uploaded(spark, sf_dir)


@register(using("lines", f"""SELECT branch_code, sku, period, qty FROM up UNION ALL SELECT s.branch_code, s.sku, s.period, s.qty FROM stored s WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.branch_code = s.branch_code AND up.period = s.period)""",
    names=_NAMES, read=_READ, up=_UPLOADED, stored="SELECT 'B' || branch_id AS branch_code, brand AS sku, last_day(doc_date) AS period, CAST(SUM(sent_qty) AS DOUBLE) AS qty FROM lines GROUP BY ALL"))
def files_over_stored(spark, sf_dir):
    """Months that have a file come from it, all others from the stored table."""
    stored = tables.delivery_lines(spark, sf_dir).groupBy(F.concat(F.lit("B"), F.col("branch_id").cast("string")).alias("branch_code"), F.col("brand").alias("sku"), F.last_day("doc_date").alias("period")).agg(F.sum("sent_qty").cast("double").alias("qty"))
    uploaded = jobs.kept(_uploaded(spark, sf_dir).select("branch_code", "sku", "period", "qty"), "uploaded")
    return files.files_first(uploaded, stored, ["branch_code", "period"])


@register(using("dn", """SELECT file, CASE WHEN k = 4 THEN NULL WHEN k = 2 AND year(w) < 2000 THEN CAST(w + INTERVAL 100 YEAR AS DATE) ELSE w END AS week_start, CASE WHEN k = 4 THEN NULL WHEN branch_id % 8 = 3 THEN CASE WHEN k = 2 THEN 'B0' ELSE 'OTHER' || chr(65 + branch_id % 10) END ELSE 'B' || branch_id END AS branch_code FROM (
    SELECT branch_id, w, k, CASE k WHEN 0 THEN name || ' ' || day(w) || '-' || month(w) || '-' || year(w) WHEN 1 THEN name || '  - ' || strftime(w, '%Y-%m-%d') WHEN 2 THEN CASE WHEN branch_id % 8 = 3 THEN '' ELSE name || ' ' END || strftime(w, '%d.%m.%y')
        WHEN 3 THEN name || ' ' || strftime(w, '%Y.%m.%d') ELSE name || ' 31-02-2001' END || '.xlsx' AS file FROM (
      SELECT DISTINCT branch_id, CAST(date_trunc('week', doc_date) AS DATE) AS w, (day(date_trunc('week', doc_date)) + branch_id) % 5 AS k, CASE WHEN branch_id % 8 = 3 THEN 'other ' || chr(97 + branch_id % 10) ELSE 'Nation ' || chr(65 + branch_id) END AS name FROM dn WHERE year(doc_date) >= 2000)) GROUP BY ALL"""))
def weekly_file_names(spark, sf_dir):
    """Names with the date in several forms, one of them no date, and branches that aren't known. A name that is the
    date alone begins every branch's name, so the first one counts."""
    at, who = F.date_trunc("week", "doc_date").cast("date"), F.col("branch_id")
    notes = _with_lines(spark, sf_dir).filter("year(doc_date) >= 2000").select("branch_id", "branch", at.alias("w")).distinct()
    odd, k = who % 8 == 3, (F.dayofmonth("w") + who) % 5
    name = F.when(odd, F.concat(F.lit("other "), F.char(who % 10 + 97))).otherwise(F.concat(F.lit("Nation "), F.char(who + 65)))
    date = lambda f: F.date_format("w", f)
    text = (
        F.when(k == 0, F.concat(name, F.lit(" "), date("d-M-yyyy"))).when(k == 1, F.concat(name, F.lit("  - "), date("yyyy-MM-dd"))).when(k == 2, F.concat(F.when(odd, "").otherwise(F.concat(name, F.lit(" "))), date("dd.MM.yy")))
        .when(k == 3, F.concat(name, F.lit(" "), date("yyyy.MM.dd"))).otherwise(F.concat(name, F.lit(" 31-02-2001")))
    )
    named = notes.select(F.concat(text, F.lit(".xlsx")).alias("file")).distinct()
    return named.select("file", *(v.alias(c) for c, v in files.weekly_file(F.col("file"), [(f"Nation {chr(65 + i)}", f"B{i}") for i in range(25)]).items()))


@register("""SELECT p_partkey, trim(sku) AS sku, trim(item) AS item, GREATEST(COALESCE(TRY_CAST(qty AS DOUBLE), 0), 0) AS qty FROM (SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN ' test ' ELSE 'S' || p_partkey END AS sku,
    CASE WHEN p_partkey % 7 = 0 THEN p_name || ' test  item' WHEN p_partkey % 11 = 0 THEN 'contest items ' || p_name ELSE p_name END AS item, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(p_size - 10 AS VARCHAR) END AS qty FROM part)
    WHERE upper(trim(sku)) NOT IN ('TEST', 'TESTING') AND p_partkey % 7 <> 0""")
def weekly_items(spark, sf_dir):
    key = F.col("p_partkey")
    rows = tables.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 31 == 0, " test ").otherwise(F.concat(F.lit("S"), key.cast("string"))).alias("sku"),
        F.when(key % 7 == 0, F.concat("p_name", F.lit(" test  item"))).when(key % 11 == 0, F.concat(F.lit("contest items "), "p_name")).otherwise(F.col("p_name")).alias("item"),
        F.when(key % 5 == 0, "n/a").otherwise((F.col("p_size") - 10).cast("string")).alias("qty"),
    )
    return files.weekly_items(rows)


def _stock_files(spark, sf_dir):
    """A snapshot for each nation, with its columns in another order in every second, and one that isn't a snapshot."""
    stock = tables.stock_levels(spark, sf_dir).select(F.when(F.col("branch_id") == 9, F.lit("_b9.csv")).otherwise(F.concat(F.lit("b"), F.col("branch_id").cast("string"), F.lit(".csv"))).alias("file"), "branch_id", "product_id", (F.col("on_hand") - 20).cast("string").alias("qty"))
    swap, text = F.col("branch_id") % 2 == 1, F.col("product_id").cast("string")
    code = F.concat(F.lit(" P"), (F.col("product_id") % 50).cast("string"))
    rows = stock.select("file", (F.col("product_id") + 1).cast("long").alias("row"), F.when(swap, F.array("qty", text, code)).otherwise(F.array(code, text, "qty")).alias("cells"))
    head = stock.select("file", "branch_id").distinct().select("file", F.lit(0).cast("long").alias("row"), F.when(swap, F.array(F.lit("Closing Balance"), F.lit("Name"), F.lit("Item No"))).otherwise(F.array(F.lit("SKU"), F.lit("Name"), F.lit("Qty on hand"))).alias("cells"))
    return head.unionByName(rows)


@register(using("stock", "SELECT 'B' || branch_id AS branch_code, 'P' || product_id % 50 AS sku, CAST(SUM(GREATEST(on_hand - 20, 0)) AS DOUBLE) AS on_hand FROM stock WHERE branch_id <> 9 GROUP BY ALL"))
def stock_snapshots(spark, sf_dir):
    return files.stock_snapshots(_stock_files(spark, sf_dir))


@register(using("dn", "SELECT 'B' || branch_id AS branch_code, arg_max(dn_no, (doc_date, CAST(dn_no AS VARCHAR))) || '.csv' AS file, MAX(doc_date) AS week_start FROM dn GROUP BY branch_id"))
def latest_snapshot_files(spark, sf_dir):
    named = _with_lines(spark, sf_dir).select(F.concat(F.lit("B"), F.col("branch_id").cast("string")).alias("branch_code"), F.col("dn_no").cast("string").alias("file"), F.col("doc_date").alias("week_start"))
    return files.latest_files(named).withColumn("file", F.concat("file", F.lit(".csv")))


@register("""SELECT upper('p' || p_partkey % 97) AS sku, CAST(SUM(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE GREATEST(CAST(round_even(p_size / 4.0::DOUBLE - 3, 0) AS BIGINT), 0) END) AS BIGINT) AS on_hand FROM part WHERE p_partkey % 29 <> 0 GROUP BY ALL""")
def warehouse_snapshot(spark, sf_dir):
    key = F.col("p_partkey")
    sku = F.when(key % 29 == 0, F.when(key % 2 == 0, " ").otherwise("nan")).otherwise(F.concat(F.lit(" p"), (key % 97).cast("string")))
    return files.warehouse_snapshot(tables.table(spark, sf_dir, "part").select(sku.alias("sku"), F.when(key % 13 == 0, "?").otherwise((F.col("p_size") / 4 - 3).cast("string")).alias("qty")))


@register("""SELECT 'list' || l_suppkey % 30 AS file, l_orderkey * 10 + l_linenumber AS row, 'P' || l_partkey AS sku, CAST(l_quantity AS BIGINT) * CASE WHEN l_suppkey % 30 % 3 = 1 THEN 1000 ELSE 1 END AS qty
    FROM lineitem WHERE l_linenumber <> 4 AND l_quantity > 0 AND l_orderkey > 0""")
def quantity_lists(spark, sf_dir):
    """Lists with the header in the first or third row or without one, counts with thousands commas in some."""
    line = tables.table(spark, sf_dir, "lineitem").filter("l_orderkey > 0")
    k = F.col("l_suppkey") % 30
    sku, n = F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("long").cast("string")
    qty = F.when(F.col("l_linenumber") == 4, "-").when(k % 3 == 1, F.concat(n, F.lit(",000"))).otherwise(n)
    rows = line.select(F.concat(F.lit("list"), k.cast("string")).alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.when(k % 3 == 0, F.array(F.lit("a name"), qty, sku)).when(k % 3 == 1, F.array(sku, qty, F.lit("x"))).otherwise(F.array(sku, F.lit("a name"), qty)).alias("cells"))
    lists = line.select(k.alias("k")).distinct()
    file = F.concat(F.lit("list"), F.col("k").cast("string")).alias("file")
    head = lists.filter("k % 3 < 2").select(file, F.lit(2).cast("long").alias("row"), F.when(F.col("k") % 3 == 0, F.array(F.lit("Name"), F.lit("To  Split"), F.lit("Item No."))).otherwise(F.array(F.lit("Code"), F.lit("Available"), F.lit("Note"))).alias("cells"))
    title = lists.filter("k % 3 = 0").select(file, F.lit(0).cast("long").alias("row"), F.array(F.lit("A title"), F.lit(None).cast("string"), F.lit("")).alias("cells"))
    return files.quantity_lists(rows.unionByName(head).unionByName(title))


@register("""SELECT o_orderkey AS row, 'file' || o_orderkey % 5 AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'K' || o_orderkey ELSE upper('kit' || o_custkey || '-' || o_orderkey) END AS sku,
    CASE WHEN o_orderkey % 3 = 0 THEN 'plain' ELSE 'kit ' || o_custkey || '-' || o_orderkey END AS description, asked AS requested_qty,
    CASE WHEN o_orderkey % 3 <> 0 THEN asked WHEN o_orderkey % 6 = 0 THEN 0 ELSE LEAST(9, asked) END AS sent_qty FROM (SELECT *, o_orderkey % 17 AS asked FROM orders) WHERE asked > 0""")
def document_lines(spark, sf_dir):
    """Notes with codes, some without a sent quantity, and invoices without codes."""
    key = F.col("o_orderkey")
    label = F.when(key % 2 == 0, F.concat((key % 7).cast("string"), F.lit(".  Model : "))).otherwise("MODEL:")
    rows = tables.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("file"), (key % 5).cast("string")).alias("file"), key.alias("row"), F.when(key % 3 == 0, F.concat(F.lit(" K"), key.cast("string"))).alias("sku"),
        F.when(key % 3 == 0, "plain").otherwise(F.concat(label, F.lit("kit   "), F.col("o_custkey").cast("string"), F.lit("-"), key.cast("string"), F.lit(" ."))).alias("description"),
        (key % 17).cast("string").alias("requested"), F.when(key % 6 != 0, "9").alias("sent"),
    )
    return files.document_lines(rows.unionByName(rows))


@register(using("dn", """SELECT branch_id, product_id, doc_date AS sale_date, requested_qty AS qty, CASE WHEN line_no % 2 = 0 THEN dn_no % 1000 ELSE price_cents END AS price_cents FROM dn WHERE branch_id % 6 <> 5 AND product_id % 4 <> 3"""))
def imported_sales(spark, sf_dir):
    """Sales as text, of which some branches and products aren't known and every second line has no price."""
    lines = tables.delivery_lines(spark, sf_dir)
    rows = lines.select("branch", F.col("product_id").cast("string").alias("sku"), F.col("doc_date").cast("string").alias("sale_date"), F.col("requested_qty").cast("string").alias("qty"), F.when(F.col("line_no") % 2 == 0, (F.col("dn_no") % 1000 / 100).cast("string")).otherwise(" ").alias("price"))
    branches = tables.branches(spark, sf_dir).filter("branch_id % 6 <> 5").select("branch", "branch_id")
    products = tables.table(spark, sf_dir, "part").filter("p_partkey % 4 <> 3").select(F.col("p_partkey").cast("string").alias("sku"), F.col("p_partkey").alias("product_id"), tables.cents("p_retailprice").alias("price_cents"))
    return files.imported_sales(rows, branches, products)


@register("""SELECT n.sku, n.name, CASE WHEN p.p_partkey IS NULL THEN 'insert' WHEN p.p_name <> n.name THEN 'update' ELSE 'unchanged' END AS change FROM (
    SELECT DISTINCT ON (sku) sku, name FROM (SELECT l_partkey + CASE WHEN l_partkey % 10 = 0 THEN 1000000 ELSE 0 END AS sku, CASE WHEN l_linenumber % 2 = 0 THEN 'other' ELSE p_name END AS name, l_orderkey * 10 + l_linenumber AS seq
      FROM (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = l_partkey) ORDER BY sku, seq) n LEFT JOIN part p ON p.p_partkey = n.sku""")
def catalogue_import(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("name"))
    line = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("sku")).join(part, "sku")
    rows = line.select((F.col("sku") + F.when(F.col("sku") % 10 == 0, 1_000_000).otherwise(0)).alias("sku"), F.when(F.col("l_linenumber") % 2 == 0, "other").otherwise(F.col("name")).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return files.catalogue_diff(part, rows)


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3)")
def missing_orders(spark, sf_dir):
    done = tables.table(spark, sf_dir, "lineitem").filter("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return files.missing_rows(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey * 1000 + 2 END AS n, CAST(o_orderdate AS DATE) AS day FROM orders""")
def parsed_values(spark, sf_dir):
    """Numbers with commas and dates in several forms out of text around them."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    number = F.when(key % 5 == 0, F.element_at(F.array(*map(F.lit, ("-", "nan", " None", "", "x"))), (key / 5 % 5).cast("int") + 1)).otherwise(F.concat(F.lit(" "), key.cast("string"), F.lit(",001.6")))
    text = F.when(key % 4 == 0, F.date_format(day, "dd/MM/yyyy")).when(key % 4 == 1, F.date_format(day, "d-M-yyyy")).when(key % 4 == 2, F.date_format(day, "dd/MM/yy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", parsed_int(number).alias("n"), parsed_date(F.concat(F.lit("Date : "), text, F.lit(" page 1"))).alias("day"))
