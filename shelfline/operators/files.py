"""Uploaded files as rows: what their names say, which columns they have, and the tables made of them.

A file comes as rows of cells: file (its name), row (its place) and cells (an array of text), as read_cells() gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import parsed_int

#: What categories' names contain, in the order in which they are tried.
CATEGORIES = [
    ("Cable & Electrical", "CABLE|ELECTRIC|BREAKER|CONTACTOR|STARTER|ALTERNATOR|RECTIFIER|GENERATOR|SWITCH|SOCKET|LAMP|TORCH|WIRE ARMOUR"),
    ("Fencing & Wire", "FENCE|BARBED|TYING WIRE|BAILING|FIELD FENCE|DROPPER|GABION|POST"),
    ("Fasteners", "BOLT|NUT|WASHER|SCREW|ANCHOR|RIVET|THREADED"),
    ("Pumps & Water", "PUMP|SUBPUMP|BOREHOLE|SEWAGE|POLY PIPE|PVC|HDPE|VALVE|HOSE|IRRIGAT"),
    ("Milling & Crushing", "STAMPMILL|MILL BALL|HAMMERMILL|JAW CRUSHER|BEATER|SCREEN|LINER|DIES|SHOE|ROLLER|BUNGA"),
    ("Lubricants & Chemicals", "OIL|GREASE|HYSPIN|LUBRI|DEGREAS|FLUX|COOLANT|BRAKE FLUID|PAINT|THINNER|SAE|15W40|SUPER SERIES"),
    ("Hand Tools", "SPANNER|WRENCH|HAMMER|PICK|SHOVEL|CHISEL|PLIER|SCREWDRIVER|SAW|AXE|TROWEL|TAPE MEASURE|COMBINATION"),
    ("Power Tools & Accessories", "DRILL|GRINDER|DISC|BLADE|BIT|ANGLE GRIND|WELDER|WELDING|ELECTRODE"),
    ("PPE & Workwear", "GUMBOOT|HELMET|GLOVE|OVERALL|BOOT|GOGGLE|RESPIRATOR|MASK|EAR MUFF|VEST|MUTTON CLOTH"),
    ("Bearings & Drives", "BEARING|P/BLOCK|PLUMMER|V BELT|PULLEY|SPROCKET|CHAIN|COUPLING|SHAFT"),
]
OTHER_CATEGORY = "General / Other"
#: What headers of item, quantity and snapshot columns contain.
ITEM_KEYS = ["item no", "item_no", "itemno", "sku", "code", "product", "part no"]
REQUEST_KEYS = ["req. qty", "req qty", "req.qty", "requested", "requested_qty", "request qty", "qty req", "order qty", "req"]
COUNT_KEYS = [*REQUEST_KEYS, "qty", "quantity", "available", "avail", "in stock", "on hand", "units", "amount", "count", "to split", "split qty", "total"]
STOCK_KEYS = ["qty", "quantity", "on hand", "on_hand", "onhand", "in stock", "stock", "balance", "closing", "closing balance"]
#: Products that exist for tests only.
TEST_ITEMS, TEST_SKUS = r"(?i)\b(?:testing|test\s*item|dummy|placeholder|do\s*not\s*use)\b", ["TEST", "TESTING"]
MONTHS = ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER"]
#: A header stands within so many rows.
HEADER_ROWS = 40


def read_cells(spark: SparkSession, path: str, width: int) -> DataFrame:
    """file, row, cells of CSV files without regard to headers; the path may have wildcards. A file's rows keep its order."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    table = spark.read.schema(schema).option("header", False).csv(path)
    rows = table.select(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.array(*(f"c{i}" for i in range(width))).alias("cells"))
    order = Window.partitionBy("file").orderBy("at", "id")
    return rows.select("file", (F.row_number().over(order) - 1).alias("row"), "cells")


def category(name: Column) -> Column:
    """The first category whose words a name contains."""
    found = F.lit(OTHER_CATEGORY)
    for label, words in reversed(CATEGORIES):
        found = F.when(F.coalesce(name, F.lit("")).rlike(f"(?i){words}"), label).otherwise(found)
    return found


def sales_file(file: Column, branches: list[tuple[str, str]], default_year: int) -> dict[str, Column]:
    """What the name of a monthly file says: branch_code (of the known name that begins first, of those the longest),
    period (month end) and the days from and to. branches: names and codes, a few hundred at most. Null where the name has
    no month or no branch."""
    words = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.upper(file), r"[\s_.\-]+"), lambda w: w != ""), " "), F.lit(" "))
    tokens = F.split(F.trim(words), " ")
    known = lambda w: F.array(*(F.struct(F.instr(w, F.lit(f" {name.upper()} ")).alias("at"), F.lit(-len(name)).alias("shorter"), F.lit(code).alias("code")) for name, code in branches))
    # an array of one, so that the words are made once and not for each branch
    code = F.get(F.transform(F.array(words), lambda w: F.array_min(F.filter(known(w), lambda b: b["at"] > 0))["code"]), F.lit(0))
    month = F.element_at(F.filter(F.transform(tokens, lambda t: F.array_position(F.array(*map(F.lit, MONTHS)), t)), lambda m: m > 0), 1)
    year = F.coalesce(F.get(F.filter(tokens, lambda t: t.rlike(r"^(19|20)\d{2}$")), F.lit(0)).cast("int"), F.lit(default_year))
    period = F.when(code.isNotNull(), F.last_day(F.make_date(year, month.cast("int"), F.lit(1))))
    days = r"(?i)\b(\d{1,2})\s*(?:TO|-)\s*(\d{1,2})\b"
    first, last = (F.regexp_extract(file, days, i).try_cast("int") for i in (1, 2))
    fits = F.coalesce((first >= 1) & (first <= last) & (last <= 31), F.lit(False))
    return {
        "branch_code": F.when(month.isNotNull(), code), "period": period,
        "day_from": F.when(period.isNotNull(), F.when(fits, first).otherwise(1)),
        "day_to": F.when(period.isNotNull(), F.least(F.when(fits, last).otherwise(31), F.dayofmonth(period))),
    }


def weekly_file(file: Column, branches: list[tuple[str, str]]) -> dict[str, Column]:
    """What the name of a weekly file says: week_start (day-month-year or year-month-day, two-digit years in this century)
    and branch_code: of a known name that it is, else of the first known name that begins it or that it begins, else
    its first six letters or digits."""
    base = F.regexp_replace(file, r"\.[^.]*$", "")
    date = r"(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{2,4})|(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
    part = lambda i: F.regexp_extract(base, date, i).try_cast("int")
    year = F.when(part(1).isNotNull(), F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))).otherwise(part(4))
    month, day = F.coalesce(part(2), part(5)), F.when(part(1).isNotNull(), part(1)).otherwise(part(6))
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    start = F.when(year.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))
    token = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_extract(base, rf"^(.*?)(?:{date})", 1), r"\s+", " "), r"^[ \-_]+|[ \-_]+$", ""))
    exact = F.get(F.filter(F.array(*(F.struct(F.lit(n.upper()).alias("n"), F.lit(c).alias("c")) for n, c in branches)), lambda b: b["n"] == token), F.lit(0))["c"]
    loose = F.get(F.filter(F.array(*(F.struct(F.lit(n.upper()).alias("n"), F.lit(c).alias("c")) for n, c in branches)), lambda b: token.startswith(b["n"]) | b["n"].startswith(token)), F.lit(0))["c"]
    short = F.substring(F.regexp_replace(token, "[^A-Z0-9]", ""), 1, 6)
    return {"week_start": start, "branch_code": F.when(start.isNotNull(), F.coalesce(exact, loose, F.when(short != "", short), F.lit("UNK")))}


def _number(cell: Column) -> Column:
    return F.trim(cell).try_cast("double")


def monthly_panel(cells: DataFrame, branches: list[tuple[str, str]], default_year: int) -> DataFrame:
    """Monthly files as a panel. Columns one to three are sku, item and quantity; turnover, gp and profit are found by the
    header in the first row. Rows without a sku (totals) and files without a month or branch are left out; several rows of a sku
    and month are added, the first item counts, the margin is their mean."""
    header = cells.filter("row = 0").select("file", F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))).alias("names"))
    place = lambda test: F.array_position(F.transform("names", test), True)
    found = header.select("file", place(lambda c: c.startswith("turnover")).alias("__t"), place(lambda c: c.startswith("gp")).alias("__g"), place(lambda c: c == "profit").alias("__p"), *(v.alias(k) for k, v in sales_file(F.col("file"), branches, default_year).items()))
    rows = cells.filter("row > 0").join(F.broadcast(found.filter("period is not null")), "file")  # a row for each file
    value = lambda at: F.when(F.col(at) > 0, _number(F.get("cells", (F.col(at) - 1).cast("int"))))
    typed = rows.select(
        "branch_code", "period", "day_from", "day_to", "file", "row", F.trim(F.get("cells", F.lit(0))).alias("sku"), F.get("cells", F.lit(1)).alias("item"),
        F.coalesce(_number(F.get("cells", F.lit(2))), F.lit(0.0)).alias("qty"), value("__t").alias("turnover"), value("__g").alias("gp_pct"), value("__p").alias("profit"),
    ).filter("sku <> ''")
    # rows of an item are added first, by numbers alone, which needs no sort; where it stands first is looked for after that
    items = typed.groupBy("branch_code", "sku", "period", "file", "day_from", "day_to", "item").agg(
        F.min("row").alias("row"), *(F.sum(c).alias(c) for c in ("qty", "turnover", "profit", "gp_pct")), F.count("gp_pct").alias("__n")
    )
    at = F.struct("file", "row")
    sums = items.groupBy("branch_code", "sku", "period").agg(
        F.min_by("item", F.struct(at, "item")).alias("item"), F.sum("qty").alias("qty"), F.coalesce(F.sum("turnover"), F.lit(0.0)).alias("turnover"), F.coalesce(F.sum("profit"), F.lit(0.0)).alias("profit"),
        F.try_divide(F.sum("gp_pct"), F.sum("__n")).alias("gp_pct"), F.min_by("day_from", at).alias("day_from"), F.min_by("day_to", at).alias("day_to"),
    )
    return sums.withColumn("category", category(F.col("item")))


def files_first(files: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of files, and the stored rows of the keys (branch and period) that no file has."""
    return files.unionByName(stored.join(files.select(*keys).distinct(), keys, "left_anti").select(files.columns))


def weekly_items(rows: DataFrame) -> DataFrame:
    """Rows with sku, item, qty (text) without those that exist for tests; quantities as numbers, none below zero."""
    real = rows.withColumns({"sku": F.trim("sku"), "item": F.trim("item")}).filter("sku <> ''")
    real = real.filter(~F.coalesce(F.col("item").rlike(TEST_ITEMS), F.lit(False)) & ~F.upper("sku").isin(TEST_SKUS))
    return real.withColumn("qty", F.greatest(F.coalesce(_number(F.col("qty")), F.lit(0.0)), F.lit(0.0)))


def _pick(names: Column, keys: list[str]) -> Column:
    """The place (from 1, else 0) of the first key that is a header, else of the first key that a header contains."""
    keyed = F.array(*map(F.lit, keys))
    exact = F.get(F.filter(F.transform(keyed, lambda k: F.array_position(names, k)), lambda p: p > 0), F.lit(0))
    loose = F.get(F.filter(F.transform(keyed, lambda k: F.array_position(F.transform(names, lambda n: n.contains(k)), True)), lambda p: p > 0), F.lit(0))
    return F.coalesce(exact, loose, F.lit(0))


def stock_snapshots(cells: DataFrame) -> DataFrame:
    """branch_code (the file's name), sku, on_hand of snapshot files: columns by their headers in the first row, sums by
    sku, what isn't a number or is below zero counts 0. Files that begin with _ or ~$ are left out."""
    real = cells.filter(~F.col("file").startswith("_") & ~F.col("file").startswith("~$"))
    names = F.transform("cells", lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    header = real.filter("row = 0").select("file", _pick(names, ITEM_KEYS).alias("__s"), _pick(names, STOCK_KEYS).alias("__q")).filter("__s > 0 and __q > 0")
    cell = lambda at: F.get("cells", (F.col(at) - 1).cast("int"))
    rows = real.filter("row > 0").join(F.broadcast(header), "file")  # a row for each file
    named = rows.select(F.upper(F.trim(F.regexp_replace("file", r"\.[^.]*$", ""))).alias("branch_code"), F.trim(cell("__s")).alias("sku"), F.greatest(F.coalesce(_number(cell("__q")), F.lit(0.0)), F.lit(0.0)).alias("on_hand"))
    return named.filter("sku <> '' and lower(sku) <> 'nan'").groupBy("branch_code", "sku").agg(F.sum("on_hand").alias("on_hand"))


def latest_files(files: DataFrame) -> DataFrame:
    """Of each branch the file of its latest week."""
    return files.groupBy("branch_code").agg(F.max_by("file", F.struct("week_start", "file")).alias("file"), F.max("week_start").alias("week_start"))


def warehouse_snapshot(lines: DataFrame) -> DataFrame:
    """sku (upper case) and on_hand that replace the warehouse's snapshot: sums of quantities, rounded, none below zero."""
    sku = F.upper(F.trim("sku"))
    qty = F.greatest(F.coalesce(F.bround(_number(F.col("qty")), 0).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    return lines.select(sku.alias("sku"), qty.alias("qty")).filter("sku <> '' and lower(sku) <> 'nan'").groupBy("sku").agg(F.sum("qty").alias("on_hand"))


def quantity_lists(cells: DataFrame) -> DataFrame:
    """file, row, sku, qty of lists of products: the header is the first of HEADER_ROWS rows that names an item and a
    count; without one the first cell is the product and the first number after it the count. Counts above 0 only."""
    names = F.transform("cells", lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    holds = lambda keys: F.transform(names, lambda n: F.exists(F.array(*map(F.lit, keys)), lambda k: n.contains(k)))
    item = F.array_position(holds(ITEM_KEYS), True)
    count = F.array_position(F.transform(holds(COUNT_KEYS), lambda hit, i: hit & (i + 1 != item)), True)
    heads = cells.filter(F.col("row") < HEADER_ROWS).select("file", "row", item.alias("i"), count.alias("c")).filter("i > 0 and c > 0")
    head = heads.groupBy("file").agg(F.min(F.struct("row", "i", "c")).alias("head"))
    met = cells.join(head, "file", "left").filter("head is null or row > head.row")
    sku = F.trim(F.when(F.col("head").isNull(), F.get("cells", F.lit(0))).otherwise(F.get("cells", (F.col("head.i") - 1).cast("int"))))
    plain = F.get(F.filter(F.transform(F.slice("cells", 2, 1000), parsed_int), lambda v: v.isNotNull()), F.lit(0))
    qty = F.when(F.col("head").isNull(), plain).otherwise(parsed_int(F.get("cells", (F.col("head.c") - 1).cast("int"))))
    return met.select("file", "row", sku.alias("sku"), qty.alias("qty")).filter("qty > 0 and sku <> '' and lower(sku) not in ('nan', 'none')")


def invoice_sku(description: Column) -> tuple[Column, Column]:
    """A code and a clean description for a line of an invoice that has none: without its number and the word Model."""
    text = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " "))
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*\d+\s*[\.\)]\s*model\s*:?\s*", ""), r"(?i)^\s*model\s*:?\s*", "")
    bare = F.regexp_replace(bare, r"^[ :.\-]+|[ :.\-]+$", "")
    clean = F.when(bare != "", bare).otherwise(F.trim(F.coalesce(description, F.lit(""))))
    code = F.upper(F.regexp_replace(clean, r"\s+", ""))
    return F.when(code != "", code).otherwise("ITEM"), clean


def document_lines(rows: DataFrame, once: bool = True) -> DataFrame:
    """rows: file, row, sku, description, requested, sent (text; sku null on invoices). Lines with what was requested and
    sent: a blank sent is 0 and more than requested counts as requested; on an invoice all was sent and the code comes
    from the description. With once, of equal products and requests of a file the first counts."""
    invoice = F.col("sku").isNull()
    code, clean = invoice_sku(F.col("description"))
    asked = parsed_int(F.col("requested"))
    sent = F.when(invoice, asked).otherwise(F.least(F.coalesce(parsed_int(F.col("sent")), F.lit(0).cast("long")), asked))
    lines = rows.select("file", "row", F.when(invoice, code).otherwise(F.trim("sku")).alias("sku"), F.when(invoice, clean).otherwise(F.col("description")).alias("description"), asked.alias("requested_qty"), sent.alias("sent_qty"))
    if not once:
        return lines.filter("requested_qty > 0")
    place = F.row_number().over(Window.partitionBy("file", "sku", "requested_qty").orderBy("row"))
    return lines.filter("requested_qty > 0").withColumn("__place", place).filter("__place = 1").drop("__place")


def imported_sales(rows: DataFrame, branches: DataFrame, products: DataFrame) -> DataFrame:
    """rows: branch, sku, sale_date, qty, price (text). Sales of known branches and products; a missing price is the
    product's."""
    met = rows.join(F.broadcast(branches), "branch").join(products, "sku")
    price = F.coalesce(F.bround(_number(F.col("price")) * 100, 0).cast("long"), F.col("price_cents"))
    return met.select("branch_id", "product_id", F.try_to_date("sale_date", "yyyy-MM-dd").alias("sale_date"), parsed_int(F.col("qty")).alias("qty"), price.alias("price_cents")).filter("qty > 0 and sale_date is not null")


def catalogue_diff(stored: DataFrame, rows: DataFrame, keep: str = "first") -> DataFrame:
    """sku, name, change (insert, update, unchanged) for the rows (sku, name, seq) of a list; of a repeated sku the first
    or last counts."""
    order = F.col("seq") if keep == "first" else F.desc("seq")
    once = rows.withColumn("__place", F.row_number().over(Window.partitionBy("sku").orderBy(order))).filter("__place = 1")
    met = once.join(stored.select("sku", F.col("name").alias("__old")), "sku", "left")
    return met.select("sku", "name", F.when(F.col("__old").isNull(), "insert").when(F.col("__old") != F.col("name"), "update").otherwise("unchanged").alias("change"))


def missing_rows(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """The rows whose key the target doesn't have yet."""
    return source.join(target.select(key), key, "left_anti")
