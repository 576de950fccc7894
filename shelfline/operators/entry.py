"""What documents do to the books: checked lines, derived sales and back orders, stock movements, reversals, stages.

Nothing is updated in place. Each function derives the rows that a document adds, so a job can append them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dealt

#: Places in a branch's order of arrival whose closes are counted in one window.
SEQ_BLOCK = 65_536


def checked_lines(lines: DataFrame, known_notes: DataFrame) -> DataFrame:
    """lines: dn_no, line_no, branch_id, product_id, doc_date, requested_qty, sent_qty. Adds reason, null for a line that
    counts. A note is taken or refused as a whole: for a number that is known already, or for its first wrong line."""
    sent = F.coalesce("sent_qty", F.lit(0).cast("long"))
    wrong = (
        F.when(F.col("branch_id").isNull(), "branch not found").when(F.coalesce("requested_qty", F.lit(0)) <= 0, "requested must be positive")
        .when(sent < 0, "sent cannot be negative").when(sent > F.col("requested_qty"), "sent exceeds requested")
    )
    judged = lines.withColumns({"sent_qty": sent, "__wrong": wrong})
    first = F.min(F.when(F.col("__wrong").isNotNull(), F.struct("line_no", "__wrong"))).over(Window.partitionBy("dn_no"))
    seen = known_notes.select("dn_no").distinct().withColumn("__seen", F.lit(True))
    met = judged.withColumn("__first", first["__wrong"]).join(seen, "dn_no", "left")
    return met.withColumn("reason", F.when(F.col("__seen"), "already entered").otherwise(F.col("__first"))).drop("__wrong", "__first", "__seen")


def sales_of(checked: DataFrame, prices: DataFrame) -> DataFrame:
    """A sales record for each accepted line of which something was sent."""
    sold = checked.filter("reason is null and sent_qty > 0").join(prices.select("product_id", "price_cents"), "product_id", "left")
    return sold.select("branch_id", "product_id", F.col("doc_date").alias("sale_date"), F.col("sent_qty").alias("qty"), "price_cents", F.lit("DELIVERY").alias("source"), F.col("dn_no").alias("source_ref"))


def back_orders_of(checked: DataFrame) -> DataFrame:
    """A back-order line for each product that a note is short of. It replaces an open one of the same note."""
    short = F.col("requested_qty") - F.col("sent_qty")
    return checked.filter(F.col("reason").isNull() & (short > 0)).groupBy("dn_no", "branch_id", "product_id").agg(F.sum(short).alias("qty_ordered"))


def movements(receipts: DataFrame, known: DataFrame, tasks: int | None = None) -> DataFrame:
    """receipts: ro_no, line_no, branch_id, product_id, received_qty. The stock that accepted receipts add; a receipt with
    a line that isn't positive or with a known number is refused as a whole. tasks: how many share the receipts, where that
    is more than a shuffle has."""
    bad = receipts.filter(F.coalesce("received_qty", F.lit(0)) <= 0).select("ro_no").union(known.select("ro_no")).distinct()
    good = dealt(receipts, tasks, "ro_no").join(dealt(bad, tasks, "ro_no"), "ro_no", "left_anti")
    return good.groupBy("branch_id", "product_id", F.col("ro_no").alias("doc_no")).agg(F.sum("received_qty").alias("change"))


def capped_dispatch(orders: DataFrame, available: DataFrame, tasks: int | None = None) -> DataFrame:
    """orders: do_no, line_no, product_id, qty; available: product_id, on_hand of the warehouse. What each line sends: its
    quantity at most what the warehouse had when the order came, which other lines don't lessen. Adds status: sent,
    capped, skipped, or refused where an order sends nothing at all or has a quantity that isn't positive. tasks: how many
    share the lines, where that is more than a shuffle has."""
    held = available.select("product_id", F.greatest("on_hand", F.lit(0)).alias("on_hand"))
    met = dealt(orders, tasks, "product_id").join(dealt(held, tasks, "product_id"), "product_id", "left").withColumn("on_hand", F.coalesce("on_hand", F.lit(0).cast("long")))
    sent = dealt(met.withColumn("sent_qty", F.least("qty", "on_hand")), tasks, "do_no")
    order = Window.partitionBy("do_no")
    refused = (F.min("qty").over(order) <= 0) | (F.max("sent_qty").over(order) <= 0)
    status = F.when(refused, "refused").when(F.col("sent_qty") <= 0, "skipped").when(F.col("sent_qty") < F.col("qty"), "capped").otherwise("sent")
    return sent.withColumn("status", status).withColumn("sent_qty", F.when(refused, F.lit(0).cast("long")).otherwise(F.col("sent_qty")))


def transfers(dispatched: DataFrame, warehouse: int) -> DataFrame:
    """Both sides of what was sent: out of the warehouse and into the branch. dispatched: capped_dispatch() with branch_id."""
    sums = dispatched.filter("sent_qty > 0").groupBy("do_no", "branch_id", "product_id").agg(F.sum("sent_qty").alias("change"))
    side = lambda branch, change: F.struct(branch.cast("long").alias("branch_id"), change.alias("change"))
    sides = F.array(side(F.lit(warehouse), -F.col("change")), side(F.col("branch_id"), F.col("change")))
    return sums.select("do_no", "product_id", F.explode(sides).alias("side")).select("do_no", "side.branch_id", "product_id", "side.change")


def reversals(moves: DataFrame, asked: DataFrame, closed: DataFrame, doc: str) -> DataFrame:
    """The entries that undo the asked documents (a row each, column doc), but for those whose back order is closed."""
    undone = asked.select(doc).distinct().join(closed.select(doc), doc, "left_anti")
    return moves.join(undone, doc, "left_semi").withColumn("change", -F.col("change"))


def advanced(items: DataFrame, asked: DataFrame) -> DataFrame:
    """items: bo_no, line_no, stage, qty_ordered, qty_fulfilled; asked: bo_no, to_stage, line_no (null: all), qty. Closing
    an open order sets what was fulfilled: the asked quantity, without one what was ordered. Adds outcome for each item
    of an asked order; an order is refused as a whole where it isn't open, the stage isn't CLOSED, or a quantity is
    negative or above what was ordered."""
    stages = asked.groupBy("bo_no").agg(F.max("to_stage").alias("to_stage"))
    wanted = asked.filter("line_no is not null").select("bo_no", "line_no", "qty")
    met = items.join(stages, "bo_no").join(wanted, ["bo_no", "line_no"], "left")
    value = F.coalesce("qty", "qty_ordered")
    wrong = (
        F.when(F.col("stage") == "CLOSED", "already closed").when(F.col("to_stage") != "CLOSED", "unknown stage")
        .when(value < 0, "negative quantity").when(value > F.col("qty_ordered"), "exceeds ordered")
    )
    why = F.min(wrong).over(Window.partitionBy("bo_no"))
    done = met.withColumn("outcome", F.coalesce(why, F.lit("closed")))
    closed = F.col("outcome") == "closed"
    return done.select("bo_no", "line_no", F.when(closed, F.lit("CLOSED")).otherwise(F.col("stage")).alias("stage"), "qty_ordered", F.when(closed, value).otherwise(F.col("qty_fulfilled")).alias("qty_fulfilled"), "outcome")


def rebuilt_items(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """orders: bo_no, source_ref (note numbers with commas between). What the listed notes are short of, by product."""
    notes = orders.select("bo_no", F.explode(F.split("source_ref", ",")).alias("dn_no")).filter("dn_no <> ''").distinct()
    short = F.greatest(F.col("requested_qty") - F.col("sent_qty"), F.lit(0).cast("long"))
    sums = lines.withColumn("dn_no", F.col("dn_no").cast("string")).join(notes, "dn_no").groupBy("bo_no", "product_id").agg(F.sum(short).alias("qty_ordered"))
    return sums.filter("qty_ordered > 0")


def week_number(branch: Column, day: Column) -> Column:
    """BO-branch-yearWweek by the ISO calendar."""
    week = F.lpad(F.weekofyear(day).cast("string"), 2, "0")
    return F.concat(F.lit("BO-"), branch, F.lit("-"), F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("W"), week)


def accumulated(notes: DataFrame) -> DataFrame:
    """notes: branch_id, branch, seq, kind (NOTE or CLOSE), dn_no, doc_date, shorts (array of product_id, qty). A branch has
    one open back order at most: its notes load what they are short of onto it until a CLOSE, after which the next note
    opens another, numbered by its week (the second of a week has -2 behind it, and so on). A row for each order and
    product, with the order's notes and whether it is still open."""

    branch, close = Window.partitionBy("branch_id"), (F.col("kind") == "CLOSE").cast("long")
    # closes are counted inside blocks of a branch, and the blocks before, a row each, are carried in front
    ahead = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    cut = notes.withColumn("__block", F.coalesce(F.floor(F.col("seq") / SEQ_BLOCK), F.lit(-(1 << 62))))
    blocks = cut.groupBy("branch_id", "__block").agg(F.sum(close).alias("__n"))
    blocks = blocks.select("branch_id", "__block", F.coalesce(F.sum("__n").over(ahead(branch.orderBy("__block"))), F.lit(0)).alias("__ahead"), F.sum("__n").over(branch).alias("__closes"))
    inside = F.coalesce(F.sum(close).over(ahead(Window.partitionBy("branch_id", "__block").orderBy("seq"))), F.lit(0))
    placed = cut.withColumn("__inside", inside).filter("kind <> 'CLOSE'").join(blocks, ["branch_id", "__block"]).withColumn("__order", F.col("__ahead") + F.col("__inside"))
    orders = placed.groupBy("branch_id", "__order").agg(
        F.min("seq").alias("__first"), F.min_by(week_number(F.col("branch"), F.col("doc_date")), "seq").alias("__base"), F.count(F.lit(1)).alias("notes"), F.bool_and(F.col("__order") == F.col("__closes")).alias("is_open")
    )
    nth = F.row_number().over(Window.partitionBy("branch_id", "__base").orderBy("__first"))
    numbered = orders.withColumn("__nth", nth).withColumn("bo_no", F.when(F.col("__nth") == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", F.col("__nth").cast("string"))))
    sums = placed.select("branch_id", "__order", F.explode("shorts").alias("s")).groupBy("branch_id", "__order", "s.product_id").agg(F.sum("s.qty").alias("qty_ordered"))
    return sums.join(numbered, ["branch_id", "__order"]).select("branch_id", "bo_no", "notes", "is_open", "product_id", F.col("qty_ordered").cast("long").alias("qty_ordered"))


def upserted(products: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalogue after changes (sku, name, category, price_cents; null keeps what is there): what is new gets 0 for a
    price and its code for a name. Adds change: new, changed or same. Of several changes of a code the last (seq) counts."""
    last = changes.withColumn("__rank", F.row_number().over(Window.partitionBy("sku").orderBy(F.desc("seq")))).filter("__rank = 1")
    old, new = products.alias("old"), last.alias("new")
    both = old.join(new, "sku", "full")
    pick = lambda c, default: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"), default)
    fields = {"name": pick("name", F.col("sku")), "category": pick("category", F.lit(None).cast("string")), "price_cents": pick("price_cents", F.lit(0).cast("long"))}
    is_new = F.col("old.price_cents").isNull() & F.col("old.name").isNull()
    moved = ~(F.col("old.name").eqNullSafe(fields["name"]) & F.col("old.category").eqNullSafe(fields["category"]) & F.col("old.price_cents").eqNullSafe(fields["price_cents"]))
    return both.select("sku", *(c.alias(k) for k, c in fields.items()), F.when(is_new, "new").when(moved, "changed").otherwise("same").alias("change"))


def numbered(rows: DataFrame, order: str, taken: int, prefix: str = "BO-") -> DataFrame:
    """Rows with new numbers behind those taken, in the given order: positions inside ranges, and how many rows the ranges
    before have (a row for each range)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id())
    inside = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    sizes = inside.groupBy("__part").agg(F.max("__at").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.col("__at") + F.col("__before") + taken
    return inside.join(F.broadcast(sizes.select("__part", "__before")), "__part").withColumn("number", F.concat(F.lit(prefix), F.lpad(number.cast("string"), 6, "0"))).drop("__part", "__at", "__before")


def audit(rows: DataFrame, entity: str, key: str, action: str, *detail: str) -> DataFrame:
    """An audit entry for each row: what it is about, what was done, and details as JSON."""
    return rows.select(F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_id"), F.lit(action).alias("action"), F.to_json(F.struct(*detail)).alias("detail"))


def merged_month(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of months after uploads of parts of them. Both: branch, period, sku, item, qty, turnover_cents, day_from,
    day_to; new also `part`, if there are several uploads of a month: they are taken one after another in its order. By the
    days a month has by then and those that come: all new ones replace, ones inside stay out, ones next to them are added by
    sku over the widened days, all others are refused. Adds decision, that of each part in order with commas between, or
    keep where nothing came. A month's parts, a few, are folded as an array; its rows meet only their fate."""
    from .panel import merge_decision

    keys = ["branch", "period"]
    new = new.withColumn("__part", F.col("part").cast("string") if "part" in new.columns else F.lit("")).drop("part")
    span = lambda rows, *more: rows.groupBy(*keys, *more).agg(F.min("day_from").alias("from"), F.max("day_to").alias("to"))
    parts = span(new, "__part").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__part", "from", "to"))).alias("parts"))
    strings = F.array().cast("array<string>")
    start = F.struct(F.col("from"), F.col("to"), F.col("from").isNotNull().alias("old"), strings.alias("kept"), strings.alias("decisions"))

    def take(s: Column, p: Column) -> Column:
        said = merge_decision(s["from"], s["to"], p["from"], p["to"])
        alone, add = said.isin("save", "replace"), said == "add"
        return F.struct(
            F.when(alone, p["from"]).when(add, F.least(s["from"], p["from"])).otherwise(s["from"]).alias("from"),
            F.when(alone, p["to"]).when(add, F.greatest(s["to"], p["to"])).otherwise(s["to"]).alias("to"),
            (s["old"] & ~alone).alias("old"),
            F.when(alone, F.array(p["__part"])).when(add, F.concat(s["kept"], F.array(p["__part"]))).otherwise(s["kept"]).alias("kept"),
            F.concat(s["decisions"], F.array(said)).alias("decisions"),
        )

    folded = span(old).join(parts, keys, "full").withColumn("fate", F.aggregate(F.coalesce("parts", F.array().cast("array<struct<__part:string,from:int,to:int>>")), start, take))
    said = F.when(F.col("parts").isNull(), "keep").otherwise(F.array_join("fate.decisions", ","))
    decided = folded.select(*keys, "fate", said.alias("decision"))
    tagged = old.withColumn("__part", F.lit(None).cast("string")).unionByName(new).join(decided, keys)
    own = F.col("__part").isNull()
    kept = tagged.filter(F.when(own, F.col("fate.old")).otherwise(F.array_contains("fate.kept", F.col("__part"))))
    widened = F.size("fate.kept") + F.col("fate.old").cast("int") > 1
    first = F.min_by("item", F.struct(F.when(own, 0).otherwise(F.array_position("fate.kept", F.col("__part"))), F.col("item")))
    return kept.groupBy(*keys, "sku", "decision").agg(
        first.alias("item"), F.sum("qty").alias("qty"), F.sum("turnover_cents").alias("turnover_cents"),
        F.min(F.when(widened, F.col("fate.from")).otherwise(F.col("day_from"))).alias("day_from"), F.max(F.when(widened, F.col("fate.to")).otherwise(F.col("day_to"))).alias("day_to"),
    )
