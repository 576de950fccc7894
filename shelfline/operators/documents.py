"""Dispatch notes and invoices from where their cells or words stand: headers by their aliases, what labels say, and tables
laid out by the boxes of words."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parsed_date
from . import files

#: What headers of sent and description columns contain, and labels of a note's number and branch.
SENT_KEYS = ["sent qty", "sent_qty", "sent", "dispatched", "dispatch qty", "delivered", "supplied", "issued"]
DESCRIPTION_KEYS = ["description", "name", "desc", "product name", "item description"]
NUMBER_LABEL = r"(?i)stock\s*movement|movement\s*(no|id|#|number)|document\s*(no|id)|transfer\s*(no|id)"
BRANCH_LABEL = r"(?i)to\s*location|receiving|destination|branch|to\s*branch"
#: A note's number after a colon, the form of a product's code, and the least and relative reach of a line.
NUMBER, SKU, LEAST_REACH, REACH = r"[A-Za-z0-9\-/]{4,}", r"^[A-Za-z0-9][A-Za-z0-9._/\-]{2,}$", 3.0, 0.6
#: Rows after the header in which labels count.
LABEL_ROWS = 3


def _plain(cell: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(cell, r"\s+", " ")))


def _place(cells: Column, keys: list[str], other_than: Column | None = None) -> Column:
    """The first cell that contains a key; null where none does."""
    has = lambda c: F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(c, k))
    fits = (lambda c, i: has(c)) if other_than is None else (lambda c, i: has(c) & (i != other_than))
    return F.array_min(F.filter(F.transform(cells, lambda c, i: F.when(fits(c, i), i)), lambda i: i.isNotNull()))


def headers(rows: DataFrame) -> DataFrame:
    """file, head_row and the columns sku, requested, sent and description of each file: the first of its first rows with a
    column of codes and one of requests, or else with one of descriptions and one of counts, as invoices have (sku null)."""
    cells = F.transform("cells", lambda c: _plain(F.coalesce(c, F.lit(""))))
    near = rows.filter(F.col("row") < files.HEADER_ROWS).select("file", "row", cells.alias("cells"))
    c = F.col("cells")
    found = near.select("file", "row", _place(c, files.ITEM_KEYS).alias("sku"), _place(c, files.REQUEST_KEYS).alias("requested"), _place(c, SENT_KEYS).alias("sent"), _place(c, DESCRIPTION_KEYS).alias("description"), "cells")
    found = found.withColumn("count", _place(c, files.COUNT_KEYS, F.coalesce("description", F.lit(-1)))).drop("cells")
    note = F.col("sku").isNotNull() & F.col("requested").isNotNull()
    invoice = F.col("description").isNotNull() & F.col("count").isNotNull()
    first = lambda some, *columns: F.min(F.when(some, F.struct(F.col("row").alias("head_row"), *columns)))
    none = F.lit(None).cast("int")
    heads = found.groupBy("file").agg(
        first(note, F.col("sku"), F.col("requested"), F.col("sent"), F.col("description")).alias("note"),
        first(invoice, none.alias("sku"), F.col("count").alias("requested"), none.alias("sent"), F.col("description")).alias("invoice"),
    )
    return heads.select("file", F.coalesce("note", "invoice").alias("head")).filter("head IS NOT NULL").select("file", "head.*")


def labelled(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """file, number, branch, doc_date: what stands behind a colon in a cell with the label, or in the next cell that has
    something, of the rows before the header and the next three; the date is the first of any kind there, and without a
    labelled number the first cell before the header with six digits or more and nothing else is one."""
    near = rows.join(heads.select("file", "head_row"), "file").filter((F.col("row") <= F.col("head_row") + LABEL_ROWS) & (F.col("row") != F.col("head_row")))
    cells = F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))))
    near = near.select("file", "row", "head_row", cells.alias("cells"))
    behind = lambda c: F.when(F.contains(c, F.lit(":")), F.trim(F.element_at(F.split(c, ":"), -1)))
    after = lambda i: F.get(F.filter(F.slice("cells", i + 2, F.size("cells")), lambda n: n != ""), F.lit(0))

    def said(label: str, value) -> Column:
        told = F.transform("cells", lambda c, i: F.when(_plain(c).rlike(label), F.coalesce(value(behind(c)), after(i))))
        return F.get(F.filter(told, lambda v: v.isNotNull()), F.lit(0))

    some = lambda v: F.when(v != "", v)
    bare = F.get(F.filter("cells", lambda c: c.rlike("^[0-9]{6,}$")), F.lit(0))
    told = near.select(
        "file", "row", said(NUMBER_LABEL, lambda b: some(F.regexp_extract(F.coalesce(b, F.lit("")), NUMBER, 0))).alias("number"), said(BRANCH_LABEL, some).alias("branch"),
        parsed_date(F.array_join("cells", " | ")).alias("doc_date"), F.when(F.col("row") < F.col("head_row"), bare).alias("bare"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row"))).alias(c)
    sums = told.groupBy("file").agg(*map(first, ("number", "branch", "doc_date", "bare")))
    return sums.select("file", F.coalesce("number", "bare").alias("number"), "branch", "doc_date")


def from_cells(rows: DataFrame) -> DataFrame:
    """number, branch and doc_date of each file beside its lines, as files.document_lines() gives them. rows: file, row,
    cells. Files without a header or lines give nothing."""
    heads = headers(rows)
    cell = lambda c: F.trim(F.coalesce(F.get("cells", F.col(c)), F.lit("")))
    invoice = F.col("sku_at").isNull()
    heads_at = heads.select("file", "head_row", *(F.col(c).alias(f"{c}_at") for c in ("sku", "requested", "sent", "description")))
    body = rows.join(heads_at, "file").filter(F.col("row") > F.col("head_row"))
    lines = body.select(
        "file", "row", F.when(~invoice, cell("sku_at")).alias("sku"), F.when(F.col("description_at").isNull(), "").otherwise(cell("description_at")).alias("description"),
        F.when(invoice, F.regexp_replace(cell("requested_at"), r"[^\d.,]", "")).otherwise(cell("requested_at")).alias("requested"), F.when(F.col("sent_at").isNotNull(), cell("sent_at")).alias("sent"),
    )
    real = F.when(F.col("sku").isNull(), F.col("description") != "").otherwise(~F.lower("sku").isin("", "nan", "none"))
    return files.document_lines(lines.filter(real), once=False).join(labelled(rows, heads), "file", "left")


#: What words of a header contain, and what those over its columns begin with; bits of a number in this order.
_HOLD, _BEGIN = (("req.",), ("description",), ("sent", "qty")), ("item", "req", "desc", "sent", "rec")
_MAY = "|".join(t.replace(".", r"\.") for some in (*_HOLD, _BEGIN) for t in some)
#: Words of a task that are laid out at once, whole pages.
WORDS_AT_ONCE = 100_000
_PARTS = ("sku", "requested", "description", "sent")


def lines_of_words(words: DataFrame, tasks: int | None = None) -> DataFrame:
    """file, page, line and the texts under each column (sku, requested, description, sent) of words (file, page, text, x0, x1,
    top, bottom). A word within reach of a line's first top, in points or pixels as the page's words are high, belongs to it.
    Bounds between columns are half way between the middles of a header's words, and a word lies before the first bound that
    is to the right of its middle. Lines of a page up to its header go, as do lines without a code; a page without a header goes
    on with the columns of the page before. Words move once, to where their file is; a worker holds whole pages, some 100,000
    words or one page at a time."""
    number = lambda c: F.col(c).cast("double")
    whole = words.filter((F.trim("text") != "") & F.col("file").isNotNull() & F.col("page").isNotNull())
    whole = whole.select("file", F.col("page").cast("long").alias("page"), "text", number("x0").alias("x0"), ((number("x0") + number("x1")) / 2).alias("middle"), number("top").alias("top"), (number("bottom") - number("top")).alias("height"))
    # a number sorts faster than a name; what files share by chance is told apart later
    whole = whole.withColumn("at", F.xxhash64("file"))
    near = (whole.repartition(tasks, "at") if tasks else whole.repartition("at")).sortWithinPartitions("at", "page")
    ready = near.select("at", "file", "page", F.trim("text").alias("text"), "x0", "middle", "top", "height")
    return ready.mapInArrow(_laid_out, "file string, page long, line int, sku string, requested string, description string, sent string")


@lru_cache(10_000)
def _bits(text: str) -> int:
    """What of _HOLD and _BEGIN a word says."""
    plain = text.lower().lstrip(" \t\n\v\f\r")
    said = [any(t in plain for t in some) for some in _HOLD] + [plain.startswith(t) for t in _BEGIN]
    return sum(1 << i for i, s in enumerate(said) if s)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, limit, heads = [], 0, WORDS_AT_ONCE, {}
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < limit:
            continue
        table = pa.Table.from_batches(held)
        at, page = table["at"].to_numpy(), table["page"].to_numpy()
        whole = n - int(((at == at[-1]) & (page == page[-1])).sum())  # the last page may go on
        if whole:
            yield from _lines(table.slice(0, whole), heads)
        held, n = table.slice(whole).combine_chunks().to_batches(), n - whole
        limit = max(WORDS_AT_ONCE, 2 * n)
    if n:
        yield from _lines(pa.Table.from_batches(held), heads)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and which are null."""
    return column.to_numpy(), column.is_null().to_numpy()


def _begins(tops: list[float], first: np.ndarray, end: np.ndarray, reach: np.ndarray) -> list[int]:
    """Where lines begin: tops are in order within each page (first to end), and a line is what is within reach of its first."""
    found = []
    for i, stop, far in zip(first.tolist(), end.tolist(), reach.tolist()):
        while i < stop:
            found.append(i)
            begin = tops[i]
            j = bisect_right(tops, begin + far, i + 1, stop)
            # sums and differences may round apart
            while j < stop and not tops[j] - begin > far:
                j += 1
            while j > i + 1 and tops[j - 1] - begin > far:
                j -= 1
            i = j
    return found


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _lines(table: pa.Table, heads: dict[str, tuple]) -> Iterator[pa.RecordBatch]:
    """The lines of whole pages. heads: the last header of each file that may go on, which is brought up to date."""
    named = table["file"].combine_chunks().dictionary_encode()
    (top, no_top), (x0, no_x0), (height, _), (middle, _) = (_numbers(table[c]) for c in ("top", "x0", "height", "middle"))
    code, page = named.indices.to_numpy(), table["page"].to_numpy()
    # nulls come first, and what is no number last
    top, x0 = (np.where(none, -np.inf, np.where(np.isnan(v), np.inf, v)) for v, none in ((top, no_top), (x0, no_x0)))
    order = np.lexsort((x0, top, page, code))
    code, page, top, x0, no_top, height, middle = (v[order] for v in (code, page, top, x0, no_top, height, middle))
    texts = table["text"].combine_chunks()
    bits, may = np.zeros(len(order), np.int64), pc.match_substring_regex(texts, _MAY, ignore_case=True).to_numpy(zero_copy_only=False)
    bits[may] = [_bits(t) for t in texts.filter(may).to_pylist()]
    bits = bits[order]

    starts = _runs(code, page)
    ends = np.append(starts[1:], len(order))
    of_page = np.repeat(np.arange(len(starts)), ends - starts)
    high = height > 0
    tall = np.lexsort((height[high], of_page[high]))
    of_tall, tall = of_page[high][tall], height[high][tall]
    reach = np.full(len(starts), 10.0)
    if len(tall):
        begin = _runs(of_tall)
        reach[of_tall[begin]] = tall[begin + np.diff(np.append(begin, len(tall))) // 2]
    reach = np.maximum(LEAST_REACH, REACH * reach)
    new = np.zeros(len(order), np.int64)
    new[_begins(top.tolist(), starts + np.add.reduceat(no_top, starts, dtype=np.int64), ends, reach)] = 1
    line = np.cumsum(new)
    line -= (line - new)[starts][of_page]  # words without a top are in line 0

    # headers
    rows = _runs(of_page, line)
    of_row = np.repeat(np.arange(len(rows)), np.diff(np.append(rows, len(order))))
    good = (np.bitwise_or.reduceat(bits, rows) & 0b111) == 0b111
    places = np.full((len(_BEGIN), len(rows)), np.nan)
    for i, place in enumerate(places):
        said = np.flatnonzero((bits >> (i + len(_HOLD)) & 1).astype(bool) & good[of_row])
        row, first = np.unique(of_row[said], return_index=True)
        place[row] = middle[said[first]]
    good &= ~np.isnan(places[:3]).any(axis=0)
    of_head, first = np.unique(of_page[rows[good]], return_index=True)
    columns, head_line = np.full((len(_BEGIN), len(starts)), np.nan), np.zeros(len(starts), np.int64)
    columns[:, of_head], head_line[of_head] = places[:, good][:, first], line[rows[good]][first]
    has = np.zeros(len(starts), bool)
    has[of_head] = True
    file_of = code[starts]
    last = np.maximum.accumulate(np.where(has, np.arange(len(starts)), -1))
    known = (last >= 0) & (file_of[last] == file_of)
    columns = np.where(known, columns[:, last], np.nan)
    for i in np.flatnonzero(~known & np.isin(file_of, [i for i, f in enumerate(named.dictionary.to_pylist()) if f in heads])) if heads else ():
        columns[:, i], known[i] = heads[named.dictionary[int(file_of[i])].as_py()], True
    goes_on = table["at"].to_numpy()[order][starts] == table["at"][-1].as_py()
    after = {named.dictionary[int(file_of[i])].as_py(): tuple(columns[:, i]) for i in np.flatnonzero(goes_on & known)}
    heads.clear()
    heads.update(after)

    # columns
    item, req, desc, sent, rec = columns
    far = 1e9
    bounds = np.stack([(item + req) / 2, (req + desc) / 2, (desc + np.where(np.isnan(sent), desc + 200, sent)) / 2, np.where(np.isnan(sent), far, (sent + np.where(np.isnan(rec), far, rec)) / 2)])
    inside = np.flatnonzero(known[of_page] & (line > head_line[of_page]))
    before = middle[inside] < bounds[:, of_page[inside]]
    place = np.where(before.any(axis=0), before.argmax(axis=0), len(bounds))
    wanted = np.unique(of_row[inside[place == 0]])  # without a code there is no line
    out = {}
    for i, name in enumerate(_PARTS):
        mine = inside[place == i]
        mine = mine[np.isin(of_row[mine], wanted)]
        mine = mine[np.lexsort((x0[mine], of_row[mine]))]
        same = np.flatnonzero((of_row[mine][1:] == of_row[mine][:-1]) & (x0[mine][1:] == x0[mine][:-1]))
        if len(same):  # equal places go by text
            for part in np.split(same, np.flatnonzero(np.diff(same) != 1) + 1):
                span = slice(part[0], part[-1] + 2)
                mine[span] = sorted(mine[span], key=lambda w: (texts[int(order[w])].as_py().encode(), middle[w]))
        offsets = np.searchsorted(of_row[mine], np.append(wanted, len(rows))).astype(np.int32)
        out[name] = pc.binary_join(pa.ListArray.from_arrays(offsets, texts.take(order[mine])), " " if name == "description" else "")
    at = rows[wanted]
    yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(code[at])), pa.array(page[at]), pa.array(line[at].astype(np.int32)), *out.values()], ["file", "page", "line", *out])


def lines_with_columns(lines: DataFrame) -> DataFrame:
    """file, row and the texts of the lines that have a product's code in its column."""
    coded = lines.filter(F.col("sku").rlike(SKU))
    return coded.select("file", (F.col("page") * 1_000_000 + F.col("line")).alias("row"), *_PARTS)


def from_words(words: DataFrame, tasks: int | None = None) -> DataFrame:
    """Lines of dispatch notes from the words of their pages: file, row, sku, description, requested_qty, sent_qty. Words go
    to the column in whose interval their middle lies, and what has no code or no positive request is no line. Empty words
    and pages before the first header count for nothing; of equal codes and requests of a file the first stays. tasks: how
    many the words are dealt to, where that is known."""
    return files.document_lines(lines_with_columns(lines_of_words(words, tasks)))
