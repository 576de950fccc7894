"""Headers, labels and laid-out words on small documents."""

import datetime
import random

import pyarrow as pa

from shelfline.operators import documents

CELLS, WORDS = "file string, row long, cells array<string>", "file string, page long, text string, x0 double, x1 double, top double, bottom double"


def from_cells(spark, *files):
    rows = [(f"f{i}", r, cells) for i, file in enumerate(files) for r, cells in enumerate(file)]
    return sorted(map(tuple, documents.from_cells(spark.createDataFrame(rows, CELLS)).select("file", "sku", "description", "requested_qty", "sent_qty", "number", "branch", "doc_date").collect()))


def test_headers_by_their_aliases_and_labels(spark):
    got = from_cells(
        spark,
        [["Transfer ID", "", "TR/77-1"], ["To Location: Main  Branch"], ["Item No.", " REQ. QTY", "Description"], ["A1", "1,200", "nuts"], ["nan", "3", "x"], ["B2", "0", "x"], ["C3"], ["D4", "2.0"]],
        [["no header"], ["A", "1"]],
        [["1234567"], ["12345"], ["Product", "Requested", "Supplied"], ["P-1", "5", "9"], ["P-1", "5", None], ["Date", "", "7/4/2001"]],
        [["Document No: 12", "LATE-9"], ["Description", "Units", "Units"], ["2) Model: Big Pump.", "10 sets"], ["", "4"]],
        [],
    )
    day = datetime.date(2001, 4, 7)
    assert got == sorted([
        ("f0", "A1", "nuts", 1200, 0, "TR/77-1", "Main  Branch", None), ("f0", "D4", "", 2, 0, "TR/77-1", "Main  Branch", None),
        ("f2", "P-1", "", 5, 5, "1234567", None, day), ("f2", "P-1", "", 5, 0, "1234567", None, day),
        ("f3", "BIGPUMP", "Big Pump", 10, 10, "LATE-9", None, None),
    ])


def test_lines_by_reach_and_columns_over_pages(spark):
    w = lambda page, text, x, top, h=10.0: ("f", page, text, float(x), float(x + 10), float(top), float(top + h))
    head = [w(1, t, x, 50) for t, x in (("Item", 0), ("No", 12), ("Req.", 100), ("Qty", 112), ("Description", 200), ("Sent", 300))]
    body = [w(1, "AB-", 0, 70), w(1, "12", 14, 76), w(1, "1", 96, 75), w(1, "0", 108, 74), w(1, "late", 215, 70), w(1, "long", 190, 75.9), w(1, "4", 300, 71), w(1, "CD-99", 0, 77), w(1, "7", 100, 77)]
    later = [w(2, "EF-1", 0, 20), w(2, "3", 100, 20), w(2, "8", 300, 20), w(2, "!!", 0, 40), w(2, "5", 100, 40), w(3, "AB-12", 0, 5), w(3, "10", 100, 5), w(2, "  ", 0, 60)]
    words = spark.createDataFrame(head + body + later + [("g", 1, "lost", 0.0, 9.0, 1.0, 2.0)], WORDS).repartition(3)
    got = [(r.sku, r.requested_qty, r.description, r.sent_qty) for r in documents.from_words(words).orderBy("row").collect()]
    # within six points of its first word a line goes on; the page after the header keeps its columns; AB-12 comes twice
    assert got == [("AB-12", 10, "long late", 4), ("CD-99", 7, "", 0), ("EF-1", 3, "", 3)]
    assert documents.from_words(words.limit(0)).count() == 0 and documents.from_cells(spark.createDataFrame([], CELLS)).count() == 0


def test_words_move_once(spark):
    """Pages, headers and lines of a file are found where its words are; a page without a header goes on with the one before."""
    rows = [("f", 1, t, x, x + 10.0, 20.0) for t, x in (("Item", 10.0), ("Req.", 100.0), ("Qty", 112.0), ("Description", 200.0), ("Sent", 400.0))]
    rows += [("f", p, t, x, x + 10.0, 40.0 + dy) for p in (1, 2) for t, x, dy in ((f"AB{p}-", 10.0, 0.0), ("X", 22.0, 1.0), (str(p + 3), 104.0, -1.0), ("thing", 215.0, 0.0), ("a", 195.0, 0.0), ("2", 402.0, 2.0))]
    rows += [("g", 1, "CD1", 10.0, 20.0, 40.0), (None, 1, "CD1", 10.0, 20.0, 40.0)]
    words = spark.createDataFrame([(*r, r[5] + 10.0) for r in rows], "file string, page int, text string, x0 double, x1 double, top double, bottom double")
    found = documents.from_words(words)
    assert {(r.file, r.sku, r.description, r.requested_qty, r.sent_qty) for r in found.collect()} == {("f", "AB1-X", "a thing", 4, 2), ("f", "AB2-X", "a thing", 5, 2)}
    assert "Join" not in documents.lines_with_columns(documents.lines_of_words(words))._jdf.queryExecution().executedPlan().toString()


def test_words_are_laid_out_in_one_pass(spark):
    """Words were sorted and collected for pages, lines, headers and files in turn."""
    words = spark.createDataFrame([], WORDS)
    plan = documents.from_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and plan.count("MapInArrow") == 1


def test_pages_and_headers_go_on_over_batches(monkeypatch):
    """Files a and b are told apart though their numbers are the same; a header goes on to the next pages of its file only."""
    rng, rows = random.Random(3), []
    word = lambda at, file, page, text, x, top: rows.append((at, file, page, text, float(x), x + 5.0, top, 10.0))
    for at, file, pages in ((1, "a", range(1, 9)), (1, "b", range(1, 9)), (2, "c", (1, 4, 5)), (3, "d", (1,))):
        for page in pages:
            shift = 30 if page >= 4 else 0  # the columns of the second header are further to the right
            if page in (1, 4) and file != "d" or (file, page) == ("b", 6):
                for text, x in (("Item", 0), ("REQ.", 100), ("Description", 200), ("Sent", 300)):
                    word(at, file, page, text, x + shift, 10.0)
            for line in range(3):
                for text, x in ((f"{file.upper()}{page}", 0), (f"-{line}", 20), (str(line + 1), 95), ("y", 190), ("z", 190), ("x", 210), ("1", 295)):
                    word(at, file, page, text, x + shift, 40.0 + 20 * line + rng.choice([0, 3, 5.5]))
    rng.shuffle(rows)
    rows.sort(key=lambda r: (r[0], r[2]))
    table = pa.table(dict(zip(("at", "file", "page", "text", "x0", "middle", "top", "height"), map(list, zip(*rows)))))

    def laid_out(size):
        monkeypatch.setattr(documents, "WORDS_AT_ONCE", size)
        return sorted(tuple(r.values()) for b in documents._laid_out(iter(table.to_batches(max_chunksize=max(1, size // 3)))) for r in b.to_pylist())

    want = sorted((f, p, n + (2 if p in (1, 4) or (f, p) == ("b", 6) else 1), f"{f.upper()}{p}-{n}", str(n + 1), "y z x", "1") for f, pages in (("a", range(1, 9)), ("b", range(1, 9)), ("c", (1, 4, 5))) for p in pages for n in range(3))
    assert laid_out(100_000) == want
    for size in (1, 20, 50, 120):
        assert laid_out(size) == want
    assert list(documents._laid_out(iter([]))) == []
