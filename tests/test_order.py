"""Order-dependent operators against the literal sequential rule."""

import random

from pyspark.sql import functions as F

from quaytally.operators import order, rules
from quaytally.sources import grids, lines

MANIFEST = "document_id long, item_id long, line_no long, section string, marks string, item_code string, description string, shop string, total_cartons decimal(18,3), total_quantity double, unit_price_rmb double, total_amount_rmb double, total_cbm double, total_weight_kg double, remarks string"


def sequential_dedupe(rows):
    out = [dict(r) for r in rows]
    for before, row in zip(out, out[1:]):
        if row["section"] != "shipped" or before["section"] != "shipped":
            continue
        if all(row[k] == before[k] for k in order.DUPLICATE_KEYS):
            row["total_cartons"], row["remarks"] = 0, "carton_dedup:secondary_row"
    return [(r["item_id"], float(r["total_cartons"]), r["remarks"]) for r in out]


def test_runs_of_equal_rows_lose_every_second_carton(spark):
    random.seed(1)
    rows = []
    for doc in range(30):
        for line in range(1, 12):
            value = random.choice([5, 5, 5, 0])
            mark = random.choice("ab")
            section = random.choice(["shipped"] * 5 + ["repacked"])
            rows.append(dict(document_id=doc, item_id=doc * 100 + line, line_no=line, section=section, marks=mark, item_code="x", description="d", shop="s", total_cartons=value, total_quantity=1.0, unit_price_rmb=1.0, total_amount_rmb=1.0, total_cbm=1.0, total_weight_kg=1.0, remarks=None))
    expected = [x for doc in range(30) for x in sequential_dedupe([r for r in rows if r["document_id"] == doc])]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], MANIFEST.replace("decimal(18,3)", "long")).withColumn("total_cartons", F.col("total_cartons").cast("decimal(18,3)"))
    got = [(r.item_id, float(r.total_cartons), r.remarks) for r in order.cartons_deduplicated(df).orderBy("item_id").collect()]
    assert got == expected


def test_runs_of_two_three_and_four(spark):
    for n, cartons in ((2, [5, 0]), (3, [5, 0, 5]), (4, [5, 0, 5, 0])):
        rows = [(1, i, i, "shipped", "m", "x", "d", "s", 5, 1.0, 1.0, 1.0, 1.0, 1.0, None) for i in range(n)]
        df = spark.createDataFrame(rows, MANIFEST.replace("decimal(18,3)", "long")).withColumn("total_cartons", F.col("total_cartons").cast("decimal(18,3)"))
        assert [int(r.total_cartons) for r in order.cartons_deduplicated(df).orderBy("item_id").collect()] == cartons


def test_overflow_skips_what_is_too_large(spark):
    rows = [(1, i, i, float(24 * (10)), 24.0, float(10 + extra)) for i, extra in enumerate((8, 6, 4, 9))]
    items = spark.createDataFrame(rows, "document_id long, item_id long, line_no long, total_quantity double, qty_per_carton double, total_cartons double")
    footers = spark.createDataFrame([(1, float(sum(r[5] for r in rows) - 13))], "document_id long, footer_cartons double")
    got = {(r.item_id, r.new_cartons) for r in order.overflow_reconciled(items, footers).collect()}
    assert got == {(3, 10.0), (2, 10.0)}  # 9 is taken, 8 and 6 do not fit in 4, 4 does


def test_continuations_fold_into_the_merged_row(spark):
    rows = [
        (1, 1, 1, "M", "K 1", "steel cup large", None, None, None, None), (1, 2, 2, "", "k1", "22", 5.0, 2.0, 10.0, "r"), (1, 3, 3, "M", "K1", "", 7.0, None, None, None), (1, 4, 4, "X", "K1", "33", 1.0, None, None, None), (1, 5, 5, "X", "K1", "long title text", None, 3.0, None, None),
        (2, 6, 1, None, "__FOOTER__", "", None, None, None, None), (2, 7, 2, None, "__FOOTER__", "longer text", 1.0, 1.0, 1.0, None), (2, 8, 3, None, None, "x", None, None, None, None), (2, 9, 4, None, None, "y y y y y", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "document_id long, item_id long, line_no long, marks string, item_code string, description string, total_quantity double, unit_price_rmb double, total_amount_rmb double, remarks string")
    got = [tuple(r)[1:] for r in order.continuations_merged(df).drop("line_no").orderBy("item_id").collect()]
    tag = order.MERGED_TAG
    assert got == [
        (1, "M", "K 1", "steel cup large", 5.0, 2.0, 10.0, f"r;{tag}"), (3, "M", "K1", "", 7.0, None, None, None), (4, "X", "K1", "33 long title text", 1.0, 3.0, None, tag),
        (6, None, "__FOOTER__", "", None, None, None, None), (7, None, "__FOOTER__", "longer text", 1.0, 1.0, 1.0, None), (8, None, None, "x", None, None, None, None), (9, None, None, "y y y y y", None, None, None, None),
    ]


def test_chunks(spark):
    def got(table, **sizes):
        df = spark.createDataFrame(table, "document_id long, line_no long, text string")
        return [(r.chunk, r.first_line, r.last_line) for r in lines.chunks(df, **sizes).orderBy("chunk").collect()]

    anchored = [(1, i, f"MS-101-{i}" if i % 3 == 0 else " " if i % 3 == 1 else "x") for i in range(30)]
    # blank lines go, and anchors among the repeated lines count
    assert got(anchored, rows=2, most=100, overlap=1) == [(0, 0, 5), (1, 5, 11), (2, 11, 17), (3, 17, 23), (4, 23, 29)]
    assert got(anchored, rows=2, most=100, overlap=2) == [(0, 0, 5), (1, 3, 8), (2, 6, 11), (3, 9, 14), (4, 12, 17), (5, 15, 20), (6, 18, 23), (7, 21, 26), (8, 24, 29)]
    # without anchors a piece still ends
    assert got([(1, i, "x") for i in range(50)], rows=2, most=10, overlap=0) == [(k, 10 * k, 10 * k + 9) for k in range(5)]


def test_rowspan_moves_later_cells(spark):
    page = "<table><tr><td rowspan=2>A</td><td>b</td></tr><tr><td colspan='2'>c&amp;d<br>e</td></tr><tr><td>f<br>rs x</td></tr></table>"
    got = {(r.row, r.col): r.text for r in grids.html_cells(spark.createDataFrame([(1, page), (2, None), (3, "<p>none</p>")], "page_id long, html string")).collect()}
    # rows are as wide as the table
    assert got == {(0, 0): "A", (0, 1): "b", (0, 2): "", (1, 0): "A", (1, 1): "c&de", (1, 2): "c&de", (2, 0): "f rs x", (2, 1): "", (2, 2): ""}


def test_delivery_note_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿title,,,\n"MARKS / SKU",QTY,"A ""x""",\nm-1,"2\nlines",3,4\n,,,\nbanner,,,\nm-2,5,6,\n', encoding="utf-8")
    rows = grids.headed_rows(grids.delivery_notes(spark, str(tmp_path / "a.csv"))).orderBy("record").collect()
    assert [dict(r.cells) for r in rows] == [{"MARKS / SKU": "m-1", "QTY": "2\nlines", 'A "x"': "3", "__col3": "4"}, {"MARKS / SKU": "m-2", "QTY": "5", 'A "x"': "6", "__col3": ""}]


def manifest_row(spark, **values):
    row = tuple(values.get(c) for c in rules.MANIFEST_FIELDS)
    return spark.createDataFrame([row], ", ".join(f"{c} {'string' if i < 6 else 'double'}" for i, c in enumerate(rules.MANIFEST_FIELDS)))


def test_shift_rules(spark):
    moved = dict(description="pan", packing="2CTNS", unit_weight="12KGS", total_weight="15", cartons=48.0, quantity=60.0, unit_cbm=0.2, cbm=9.0, cost_price=700.0)
    got = rules.manifest_repaired(manifest_row(spark, **moved)).first()
    assert (got.cartons, got.quantity, got.cbm, got.unit_cbm, got.cost_price, got.total_amount_rmb, got.packing, got.unit_weight, got.total_weight) == (2.0, 48.0, 0.2, 0.1, 15.0, 700.0, "24pcs/ctn", "9KGS", "12KGS")
    assert got.remarks == "repair:compact_packed_shift_row_v2"
    one = rules.manifest_repaired(manifest_row(spark, **moved | dict(cartons=3.0, cost_price=15.0))).first()
    assert (one.cartons, one.quantity, one.total_amount_rmb, one.remarks) == (2.0, 2.0, 15.0, "repair:manifest_outlier_shift")
    fine = dict(description="pan", packing="24pcs/ctn", unit_weight="4KGS", total_weight="8KGS", cartons=2.0, quantity=48.0, unit_cbm=0.1, cbm=0.2, cost_price=5.0, total_amount_rmb=240.0)
    assert rules.manifest_repaired(manifest_row(spark, **fine)).first().asDict() == {c: fine.get(c) for c in rules.MANIFEST_FIELDS}


def test_running_stock_is_the_same_in_slices_of_any_length(spark):
    import random
    from datetime import datetime, timedelta
    from decimal import Decimal

    rng = random.Random(3)
    moves = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["in", "in", "out", "adjustment" if i % 9 == 0 else "in"]), Decimal(rng.randrange(1, 50)), datetime(2026, 1, 1) + timedelta(minutes=rng.randrange(3000))) for i in range(400)]
    moves.append((400, 1, "in", Decimal(7), None))
    expected, stock = {}, {}
    for i, product, kind, quantity, _ in sorted(moves, key=lambda m: (m[4] is not None, m[4] or datetime.min, m[0])):
        stock[product] = quantity if kind == "adjustment" else stock.get(product, 0) + (-quantity if kind == "out" else quantity)
        expected[i] = stock[product]
    frame = spark.createDataFrame(moves, "movement_id long, product_id long, movement_type string, quantity decimal(18,2), created_at timestamp")
    for seconds in (60, 3600, 1 << 40):
        assert {r.movement_id: r.stock for r in order.running_stock(frame, seconds).collect()} == expected, seconds


def test_names_are_ranked_by_their_own_order(spark):
    from pyspark.sql import functions as F

    from quaytally.operators import joins

    names = ["aez", "\u00e6x", "aex2", "e\u0301z", "ea", "\u00c5ngstrom", "angstrom2", "Zed", "zeb", "\u00df", "ss1", ""]
    frame = spark.createDataFrame([(n,) for n in names], "name string").select(F.collate("name", "UNICODE_CI_AI").alias("name")).repartition(3)
    found = [r.name for r in joins.name_ranks(frame, "name").orderBy("name_rank").collect()]
    assert found == [r.name for r in frame.orderBy("name").collect()]
    assert sorted(r.name_rank for r in joins.name_ranks(frame, "name").collect()) == list(range(1, len(names) + 1))


def test_donors_are_those_of_all_pairs(spark):
    import random

    from quaytally.operators import joins

    rng = random.Random(8)
    words = ["steel", "cup", "big", "lid", "cup", "xx", "red"]
    rows = []
    for i in range(160):
        priced = i % 3 != 0
        rows.append((i, i % 2, i, rng.choice(["AB-1", "AB-2", "CDE-9", "", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(5))), rng.choice([None, 10.0, 11.0, 13.0]), 5.0, float(i) if priced else None, None))
    items = spark.createDataFrame(rows, "item_id long, document_id long, line_no long, item_code string, description string, qty_per_carton double, total_quantity double, unit_price_rmb double, total_amount_rmb double")
    keyed = items.select("*", joins.code_stem(items["item_code"]).alias("stem"), joins.tokens(items["description"]).alias("words")).collect()
    expected = {}
    for n in (r for r in keyed if not (r.unit_price_rmb or 0) > 0):
        best = None
        for d in (r for r in keyed if (r.unit_price_rmb or 0) > 0 and r.document_id == n.document_id):
            score = 4 * (n.stem != "" and n.stem == d.stem) + 3 * (sum(w in n.words for w in d.words) >= 2) + (None not in (n.qty_per_carton, d.qty_per_carton) and abs(n.qty_per_carton - d.qty_per_carton) <= 2)
            if score >= 3 and (best is None or (-score, d.line_no) < best):
                best = (-score, d.line_no)
        if best:
            expected[n.item_id] = best
    assert {r.item_id: (-r.score, r.donor_line) for r in joins.price_donors(items).collect()} == expected


def test_compiled_products_may_round_after_each_addition(spark):
    from decimal import Decimal

    from quaytally.operators import reports

    volumes = ("0.00004", "0.00004", "0.00006", "1")
    rows = [(i, i, "shipped", "cup", "4pcs/ctn", "m", "c", Decimal(v), Decimal(1), Decimal(4), Decimal(2), Decimal(8)) for i, v in enumerate(volumes)]
    decimals = ", ".join(f"{c} decimal(18,6)" for c in ("total_cbm", "total_cartons", "total_quantity", "total_weight_kg", "total_amount_rmb"))
    items = spark.createDataFrame(rows, f"item_id long, line_no long, section string, description string, packaging string, marks string, item_code string, {decimals}")
    assert float(reports.compiled_products(items).first().cbm) == 1.0001
    assert float(reports.compiled_products(items, exact=True).first().cbm) == 1.0001
    assert float(reports.compiled_products(items.where("item_id < 2")).first().cbm) == 0.0001
    assert float(reports.compiled_products(items.where("item_id < 2"), exact=True).first().cbm) == 0.0
