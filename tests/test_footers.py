"""Footer rows of every pattern and column."""

def test_footer_rows_of_all_patterns_and_columns(spark):
    from quaytally.operators import joins as J

    words = [*J.FOOTER_WORDS, "Freight", "balance payment", "Outstanding balance is not paid", "PAYMENT DELAY SURCHARGE", "Vessel Arrival Mombasa"]
    rows = [(i, *("x " + w if j == i % 3 else None for j in range(3)), None, False) for i, w in enumerate(w for w in words for _ in range(3))]
    rows += [(900, None, None, None, "FREIGHT", False), (901, "FREIGHT", None, None, None, True), (902, "cup", "cup", "cup", "cup", False)]
    items = spark.createDataFrame(rows, "item_id long, marks string, description string, shop string, item_code string, deleted boolean")
    assert len(J.FOOTER_WORDS) == 15
    assert [r.item_id for r in J.footer_rows(items).collect()] == list(range(len(words) * 3))
    assert 901 in [r.item_id for r in J.footer_rows(items, include_deleted=True).collect()]
