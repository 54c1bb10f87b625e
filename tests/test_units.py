import pytest

from tapelight.operators import units


@pytest.mark.parametrize(
    "text,want",
    [
        ("USD 0.1200", (0.12, 1, 0, 0)), ("$0.66", (0.66, 1, 0, 0)), ("59 ct", (59, 1, 0, -2)), ("52 US cents", (52, 1, 0, -2)), ("5700bp", (5700, 0, 0, -4)),
        ("6200 basis points", (6200, 0, 0, -4)), ("54 %", (54, 0, 0, -2)), ("0,2500", (0.25, 0, 0, 0)), ("2,220.00", (2220, 0, 0, 0)), ("1.234,5 contracts", (1234.5, 0, 1, 0)),
        ("23000 /100", (23000, 0, 0, -2)), ("24000 hundredths of a contract", (24000, 0, 1, -2)), ("1.68 hundred contracts", (1.68, 0, 1, 2)), ("0.2k contracts", (0.2, 0, 1, 3)), ("0.126 tsd.", (0.126, 0, 0, 3)),
        ("0.01682 million", (0.01682, 0, 0, 6)), ("5 furlongs", None), ("", None), ("cents", None), ("9" * 5000, None),
    ],
)
def test_grammar(text, want):
    got = units.parse_quantity(text)
    assert (got is None) == (want is None), got
    if want:
        assert got[0] == pytest.approx(want[0]) and got[1:4] == want[1:]


def test_live_prices(spark):
    cases = [
        ("0.8360", "0.1640", 0), (".61", ".39", 0), ("7.60e-01", "2.40e-01", 0), ("24", "76", -2), ("610", "390", -3), ("6830", "3170", -4), ("33", "0.6700", -2), ("44 ct", "0.5600", -2), ("36", None, -2), ("340", None, -3),
        ("0.27", None, 0), ("1", "99", -2), ("1", None, 0), (None, "0.5", None), ("0,25", "0,75", 0), ("32.5 ct", "67.5 ct", -2), ("3 furlongs", None, None), ("", "", None),
    ]
    df = spark.createDataFrame([(k, y, n, "5 ctr", "x") for k, (y, n, _) in enumerate(cases)], "id int, yes_price_dollars string, no_price_dollars string, count_fp string, price_scale string")
    got = {r.id: r for r in units.live_quantities(df).collect()}
    for k, (y, n, want) in enumerate(cases):
        assert (got[k].price_scale if got[k].price_usd is not None else None) == want, (y, n)
        assert got[k].contracts == 5
    assert units.live_quantities(df.where("false")).count() == 0


def test_archive_and_notional(spark):
    a = spark.createDataFrame([(1, 20, 80), (2, 510, 490), (3, 2300, 7700), (4, 98, None), (5, 700, None), (6, None, 50)], "delivery_id bigint, yes_price bigint, no_price bigint")
    assert {r.delivery_id: r.price_scale for r in units.archive_quantities(a).collect()} == {1: -2, 2: -3, 3: -4, 4: -2, 5: -3, 6: None}
    cols = "delivery_id bigint, price_yes double, size double, usdc_amount double, outcome string, maker_asset_id string, taker_asset_id string, maker_amount bigint, taker_amount bigint"
    p = spark.createDataFrame(
        [
            (1, 0.5, 100.0, 50.0, "Yes", None, None, None, None), (2, 0.5, 100.0, 5e7, "Yes", None, None, None, None), (3, 0.25, 100.0, 7500.0, "No", None, None, None, None), (4, 0.5, 100.0, 0.05, "Yes", None, None, None, None),
            (5, None, None, 9.25, None, "0", "123", 9250000, 1), (6, None, None, 925.0, None, "123", "0", 1, 9250000), (7, None, None, 5.0, "Yes", None, None, None, None), (8, float("nan"), 3.0, 5.0, "Yes", None, None, None, None), (9, 0.5, 1.0, None, "Yes", None, None, None, None),
        ], cols,
    )
    assert {r.delivery_id: r.usdc_scale for r in units.notional_quantities(p).collect()} == {1: 0, 2: -6, 3: -2, 4: 3, 5: 0, 6: -2, 7: 0, 8: 0, 9: None}
