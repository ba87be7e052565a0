"""Item checks: rules, reasons, copies, report, CSV reading."""

from pyspark.sql import functions as F

from orderlight.operators import validation as v
from orderlight.sources.items import read_items
from tests.conftest import rows

COLUMNS = "increment_id STRING, created_at STRING, price STRING, qty_ordered STRING, grand_total STRING, discount_amount STRING, payment_method STRING, category_name_1 STRING, status STRING"
GOOD = ("a1", "2024-01-01", "10", "1", "10", "0", "cod", "A", "complete")


def item(**changes):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return tuple({**dict(zip(names, GOOD)), **changes}[n] for n in names)


def check(spark, *items):
    return v.check_items(spark.createDataFrame(list(items), COLUMNS))


def test_zero_quantity_is_quarantined_not_fatal(spark):
    out = check(spark, item(qty_ordered="0"))
    assert not out.fatal
    assert out.valid.count() == 0
    assert rows(out.quarantine, v.REASON) == [("invalid_qty_ordered;",)]


def test_reasons_follow_rule_order(spark):
    out = check(spark, item(increment_id=" nan ", created_at="soon", price="-1", qty_ordered="x", grand_total=None,
                            discount_amount="NaN", status="received"))
    assert rows(out.quarantine, v.REASON) == [(
        "missing_order_id;invalid_created_at;invalid_price;invalid_qty_ordered;invalid_grand_total;"
        "invalid_discount_amount;invalid_status;",)]


def test_numbers_and_dates_like_text_files_have_them(spark):
    out = check(
        spark, item(increment_id="i", price="inf"), item(increment_id="d", created_at="09/12/2018"),
        item(increment_id="s", status=" Canceled "), item(increment_id="j", price="1.5d"), item(increment_id="h", price="0x10"))
    assert sorted(rows(out.valid, "increment_id", "status")) == [("d", "complete"), ("i", "complete"), ("s", "canceled")]
    assert {r["increment_id"] for r in out.quarantine.collect()} == {"j", "h"}
    assert out.valid.filter("increment_id = 'd'").first()["created_at"].strftime("%Y-%m-%d") == "2018-09-12"


def test_copies_after_the_first_are_quarantined(spark):
    items = [item()] * 5 + [item(increment_id="bad", status="x")] * 3 + [item(increment_id="b")]
    out = check(spark, *items)
    assert sorted(r["increment_id"] for r in out.valid.collect()) == ["a1", "b"]
    assert sorted(rows(out.quarantine, "increment_id", v.REASON)) == (
        [("a1", "duplicate_row;")] * 4 + [("bad", "invalid_status;")] + [("bad", "invalid_status;duplicate_row;")] * 2)
    assert out.counts["duplicate_row"] == 6
    assert out.counts["invalid_status"] == 3
    assert out.counts["raw_rows"] == 9 and out.counts["valid_rows"] == 2


def test_rows_with_nulls_are_copies_of_each_other_but_not_across_columns(spark):
    out = check(spark, item(payment_method=None), item(payment_method=None), item(category_name_1=None), item(payment_method="A", category_name_1=None))
    assert out.counts["duplicate_row"] == 1


def test_many_copies_are_written_in_chunks(spark):
    checked = v.checked_rows(spark.range(1000).select(*[F.lit(x).alias(c.split()[0]) for x, c in zip(GOOD, COLUMNS.split(", "))]))
    assert checked.count() == 1
    assert v.quarantined_rows(checked, chunk=64).count() == 999


def test_first_copy_keeps_the_lowest_position(spark):
    df = spark.createDataFrame([(*item(), i) for i in (7, 3, 9)], COLUMNS + ", _ord BIGINT")
    assert rows(v.checked_rows(df), "_ord", "_copies") == [(3, 3)]


def test_missing_columns_fail_the_batch(spark):
    out = v.check_items(spark.createDataFrame([("a", "1")], "increment_id STRING, price STRING"))
    assert out.fatal and out.report[0][:3] == ("required_columns", "FAIL", 7)
    assert out.counts["raw_rows"] == 1


def test_report_grades_each_check(spark):
    out = check(spark, item(), item(increment_id="b", status="x"))
    graded = {name: (status, n) for name, status, n, _ in out.report}
    assert graded["target_status"] == ("WARN", 1)
    assert graded["duplicate_rows"] == ("PASS", 0)
    assert list(graded) == [
        "required_columns", "order_identifier", "date_parsing", "range_price", "range_qty_ordered", "range_grand_total",
        "range_discount_amount", "target_status", "duplicate_rows", "leakage_guard"]


def test_without_any_order_id_the_report_warns(spark):
    df = spark.createDataFrame([GOOD[1:]], COLUMNS.split(", ", 1)[1])
    out = v.check_items(df)
    assert out.report[1][:2] == ("order_identifier", "WARN")
    assert out.valid.count() == 1


def test_inconsistent_and_existing_orders(spark):
    out = check(spark, item(), item(price="11", status="canceled"), item(increment_id="b"), item(increment_id="c"))
    assert rows(v.inconsistent_orders(out.valid, "increment_id"), "order_id") == [("a1",)]
    old = spark.createDataFrame([("b",), ("z",)], "order_id STRING")
    assert rows(v.existing_orders(out.valid, "increment_id", old), "order_id") == [("b",)]


def test_csv_keeps_texts_and_drops_blank_lines(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text('increment_id,"Customer ID"," MV ",Unnamed: 21\n001,143.0," 32,655 ",\n,,,\n002,,"x",\n,,,\n')
    df = read_items(spark, str(path))
    assert df.columns == ["increment_id", "Customer ID", " MV ", "Unnamed: 21", "_ord"]
    assert [tuple(r)[:3] for r in df.orderBy("_ord").collect()] == [("001", "143.0", " 32,655 "), ("002", None, "x")]
