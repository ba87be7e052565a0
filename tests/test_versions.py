"""Versions as lists of parts, commits that one writer wins, and sessions without a configured scratch folder."""

import os
import random
import subprocess
import sys
import threading
from datetime import datetime, timedelta

import pytest

from orderlight.operators.snapshots import SNAPSHOT_COLUMNS, cumulative_snapshot
from orderlight.plans import ingest
from orderlight.sources import parts
from orderlight.sources.commits import put_if_absent
from orderlight.sources.schemas import SNAPSHOT

T0 = datetime(2024, 1, 1)
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def order(i, customer, day, canceled=0):
    at = None if day is None else T0 + timedelta(days=day)
    return (f"o{i:04d}", at, customer, 1.0, 1.0, 5.0, 0.0, canceled, "A", "cod", "complete", 0.0, 1, 0, 0, 8, None, None, None)


def table(spark, orders):
    return spark.createDataFrame(orders, SNAPSHOT)


def content(df):
    return sorted(map(str, df.select(*SNAPSHOT_COLUMNS).collect()))


def manifest_of(spark, path, rows):
    spark.createDataFrame(rows, parts.MANIFEST).write.parquet(path)
    return parts.read_manifest(spark, path)


def whole(spark, manifest):
    return parts.read_parts(spark, [r["part"] for r in manifest])


@pytest.mark.parametrize("disjoint", [True, False])
@pytest.mark.parametrize("hot", [3, 2_000_000])
def test_extended_parts_equal_the_cumulative_snapshot(spark, tmp_path, disjoint, hot):
    rng = random.Random(1)
    customers = [None, "", "big", "big", *[f"c{k}" for k in range(12)]]
    make = lambda ids, days: [order(i, rng.choice(customers), rng.choice(days), rng.randint(0, 1)) for i in ids]
    known = make(range(150), range(30))
    manifest = manifest_of(spark, f"{tmp_path}/m0", parts.write_parts(spark, cumulative_snapshot(None, table(spark, known)), 4, f"{tmp_path}/p0"))
    expected = cumulative_snapshot(None, table(spark, known))
    for step, (ids, days) in enumerate([(range(200, 230), range(40, 50)), (range(300, 330), [5, None, 60]), (range(400, 404), range(70, 72))], 1):
        if not disjoint:
            ids = [*ids, 3, 200]
        new = table(spark, make(ids, days))
        before = manifest
        rows = parts.extend_parts(spark, manifest, new, f"{tmp_path}/p{step}", disjoint, hot, max_parts=2)
        manifest = manifest_of(spark, f"{tmp_path}/m{step}", rows)
        older, expected = content(expected), cumulative_snapshot(expected, new)
        assert content(whole(spark, manifest)) == content(expected)
        assert content(whole(spark, before)) == older
        assert sum(r["row_count"] for r in manifest) == expected.count()
        by_bucket = [r["bucket"] for r in manifest]
        assert max(map(by_bucket.count, by_bucket)) <= 2


def test_what_a_batch_writes_follows_what_it_touches(spark, tmp_path):
    known = [order(i, f"c{i % 40}", i % 20) for i in range(2000)]
    manifest = manifest_of(spark, f"{tmp_path}/m0", parts.write_parts(spark, cumulative_snapshot(None, table(spark, known)), 16, f"{tmp_path}/p0"))
    later = parts.extend_parts(spark, manifest, table(spark, [order(3000, "c1", 50)]), f"{tmp_path}/p1", True)
    fresh = [r for r in later if "/p1/" in r[2]]
    # An order after all others of its customer is a part of one row; everything else stays where it is.
    assert [r[3] for r in fresh] == [1] and len(later) == len(manifest) + 1
    earlier = parts.extend_parts(spark, manifest, table(spark, [order(3000, "c1", -5)]), f"{tmp_path}/p2", True)
    fresh = [r for r in earlier if "/p2/" in r[2]]
    # One before others changes their history: its bucket alone is written again.
    assert len(fresh) == 1 and len(earlier) == len(manifest)
    assert fresh[0][3] == 1 + next(r["row_count"] for r in manifest if r["bucket"] == fresh[0][0])


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "BUCKET_ROWS", 5)
    monkeypatch.setattr(parts, "LEAST_BUCKETS", 2)
    known = table(spark, [order(i, f"c{i}", i) for i in range(10)])
    manifest = manifest_of(spark, f"{tmp_path}/m0", parts.write_parts(spark, cumulative_snapshot(None, known), 2, f"{tmp_path}/p0"))
    new = table(spark, [order(100 + i, f"c{i}", 50 + i) for i in range(60)])
    rows = parts.extend_parts(spark, manifest, new, f"{tmp_path}/p1", True)
    assert {r[1] for r in rows} == {14} and content(parts.read_parts(spark, [r[2] for r in rows])) == content(cumulative_snapshot(known, new))


def test_one_writer_wins_a_name(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append((put_if_absent(spark, f"{tmp_path}/x/1.json", f"{k}"), k))) for k in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [k for ok, k in won if ok]
    assert len(winners) == 1 and (tmp_path / "x" / "1.json").read_text() == str(winners[0])
    assert os.listdir(tmp_path / "x") == ["1.json"]


def test_two_writers_of_one_upload(spark, workspace):
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(ingest.reserve(workspace, f"{k}.csv", "samehash", T0))) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    batches = [b for b, _ in got if b is not None]
    assert len(batches) == 1
    assert all(known["batch_id"] == batches[0].batch_id and known["status"] == "PROCESSING" for b, known in got if b is None)


def items(spark, ids, day):
    rows = [(f"o{i}", "c1", str(T0 + timedelta(days=day)), "10", "1", "10", "0", "cod", "A", "complete", k) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "increment_id string, `Customer ID` string, created_at string, price string, qty_ordered string, grand_total string, discount_amount string, payment_method string, category_name_1 string, status string, _ord bigint")


def test_two_uploads_at_once_lose_no_order(spark, workspace):
    ingest.ingest_items(workspace, items(spark, [1, 2], 0), "b0", "0.csv", "k0", T0)
    got = []
    run = lambda k, ids: got.append(ingest.ingest_items(workspace, items(spark, ids, k), f"b{k}", f"{k}.csv", f"k{k}", T0 + timedelta(hours=3 - k)))
    threads = [threading.Thread(target=run, args=a) for a in ((1, [3, 4]), (2, [4, 5]))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [g["status"] for g in got] == ["success", "success"] and len({g["dataset_version"] for g in got}) == 2
    assert sorted(r.order_id for r in workspace.snapshot().collect()) == ["o1", "o2", "o3", "o4", "o5"]
    assert sorted(r.prev_orders for r in workspace.snapshot().collect()) == [0, 1, 2, 3, 4]


def test_versions_of_earlier_releases_are_read_and_extended(spark, workspace):
    old = cumulative_snapshot(None, table(spark, [order(i, "c1", i) for i in range(5)]))
    path = workspace.path("snapshots", "dataset_version=v001")
    old.write.parquet(path)
    workspace.append("dataset_versions", [("v001", T0, "b0", 5, 5, path, "", "", False)])
    assert content(workspace.snapshot("v001")) == content(workspace.snapshot()) == content(old)
    done = ingest.ingest_items(workspace, items(spark, [7, 8], 90), "b1", "1.csv", "k1", T0 + timedelta(days=1))
    assert done["snapshot_orders"] == 7 and workspace.snapshot().count() == 7
    assert sorted(r.prev_orders for r in workspace.snapshot().collect()) == list(range(7))


def test_two_writers_of_requests_get_two_ids(spark, workspace):
    from orderlight.plans import retrain

    got = []
    run = lambda k: got.append(retrain.create_request(workspace, "m", "v001", f"T{k}", T0, {"k": k}, force_new=True)["request_id"])
    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = retrain.current_requests(workspace).collect()
    assert len(set(got)) == 3 and {r.request_id for r in rows} == set(got)
    assert {(r.status, r.updated_at) for r in rows} == {("RETRAINING_REQUIRED", T0)}


def test_top_importances(spark):
    from orderlight.operators.selection import top_importances

    rows = [(f"f{k:02d}", float(k // 3)) for k in range(40)] + [("none", None), ("nan", float("nan"))]
    got = [(r.feature, r.importance) for r in top_importances(spark.createDataFrame(rows, "feature string, importance double")).collect()]
    assert got == sorted(rows[:40], key=lambda x: (-x[1], x[0]))[:15]


def test_generated_ids_follow_the_content(spark):
    from orderlight.functions.features import inference_features

    rows = [(10.0, 1.0, 5.0, 0.0, "cod", "A")] * 3 + [(11.0, 1.0, 5.0, 0.0, None, "A"), (11.0, 1.0, 5.0, 0.0, "A", None)]
    df = spark.createDataFrame(rows, "price double, qty_ordered double, grand_total double, discount_amount double, payment_method string, category_name_1 string")
    first, second = ({r.order_id for r in inference_features(df.repartition(n), "2024-01-01").collect()} for n in (1, 4))
    assert first == second and len(first) == 5


def test_other_queries_stand_without_optional_packages():
    code = (
        "import sys\n"
        "sys.modules['xxhash'] = None\n"
        "import importlib.abc\n"
        "import __spark_entry__ as e\n"
        "print('found', 'ingest_batch' in e.queries(), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "found True False" in done.stdout, done.stderr[-2000:]


def test_a_plain_local_session_finds_a_scratch_folder(tmp_path):
    code = (
        "from pyspark.sql import SparkSession\n"
        "from orderlight.session import scratch_root, stored\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert stored(spark.range(3)).count() == 3 and scratch_root(spark) == scratch_root(spark)\n"
        "print('found')\n"
    )
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT + ":" + os.environ.get("PYTHONPATH", ""), "TMPDIR": str(tmp_path)}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert "found" in done.stdout, done.stderr[-2000:]
