"""Publishing, exports and captures: held and interrupted runs, damaged files, numbered lines across splits."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.publish import Held, Outputs, required_controls
from ledgerloom.sources.captures import numbered_lines, read_capture
from ledgerloom.sources.export import damage, export_ordered, restore

CLEAN = lambda b: b.createDataFrame([("fine", 0)], "reason string, failures long")
BAD = lambda b: b.createDataFrame([("open_month", 2)], "reason string, failures long")


def test_only_whole_clean_runs_are_seen(spark, tmp_path):
    out = Outputs(spark, f"file://{tmp_path}/out")
    table = lambda n: spark.createDataFrame([(k, 10 * k) for k in range(n)], "k long, amount_cents long")
    controls = {"accounting": CLEAN, "core": CLEAN, "journal": CLEAN}
    first = out.publish(spark, {"fact_revenue": (table(4), ["k"])}, controls)
    assert out.read("fact_revenue").count() == 4 and [(r.row_count, int(r.cents)) for r in out.manifest().collect()] == [(4, 60)]
    with pytest.raises(Held, match="journal: open_month=2"):
        out.publish(spark, {"fact_revenue": (table(5), ["k"])}, controls | {"journal": BAD})
    with pytest.raises(Held, match="fact_revenue: keys=1"):
        out.publish(spark, {"fact_revenue": (table(5).withColumn("k", F.nullif("k", F.lit(3))), ["k"])}, controls)
    with pytest.raises(Held, match="fact_revenue: empty=1"):
        out.publish(spark, {"fact_revenue": (table(0), ["k"])}, controls)

    def dies(_):
        raise RuntimeError("half-way")

    with pytest.raises(RuntimeError):
        out.publish(spark, {"fact_revenue": (table(9), ["k"])}, controls | {"core": dies})
    assert out.read("fact_revenue").select("run_id").distinct().first()[0] == first and len(list((tmp_path / "out/runs").iterdir())) == 1
    second = out.publish(spark, {"fact_revenue": (table(7), ["k"]), "other": (table(2), ["k"])}, controls)
    assert out.read("fact_revenue").count() == 7 and out.read("fact_revenue", first).count() == 4 and out.read("other", second).count() == 2
    with pytest.raises(ValueError):
        out.read("nothing")
    assert required_controls(["subscriptions"]) == ["accounting", "core", "seat"]


def test_export_is_ordered_and_damage_is_found(spark, tmp_path):
    rows = [(f"a{k}", "x" if k % 7 else None, f'{{"n":{k}}}', k) for k in range(1, 61)]
    act = spark.createDataFrame(rows, "activity_id string, customer string, feature_json string, _stream_position long").repartition(5)
    path = f"{tmp_path}/export"
    export_ordered(act, f"file://{path}", ranges=4)
    assert sorted(map(tuple, restore(spark, f"file://{path}").select(act.columns).collect())) == sorted(rows)
    files = sorted((tmp_path / "export/lines").glob("part=*/*.txt"))
    lines = [json.loads(x)["_stream_position"] for f in files for x in f.read_text().splitlines()]
    assert lines == list(range(1, 61)) and len(files) > 1
    text = files[1].read_text()
    what = lambda: {(r.part, r.what) for r in damage(spark, f"file://{path}").collect()}
    (files[1].parent / f".{files[1].name}.crc").unlink()
    files[1].write_text(text.replace('"customer":"x"', '"customer": "x"', 1))
    assert {w for _, w in what()} == {"changed", "not canonical"}
    files[1].write_text("\n".join(text.splitlines()[1:]) + "\n")
    assert {w for _, w in what()} == {"changed"}
    with pytest.raises(ValueError, match="changed"):
        restore(spark, f"file://{path}")
    short = act.filter("_stream_position <> 20")
    export_ordered(short, f"file://{tmp_path}/gap", ranges=4)
    assert [r.what for r in damage(spark, f"file://{tmp_path}/gap").collect()] == ["gap"]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f"line {k} {'x' * (k % 50)}\n" for k in range(1, 4001)))
    (tmp_path / "small.jsonl").write_text("line 1\nline 2")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = numbered_lines(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 4002 and all(r.value.split()[1] == str(r.observation) for r in rows)


def test_capture_statuses(spark, tmp_path):
    about = {"credit_id": "k", "invoice_id": "i", "period": "2024-01-01", "amount_usd": "5.00", "reason": "r"}
    line = lambda name, at="2024-01-09T00:00:00Z", **more: json.dumps({"event": {"activity_id": name, "ts": "2024-01-05T00:00:00Z", "customer": "c", "activity": "credit_issued", "feature_json": about | more}, "recorded_at": at})
    texts = [line("a"), line("b"), "no json", line("a"), line("a", at="2024-01-10T00:00:00Z"), line("b", reason="other"), line("c", at="2024-01-01T00:00:00Z"), line("d", amount_usd="-1"), line("e", extra="1"), ""]
    (tmp_path / "capture.jsonl").write_text("\n".join(texts) + "\n")
    found = {r.observation: (r.status, r.error) for r in read_capture(spark, f"file://{tmp_path}/capture.jsonl", "src").collect()}
    assert {k: s for k, (s, _) in found.items()} == {1: "accepted", 2: "accepted", 3: "rejected", 4: "duplicate", 5: "conflict", 6: "conflict", 7: "rejected", 8: "rejected", 9: "rejected", 10: "rejected"}
    assert found[3][1] == "unreadable" and found[7][1] == "arrival precedes economic time" and "amount_usd" in found[8][1] and found[9][1] == "unknown field"
