"""The stateful stream: any split into micro-batches and runs ends where one fold ends."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rivulet.operators.fold import fold
from rivulet.schemas import event_schema
from rivulet.sources import pages
from rivulet.streaming import keyed
from tests.model import apply_all
from tests.test_fold import frame, make_events, make_rows
from tests.test_live import landing

AMOUNTS = ("total_amount", "withdrawn", "amount", "recipient_amount", "sender_refund")


def folded(spark, tmp_path, events, snapshot, splits):
    """Typed events as files, one micro-batch each, in runs of their own; state and outcomes after all of them."""
    schema = event_schema()
    known = None
    if snapshot:
        from rivulet.schemas import snapshot_schema

        known = frame(spark, [{"stream_id": Decimal(k), **v} for k, v in snapshot.items()], snapshot_schema(), "text")
    for run, batches in enumerate(splits):
        for number, rows in enumerate(batches):
            folder = tmp_path / "events" / f"{run:02d}-{number:03d}.json"
            folder.parent.mkdir(exist_ok=True)
            lines = [json.dumps({k: (str(v) if k in AMOUNTS and v is not None else v) for k, v in e.items()}) for e in rows]
            folder.write_text("\n".join(lines))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "events"))
        rows = keyed.fold_stream(source, known)
        query = rows.writeStream.format("parquet").partitionBy("row_type").option("path", str(tmp_path / "out"))
        query.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return keyed.streams(spark, str(tmp_path / "out")).collect(), keyed.outcomes(spark, str(tmp_path / "out")).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_the_model_after_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = make_events(rng, 160, 12, 10**30, hot=0.3)
    for e in events:
        e["stream_id"] += 2**64 - 20
    snapshot = {k + 2**64 - 20: v for k, v in make_rows(rng, 12, 0.5, 10**30, stored=False).items()}
    ordered = sorted(events, key=lambda e: (e["page_seq"], e["pos"]))
    cuts = sorted(rng.sample(range(1, len(ordered)), 3))
    parts = [ordered[i:j] for i, j in zip([0, *cuts], [*cuts, len(ordered)], strict=True)]
    for part in parts:
        rng.shuffle(part)
    state, outcomes = folded(spark, tmp_path, events, snapshot, [parts[:2], parts[2:]])
    wanted_outcomes, wanted = apply_all(events, None, snapshot)
    got = {int(r.stream_id): {k: (int(v) if k in AMOUNTS else v) for k, v in r.asDict().items() if k != "stream_id"} for r in state}
    assert got == {k: {c: v[c] for c in next(iter(got.values()))} for k, v in wanted.items()}
    assert {(r.page_seq, r.pos): r.outcome for r in outcomes} == wanted_outcomes and len(outcomes) == len(events)


def test_pages_late_and_again(spark, tmp_path):
    def run():
        keyed.start(spark, str(tmp_path / "pages"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), files_per_batch=2).awaitTermination()
        return sorted((r.stream_id, r.withdrawn, r.cancelled) for r in keyed.streams(spark, str(tmp_path / "out")).collect())

    landing(tmp_path, 0, [0, 4])
    landing(tmp_path, 7, [])
    assert len(run()) == 1
    landing(tmp_path, 2, [1])
    landing(tmp_path, 0, [0, 4], twice=True)
    (tmp_path / "pages" / "broken.json").write_text("no page")
    first = run()
    assert [w for i, w, c in first if i == 42] == ["25000000000000"]
    landing(tmp_path, 3, [2, 5, 3])
    last = run()
    assert [w for i, w, c in last if i == 42] == ["55000000000000"]
    counts = {(r.kind, r.outcome): r.n for r in keyed.outcomes(spark, str(tmp_path / "out")).groupBy("kind", "outcome").agg(F.count("*").alias("n")).collect()}
    assert counts[("created", "duplicate")] == 1 and counts[("withdrawn", "applied")] == 1


def test_events_and_lines_go_as_one_column(spark, tmp_path):
    """What a stream costs in a micro-batch goes with the number of columns, so pandas gets one and gives one."""
    source = spark.readStream.schema(event_schema()).json(str(tmp_path))
    plan = keyed.fold_stream(source)._jdf.queryExecution().analyzed()
    node = next(line for line in plan.toString().splitlines() if "FlatMapGroupsInPandasWithState" in line)
    assert "line#" in node and "sender#" not in node
    event = {c: None for c in keyed.EVENT} | {"kind": "created", "event_id": "7", "total_amount": "9", "sender": "", "on_chain": True}
    assert keyed._text(True) == "true" and keyed._text(Decimal(5)) == "5" and keyed._text("") == "" and keyed._text(None) is None
    row, outcome = keyed.apply_event(None, event)
    assert outcome == "applied" and row["sender"] == ""


def test_streams_that_share_a_slot_keep_their_own_rows(spark, tmp_path, monkeypatch):
    """All streams in two slots, over runs and micro-batches: still the rows and versions of each."""
    monkeypatch.setattr(keyed, "DEFAULT_SLOTS", 2)
    source = spark.readStream.schema(event_schema()).json(str(tmp_path))
    plan = keyed.fold_stream(source)._jdf.queryExecution().analyzed().toString()
    assert "slot#" in next(line for line in plan.splitlines() if "FlatMapGroupsInPandasWithState" in line)
    rng = random.Random(5)
    events = make_events(rng, 120, 9, 10**30, hot=0.2)
    for e in events:
        e["stream_id"] += 2**64 - 20
    snapshot = {k + 2**64 - 20: v for k, v in make_rows(rng, 9, 0.5, 10**30, stored=False).items()}
    ordered = sorted(events, key=lambda e: (e["page_seq"], e["pos"]))
    (tmp_path / "run").mkdir()
    state, outcomes = folded(spark, tmp_path / "run", ordered, snapshot, [[ordered[:30], ordered[30:70]], [ordered[70:]]])
    wanted_outcomes, wanted = apply_all(events, None, snapshot)
    got = {int(r.stream_id): {k: (int(v) if k in AMOUNTS else v) for k, v in r.asDict().items() if k != "stream_id"} for r in state}
    assert got == {k: {c: v[c] for c in next(iter(got.values()))} for k, v in wanted.items()}
    assert {(r.page_seq, r.pos): r.outcome for r in outcomes} == wanted_outcomes and len(outcomes) == len(events)
    kept = spark.read.schema(keyed.LOG).parquet(str(tmp_path / "run" / "out")).where("row_type = 'state'").groupBy("key").agg(F.max("version").alias("last"), F.count("*").alias("n"), F.countDistinct("version").alias("versions"))
    assert kept.where("last <> n OR versions <> n").count() == 0 and kept.where("last > 1").count() > 0


def test_the_state_of_a_slot_goes_into_text_and_back():
    row = ["a,\"ü", None, "t", "9" * 40, "0", Decimal(2**64 - 1), None, Decimal(0), True, 5, 2**62, "x"]
    assert len(row) == len(keyed.ROW_NAMES)
    rows = {str(2**64 - 1): [3, *row], "0": [1, *row]}
    assert keyed._unpacked(keyed._packed(rows)) == rows
    assert isinstance(keyed._unpacked(keyed._packed(rows))["0"][6], Decimal)


def test_a_checkpoint_keeps_its_number_of_slots(spark, tmp_path):
    checkpoint = str(tmp_path / "checkpoint")
    assert keyed._kept_slots(spark, checkpoint, 7) == 7
    assert keyed._kept_slots(spark, checkpoint, None) == keyed._kept_slots(spark, checkpoint, 7) == 7
    with pytest.raises(ValueError):
        keyed._kept_slots(spark, checkpoint, 8)
    assert keyed._kept_slots(spark, str(tmp_path / "other"), None) == keyed.DEFAULT_SLOTS
