"""The payment stream against the batch operator, in shuffled files and with repeated updates."""

import json
import random

from fixtures import at, frame, rows_of, tables
from tradewind.functions import ntz
from tradewind.operators.changes import apply_payments
from tradewind.sources import REQUEST_SCHEMAS
from tradewind.streaming import payments_stream, stream_requests
from tradewind.streaming.payments import compact_state, stream_state

NOW = "2024-02-01 00:00:00"


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    updates = [{
        "request_id": f"q{i:03d}", "request_ts": at(rng.randint(0, 30)), "payment_id": f"p{rng.randint(0, 25)}",
        "status": rng.choice(["paid", "failed", "unpaid", "refunded", "lost"]), "reference_no": rng.choice([None, "", f"r{i}"]),
    } for i in range(150)]
    t = tables(spark, orders=[{"order_id": f"o{i}", "buyer_id": "b", "status": rng.choice(["pending", "shipped"])} for i in range(20)],
               payments=[{"payment_id": f"p{i}", "order_id": f"o{i}", "reference_no": "old"} for i in range(20)])
    batch = apply_payments(t, frame(spark, REQUEST_SCHEMAS["payment"], updates), ntz(NOW))

    repeated = updates + rng.sample(updates, 30)
    rng.shuffle(repeated)
    source = tmp_path / "in"
    source.mkdir()
    for n in range(5):
        lines = [json.dumps({**u, "request_ts": u["request_ts"].isoformat()}) for u in repeated[n::5]]
        (source / f"{n}.json").write_text("\n".join(lines))
    stream = stream_requests(spark, str(source), files_per_batch=1)
    streamed = payments_stream(t, stream, str(tmp_path / "out"), ntz(NOW))
    for table in ("payments", "orders"):
        columns = batch.tables[table].columns
        assert rows_of(streamed[table], *columns) == rows_of(batch.tables[table], *columns)


def test_empty_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    t = tables(spark, orders=[{"order_id": "o", "buyer_id": "b"}], payments=[{"payment_id": "p", "order_id": "o"}])
    state = payments_stream(t, stream_requests(spark, str(tmp_path / "in")), str(tmp_path / "out"), ntz(NOW))
    assert rows_of(state["payments"], "payment_id", "status") == [("p", "unpaid")]


def test_refused_and_malformed_updates_are_kept(spark, tmp_path):
    t = tables(spark, orders=[{"order_id": "o", "buyer_id": "b"}], payments=[{"payment_id": "p", "order_id": "o"}])
    line = lambda i, **more: json.dumps({"request_id": f"q{i}", "request_ts": at(i).isoformat(), "payment_id": "p", **more})
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "0.json").write_text("\n".join([line(1, status="paid"), line(2, status="lost"), "{broken", line(3, status="paid", payment_id="zz")]))
    first = payments_stream(t, stream_requests(spark, str(source)), out, ntz(NOW))
    assert rows_of(first["rejected"], "request_id", "reason") == [("q2", "bad_enum"), ("q3", "not_found")]
    assert [r.line for r in first["malformed"].collect()] == ["{broken"]
    # a restart reads only what is new, and keeps what it knew
    (source / "1.json").write_text("\n".join([line(4, status="failed"), line(2, status="lost")]))
    second = payments_stream(t, stream_requests(spark, str(source)), out, ntz(NOW))
    assert rows_of(second["payments"], "payment_id", "status") == [("p", "failed")]
    assert rows_of(second["rejected"], "request_id", "reason") == [("q2", "bad_enum"), ("q3", "not_found")]
    state = stream_state(spark, f"{out}/state")
    merged = compact_state(spark, f"{out}/state", str(tmp_path / "merged"))
    assert merged.count() == state.count() and rows_of(merged, *state.columns) == rows_of(state, *state.columns)
