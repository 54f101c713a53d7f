"""A sequential model of the fold: one event after another over a dictionary of rows."""

from __future__ import annotations


def apply_all(events, mirror=None, snapshot=None):
    """Outcomes by (page_seq, pos), and the rows after all events."""
    rows = {k: dict(v) for k, v in (mirror or {}).items()}
    outcomes = {}
    for e in sorted(events, key=lambda e: (e["page_seq"], e["pos"])):
        at = (e["page_seq"], e["pos"])
        if e["error"]:
            outcomes[at] = "failed"
            continue
        key, row = e["stream_id"], rows.get(e["stream_id"])
        if e["kind"] == "created":
            if row:
                outcomes[at] = "duplicate"
                continue
            rows[key] = {
                **{f: e[f] for f in ("sender", "recipient", "token", "total_amount", "start_time", "end_time", "cliff_time")},
                "withdrawn": 0,
                "cancelled": False,
                "created_ledger": e["ledger"],
                "updated_ledger": e["ledger"],
                "last_event_id": e["event_id"],
            }
            outcomes[at] = "applied"
            continue
        if row is None:
            full = (snapshot or {}).get(key)
            if full is None:
                outcomes[at] = "missing"
                continue
            guard = max(e["event_id"], full.get("as_of_event_id") or "")
            rows[key] = {
                **{f: v for f, v in full.items() if f != "as_of_event_id"},
                "created_ledger": e["ledger"],
                "updated_ledger": e["ledger"],
                "last_event_id": guard,
            }
            outcomes[at] = "reconciled"
            continue
        if row["last_event_id"] is not None and not row["last_event_id"] < e["event_id"]:
            outcomes[at] = "duplicate"
            continue
        if e["kind"] == "withdrawn":
            row["withdrawn"] += e["amount"]
        else:
            frozen = row["withdrawn"] + e["recipient_amount"]
            row.update(total_amount=frozen, withdrawn=frozen, end_time=e["closed_at"], cancelled=True)
        row.update(updated_ledger=e["ledger"], last_event_id=e["event_id"])
        outcomes[at] = "applied"
    return outcomes, rows
