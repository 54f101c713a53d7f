"""The metrics that this library gives out, in the order of its operators: fold, failures, position, requests."""

from __future__ import annotations

from dataclasses import dataclass

NAMESPACE = "rivulet"


@dataclass(frozen=True)
class Declared:
    """A metric as declared; its samples are the rows of the query ``source``."""

    source: str
    suffix: str
    kind: str
    labels: tuple[str, ...]
    help: str

    @property
    def name(self) -> str:
        return f"{NAMESPACE}_{self.suffix}"


_REQUEST = ("method", "route", "status")
DECLARED = (
    Declared("outcome_counts", "fold_outcomes", "counter", ("kind", "outcome"), "What the fold made of each event."),
    Declared("failed_counter", "dead_letter_attempts", "counter", ("kind",), "Attempts that ended as a dead letter."),
    Declared("pages_counter", "log_pages", "counter", (), "Distinct pages in the log."),
    Declared("lag_gauge", "position_lag", "gauge", (), "Ledgers between the position and the newest page head."),
    Declared("request_counter", "requests", "counter", _REQUEST, "Rows of the request log."),
    Declared("request_histogram", "request_time", "histogram", _REQUEST, "Time per request, ms."),
    Declared("error_counter", "request_faults", "counter", ("operation",), "Requests that ended with status 500."),
    Declared("drain_faults", "drain_faults", "counter", (), "Drains that broke off."),
)
