"""The same queries in SQL, for checking: written from the rules, row by row where Spark is not."""

from __future__ import annotations

from rivulet.plans.queries import (
    AS_OF,
    CURSOR,
    FROM_LEDGER,
    RECIPIENT,
    SENDER,
    START_LEDGER,
    STREAM_ID,
    TOKEN,
    WIDEN,
)
from rivulet.plans.registry import DECLARED

BASE = """
base AS (
  SELECT o_orderkey AS k,
         'G' || lpad(o_custkey::VARCHAR, 9, '0') AS sender,
         'R' || lpad((o_orderkey % 97)::VARCHAR, 9, '0') AS recipient,
         o_orderpriority AS token,
         round(o_totalprice * 100)::BIGINT AS total,
         epoch(o_orderdate)::BIGINT AS s,
         o_orderstatus AS st
  FROM orders
),
every AS (
  SELECT k, 'created' AS kind, s AS closed_at, '-0' || lpad(k::VARCHAR, 10, '0') || repeat('0', 21) AS tail,
         sender, recipient, token, total AS total_amount, s AS start_time, s + 365 * 86400 AS end_time,
         s + 86400 * 30 * (k % 4) AS cliff_time, NULL::BIGINT AS amount, NULL::BIGINT AS recipient_amount,
         NULL::BIGINT AS sender_refund, FALSE AS rejected
  FROM base WHERE k % 10 <> 3
  UNION ALL
  SELECT l_orderkey, 'withdrawn', epoch(l_shipdate)::BIGINT,
         '-1' || lpad(l_orderkey::VARCHAR, 10, '0') || l_linenumber::VARCHAR || lpad(l_partkey::VARCHAR, 10, '0')
              || lpad(l_suppkey::VARCHAR, 10, '0'),
         NULL, 'R' || lpad((l_orderkey % 97)::VARCHAR, 9, '0'), NULL, NULL, NULL, NULL, NULL,
         round(l_extendedprice * 10)::BIGINT, NULL, NULL, l_suppkey % 50 = 7
  FROM lineitem
  UNION ALL
  SELECT k, 'cancelled', s + 86400 * (1 + k % 300), '-2' || lpad(k::VARCHAR, 10, '0') || repeat('0', 21),
         sender, NULL, NULL, NULL, NULL, NULL, NULL, NULL, total // 10, total - total // 10, FALSE
  FROM base WHERE st = 'F' AND k % 4 = 0
),
log AS (
  SELECT p.pass * 1000000 + (closed_at // 86400) // 7 AS page_seq,
         lpad((closed_at // 86400)::VARCHAR, 10, '0') || tail AS event_id,
         closed_at // 86400 AS ledger, rejected AND p.pass = 0 AS failed, p.pass AS pass, every.* EXCLUDE (tail, rejected)
  FROM every JOIN (VALUES (0), (1)) AS p(pass) ON p.pass = 0 OR k % 10 = 0
),
snap AS (
  SELECT k, sender, recipient, token, total, total // 20 AS drawn, s AS start_time, s + 365 * 86400 AS end_time,
         s + 86400 * 30 * (k % 4) AS cliff_time
  FROM base WHERE k % 20 = 3
)"""


def fold_sql(passes: str = "TRUE", failed: bool = False) -> str:
    """The fold of some passes; failed: failed attempts stay in ``done``, apart from the others."""
    kept, own = ("TRUE", "k, failed") if failed else ("NOT failed", "k")
    return f"""{BASE},
numbered AS (
  SELECT log.*, snap.k IS NOT NULL AS known,
         row_number() OVER (PARTITION BY {own.replace("k", "log.k", 1)} ORDER BY page_seq, event_id) AS n
  FROM log LEFT JOIN snap ON snap.k = log.k WHERE {kept} AND {passes}
),
seeded AS (
  SELECT *, min(CASE WHEN kind = 'created' OR known THEN n END) OVER (PARTITION BY {own}) AS seed FROM numbered
),
guarded AS (
  SELECT *, max(CASE WHEN n = seed OR (n > seed AND kind <> 'created') THEN event_id END)
              OVER (PARTITION BY {own} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM seeded
),
done AS (
  SELECT *, CASE WHEN seed IS NULL OR n < seed THEN 'missing'
                 WHEN n = seed THEN CASE WHEN kind = 'created' THEN 'applied' ELSE 'reconciled' END
                 WHEN kind = 'created' THEN 'duplicate'
                 WHEN seen IS NULL OR event_id > seen THEN 'applied' ELSE 'duplicate' END AS outcome
  FROM guarded
),
summed AS (
  SELECT *, sum(CASE WHEN outcome = 'applied' THEN coalesce(amount, recipient_amount, 0) ELSE 0 END)
              OVER (PARTITION BY k ORDER BY n) AS run
  FROM done
),
keyed AS (
  SELECT k,
         arg_max(run, n) AS moved,
         arg_max(run, n) FILTER (WHERE kind = 'cancelled' AND outcome = 'applied') AS frozen,
         arg_max(closed_at, n) FILTER (WHERE kind = 'cancelled' AND outcome = 'applied') AS cancelled_at,
         arg_max(ledger, n) FILTER (WHERE outcome IN ('applied', 'reconciled')) AS updated_ledger,
         arg_max(event_id, n) FILTER (WHERE outcome IN ('applied', 'reconciled')) AS last_event_id,
         max(ledger) FILTER (WHERE n = seed) AS created_ledger,
         max(kind) FILTER (WHERE n = seed) AS seed_kind,
         max(event_id) FILTER (WHERE n = seed) AS seed_id
  FROM summed GROUP BY k
),
state AS (
  SELECT keyed.k AS stream_id, base.sender, base.recipient, base.token,
         CASE WHEN frozen IS NULL THEN base.total ELSE frozen + b.drawn END::HUGEINT AS total_amount,
         (moved + b.drawn)::HUGEINT AS withdrawn,
         base.s AS start_time, coalesce(cancelled_at, base.s + 365 * 86400) AS end_time,
         base.s + 86400 * 30 * (keyed.k % 4) AS cliff_time,
         cancelled_at IS NOT NULL AS cancelled, created_ledger, updated_ledger, last_event_id, seed_kind, seed_id
  FROM keyed JOIN base ON base.k = keyed.k
  JOIN (SELECT k, CASE WHEN seed_kind = 'created' THEN 0 ELSE base.total // 20 END AS drawn
        FROM keyed JOIN base USING (k)) AS b ON b.k = keyed.k
  WHERE seed_kind IS NOT NULL
)"""


FOLD = fold_sql()


def valued_sql(scale: str = "1") -> str:
    """Valuation of the state; ``scale`` multiplies amounts without ever multiplying them out."""
    return f"""{FOLD},
scaled AS (
  SELECT * REPLACE ((total_amount * {scale})::HUGEINT AS total_amount, (withdrawn * {scale})::HUGEINT AS withdrawn)
  FROM state
),
vested AS (
  SELECT *, CASE WHEN {AS_OF} < cliff_time OR {AS_OF} < start_time THEN 0::HUGEINT
                 WHEN {AS_OF} >= end_time THEN total_amount
                 ELSE total_amount // (end_time - start_time) * ({AS_OF} - start_time)
                      + ((total_amount % (end_time - start_time)) * ({AS_OF} - start_time)) // (end_time - start_time)
            END AS v
  FROM scaled
),
viewed AS (
  SELECT stream_id, stream_id::VARCHAR AS id, sender, recipient, token, total_amount::VARCHAR AS total_amount,
         withdrawn::VARCHAR AS withdrawn, v::VARCHAR AS vested,
         greatest(v - withdrawn, 0)::VARCHAR AS withdrawable, (total_amount - v)::VARCHAR AS locked,
         CASE WHEN total_amount = 0 THEN 10000 ELSE ((v // {scale}) * 10000) // (total_amount // {scale}) END::BIGINT
           AS coarse_progress,
         v, total_amount AS t, start_time::VARCHAR AS start_time, end_time::VARCHAR AS end_time,
         cliff_time::VARCHAR AS cliff_time, cancelled,
         CASE WHEN cancelled THEN 'cancelled' WHEN {AS_OF} < start_time THEN 'pending'
              WHEN {AS_OF} >= end_time THEN 'completed' ELSE 'streaming' END AS status
  FROM vested
)"""


VALUED = valued_sql()
VIEW = (
    "id, sender, recipient, token, total_amount, withdrawn, vested, withdrawable, locked, "
    "coarse_progress AS progress, start_time, end_time, cliff_time, cancelled, status"
)
STATE = (
    "stream_id, sender, recipient, token, total_amount::VARCHAR AS total_amount, withdrawn::VARCHAR AS withdrawn, "
    "start_time, end_time, cliff_time, cancelled, created_ledger, updated_ledger, last_event_id"
)


def listed(where: str = "TRUE", limit: int = 50, offset: int = 0) -> str:
    return f"WITH {VALUED} SELECT {VIEW} FROM viewed WHERE {where} ORDER BY stream_id DESC LIMIT {limit} OFFSET {offset}"


FAILURES = f"""{BASE},
tries AS (SELECT event_id, kind, k::VARCHAR AS stream_id, ledger, failed, page_seq FROM log),
stuck AS (
  SELECT event_id, min(kind) AS kind, min(stream_id) AS stream_id, min(ledger) AS ledger,
         'constraint violated' AS error, count(*) AS failure_count
  FROM tries WHERE failed
  GROUP BY event_id
),
waiting AS (
  SELECT stuck.* FROM stuck
  WHERE NOT EXISTS (SELECT 1 FROM tries AS ok, tries AS bad
                    WHERE ok.event_id = stuck.event_id AND bad.event_id = stuck.event_id
                      AND bad.failed AND NOT ok.failed AND ok.page_seq > bad.page_seq)
)"""

PAGES = f"""{BASE},
heads AS (
  SELECT page_seq, max(ledger) + 10 AS chain_ledger, max(event_id) AS cursor,
         max(CASE WHEN NOT failed THEN ledger END) AS done
  FROM log GROUP BY page_seq
),
history AS (
  SELECT page_seq, greatest({START_LEDGER - 1}, max(done) OVER (ORDER BY page_seq)) AS last_ledger, chain_ledger, cursor
  FROM heads
),
lagged AS (SELECT *, greatest(0, chain_ledger - last_ledger) AS lag_ledgers FROM history),
latest AS (SELECT * FROM lagged ORDER BY page_seq DESC LIMIT 1)"""

REQUESTS = """
requests AS (
  SELECT 'GET' AS method, event_type AS route, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
         "value"::DECIMAL(18, 2) AS ms, user_id, ts, event_id
  FROM events
)"""

BOUNDS = ["5", "10", "25", "50", "100", "250", "500", "1000", "2500", "5000"]
HISTOGRAM = f"""{REQUESTS},
bounds AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, '{b}', {b}::DECIMAL(18, 2))" for i, b in enumerate(BOUNDS))}) AS t(i, le, bound)
  UNION ALL SELECT {len(BOUNDS)}, '+Inf', NULL
),
totals AS (SELECT method, route, status, sum(ms) AS "sum", count(*) AS "count" FROM requests GROUP BY ALL),
buckets AS (
  SELECT t.method, t.route, t.status, b.i, b.le, t."sum", t."count",
         (SELECT count(*) FROM requests AS r
          WHERE r.route = t.route AND r.status = t.status AND (b.bound IS NULL OR r.ms <= b.bound)) AS bucket
  FROM totals AS t CROSS JOIN bounds AS b
)"""


_NAME = {d.source: d.name for d in DECLARED}
_HEADERS = " UNION ALL ".join(
    f"SELECT {number} AS metric_no, '' AS label_text, unnest(['# HELP {d.name} {d.help}', '# TYPE {d.name} {d.kind}']) AS line"
    for number, d in enumerate(DECLARED)
)


_REQUEST_PAIRS = """'method="' || method || '",route="' || route || '",status="' || status || '"'"""
_NUMBER = """regexp_replace(regexp_replace("sum"::VARCHAR, '0+$', ''), '\\.$', '')"""

EXPOSITION = f"""WITH {fold_sql()},
{PAGES[len(BASE):].lstrip(", ").lstrip()},
{HISTOGRAM}
{_HEADERS}
UNION ALL SELECT 0, pairs, '{_NAME["outcome_counts"]}_total{{' || pairs || '}} ' || n::VARCHAR
  FROM (SELECT 'kind="' || kind || '",outcome="' || outcome || '"' AS pairs, count(*) AS n FROM done GROUP BY ALL)
UNION ALL SELECT 1, pairs, '{_NAME["failed_counter"]}_total{{' || pairs || '}} ' || n::VARCHAR
  FROM (SELECT 'kind="' || kind || '"' AS pairs, count(*) AS n FROM log WHERE failed GROUP BY ALL)
UNION ALL SELECT 2, '', '{_NAME["pages_counter"]}_total ' || count(*)::VARCHAR FROM heads
UNION ALL SELECT 3, '', '{_NAME["lag_gauge"]} ' || lag_ledgers::VARCHAR FROM latest
UNION ALL SELECT 4, {_REQUEST_PAIRS}, '{_NAME["request_counter"]}_total{{' || {_REQUEST_PAIRS} || '}} ' || "count"::VARCHAR
  FROM totals
UNION ALL SELECT 5, {_REQUEST_PAIRS},
  '{_NAME["request_histogram"]}_bucket{{' || {_REQUEST_PAIRS} || ',le="' || le || '"}} ' || bucket::VARCHAR
  FROM buckets
UNION ALL SELECT 5, {_REQUEST_PAIRS},
  '{_NAME["request_histogram"]}_sum{{' || {_REQUEST_PAIRS} || '}} ' || {_NUMBER} FROM totals
UNION ALL SELECT 5, {_REQUEST_PAIRS},
  '{_NAME["request_histogram"]}_count{{' || {_REQUEST_PAIRS} || '}} ' || "count"::VARCHAR FROM totals
UNION ALL SELECT 6, pairs, '{_NAME["error_counter"]}_total{{' || pairs || '}} ' || n::VARCHAR
  FROM (SELECT 'operation="' || route || '"' AS pairs, count(*) AS n FROM requests WHERE status = '500' GROUP BY ALL)
UNION ALL SELECT 7, '', '{_NAME["drain_faults"]}_total 0'
"""

# Address text of a name's hash: the checksum byte by byte with a table, the letters bit by bit.
STRKEYS = """
crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
           list_prepend(b << 8, range(8)),
           lambda c, i: CASE WHEN (c & 32768) <> 0 THEN xor((c << 1), 4129) & 65535 ELSE (c << 1) & 65535 END)) AS t
),
named AS (
  SELECT DISTINCT name FROM (
    SELECT sender AS name FROM every UNION ALL SELECT recipient FROM every UNION ALL SELECT token FROM every)
  WHERE name IS NOT NULL
),
bodied AS (SELECT name, '30' || sha256(name) AS body FROM named),
summed_keys AS (
  SELECT name, body, list_reduce(
           list_prepend(0::BIGINT, list_transform(range(33), lambda i: ('0x' || body[2 * i + 1 : 2 * i + 2])::BIGINT)),
           lambda c, b: xor((c << 8) & 65535, t[(xor(c >> 8, b) + 1)::BIGINT])) AS crc
  FROM bodied, crc_table
),
whole_keys AS (
  SELECT name, body || printf('%02x', crc & 255) || printf('%02x', crc >> 8) AS h FROM summed_keys
),
keys AS (
  SELECT name, array_to_string(list_transform(range(56), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || h[10 * (i // 8) + 1 : 10 * (i // 8) + 10])::BIGINT >> (35 - 5 * (i % 8))) & 31)::BIGINT + 1, 1)), '')
         AS strkey
  FROM whole_keys
)"""

STATE_SQL = f"WITH {FOLD} SELECT {STATE} FROM state"


def event_fields(parties: str, text: bool) -> str:
    names = ("total_amount", "amount", "recipient_amount", "sender_refund")
    amounts = {n: f"{n}::VARCHAR AS {n}" if text else n for n in names}
    return (
        f"event_id, kind, k AS stream_id, ledger, closed_at, md5(event_id) AS tx_hash, {parties}, "
        f"{amounts['total_amount']}, start_time, end_time, cliff_time, {amounts['amount']}, "
        f"{amounts['recipient_amount']}, {amounts['sender_refund']}"
    )


ORACLE: dict[str, str] = {
    "events_typed": f"WITH {BASE} SELECT page_seq, {event_fields('sender, recipient, token', False)} FROM log",
    "events_unknown_skipped": """
        SELECT name, count(*) AS n, CASE WHEN name IN ('created', 'withdrawn', 'cancelled') THEN 'kept' ELSE 'skipped' END AS verdict
        FROM (SELECT CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'withdrawn'
                                     WHEN 'error' THEN 'cancelled' ELSE event_type END AS name FROM events)
        GROUP BY name""",
    "events_from_cursor": f"WITH {BASE} SELECT page_seq, event_id, kind, k AS stream_id, ledger FROM log WHERE event_id > '{CURSOR}'",
    "events_from_ledger": f"WITH {BASE} SELECT page_seq, event_id, kind, k AS stream_id, ledger FROM log WHERE ledger >= {FROM_LEDGER}",
    "decode_raw_pages": f"""WITH {BASE}, {STRKEYS}
        SELECT {event_fields('a.strkey AS sender, b.strkey AS recipient, c.strkey AS token', True)}, NULL::VARCHAR AS error
        FROM log LEFT JOIN keys AS a ON a.name = log.sender LEFT JOIN keys AS b ON b.name = log.recipient
        LEFT JOIN keys AS c ON c.name = log.token WHERE pass = 0""",
    # Failed attempts are a partition of their own, so that the log is read once.
    "apply_outcomes": f"""WITH {fold_sql(failed=True)}
        SELECT page_seq, event_id, kind, k AS stream_id, ledger, CASE WHEN failed THEN 'failed' ELSE outcome END AS outcome FROM done""",
    "outcome_counts": f'WITH {FOLD} SELECT kind, outcome, count(*) AS "value" FROM done GROUP BY ALL',
    "stream_state": STATE_SQL,
    "stream_state_incremental": STATE_SQL,
    "stream_state_backfill": f"WITH {fold_sql('pass = 0')} SELECT {STATE} FROM state",
    "live_apply": STATE_SQL,
    "live_state": STATE_SQL,
    "live_counters": f'WITH {FOLD} SELECT kind, outcome, count(*) AS "value" FROM done GROUP BY ALL',
    "created_inserts": f"""WITH {FOLD}
        SELECT k AS stream_id, event_id, sender, recipient, token, total_amount, start_time, end_time, cliff_time
        FROM done WHERE kind = 'created' AND outcome = 'applied'""",
    "withdrawal_totals": f"""WITH {FOLD}
        SELECT k AS stream_id, sum(amount)::BIGINT AS drawn, count(*) AS withdrawals
        FROM done WHERE kind = 'withdrawn' AND outcome = 'applied' GROUP BY k""",
    "cancel_freeze": f"""WITH {FOLD}
        SELECT stream_id, total_amount::VARCHAR AS total_amount, withdrawn::VARCHAR AS withdrawn, end_time,
               updated_ledger, last_event_id FROM state WHERE cancelled""",
    "replay_is_noop": f"""WITH {FOLD},
        again AS (
          SELECT log.kind, log.event_id, state.stream_id IS NOT NULL AS stored, last_event_id, snap.k IS NOT NULL AS known
          FROM log LEFT JOIN state ON state.stream_id = log.k LEFT JOIN snap ON snap.k = log.k WHERE NOT failed
        )
        SELECT kind, count(*) AS replayed,
               count(*) FILTER (WHERE CASE WHEN stored THEN kind <> 'created' AND event_id > last_event_id ELSE kind = 'created' OR known END) AS changed
        FROM again GROUP BY kind""",
    # A stream is reconciled by its seed, unless that is its creation.
    "reconciled_streams": f"""WITH {FOLD}
        SELECT stream_id, seed_id AS event_id, created_ledger AS ledger, sender, total_amount::VARCHAR AS total_amount,
               withdrawn::VARCHAR AS withdrawn, created_ledger
        FROM state WHERE seed_kind <> 'created'""",
    "missing_events": f"WITH {FOLD} SELECT page_seq, event_id, k AS stream_id, ledger FROM done WHERE outcome = 'missing'",
    "failed_events": f"WITH {FAILURES} SELECT * FROM stuck",
    "failed_events_open": f"WITH {FAILURES} SELECT * FROM waiting",
    "failed_events_oldest": f"WITH {FAILURES} SELECT * FROM waiting ORDER BY ledger, event_id LIMIT 100",
    "position": f"WITH {PAGES} SELECT last_ledger, chain_ledger, cursor FROM latest",
    "position_history": f"WITH {PAGES} SELECT page_seq, last_ledger, chain_ledger, cursor, lag_ledgers FROM lagged",
    "status_report": f"""WITH {PAGES}
        SELECT TRUE AS initialized, last_ledger, cursor, chain_ledger AS latest_ledger, lag_ledgers FROM latest""",
    "stream_by_id": f"WITH {VALUED} SELECT {VIEW} FROM viewed WHERE stream_id = {STREAM_ID}",
    "streams_by_sender": listed(f"sender = '{SENDER}'", 100),
    "streams_by_recipient": listed(f"recipient = '{RECIPIENT}'"),
    "streams_by_token": listed(f"token = '{TOKEN}'"),
    "streams_by_all": listed(f"(sender, recipient, token) = (SELECT (sender, recipient, token) FROM base WHERE k = {STREAM_ID})"),
    "streams_page": listed(limit=50, offset=100),
    "streams_deep_page": listed(limit=100, offset=1200),
    "streams_count": f"WITH {FOLD} SELECT count(*) AS total FROM state WHERE token = '{TOKEN}'",
    "streams_envelope": f"""WITH {VALUED},
        matching AS (SELECT * FROM viewed WHERE token = '{TOKEN}'),
        page AS (SELECT * FROM matching ORDER BY stream_id DESC LIMIT 20 OFFSET 10)
        SELECT '[' || string_agg(to_json(struct_pack(id := id, sender := sender, recipient := recipient, token := token,
                 total_amount := total_amount, withdrawn := withdrawn, vested := vested, withdrawable := withdrawable,
                 locked := locked, progress := coarse_progress, start_time := start_time, end_time := end_time,
                 cliff_time := cliff_time, cancelled := cancelled, status := status))::VARCHAR, ',' ORDER BY stream_id DESC)
               || ']' AS streams,
               (SELECT count(*) FROM matching) AS total, 20::BIGINT AS "limit", 10::BIGINT AS "offset"
        FROM page""",
    "vesting_asof": f"WITH {VALUED} SELECT stream_id, vested FROM viewed",
    "withdrawable_asof": f"WITH {VALUED} SELECT stream_id, vested, withdrawable, locked FROM viewed",
    "progress_asof": f"WITH {VALUED} SELECT stream_id, coarse_progress AS progress FROM viewed",
    "status_asof": f"WITH {VALUED} SELECT stream_id, status FROM viewed",
    "stream_view": f"WITH {VALUED} SELECT {VIEW} FROM viewed",
    # Dividing vested by the scale first may lose a unit there, so progress is searched for exactly:
    # the largest p with p * total <= vested * 10000, compared in quotient and remainder of 10000.
    "vesting_wide": f"""WITH {valued_sql("1" + WIDEN + "::HUGEINT")}
        SELECT stream_id, vested, withdrawable, locked,
               CASE WHEN t = 0 THEN 10000
                    ELSE coarse_progress + CASE WHEN coarse_progress < 10000
                         AND (t // 10000) * (coarse_progress + 1) + ((t % 10000) * (coarse_progress + 1)) // 10000
                             + CASE WHEN ((t % 10000) * (coarse_progress + 1)) % 10000 > 0 THEN 1 ELSE 0 END <= v
                         THEN 1 ELSE 0 END END::BIGINT AS progress
        FROM viewed""",
    "request_counter": f'WITH {REQUESTS} SELECT method, route, status, count(*) AS "value" FROM requests GROUP BY ALL',
    "request_histogram": f"""WITH {HISTOGRAM}
        SELECT method, route, status, "sum"::VARCHAR AS "sum", "count", le, bucket FROM buckets""",
    "request_metrics_merged": f"""WITH {HISTOGRAM}
        SELECT method, route, status, "sum"::VARCHAR AS "sum", "count", le, bucket FROM buckets""",
    "gauge_last": f"""WITH {REQUESTS}
        SELECT user_id, arg_max(ms, (ts, event_id))::VARCHAR AS "value" FROM requests GROUP BY user_id""",
    "failed_counter": f'WITH {BASE} SELECT kind, count(*) AS "value" FROM log WHERE failed GROUP BY kind',
    "pages_counter": f'WITH {BASE} SELECT count(DISTINCT page_seq) AS "value" FROM log',
    "error_counter": f"""WITH {REQUESTS}
        SELECT route AS operation, count(*) AS "value" FROM requests WHERE status = '500' GROUP BY route""",
    "lag_gauge": f"WITH {PAGES} SELECT lag_ledgers FROM latest",
    "exposition_lines": EXPOSITION,
}
