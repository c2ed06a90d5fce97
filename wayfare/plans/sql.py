"""Common table expressions of the SQL oracles (written for DuckDB, independent of the plans)."""

from __future__ import annotations

EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS id, ts AS event_timestamp, event_type AS event_name,
         CAST(CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 2 WHEN 'signup' THEN 23
              WHEN 'purchase' THEN 28 WHEN 'error' THEN 12 END AS BIGINT) AS ed_id,
         epoch_us(ts) AS ts_us
  FROM events)"""

OL_RAW = """ol_raw AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderdate AS event_timestamp,
         CASE WHEN o_orderstatus = 'F' THEN 'order_shipped' ELSE
           CASE o_orderpriority WHEN '1-URGENT' THEN 'add_to_cart' WHEN '2-HIGH' THEN 'begin_checkout'
             WHEN '3-MEDIUM' THEN 'browse_products' WHEN '4-NOT SPECIFIED' THEN 'view_cart'
             WHEN '5-LOW' THEN 'campaign_click' END END AS event_name,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 28 ELSE
           CASE o_orderpriority WHEN '1-URGENT' THEN 11 WHEN '2-HIGH' THEN 6 WHEN '3-MEDIUM' THEN 4
             WHEN '4-NOT SPECIFIED' THEN 5 WHEN '5-LOW' THEN 2 END END AS BIGINT) AS ed_id,
         epoch_us(o_orderdate) AS ts_us
  FROM orders)"""

OL = OL_RAW + """,
ol AS (SELECT DISTINCT * FROM ol_raw)"""

# Labels by last action: status per journey of log ``{log}`` with a horizon in microseconds.
LABEL = """sm AS (
  SELECT id, count(*) AS num_actions, count(DISTINCT ed_id) AS num_unique_actions,
         min(ts_us) AS start_us, max(ts_us) AS end_us,
         (max(ts_us) - min(ts_us)) // 1000000 AS duration_seconds,
         arg_min(ed_id, (ts_us, ed_id)) AS first_action, arg_max(ed_id, (ts_us, ed_id)) AS last_action,
         bool_or(ed_id = 28) AS has_order_shipped, min(CASE WHEN ed_id = 28 THEN ts_us END) AS completion_us
  FROM {log} GROUP BY id),
lb AS (
  SELECT *, last_action = 28 AS is_successful,
         (SELECT max(ts_us) FROM {log}) - end_us >= {horizon} AS inactive,
         CASE WHEN last_action = 28 THEN 'successful'
              WHEN (SELECT max(ts_us) FROM {log}) - end_us >= {horizon} THEN 'incomplete'
              ELSE 'other' END AS journey_status
  FROM sm)"""

H60D = "5184000000000"
H12H = "43200000000"
DAY = "86400000000"

OL_LABEL = OL + ",\n" + LABEL.format(log="ol", horizon=H60D)
EV_LABEL = EV + ",\n" + LABEL.format(log="ev", horizon=H12H)

CUSTOMER = "(2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 18, 19, 22, 23, 25)"
CUSTOMER28 = "(2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 18, 19, 22, 23, 25, 28)"


def uniform(seed: int, *parts: str) -> str:
    """The same repeatable draw as the Spark side."""
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS UBIGINT) / 4294967296.0)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# Transitions after the customer filter: tr(id, seq, state, next_state, dt_us), repeats kept.
def transitions(log: str, name: str = "tr") -> str:
    return f"""{name}_f AS (SELECT * FROM {log} WHERE ed_id IN {CUSTOMER28}),
{name}_w AS (
  SELECT id, row_number() OVER w AS seq, ed_id AS state, lead(ed_id) OVER w AS next_state,
         lead(ts_us) OVER w - ts_us AS dt_us
  FROM {name}_f WINDOW w AS (PARTITION BY id ORDER BY ts_us, ed_id)),
{name} AS (SELECT * FROM {name}_w WHERE next_state IS NOT NULL)"""


# Timeout transitions of resolved journeys: tt(id, seq, state, next_state, dt_us), no repeats. Needs lb.
def timeout_transitions(log: str, timeout_us: str, name: str = "tt") -> str:
    return f"""{name}_w AS (
  SELECT e.id, row_number() OVER w AS seq, e.ed_id AS state, lead(e.ed_id) OVER w AS nxt,
         lead(e.ts_us) OVER w - e.ts_us AS gap, l.journey_status
  FROM {log} e JOIN lb l USING (id)
  WHERE e.ed_id IN {CUSTOMER28} AND l.journey_status IN ('successful', 'incomplete')
  WINDOW w AS (PARTITION BY e.id ORDER BY e.ts_us, e.ed_id)),
{name} AS (
  SELECT id, seq, state, coalesce(nxt, -1) AS next_state,
         CASE WHEN nxt IS NULL THEN {timeout_us} ELSE gap END AS dt_us
  FROM {name}_w WHERE (nxt IS NOT NULL OR journey_status = 'incomplete') AND state <> coalesce(nxt, -1))"""


# Pair totals: {name}(segment, f, t, n, us) with a segment expression over {source}.
def totals(source: str, name: str = "pt", segment: str = "'all'") -> str:
    return f"""{name} AS (
  SELECT CAST({segment} AS VARCHAR) AS segment, state AS f, next_state AS t, count(*) AS n, sum(dt_us)::BIGINT AS us
  FROM {source} WHERE state <> next_state GROUP BY ALL)"""


# Rates: {name}(segment, f, t, n, us, exp_us, rate per second).
def rates(source: str = "pt", name: str = "rt") -> str:
    return f"""{name} AS (
  SELECT *, n / greatest(exp_us / 1e6, 1e-9) AS rate FROM (
    SELECT *, sum(us) OVER (PARTITION BY segment, f)::BIGINT AS exp_us FROM {source}))"""


def uniformized(source: str, horizon: str, name: str, absorbing: str = "NULL", rounds: int = 120) -> str:
    """{name}(segment, states, top, rows): I + Q/top as nested lists, rows of absorbing states zeroed."""
    return f"""{name}_s AS (SELECT DISTINCT segment, s FROM (SELECT segment, f AS s FROM {source} UNION ALL SELECT segment, t FROM {source})),
{name}_r AS (SELECT segment, f, t, rate FROM {source} WHERE f <> t AND f IS DISTINCT FROM {absorbing}),
{name}_o AS (SELECT segment, f, sum(rate) AS out FROM {name}_r GROUP BY ALL),
{name}_t AS (SELECT segment, max(out) AS top FROM {name}_o GROUP BY segment),
{name}_g AS (
  SELECT a.segment, a.s AS f, list(coalesce(r.rate, 0) / tp.top + CASE WHEN a.s = b.s THEN 1 - coalesce(o.out, 0) / tp.top ELSE 0 END ORDER BY b.s) AS cells
  FROM {name}_s a JOIN {name}_s b USING (segment) JOIN {name}_t tp USING (segment)
  LEFT JOIN {name}_r r ON r.segment = a.segment AND r.f = a.s AND r.t = b.s
  LEFT JOIN {name}_o o ON o.segment = a.segment AND o.f = a.s GROUP BY a.segment, a.s),
{name} AS (
  SELECT g.segment, list(g.f ORDER BY g.f) AS states, any_value(tp.top) * ({horizon}) AS load, list(g.cells ORDER BY g.f) AS cells
  FROM {name}_g g JOIN {name}_t tp USING (segment) GROUP BY g.segment)"""


def horizon_hits(source: str, horizon: str, name: str = "hz", goal: str = "28", rounds: int = 120) -> str:
    """{name}(segment, state, p): P(goal within the horizon), summed Poisson series (needs WITH RECURSIVE)."""
    m = f"{name}_m"
    return f"""{uniformized(source, horizon, m, absorbing=goal)},
{name}_it AS (
  SELECT segment, 0 AS k, list_transform(states, lambda s: CASE WHEN s = {goal} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v,
         exp(-load) AS w, list_transform(states, lambda s: CASE WHEN s = {goal} THEN exp(-load) ELSE 0.0::DOUBLE END) AS acc
  FROM {m}
  UNION ALL
  SELECT segment, k + 1, nv, w2, list_transform(range(1, len(acc) + 1), lambda i: acc[i] + w2 * nv[i]) FROM (
    SELECT it.segment, it.k, it.acc, it.w * mm.load / (it.k + 1) AS w2,
           list_transform(mm.cells, lambda r: list_dot_product(r, it.v)) AS nv
    FROM {name}_it it JOIN {m} mm USING (segment) WHERE it.k < {rounds})),
{name} AS (
  SELECT mm.segment, unnest(mm.states) AS state, unnest(it.acc) AS p
  FROM {name}_it it JOIN {m} mm USING (segment) WHERE it.k = {rounds})"""


def absorption(source: str, name: str = "ab", rounds: int = 300, start: str = "0.0") -> str:
    """{name}(segment, state, p): value of u = b + P u on the jump chain; {source}(segment, f, t, n, good)
    where ``good`` is the share of the n samples that count as a move in time."""
    return f"""{name}_n AS (SELECT segment, f, sum(n) AS out FROM {source} GROUP BY ALL),
{name}_s AS (SELECT DISTINCT segment, f AS s FROM {source}
  UNION SELECT DISTINCT segment, t FROM {source} WHERE t NOT IN (28, -1)),
{name}_g AS (
  SELECT a.segment, a.s AS f, list(coalesce(r.good / o.out, 0.0) ORDER BY b.s) AS cells
  FROM {name}_s a JOIN {name}_s b USING (segment)
  LEFT JOIN {source} r ON r.segment = a.segment AND r.f = a.s AND r.t = b.s
  LEFT JOIN {name}_n o ON o.segment = a.segment AND o.f = a.s GROUP BY a.segment, a.s),
{name}_b AS (
  SELECT a.segment, a.s AS f, coalesce(max(r.good / o.out), 0.0) AS b
  FROM {name}_s a LEFT JOIN {source} r ON r.segment = a.segment AND r.f = a.s AND r.t = 28
  LEFT JOIN {name}_n o ON o.segment = a.segment AND o.f = a.s GROUP BY a.segment, a.s),
{name}_m AS (
  SELECT g.segment, list(g.f ORDER BY g.f) AS states, list(g.cells ORDER BY g.f) AS cells, list(bb.b ORDER BY g.f) AS b
  FROM {name}_g g JOIN {name}_b bb ON bb.segment = g.segment AND bb.f = g.f GROUP BY g.segment),
{name}_it AS (
  SELECT segment, 0 AS k, list_transform(states, lambda s: {start}::DOUBLE) AS u FROM {name}_m
  UNION ALL
  SELECT it.segment, it.k + 1, list_transform(range(1, len(mm.b) + 1), lambda i: mm.b[i] + list_dot_product(mm.cells[i], it.u))
  FROM {name}_it it JOIN {name}_m mm USING (segment) WHERE it.k < {rounds}),
{name} AS (
  SELECT mm.segment, unnest(mm.states) AS state, unnest(it.u) AS p
  FROM {name}_it it JOIN {name}_m mm USING (segment) WHERE it.k = {rounds}
  UNION ALL SELECT segment, 28, 1.0 FROM {name}_m UNION ALL SELECT segment, -1, 0.0 FROM {name}_m)"""


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
