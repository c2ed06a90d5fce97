"""Registered queries: transition tables and rate estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions.columns import age_bin, uniform
from wayfare.operators import assemble, rates, scoring, transitions
from wayfare.plans import sql
from wayfare.plans.registry import query, r6
from wayfare.plans.sql import CUSTOMER28, EV, EV_LABEL, OL, OL_LABEL, recursive, with_
from wayfare.session import settle
from wayfare.sources import adapters

H12 = 43_200
DAY = 86_400
EDGES = (1 * DAY, 7 * DAY, 14 * DAY, 21 * DAY)
ORDER_EDGES = (30 * DAY, 90 * DAY, 365 * DAY, 730 * DAY)
PER_DAY = 86_400.0

TABLE = ["id", "seq", "state", "next_state", "dt_seconds"]
EV_TT = sql.timeout_transitions("ev", "86400000000")
OL_TT = sql.timeout_transitions("ol", "5184000000000")


def ev_timeout(spark, folder):
    return transitions.timeout_transitions(
        adapters.events_log(spark, folder), timeout_seconds=DAY, horizon_seconds=H12
    )


def ol_timeout(spark, folder):
    return transitions.timeout_transitions(adapters.orders_log(spark, folder))


def bigint_where_it_fits(cells, column="exposure_us"):
    """The SQL's BIGINT; where a total is beyond it and the SQL has no result, the column stays an exact decimal(38,0)."""
    # One row per segment and pair of states.
    cells = settle(cells)
    most = cells.select(F.max(column)).first()[0]
    return cells if most is not None and most >= 2**63 else cells.withColumn(column, F.col(column).cast("long"))


def ev_transitions(spark, folder):
    return transitions.transitions(adapters.events_log(spark, folder))


@query(
    "transitions",
    with_(EV, sql.transitions("ev"))
    + "SELECT id, seq, state, next_state, round(dt_us / 1e6, 6) AS dt_seconds FROM tr",
)
def _(spark, folder):
    return r6(ev_transitions(spark, folder).select(*TABLE))


@query(
    "transitions_all_states",
    with_(OL)
    + """SELECT * FROM (SELECT id, row_number() OVER w AS seq, ed_id AS state, lead(ed_id) OVER w AS next_state,
  (lead(ts_us) OVER w - ts_us) / 1e6 AS dt_seconds FROM ol WINDOW w AS (PARTITION BY id ORDER BY ts_us, ed_id))
WHERE next_state IS NOT NULL""",
)
def _(spark, folder):
    return r6(transitions.transitions(adapters.orders_log(spark, folder), states=None).select(*TABLE))


@query(
    "timeout_transitions",
    with_(OL_LABEL, OL_TT) + "SELECT id, seq, state, next_state, round(dt_us / 1e6, 6) AS dt_seconds FROM tt",
)
def _(spark, folder):
    return r6(ol_timeout(spark, folder).select(*TABLE))


@query(
    "timeout_transitions_events",
    with_(EV_LABEL, EV_TT) + "SELECT id, seq, state, next_state, round(dt_us / 1e6, 6) AS dt_seconds FROM tt",
)
def _(spark, folder):
    return r6(ev_timeout(spark, folder).select(*TABLE))


@query(
    "prefix_transitions",
    with_(
        EV,
        """nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts_us, ed_id) AS pos, count(*) OVER (PARTITION BY id) AS n FROM ev),
pf AS (SELECT * FROM nn WHERE pos <= CASE WHEN n <= 1 THEN 1 ELSE greatest(1, least(n - 1, floor(0.7 * n))) END)""",
        sql.transitions("pf"),
    )
    + "SELECT id, seq, state, next_state, round(dt_us / 1e6, 6) AS dt_seconds FROM tr",
)
def _(spark, folder):
    from wayfare.operators.snapshots import fraction_cut

    log = adapters.events_log(spark, folder)
    return r6(transitions.prefix_transitions(log, fraction_cut(F.col("n"))).select(*TABLE))


def probe_sql(log: str, seed: int) -> str:
    """Three probe times per journey, drawn in its own span."""
    return f"""pr AS (
  SELECT id, k AS sample_num, id || '::' || k AS snapshot_id,
         lo + floor({sql.uniform(seed, "id", "k")} * (hi - lo))::BIGINT AS probe_us
  FROM (SELECT id, min(ts_us) AS lo, max(ts_us) AS hi FROM {log} GROUP BY id), range(1, 4) r(k))"""


def probes(log, seed):
    spans = log.events.groupBy("id").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    rows = spans.withColumn("sample_num", F.explode(F.sequence(F.lit(1), F.lit(3))))
    at = F.col("lo") + F.floor(uniform(seed, "id", "sample_num") * (F.col("hi") - F.col("lo"))).cast("long")
    snapshot_id = F.concat_ws("::", "id", F.col("sample_num").cast("string")).alias("snapshot_id")
    return rows.select("id", "sample_num", snapshot_id, at.alias("probe_us"))


@query(
    "asof_state",
    with_(OL, probe_sql("ol", 7))
    + """SELECT p.id, sample_num, probe_us, arg_max(ed_id, (ts_us, ed_id)) AS state, max(ts_us) AS state_us
FROM pr p JOIN ol e ON e.id = p.id AND e.ts_us <= p.probe_us GROUP BY ALL""",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    return transitions.state_at(log, probes(log, 7)).drop("seq")


def suffix_sql(log: str, label: str, seed: int, timeout_us: str) -> str:
    return with_(
        label,
        probe_sql(log, seed),
        f"f AS (SELECT * FROM {log} WHERE ed_id IN {CUSTOMER28})",
        """cur AS (SELECT p.snapshot_id, p.id, p.probe_us, arg_max(ed_id, (ts_us, ed_id)) AS st
  FROM pr p JOIN f ON f.id = p.id AND f.ts_us <= p.probe_us GROUP BY ALL)""",
        """fut AS (SELECT c.snapshot_id, c.id, c.probe_us, c.st, f.ed_id, f.ts_us, row_number() OVER w AS k,
  coalesce(lag(f.ed_id) OVER w, c.st) AS ps, coalesce(lag(f.ts_us) OVER w, c.probe_us) AS pt
  FROM cur c JOIN f ON f.id = c.id AND f.ts_us > c.probe_us
  WINDOW w AS (PARTITION BY c.snapshot_id ORDER BY f.ts_us, f.ed_id))""",
        f"""fl AS (SELECT *, ts_us - pt > {timeout_us} AS late, (ts_us - pt > {timeout_us} OR ed_id = 28) AS stop FROM fut)""",
        """kept AS (SELECT * FROM (SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY snapshot_id ORDER BY k
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM fl) WHERE over = 0)""",
        f"""alls AS (
  SELECT snapshot_id, id, ps AS state, CASE WHEN late THEN -1 ELSE ed_id END AS next_state,
         CASE WHEN late THEN {timeout_us} ELSE ts_us - pt END AS dt_us FROM kept
  UNION ALL
  SELECT c.snapshot_id, c.id, coalesce(l.last_state, c.st), -1, {timeout_us}
  FROM cur c LEFT JOIN (SELECT snapshot_id, arg_max(ed_id, k) AS last_state, max(stop::INT) AS stopped FROM kept GROUP BY 1) l USING (snapshot_id)
  WHERE coalesce(l.stopped, 0) = 0)""",
    ) + "SELECT snapshot_id, id, state, next_state, round(dt_us / 1e6, 6) AS dt_seconds FROM alls WHERE state <> next_state"


@query("suffix_transitions", suffix_sql("ol", OL, 11, "5184000000000::BIGINT"))
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    snapshots = probes(log, 11).withColumnRenamed("probe_us", "snapshot_us")
    out = transitions.suffix_transitions(log, snapshots)
    return r6(out.select("snapshot_id", "id", "state", "next_state", "dt_seconds"))


@query("suffix_transitions_events", suffix_sql("ev", EV, 12, "86400000000::BIGINT"))
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    snapshots = probes(log, 12).withColumnRenamed("probe_us", "snapshot_us")
    out = transitions.suffix_transitions(log, snapshots, timeout_seconds=DAY)
    return r6(out.select("snapshot_id", "id", "state", "next_state", "dt_seconds"))


# One of two segments by the snapshot's name.
HALF = "CASE WHEN substr(md5(snapshot_id), 1, 1) < '8' THEN 'low' ELSE 'high' END"


def suffix_totals_sql(segment: str, *source) -> str:
    rows = suffix_sql(*source).rsplit("SELECT snapshot_id, id, state", 1)[0]
    return rows + f"SELECT {segment} AS segment, state AS from_state, next_state AS to_state, count(*) AS n, sum(dt_us)::BIGINT AS dwell_us FROM alls WHERE state <> next_state GROUP BY ALL"


@query("suffix_totals", suffix_totals_sql("'all'", "ol", OL, 11, "5184000000000::BIGINT"))
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    return transitions.suffix_totals(log, probes(log, 11).withColumnRenamed("probe_us", "snapshot_us"))


@query("suffix_totals_segments", suffix_totals_sql(HALF, "ev", EV, 12, "86400000000::BIGINT"))
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    snapshots = probes(log, 12).withColumnRenamed("probe_us", "snapshot_us").withColumn("segment", F.expr(HALF))
    return transitions.suffix_totals(log, snapshots, segments=["low", "high"], timeout_seconds=DAY)


def ages_sql(edges, source="tt", name="ag"):
    bins = " + ".join(f"({{x}} >= {e * 1_000_000}::BIGINT)::INT" for e in edges)
    return f"""{name} AS (
  SELECT *, end_us - dt_us AS start_us, {bins.format(x="end_us")} AS end_bin FROM (
    SELECT *, sum(dt_us) OVER (PARTITION BY id ORDER BY seq)::BIGINT AS end_us FROM {source} WHERE state <> next_state))"""


def bins_sql(edges):
    ends = [0, *[e * 1_000_000 for e in edges]]
    rows = ", ".join(f"({b}, {lo}::BIGINT, {hi}::BIGINT)" for b, (lo, hi) in enumerate(zip(ends, [*ends[1:], 4 * 10**18])))
    return f"bn(bin, lo, hi) AS (VALUES {rows})"


SPLIT = """sp AS (
  SELECT a.id, a.seq, a.state, a.next_state, b.bin, greatest(0, least(a.end_us, b.hi) - greatest(a.start_us, b.lo)) AS exposure_us,
         (b.bin = a.end_bin)::INT AS jumps
  FROM ag a JOIN bn b ON (a.start_us < b.hi AND a.end_us >= b.lo))"""


@query(
    "age_bin_exposure",
    with_(OL_LABEL, OL_TT, ages_sql(ORDER_EDGES), bins_sql(ORDER_EDGES), SPLIT)
    + "SELECT id, seq, state, next_state, bin, exposure_us, jumps FROM sp",
)
def _(spark, folder):
    return transitions.age_bin_exposure(ol_timeout(spark, folder), ORDER_EDGES)


@query(
    "age_bin",
    with_(EV, f"x AS (SELECT id, (max(ts_us) - min(ts_us)) / 1e6 AS age FROM ev WHERE ed_id IN {CUSTOMER28} GROUP BY id)")
    + "SELECT id, "
    + " + ".join(f"(age >= {e})::INT" for e in EDGES)
    + " AS age_bin FROM x",
)
def _(spark, folder):
    rows = assemble.current_state(adapters.events_log(spark, folder))
    return rows.select("id", age_bin(F.col("observed_age_seconds"), EDGES).alias("age_bin"))


def history_sql(log: str, k: int, name: str = "h") -> str:
    back = ", ".join(f"coalesce(lag(ed_id, {i}) OVER w, -999)" for i in range(k - 1, 0, -1))
    parts = f"concat_ws(',', {back}, ed_id)"
    goal = ",".join(["28"] * k)
    return f"""{name}_f AS (SELECT * FROM {log} WHERE ed_id IN {CUSTOMER28}),
{name} AS (SELECT id, row_number() OVER w AS seq, ed_id, ts_us, CASE WHEN ed_id = 28 THEN '{goal}' ELSE {parts} END AS history
  FROM {name}_f WINDOW w AS (PARTITION BY id ORDER BY ts_us, ed_id))"""


@query("order_k_history", with_(OL, history_sql("ol", 3)) + "SELECT id, seq, ed_id, history FROM h")
def _(spark, folder):
    out = transitions.order_k_history(adapters.orders_log(spark, folder), 3)
    return out.select("id", "seq", "ed_id", transitions.history_key(F.col("history")).alias("history"))


def order_sql(log: str, k: int) -> str:
    return f"""{history_sql(log, k)},
hk AS (SELECT id, seq, history AS state, lead(history) OVER w AS next_state, lead(ts_us) OVER w - ts_us AS dt_us
  FROM h WINDOW w AS (PARTITION BY id ORDER BY seq)),
ht AS (SELECT * FROM hk WHERE next_state IS NOT NULL AND state <> next_state)"""


def order_generator(spark, folder, k):
    table = transitions.order_k_transitions(adapters.events_log(spark, folder), k)
    goal = ",".join(["28"] * k)
    cells = bigint_where_it_fits(rates.rate_table(table))
    cells = cells.withColumn("rate", F.when(F.col("from_state") == goal, 0.0).otherwise(F.col("rate")))
    return r6(cells.select("from_state", "to_state", "n", "exposure_us", (F.col("rate") * PER_DAY).alias("rate_per_day")))


def order_generator_sql(k):
    goal = ",".join(["28"] * k)
    return (
        with_(EV, order_sql("ev", k), sql.totals("ht"), sql.rates())
        + f"""SELECT f AS from_state, t AS to_state, n, exp_us AS exposure_us,
  round(CASE WHEN f = '{goal}' THEN 0 ELSE rate * 86400 END, 6) AS rate_per_day FROM rt"""
    )


@query("order2_generator", order_generator_sql(2))
def _(spark, folder):
    return order_generator(spark, folder, 2)


@query("order3_generator", order_generator_sql(3))
def _(spark, folder):
    return order_generator(spark, folder, 3)


EV_RATES = (EV, sql.transitions("ev"), sql.totals("tr"), sql.rates())


@query(
    "transition_counts",
    with_(*EV_RATES, "s AS (SELECT f AS s FROM rt UNION SELECT t FROM rt)")
    + """SELECT a.s AS from_state, b.s AS to_state, coalesce(max(rt.n), 0) AS n
FROM s a CROSS JOIN s b LEFT JOIN rt ON rt.f = a.s AND rt.t = b.s GROUP BY ALL""",
)
def _(spark, folder):
    return rates.transition_counts(ev_transitions(spark, folder)).drop("segment")


@query(
    "state_exposure",
    with_(*EV_RATES, "s AS (SELECT f AS s FROM rt UNION SELECT t FROM rt)")
    + """SELECT s AS state, round(greatest(coalesce(sum(us), 0) / 1e6, 1e-9), 6) AS exposure_seconds
FROM s LEFT JOIN rt ON rt.f = s.s GROUP BY s""",
)
def _(spark, folder):
    return r6(rates.state_exposure(ev_transitions(spark, folder)).drop("segment"))


@query(
    "generator",
    with_(*EV_RATES, "s AS (SELECT f AS s FROM rt UNION SELECT t FROM rt)")
    + """SELECT f AS from_state, t AS to_state, round(rate * 86400, 6) AS rate_per_day FROM rt
UNION ALL SELECT s, s, round(0 - coalesce(sum(rate), 0) * 86400, 6) FROM s LEFT JOIN rt ON rt.f = s.s GROUP BY s""",
)
def _(spark, folder):
    cells = rates.generator(rates.rate_table(ev_transitions(spark, folder)))
    return r6(cells.select("from_state", "to_state", (F.col("rate") * PER_DAY).alias("rate_per_day")))


@query(
    "top_rates",
    with_(*EV_RATES)
    + "SELECT f AS from_state, t AS to_state, round(rate * 86400, 6) AS rate_per_day FROM rt ORDER BY rate DESC, f, t LIMIT 15",
)
def _(spark, folder):
    top = rates.top_rates(rates.rate_table(ev_transitions(spark, folder)))
    return r6(top.select("from_state", "to_state", (F.col("rate") * PER_DAY).alias("rate_per_day")))


@query(
    "laplace_generator",
    with_(OL_LABEL, OL_TT, sql.totals("tt"), "s AS (SELECT f AS s FROM pt UNION SELECT t FROM pt)")
    + """SELECT a.s AS from_state, b.s AS to_state, coalesce(pt.n, 0) AS n,
  round((coalesce(pt.n, 0) + 0.5) / greatest(coalesce((SELECT sum(us) FROM pt x WHERE x.f = a.s), 0) / 1e6, 1e-9) * 86400, 6) AS rate_per_day
FROM s a JOIN s b ON a.s <> b.s LEFT JOIN pt ON pt.f = a.s AND pt.t = b.s""",
)
def _(spark, folder):
    cells = rates.smoothed_rates(ol_timeout(spark, folder), alpha=0.5)
    return r6(cells.select("from_state", "to_state", "n", (F.col("rate") * PER_DAY).alias("rate_per_day")))


ABS_IN = "tx AS (SELECT * FROM tt WHERE state NOT IN (28, -1))"
GOOD = "gd AS (SELECT segment, f, t, n, n::DOUBLE AS good FROM pt)"
FALL = "fb AS (SELECT segment, coalesce(sum(n) FILTER (t = 28) / sum(n) FILTER (t IN (28, -1)), 0.0) AS fallback FROM pt GROUP BY segment)"


@query(
    "timeout_absorption",
    recursive(OL_LABEL, OL_TT, ABS_IN, sql.totals("tx"), GOOD, FALL, sql.absorption("gd"))
    + "SELECT state, round(p, 6) AS p, round(fallback, 6) AS fallback FROM ab JOIN fb USING (segment)",
)
def _(spark, folder):
    totals = scoring.timeout_totals(ol_timeout(spark, folder))
    out = scoring.timeout_table(totals).join(rates.terminal_share(totals), "segment")
    return r6(out.select("state", "p", "fallback"))


@query(
    "semi_markov",
    recursive(
        EV_LABEL,
        EV_TT,
        "gd AS (SELECT 'all' AS segment, state AS f, next_state AS t, count(*) AS n, count(*) FILTER (dt_us <= 43200000000)::DOUBLE AS good FROM tt GROUP BY ALL)",
        "gx AS (SELECT * FROM gd WHERE f <> 28)",
        sql.absorption("gx", start="0.5"),
    )
    + "SELECT state, round(p, 6) AS p FROM ab",
)
def _(spark, folder):
    weights = scoring.fitted_weights(ev_timeout(spark, folder), timeout_seconds=H12)
    return r6(scoring.semi_markov_table(weights).select("state", "p"))


STRAT = (
    OL_LABEL,
    OL_TT,
    ages_sql(ORDER_EDGES),
    "pb AS (SELECT end_bin::VARCHAR AS segment, state AS f, next_state AS t, count(*) AS n, sum(dt_us)::BIGINT AS us FROM ag GROUP BY ALL)",
    "big AS (SELECT segment FROM pb GROUP BY segment HAVING sum(n) >= 200)",
    """pt AS (SELECT segment, f, t, n, us, false AS fallback FROM pb WHERE segment IN (SELECT segment FROM big)
  UNION ALL SELECT b::VARCHAR, f, t, sum(n)::BIGINT, sum(us)::BIGINT, true FROM pb, range(5) r(b)
  WHERE b::VARCHAR NOT IN (SELECT segment FROM big) GROUP BY ALL)""",
)


@query(
    "stratified_generator",
    with_(*STRAT, sql.rates())
    + "SELECT segment AS age_bin, f AS from_state, t AS to_state, n, exp_us AS exposure_us, round(rate * 86400, 6) AS rate_per_day, fallback FROM rt",
)
def _(spark, folder):
    totals = rates.stratified_totals(ol_timeout(spark, folder), ORDER_EDGES)
    cells = bigint_where_it_fits(rates.with_rates(totals))
    return r6(
        cells.select(
            F.col("segment").alias("age_bin"), "from_state", "to_state", "n", "exposure_us",
            (F.col("rate") * PER_DAY).alias("rate_per_day"), "fallback",
        )
    )


@query(
    "stratified_summary",
    with_(*STRAT)
    + """SELECT segment AS age_bin, sum(n)::BIGINT AS n_transitions, bool_or(fallback) AS fallback,
  (SELECT count(*) FROM (SELECT f FROM pt y WHERE y.segment = pt.segment UNION SELECT t FROM pt y WHERE y.segment = pt.segment)) AS n_states
FROM pt GROUP BY segment""",
)
def _(spark, folder):
    out = rates.stratified_summary(rates.stratified_totals(ol_timeout(spark, folder), ORDER_EDGES))
    return out.withColumnRenamed("segment", "age_bin")


PIECE = (
    OL_LABEL,
    OL_TT,
    ABS_IN,
    ages_sql(ORDER_EDGES, "tx"),
    bins_sql(ORDER_EDGES),
    SPLIT,
    "cl AS (SELECT bin, state AS f, next_state AS t, sum(jumps) AS n, sum(exposure_us)::BIGINT AS us FROM sp GROUP BY ALL)",
    "rw AS (SELECT bin, f, sum(n) AS jumps, sum(us)::BIGINT AS exp_us FROM cl GROUP BY ALL)",
    "rich AS (SELECT bin, f FROM rw WHERE jumps >= 20 AND exp_us >= 3600000000)",
    "gl AS (SELECT f, t, sum(n) AS n, sum(sum(us)) OVER (PARTITION BY f)::BIGINT AS exp_us FROM cl GROUP BY f, t)",
    """pw AS (
  SELECT c.bin, c.f, c.t, c.n::BIGINT AS n, rw.exp_us, false AS fallback FROM cl c JOIN rich USING (bin, f) JOIN rw USING (bin, f)
  UNION ALL SELECT b.bin, g.f, g.t, g.n::BIGINT, g.exp_us, true FROM gl g, bn b
  WHERE NOT EXISTS (SELECT 1 FROM rich r WHERE r.bin = b.bin AND r.f = g.f))""",
)


@query(
    "piecewise_generator",
    with_(*PIECE)
    + """SELECT bin::VARCHAR AS age_bin, f AS from_state, t AS to_state, n, exp_us AS exposure_us,
  round(CASE WHEN exp_us > 0 THEN n / (exp_us / 1e6) * 86400 ELSE 0 END, 6) AS rate_per_day, fallback FROM pw""",
)
def _(spark, folder):
    cells = bigint_where_it_fits(rates.piecewise_rates(ol_timeout(spark, folder), ORDER_EDGES))
    return r6(
        cells.select(
            F.col("segment").alias("age_bin"), "from_state", "to_state", "n", "exposure_us",
            (F.col("rate") * PER_DAY).alias("rate_per_day"), "fallback",
        )
    )


@query(
    "bin_summary",
    with_(*PIECE)
    + """SELECT b.bin, CASE b.bin WHEN 0 THEN '0-30d' WHEN 1 THEN '30-90d' WHEN 2 THEN '90-365d' WHEN 3 THEN '365-730d' ELSE '730d+' END AS window,
  coalesce((SELECT sum(n) FROM cl WHERE cl.bin = b.bin), 0)::BIGINT AS n_transitions,
  round(coalesce((SELECT sum(us) FROM cl WHERE cl.bin = b.bin), 0) / 86400e6, 6) AS exposure_days,
  (SELECT count(DISTINCT f) FROM pw WHERE pw.bin = b.bin AND fallback)
    + (SELECT count(*) FROM (SELECT DISTINCT t FROM cl WHERE t NOT IN (28, -1) AND t NOT IN (SELECT f FROM cl))) AS n_fallback_rows,
  (SELECT count(*) + 2 FROM (SELECT f FROM cl UNION SELECT t FROM cl) u(s) WHERE s NOT IN (28, -1)) AS n_states
FROM bn b""",
)
def _(spark, folder):
    return r6(rates.piecewise_summary(ol_timeout(spark, folder), ORDER_EDGES))


@query(
    "journey_speed",
    with_(*EV_RATES, "ex AS (SELECT f, sum(rate) AS q FROM rt GROUP BY f)")
    + """SELECT id, count(*) AS n, round(count(*) / greatest(sum(q * dt_us / 1e6), 1e-9), 6) AS alpha,
  round(ln(least(1e6, greatest(1e-6, count(*) / greatest(sum(q * dt_us / 1e6), 1e-9)))), 6) AS log_alpha
FROM tr JOIN ex ON ex.f = tr.state WHERE state <> next_state GROUP BY id""",
)
def _(spark, folder):
    table = ev_transitions(spark, folder)
    out = rates.journey_speed(table, rates.with_rates(scoring.fitted_totals(table)))
    return r6(out.select("id", "n", "alpha", "log_alpha"))


@query(
    "success_prior",
    with_(*EV_RATES) + "SELECT round(sum(n) FILTER (t = 28) / sum(n), 6) AS prior FROM rt",
)
def _(spark, folder):
    return r6(rates.success_prior(rates.pair_totals(ev_transitions(spark, folder))).select("prior"))


@query(
    "state_samples",
    with_(OL_LABEL, OL_TT)
    + """SELECT state, count(*) AS samples, count(*) FILTER (next_state = 28) AS success,
  count(*) FILTER (next_state = -1) AS failure, count(*) FILTER (dt_us > 5184000000000) AS late FROM tt GROUP BY state""",
)
def _(spark, folder):
    return rates.state_samples(ol_timeout(spark, folder))


@query(
    "state_volume",
    with_(OL_LABEL, OL_TT, sql.totals("tt"))
    + """SELECT s AS state, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in, sum(o + i)::BIGINT AS volume FROM (
  SELECT f AS s, n AS o, 0 AS i FROM pt UNION ALL SELECT t, 0, n FROM pt) GROUP BY s""",
)
def _(spark, folder):
    return rates.state_volume(rates.pair_totals(ol_timeout(spark, folder))).drop("segment")


SEGMENT_SQL = f"""sg AS (SELECT id, arg_min(ed_id, (ts_us, ed_id)) AS seg FROM ev WHERE ed_id IN {CUSTOMER28} GROUP BY id),
ts AS (SELECT tr.*, sg.seg FROM tr JOIN sg USING (id))"""


def first_state_segments(log):
    """A rule-based segment: the first customer action of the journey."""
    place = F.struct("ts_us", "ed_id")
    return log.states(transitions.CUSTOMER_STATES, also=28).events.groupBy("id").agg(
        F.min_by("ed_id", place).cast("string").alias("segment")
    )


@query(
    "segment_generator",
    with_(EV, sql.transitions("ev"), SEGMENT_SQL, sql.totals("ts", segment="seg"), sql.rates())
    + "SELECT segment, f AS from_state, t AS to_state, n, exp_us AS exposure_us, round(rate * 86400, 6) AS rate_per_day FROM rt",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    table = transitions.transitions(log).join(first_state_segments(log), "id")
    cells = bigint_where_it_fits(rates.rate_table(table, F.col("segment")))
    return r6(cells.select("segment", "from_state", "to_state", "n", "exposure_us", (F.col("rate") * PER_DAY).alias("rate_per_day")))
