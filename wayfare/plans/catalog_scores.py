"""Registered queries: scores of journeys under the fitted rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfare.functions.columns import clip, shift_prevalence
from wayfare.operators import assemble, learn, rates, scoring, segments, snapshots, transitions
from wayfare.plans import sql
from wayfare.plans.catalog_transitions import (
    ABS_IN,
    DAY,
    EV_RATES,
    EV_TT,
    FALL,
    GOOD,
    H12,
    OL_TT,
    ORDER_EDGES,
    PIECE,
    SEGMENT_SQL,
    STRAT,
    ev_transitions,
    first_state_segments,
    order_sql,
)
from wayfare.plans.catalog_log import definitions
from wayfare.plans.catalog_snapshots import FRAC, numbered
from wayfare.plans.registry import query, r6
from wayfare.plans.sql import CUSTOMER28, EV, EV_LABEL, OL, OL_LABEL, recursive, with_
from wayfare.plans.two_logs import FitStore, two_log_scores
from wayfare.session import settle, shared_folder
from wayfare.sources import adapters

D60 = 5_184_000
CURRENT = f"""cs AS (SELECT id, arg_max(ed_id, (ts_us, ed_id)) AS current_state, (max(ts_us) - min(ts_us)) / 1e6 AS age
  FROM {{log}} WHERE ed_id IN {CUSTOMER28} GROUP BY id)"""
OPEN = CURRENT + """,
op AS (SELECT cs.* FROM cs JOIN lb USING (id) WHERE journey_status = 'other')"""
PRIOR = "pr AS (SELECT segment, sum(n) FILTER (t = 28) / sum(n) AS prior FROM pt GROUP BY segment)"


@query(
    "transition_prob",
    recursive(
        *EV_RATES,
        sql.uniformized("rt", "43200", "um"),
        """it AS (
  SELECT segment, s AS goal, 0 AS k, list_transform(states, lambda x: CASE WHEN x = s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v,
         exp(-load) AS w, list_transform(states, lambda x: CASE WHEN x = s THEN exp(-load) ELSE 0.0::DOUBLE END) AS acc
  FROM (SELECT *, unnest(states) AS s FROM um)
  UNION ALL
  SELECT segment, goal, k + 1, nv, w2, list_transform(range(1, len(acc) + 1), lambda i: acc[i] + w2 * nv[i]) FROM (
    SELECT it.segment, it.goal, it.k, it.acc, it.w * um.load / (it.k + 1) AS w2,
           list_transform(um.cells, lambda r: list_dot_product(r, it.v)) AS nv
    FROM it JOIN um USING (segment) WHERE it.k < 80))""",
    )
    + "SELECT unnest(um.states) AS from_state, it.goal AS to_state, round(unnest(it.acc), 6) AS p FROM it JOIN um USING (segment) WHERE k = 80",
)
def _(spark, folder):
    table = rates.rate_table(ev_transitions(spark, folder))
    return r6(scoring.transition_probabilities(table, H12).select("from_state", "to_state", "p"))


@query(
    "horizon_score",
    recursive(*EV_RATES, PRIOR, CURRENT.format(log="ev"), sql.horizon_hits("rt", "43200"))
    + """SELECT id, current_state, round(coalesce(p, prior), 6) AS p FROM cs LEFT JOIN hz ON hz.state = cs.current_state CROSS JOIN pr""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    totals = scoring.fitted_totals(transitions.transitions(log))
    out = scoring.horizon_score(assemble.current_state(log), totals, horizon_seconds=H12)
    return r6(out.select("id", "current_state", "p"))


@query(
    "timeout_score",
    recursive(OL_LABEL, OL_TT, ABS_IN, sql.totals("tx"), GOOD, FALL, OPEN.format(log="ol"), sql.absorption("gd"))
    + "SELECT id, current_state, round(coalesce(p, fallback), 6) AS p FROM op LEFT JOIN ab ON ab.state = op.current_state CROSS JOIN fb",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    totals = scoring.timeout_totals(transitions.timeout_transitions(log))
    return r6(scoring.timeout_score(assemble.open_journeys(log), totals).select("id", "current_state", "p"))


HIT = """hs AS (SELECT f AS s FROM rt WHERE f <> 28 UNION SELECT t FROM rt WHERE t <> 28),
ho AS (SELECT f, sum(n) AS out, any_value(exp_us) / 86400e6 AS days FROM rt GROUP BY f),
hg AS (SELECT a.s AS f, list(coalesce(r.n / o.out, 0.0)::DOUBLE ORDER BY b.s) AS cells, any_value(o.days / o.out)::DOUBLE AS wait
  FROM hs a JOIN hs b ON true LEFT JOIN rt r ON r.f = a.s AND r.t = b.s LEFT JOIN ho o ON o.f = a.s GROUP BY a.s),
hm AS (SELECT list(f ORDER BY f) AS states, list(cells ORDER BY f) AS cells, list(wait ORDER BY f) AS wait FROM hg),
hi AS (SELECT 0 AS k, list_transform(wait, lambda x: 0.0::DOUBLE) AS m FROM hm
  UNION ALL SELECT k + 1, list_transform(range(1, len(wait) + 1), lambda i: wait[i] + list_dot_product(cells[i], m)) FROM hi, hm WHERE k < 400),
ht AS (SELECT unnest(states) AS state, unnest(m) AS days FROM hi, hm WHERE k = 400 UNION ALL SELECT 28, 0.0)"""


@query(
    "hitting_time",
    recursive(*EV_RATES, CURRENT.format(log="ev"), HIT)
    + """SELECT id, current_state, round(days, 6) AS expected_days, round(exp(-days * 86400 / 5184000), 6) AS waiting_score
FROM cs LEFT JOIN ht ON ht.state = cs.current_state""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    totals = scoring.fitted_totals(transitions.transitions(log))
    out = scoring.hitting_time(assemble.current_state(log), totals)
    return r6(
        out.select(
            "id", "current_state", (F.col("seconds") / 86400.0).alias("expected_days"),
            scoring.waiting_score(F.col("seconds")).alias("waiting_score"),
        )
    )


@query(
    "clustered_score",
    recursive(
        EV, sql.transitions("ev"), SEGMENT_SQL, sql.totals("ts", segment="seg"), sql.rates(), PRIOR,
        CURRENT.format(log="ev"), sql.horizon_hits("rt", "43200"),
        # Every segment of a first state is fitted, so the global model is never needed.
    )
    + """SELECT cs.id, seg AS segment, current_state, round(coalesce(p, prior), 6) AS p
FROM cs JOIN sg USING (id) LEFT JOIN hz ON hz.segment = sg.seg::VARCHAR AND hz.state = cs.current_state LEFT JOIN pr ON pr.segment = sg.seg::VARCHAR""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    tagged = transitions.transitions(log).join(first_state_segments(log), "id")
    totals = scoring.fitted_totals(tagged, F.col("segment"))
    whole = totals.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"), F.sum("dwell_us").alias("dwell_us"))
    journeys = assemble.current_state(log).join(first_state_segments(log), "id")
    out = scoring.segment_score(journeys, totals, whole.withColumn("segment", F.lit(rates.GLOBAL)), horizon_seconds=H12)
    return r6(out.select("id", F.col("segment").cast("long").alias("segment"), "current_state", "p"))


@query(
    "clustered_timeout_score",
    recursive(
        EV_LABEL, EV_TT, f"sg AS (SELECT id, arg_min(ed_id, (ts_us, ed_id)) AS seg FROM ev WHERE ed_id IN {CUSTOMER28} GROUP BY id)",
        "tx AS (SELECT tt.*, sg.seg FROM tt JOIN sg USING (id) WHERE state NOT IN (28, -1))",
        sql.totals("tx", segment="seg"), GOOD, FALL, OPEN.format(log="ev"), sql.absorption("gd"),
    )
    + """SELECT op.id, seg AS segment, current_state, round(coalesce(p, fallback), 6) AS p
FROM op JOIN sg USING (id) LEFT JOIN ab ON ab.segment = sg.seg::VARCHAR AND ab.state = op.current_state LEFT JOIN fb ON fb.segment = sg.seg::VARCHAR""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    table = transitions.timeout_transitions(log, timeout_seconds=DAY, horizon_seconds=H12)
    totals = scoring.timeout_totals(table.join(first_state_segments(log), "id"), F.col("segment"))
    whole = totals.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"), F.sum("dwell_us").alias("dwell_us"))
    journeys = assemble.open_journeys(log, horizon_seconds=H12).join(first_state_segments(log), "id")
    out = scoring.segment_timeout_score(journeys, totals, whole.withColumn("segment", F.lit(rates.GLOBAL)))
    return r6(out.select("id", F.col("segment").cast("long").alias("segment"), "current_state", "p"))


@query(
    "stratified_score",
    recursive(*STRAT, sql.rates(), PRIOR, OPEN.format(log="ol"), sql.horizon_hits("rt", "5184000"))
    + f"""SELECT op.id, current_state, bin AS age_bin, round(coalesce(p, prior), 6) AS p
FROM (SELECT *, ({" + ".join(f"(age >= {e})::INT" for e in ORDER_EDGES)})::VARCHAR AS bin FROM op) op
LEFT JOIN hz ON hz.segment = op.bin AND hz.state = op.current_state LEFT JOIN pr ON pr.segment = op.bin""",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    totals = settle(rates.stratified_totals(transitions.timeout_transitions(log), ORDER_EDGES))
    out = scoring.stratified_score(assemble.open_journeys(log), totals, ORDER_EDGES, horizon_seconds=D60)
    return r6(out.select("id", "current_state", "age_bin", "p"))


# Backward in time: the last bin is propagated first, then the bins before it.
PIECE_SCORE = """pw2 AS (SELECT bin::VARCHAR AS segment, f, t, CASE WHEN exp_us > 0 THEN n / (exp_us / 1e6) ELSE 0 END AS rate FROM pw),
ss AS (SELECT DISTINCT s FROM (SELECT f AS s FROM cl UNION ALL SELECT t FROM cl UNION ALL SELECT 28 UNION ALL SELECT -1)),
po AS (SELECT segment, f, sum(rate) AS out FROM pw2 GROUP BY ALL),
pt0 AS (SELECT segment, max(out) AS top FROM po GROUP BY segment),
pg AS (SELECT tp.segment, a.s AS f, any_value(tp.top) AS top,
    list(coalesce(r.rate, 0) / tp.top + CASE WHEN a.s = b.s THEN 1 - coalesce(o.out, 0) / tp.top ELSE 0 END ORDER BY b.s) AS cells
  FROM pt0 tp, ss a, ss b LEFT JOIN pw2 r ON r.segment = tp.segment AND r.f = a.s AND r.t = b.s
  LEFT JOIN po o ON o.segment = tp.segment AND o.f = a.s GROUP BY tp.segment, a.s),
pm AS (SELECT segment, any_value(top) AS top, list(cells ORDER BY f) AS cells, list(f ORDER BY f) AS states FROM pg GROUP BY segment),
pl AS (SELECT op.id, op.current_state, b.bin, greatest(0.0, least(op.age + 5184000, b.hi / 1e6) - greatest(op.age, b.lo / 1e6)) AS secs FROM op, bn b),
pi AS (SELECT id, 5 AS bin, 0 AS k, list_transform((SELECT list(s ORDER BY s) FROM ss), lambda s: CASE WHEN s = 28 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc,
    NULL::DOUBLE[] AS v, NULL::DOUBLE AS w FROM op
  UNION ALL
  SELECT x.id, x.nb, x.nk, CASE WHEN x.nk = 0 THEN list_transform(x.acc, lambda a: a * exp(-m.top * l.secs))
      ELSE list_transform(range(1, len(x.acc) + 1), lambda i: x.acc[i] + x.w * m.top * l.secs / x.nk * list_dot_product(m.cells[i], x.v)) END,
    CASE WHEN x.nk = 0 THEN x.acc ELSE list_transform(m.cells, lambda r: list_dot_product(r, x.v)) END,
    CASE WHEN x.nk = 0 THEN exp(-m.top * l.secs) ELSE x.w * m.top * l.secs / x.nk END
  FROM (SELECT id, acc, v, w, CASE WHEN bin = 5 OR k = 40 THEN bin - 1 ELSE bin END AS nb, CASE WHEN bin = 5 OR k = 40 THEN 0 ELSE k + 1 END AS nk
        FROM pi WHERE NOT (bin = 0 AND k = 40)) x
  JOIN pl l ON l.id = x.id AND l.bin = x.nb JOIN pm m ON m.segment = x.nb::VARCHAR),
pf AS (SELECT id, acc FROM pi WHERE bin = 0 AND k = 40)"""


@query(
    "piecewise_score",
    recursive(*PIECE, OPEN.format(log="ol"), PIECE_SCORE)
    + """SELECT op.id, current_state, round(acc[list_position((SELECT list(s ORDER BY s) FROM ss), current_state)], 6) AS p
FROM op JOIN pf USING (id)""",
)
def _(spark, folder):
    log = adapters.orders_log(spark, folder)
    table = transitions.timeout_transitions(log)
    cells = settle(rates.piecewise_cells(table, ORDER_EDGES))
    fitted = rates.piecewise_from_cells(cells, len(ORDER_EDGES) + 1)
    share = rates.terminal_share(cells.withColumn("segment", F.lit(rates.GLOBAL))).select("fallback").scalar()
    out = scoring.piecewise_score(
        assemble.open_journeys(log), fitted, ORDER_EDGES, F.coalesce(share, F.lit(0.0)), horizon_seconds=D60
    )
    return r6(out.select("id", "current_state", "p"))


def order_score_sql(k):
    goal = ",".join(["28"] * k)
    return (
        recursive(
            EV, sql.transitions("ev"), sql.totals("tr", "pt1"), sql.rates("pt1", "rt1"), order_sql("ev", k), sql.totals("ht"), sql.rates(),
            f"rk AS (SELECT * FROM rt WHERE f <> '{goal}')",
            "lh AS (SELECT id, arg_max(history, seq) AS history, arg_max(ed_id, seq) AS current_state FROM h GROUP BY id)",
            sql.horizon_hits("rt1", "43200", "h1"),
            sql.horizon_hits("rk", "43200", "h2", goal=f"'{goal}'"),
        )
        + "SELECT lh.id, history, round(coalesce(h2.p, h1.p), 6) AS p FROM lh LEFT JOIN h2 ON h2.state = lh.history LEFT JOIN h1 ON h1.state = lh.current_state"
    )


def order_score(spark, folder, k):
    log = adapters.events_log(spark, folder)
    first = scoring.fitted_totals(transitions.transitions(log))
    totals = scoring.fitted_totals(transitions.order_k_transitions(log, k))
    rows = transitions.order_k_history(log, k)
    last = rows.groupBy("id").agg(
        F.max_by("ed_id", "seq").alias("current_state"),
        transitions.history_key(F.max_by("history", "seq")).alias("history"),
    )
    return r6(scoring.order_k_score(last, totals, first, k, horizon_seconds=H12).select("id", "history", "p"))


@query("order_k_score", order_score_sql(2))
def _(spark, folder):
    return order_score(spark, folder, 2)


@query("order3_score", order_score_sql(3))
def _(spark, folder):
    return order_score(spark, folder, 3)


@query("speed_score")
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    table = transitions.transitions(log)
    fitted = settle(rates.rate_table(table))
    features = settle(segments.journey_features(table, segments.top_states(table)))
    columns = [c for c in features.columns if c != "id"]
    train = features.join(rates.journey_speed(table, fitted).select("id", "log_alpha"), "id")
    model = learn.log_speed_model(train, columns)
    predicted = model.transform(features).select("id", "current_state", F.col("predicted_log_alpha").alias("log_alpha"))
    return scoring.speed_score(predicted, fitted, horizon_seconds=H12)


@query(
    "speed_score_observed",
    recursive(
        *EV_RATES, CURRENT.format(log="ev"),
        "ex AS (SELECT f, sum(rate) AS q FROM rt GROUP BY f)",
        """al AS (SELECT id, ln(least(1e6, greatest(1e-6, count(*) / greatest(sum(q * dt_us / 1e6), 1e-9)))) AS la
  FROM tr JOIN ex ON ex.f = tr.state WHERE state <> next_state GROUP BY id)""",
        sql.uniformized("rt", "43200", "um", absorbing="28"),
        """it AS (
  SELECT al.id, um.load * exp(greatest(-6, least(6, la))) AS lo, 0 AS k, list_transform(states, lambda s: CASE WHEN s = 28 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v,
    exp(-(um.load * exp(greatest(-6, least(6, la))))) AS w,
    list_transform(states, lambda s: CASE WHEN s = 28 THEN exp(-(um.load * exp(greatest(-6, least(6, la))))) ELSE 0.0::DOUBLE END) AS acc FROM al, um
  UNION ALL
  SELECT id, lo, k + 1, nv, w2, list_transform(range(1, len(acc) + 1), lambda i: acc[i] + w2 * nv[i]) FROM (
    SELECT it.id, it.lo, it.k, it.acc, it.w * it.lo / (it.k + 1) AS w2, list_transform(um.cells, lambda r: list_dot_product(r, it.v)) AS nv
    FROM it, um WHERE it.k < 120))""",
    )
    + """SELECT cs.id, current_state, round(coalesce(acc[list_position(um.states, current_state)], 0), 6) AS p
FROM cs JOIN it ON it.id = cs.id AND it.k = 120 CROSS JOIN um""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    table = transitions.transitions(log)
    fitted = settle(rates.rate_table(table))
    speed = rates.journey_speed(table, fitted).select("id", "log_alpha")
    rows = assemble.current_state(log).select("id", "current_state").join(speed, "id")
    return r6(scoring.speed_score(rows, fitted, horizon_seconds=H12).select("id", "current_state", "p"))


BLEND_SQL = recursive(
    EV_LABEL, sql.transitions("ev"), sql.totals("tr"), sql.rates(), PRIOR, CURRENT.format(log="ev"), sql.horizon_hits("rt", "43200"),
    EV_TT, "tx AS (SELECT * FROM tt WHERE state NOT IN (28, -1))", sql.totals("tx", "px"),
    "gd AS (SELECT segment, f, t, n, n::DOUBLE AS good FROM px)", sql.absorption("gd"),
    "gw AS (SELECT 'all' AS segment, state AS f, next_state AS t, count(*) AS n, count(*) FILTER (dt_us <= 43200000000)::DOUBLE AS good FROM tt WHERE state <> 28 GROUP BY ALL)",
    sql.absorption("gw", "sm2", start="0.5"),
    """bs AS (SELECT cs.id, cs.current_state, coalesce(hz.p, prior) AS horizon, ab.p AS timeout, sm2.p AS semi_markov
  FROM cs CROSS JOIN pr LEFT JOIN hz ON hz.state = cs.current_state LEFT JOIN ab ON ab.state = cs.current_state LEFT JOIN sm2 ON sm2.state = cs.current_state)""",
)


def three_scores(spark, folder):
    """Horizon, timeout and semi-Markov score of every journey's current state, one column each."""
    log = adapters.events_log(spark, folder)
    horizon = scoring.fitted_totals(transitions.transitions(log))
    failing = transitions.timeout_transitions(log, timeout_seconds=DAY, horizon_seconds=H12)
    timeout = scoring.timeout_totals(failing)
    weights = scoring.fitted_weights(failing, timeout_seconds=H12)
    out = scoring.horizon_score(assemble.current_state(log), horizon, horizon_seconds=H12).withColumnRenamed("p", "horizon")
    out = scoring.timeout_score(out, timeout).withColumnRenamed("p", "timeout")
    return scoring.semi_markov_score(out, weights).withColumnRenamed("p", "semi_markov")


@query(
    "blend",
    BLEND_SQL + "SELECT id, round(horizon, 6) AS horizon, round(timeout, 6) AS timeout, round(semi_markov, 6) AS semi_markov, round((horizon + timeout + semi_markov) / 3, 6) AS blend FROM bs",
)
def _(spark, folder):
    out = scoring.blend(three_scores(spark, folder), ["horizon", "timeout", "semi_markov"])
    return r6(out.select("id", "horizon", "timeout", "semi_markov", "blend"))


@query(
    "two_log_scores",
    recursive(
        EV_LABEL, OL, sql.transitions("ev"), sql.totals("tr"), sql.rates(), PRIOR, CURRENT.format(log="ol"), sql.horizon_hits("rt", "43200"),
        EV_TT, "tx AS (SELECT * FROM tt WHERE state NOT IN (28, -1))", sql.totals("tx", "px"),
        "gd AS (SELECT segment, f, t, n, n::DOUBLE AS good FROM px)", sql.absorption("gd"),
        "gw AS (SELECT 'all' AS segment, state AS f, next_state AS t, count(*) AS n, count(*) FILTER (dt_us <= 43200000000)::DOUBLE AS good FROM tt WHERE state <> 28 GROUP BY ALL)",
        sql.absorption("gw", "sm2", start="0.5"),
        """fb AS (SELECT sum(n) FILTER (t = 28) / sum(n) FILTER (t IN (28, -1)) AS share,
    (SELECT count(*) FILTER (next_state = 28) / count(*) FILTER (next_state IN (28, -1)) FROM tt WHERE state <> next_state) AS share2 FROM px)""",
        """bs AS (SELECT cs.id, coalesce(hz.p, prior) AS horizon, coalesce(ab.p, share) AS timeout, coalesce(sm2.p, share2) AS semi_markov
  FROM cs CROSS JOIN pr CROSS JOIN fb LEFT JOIN hz ON hz.state = cs.current_state LEFT JOIN ab ON ab.state = cs.current_state LEFT JOIN sm2 ON sm2.state = cs.current_state)""",
    )
    + """SELECT c_custkey AS ordinal, c_custkey::VARCHAR AS id, round(coalesce(horizon, 0), 6) AS horizon, round(coalesce(timeout, 0), 6) AS timeout,
  round(coalesce(semi_markov, 0), 6) AS semi_markov, round(coalesce((horizon + timeout + semi_markov) / 3, 0), 6) AS blend
FROM customer LEFT JOIN bs ON bs.id = c_custkey::VARCHAR""",
)
def _(spark, folder):
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    template = customers.select(F.col("c_custkey").cast("long").alias("ordinal"), F.col("c_custkey").cast("string").alias("id"))
    store = FitStore(spark, f"{shared_folder(spark)}/fits")
    events, orders = adapters.raw_events(spark, folder), adapters.raw_orders(spark, folder)
    out = two_log_scores(events, orders, template, store, horizon_seconds=H12, timeout_seconds=DAY, label_horizon_seconds=H12, late_seconds=H12)
    return r6(out)


@query(
    "prevalence_shift",
    BLEND_SQL
    + """SELECT id, round(p, 6) AS p, round(o * r / (1 + o * r), 6) AS calibrated FROM (
  SELECT id, (horizon + timeout + semi_markov) / 3 AS p, (horizon + timeout + semi_markov) / 3 / greatest(1 - (horizon + timeout + semi_markov) / 3, 1e-10) AS o,
    (0.05018 / (1 - 0.05018)) / (0.2194 / (1 - 0.2194)) AS r FROM bs)""",
)
def _(spark, folder):
    out = scoring.blend(three_scores(spark, folder), ["horizon", "timeout", "semi_markov"], "p")
    return r6(out.select("id", "p", shift_prevalence(F.col("p")).alias("calibrated")))


PATH = f"""ep AS (SELECT e.id, e.ed_id, e.ts_us, row_number() OVER w AS seq, coalesce(hz.p, prior) AS p
  FROM ev e CROSS JOIN pr LEFT JOIN hz ON hz.state = e.ed_id WHERE e.ed_id IN {CUSTOMER28} WINDOW w AS (PARTITION BY e.id ORDER BY e.ts_us, e.ed_id))"""


def path_parts(spark, folder):
    log = adapters.events_log(spark, folder)
    totals = scoring.fitted_totals(transitions.transitions(log))
    table = settle(scoring.horizon_table(rates.with_rates(totals), horizon_seconds=H12))
    prior = rates.success_prior(totals).select("prior").scalar()
    return log.states(transitions.CUSTOMER_STATES, also=28), table, prior


@query(
    "probability_path",
    recursive(*EV_RATES, PRIOR, sql.horizon_hits("rt", "43200"), PATH)
    + """SELECT id, seq, ed_id, round(p, 6) AS p, round((ts_us - min(ts_us) OVER (PARTITION BY id)) / 86400e6, 6) AS elapsed_days,
  round(coalesce(p - lag(p) OVER (PARTITION BY id ORDER BY seq), 0), 6) + 0.0 AS delta,
  CASE WHEN coalesce(p - lag(p) OVER (PARTITION BY id ORDER BY seq), 0) > 0 THEN 'up' WHEN coalesce(p - lag(p) OVER (PARTITION BY id ORDER BY seq), 0) < 0 THEN 'down' ELSE 'flat' END AS direction
FROM ep""",
)
def _(spark, folder):
    return r6(scoring.probability_path(*path_parts(spark, folder)))


@query(
    "path_candidates",
    recursive(*EV_RATES, PRIOR, sql.horizon_hits("rt", "43200"), PATH)
    + """SELECT id, count(*) AS n_actions, round(min(p), 6) AS p_min, round(max(p), 6) AS p_max, round(max(p) - min(p), 6) AS p_range,
  bool_or(ed_id = 28) AS reached_success FROM ep GROUP BY id HAVING count(*) >= 4""",
)
def _(spark, folder):
    return r6(scoring.path_candidates(*path_parts(spark, folder)))


GRID = [k * 43_200.0 for k in range(0, 9)]
DIST = recursive(
    *EV_RATES,
    # Row vector from state 23, one step of the series per (time, k).
    sql.uniformized("rt", "1", "um"),
    """ut AS (SELECT list(list_transform(cells, lambda r: r[j]) ORDER BY j) AS cols FROM um, range(1, 100) x(j) WHERE j <= len(um.states))""",
    """it AS (
  SELECT t, 0 AS k, list_transform(states, lambda s: CASE WHEN s = 23 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v, exp(-load * t) AS w,
    list_transform(states, lambda s: CASE WHEN s = 23 THEN exp(-load * t) ELSE 0.0::DOUBLE END) AS acc
  FROM um, (SELECT j * 43200.0::DOUBLE AS t FROM range(0, 9) g(j))
  UNION ALL
  SELECT t, k + 1, nv, w2, list_transform(range(1, len(acc) + 1), lambda i: acc[i] + w2 * nv[i]) FROM (
    SELECT it.t, it.k, it.acc, it.w * um.load * it.t / (it.k + 1) AS w2, list_transform(ut.cols, lambda c: list_dot_product(c, it.v)) AS nv
    FROM it, um, ut WHERE it.k < 150))""",
    "sd AS (SELECT t AS t_seconds, unnest(um.states) AS state, unnest(acc) AS p FROM it, um WHERE k = 150)",
)


@query("state_distribution", DIST + "SELECT t_seconds, state, round(p, 6) AS p FROM sd")
def _(spark, folder):
    table = rates.rate_table(ev_transitions(spark, folder))
    return r6(scoring.state_distribution(table, {23: 1.0}, GRID).drop("segment"))


@query(
    "state_distribution_top",
    DIST
    + """SELECT t_seconds, state, rank, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY t_seconds ORDER BY p DESC, state) AS rank FROM sd)
WHERE rank <= 3 AND t_seconds > 0""",
)
def _(spark, folder):
    table = rates.rate_table(ev_transitions(spark, folder))
    out = scoring.top_states_per_time(scoring.state_distribution(table, {23: 1.0}, GRID[1:]), 3)
    return r6(out.drop("segment"))


@query(
    "state_peaks",
    DIST
    + """SELECT state, round(peak, 6) AS peak, row_number() OVER (ORDER BY peak DESC, state)::INT AS rank
FROM (SELECT state, max(p) AS peak FROM sd GROUP BY state) QUALIFY rank <= 8""",
)
def _(spark, folder):
    table = rates.rate_table(ev_transitions(spark, folder))
    return r6(scoring.top_states_by_peak(scoring.state_distribution(table, {23: 1.0}, GRID)).drop("segment"))


@query(
    "top_rates_labeled",
    with_(*EV_RATES, "d AS (SELECT ed_id, min(event_name) AS name FROM ev GROUP BY ed_id)")
    + """SELECT f AS from_state, t AS to_state, a.name AS from_name, b.name AS to_name, round(rate * 86400, 6) AS rate_per_day
FROM rt JOIN d a ON a.ed_id = f JOIN d b ON b.ed_id = t ORDER BY rate DESC, f, t LIMIT 5""",
)
def _(spark, folder):
    names = settle(definitions(spark, folder))
    top = rates.top_rates(rates.rate_table(ev_transitions(spark, folder)), 5)
    for side in ("from", "to"):
        top = assemble.with_event_label(top, names, f"{side}_state").withColumnRenamed("event_name", f"{side}_name")
    return r6(top.select("from_state", "to_state", "from_name", "to_name", (F.col("rate") * 86400.0).alias("rate_per_day")))


@query(
    "score_by_state",
    BLEND_SQL
    + """SELECT s AS state, round(max(hz.p), 6) AS horizon, round(max(ab.p), 6) AS timeout, round(max(sm2.p), 6) AS semi_markov
FROM (SELECT state AS s FROM hz UNION SELECT state FROM ab UNION SELECT state FROM sm2) u
LEFT JOIN hz ON hz.state = s LEFT JOIN ab ON ab.state = s LEFT JOIN sm2 ON sm2.state = s GROUP BY s""",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    failing = transitions.timeout_transitions(log, timeout_seconds=DAY, horizon_seconds=H12)
    return r6(
        scoring.score_by_state(
            {
                "horizon": scoring.horizon_table(rates.rate_table(transitions.transitions(log)), horizon_seconds=H12),
                "timeout": scoring.timeout_table(rates.absorbing_totals(failing)),
                "semi_markov": scoring.semi_markov_table(rates.semi_markov_weights(failing, timeout_seconds=H12)),
            }
        )
    )


def rate_sql():
    return f"""sn AS (SELECT nb.id, nb.ed_id AS current_state, (journey_status = 'successful')::INT AS label,
    CASE WHEN journey_status = 'successful' THEN (end_us - ts_us) / 1e6 ELSE 5184000.0 END AS expo,
    CASE WHEN pos > 1 THEN ((ts_us - start_us) // 1000000) / (pos - 1) ELSE 0 END AS gap
  FROM nb JOIN lb USING (id) WHERE pos = {FRAC} AND journey_status IN ('successful', 'incomplete')),
er AS (SELECT current_state, sum(label) / greatest(sum(expo), 1e-9) AS rate, sum(label)::BIGINT AS successes, sum(expo) AS expo FROM sn GROUP BY current_state)"""


def rated_snapshots(spark, folder):
    log = adapters.orders_log(spark, folder)
    taken = snapshots.position_snapshots(log, snapshots.fraction_cut(F.col("n")), milestones={})
    taken = settle(taken.withColumnRenamed("current_last_action", "current_state"))
    table = settle(rates.censored_rates(taken, ["current_state"]))
    return taken, table


@query(
    "exp_rate_score",
    with_(OL_LABEL, numbered("ol"), rate_sql())
    + "SELECT id, current_state, label, round(rate * 86400, 6) AS rate_per_day, round(1 - exp(-rate * 5184000), 6) AS p FROM sn JOIN er USING (current_state)",
)
def _(spark, folder):
    taken, table = rated_snapshots(spark, folder)
    out = taken.select("id", "current_state", "label").join(table, "current_state")
    return r6(
        out.select(
            "id", "current_state", "label", (F.col("rate") * 86400.0).alias("rate_per_day"),
            clip(scoring.exponential_score(F.col("rate"))).alias("p"),
        )
    )
