"""Registered queries: learners, evaluation, splits, sweeps and output."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wayfare.constants import TEST_PREVALENCE
from wayfare.functions.ordered import nth
from wayfare.functions.ranks import sliced_running
from wayfare.operators import assemble, evaluate, learn, output, scoring, snapshots, transitions
from wayfare.plans import sql
from wayfare.plans.chain_comparison import chain_scores, compare_chains
from wayfare.plans.catalog_scores import HIT, PRIOR, rate_sql, rated_snapshots
from wayfare.plans.catalog_snapshots import RAND, numbered
from wayfare.plans.catalog_transitions import DAY, H12
from wayfare.plans.registry import query, r6
from wayfare.plans.sql import EV_LABEL, OL_LABEL, recursive, uniform, with_
from wayfare.plans.suite import score_suite
from wayfare.plans.sweeps import edge_sweep, k_sweep, position_snapshots_for_rules, rule_comparison, segment_sweep
from wayfare.session import settle, shared_folder
from wayfare.sources import adapters

MODELS = ["exp_rate", "gap_rule", "blend"]
SCORED = f"""{numbered("ol")},
{rate_sql()},
sc AS (SELECT *, (exp_rate + gap_rule) / 2 AS blend FROM (
  SELECT id, current_state, label, 1 - exp(-rate * 5184000) AS exp_rate, exp(-gap / 5184000) AS gap_rule FROM sn JOIN er USING (current_state))),
lg AS (SELECT id, current_state, label, 'exp_rate' AS model, exp_rate AS p FROM sc UNION ALL SELECT id, current_state, label, 'gap_rule', gap_rule FROM sc
  UNION ALL SELECT id, current_state, label, 'blend', blend FROM sc)"""
BASE = with_(OL_LABEL, SCORED)


def scored(spark, folder):
    """Three scores of one snapshot per resolved journey."""
    taken, table = rated_snapshots(spark, folder)
    wide = taken.join(table.select("current_state", "rate"), "current_state").select(
        "id",
        "current_state",
        "label",
        scoring.exponential_score(F.col("rate")).alias("exp_rate"),
        scoring.waiting_score(F.col("avg_gap_seconds")).alias("gap_rule"),
    )
    return scoring.blend(wide, ["exp_rate", "gap_rule"])


def scored_long(spark, folder):
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in MODELS])
    return scored(spark, folder).select("id", "current_state", "label", F.explode(cells).alias("e")).select(
        "id", "current_state", "label", "e.model", "e.p"
    )


POINT = """SELECT model, round(avg((q - label) * (q - label)), 6) AS brier_score, round(-avg(CASE WHEN label = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss
FROM (SELECT *, least(1 - 1e-6, greatest(1e-6, p)) AS q FROM {lg}) GROUP BY model"""


@query("brier", BASE + f"SELECT model, brier_score FROM ({POINT.format(lg='lg')})")
def _(spark, folder):
    return r6(evaluate.point_metrics(scored_long(spark, folder), "model").select("model", "brier_score"))


@query("log_loss", BASE + f"SELECT model, log_loss FROM ({POINT.format(lg='lg')})")
def _(spark, folder):
    return r6(evaluate.point_metrics(scored_long(spark, folder), "model").select("model", "log_loss"))


RANKED = """SELECT model, round(sum(pos * (nu - neg / 2)) / (max(pa) * max(na)), 6) AS roc_auc,
  round(sum(pos / pa * (pa - pu + pos) / ((pa - pu + pos) + (na - nu + neg))), 6) AS average_precision FROM (
  SELECT *, sum(neg) OVER o AS nu, sum(pos) OVER o AS pu, sum(pos) OVER (PARTITION BY model) AS pa, sum(neg) OVER (PARTITION BY model) AS na FROM (
    SELECT model, least(1 - 1e-6, greatest(1e-6, p)) AS q, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM {lg} GROUP BY ALL)
  WINDOW o AS (PARTITION BY model ORDER BY q)) GROUP BY model"""


@query("roc_auc", BASE + f"SELECT model, roc_auc FROM ({RANKED.format(lg='lg')})")
def _(spark, folder):
    return r6(evaluate.rank_metrics(scored_long(spark, folder), "model").select("model", "roc_auc"))


@query("average_precision", BASE + f"SELECT model, average_precision FROM ({RANKED.format(lg='lg')})")
def _(spark, folder):
    return r6(evaluate.rank_metrics(scored_long(spark, folder), "model").select("model", "average_precision"))


CONFUSION = """SELECT model, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (
  SELECT model, count(*) FILTER (label = 1 AND z) AS tp, count(*) FILTER (label = 0 AND z) AS fp,
    count(*) FILTER (label = 1 AND NOT z) AS fn, count(*) FILTER (label = 0 AND NOT z) AS tn FROM {rows} GROUP BY model)"""


@query("threshold_metrics", BASE + CONFUSION.format(rows="(SELECT *, p >= 0.3 AS z FROM lg)"))
def _(spark, folder):
    rows = scored_long(spark, folder).withColumn("predicted", (F.col("p") >= 0.3).cast("int"))
    return r6(evaluate.threshold_metrics(rows, "model"))


@query(
    "calibration_table",
    BASE
    + """SELECT model, greatest(1, least(10, ceil(p * 10)))::INT AS bin, round(avg(p), 6) AS mean_predicted, round(avg(label), 6) AS observed_rate, count(*) AS count
FROM lg GROUP BY ALL""",
)
def _(spark, folder):
    return r6(evaluate.calibration_table(scored_long(spark, folder), "model"))


TEMPLATE = "tp AS (SELECT CAST(o_custkey AS VARCHAR) AS id, min(o_orderkey) AS ordinal FROM orders GROUP BY 1)"


def template(spark, folder):
    return spark.read.parquet(f"{folder}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(
        F.min("o_orderkey").alias("ordinal")
    )


@query(
    "prediction_summary",
    BASE.rstrip()
    + ",\n"
    + TEMPLATE
    + """,
wr AS (SELECT m.model, tp.id, coalesce(lg.p, 0) AS p FROM tp CROSS JOIN (SELECT DISTINCT model FROM lg) m LEFT JOIN lg ON lg.id = tp.id AND lg.model = m.model)
SELECT model, count(*) AS n_rows, count(*) = (SELECT count(*) FROM tp) AS order_matches, (SELECT count(*) FROM tp) - count(*) AS missing,
  round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS std, round(min(p), 6) AS min, round(quantile_cont(p, 0.5), 6) AS p50,
  round(quantile_cont(p, 0.9), 6) AS p90, round(quantile_cont(p, 0.99), 6) AS p99, round(max(p), 6) AS max FROM wr GROUP BY model""",
)
def _(spark, folder):
    order, scores = settle(template(spark, folder)), settle(scored(spark, folder))
    long = None
    for model in MODELS:
        path = f"{shared_folder(spark)}/submissions/{uuid.uuid4().hex}"
        output.align_submission(order, scores, p=model).select("id", "order_shipped").write.parquet(path)
        part = output.written_order(spark, path).select(F.lit(model).alias("model"), "id", "ordinal", F.col("order_shipped").alias("p"))
        long = part if long is None else long.unionByName(part)
    # The places of the template's ids, whatever numbers it gives them.
    places = sliced_running(order, "ordinal", {"_place": nth()}).select("id", (F.col("_place") - 1).alias("ordinal"))
    return r6(evaluate.prediction_summary(long, places))


@query(
    "score_diagnostics",
    BASE
    + f"SELECT model, round(avg(p), 6) AS mean_p, round(avg((p > 0.5)::INT), 6) AS share_above_half, {TEST_PREVALENCE}::DOUBLE AS all_zero_brier FROM lg GROUP BY model",
)
def _(spark, folder):
    return r6(evaluate.score_diagnostics(scored_long(spark, folder), "model", prevalence=TEST_PREVALENCE))


@query(
    "ecdf",
    BASE
    + """SELECT model, round(p, 6) AS p, n, round(sum(n) OVER (PARTITION BY model ORDER BY p) / sum(n) OVER (PARTITION BY model), 6) AS share
FROM (SELECT model, p, count(*) AS n FROM lg GROUP BY ALL)""",
)
def _(spark, folder):
    return r6(evaluate.ecdf(scored_long(spark, folder), "model"))


@query(
    "risk_curve",
    BASE
    + """SELECT model, rank, round(rank / total, 6) AS fraction, round(p, 6) AS p FROM (
  SELECT model, p, row_number() OVER (PARTITION BY model ORDER BY p DESC) - 1 AS rank, count(*) OVER (PARTITION BY model) AS total FROM lg)
WHERE rank % greatest(1, total // 200) = 0 AND rank / total <= 0.25""",
)
def _(spark, folder):
    return r6(evaluate.risk_curve(scored_long(spark, folder), "model", points=200))


@query(
    "spearman",
    BASE.rstrip()
    + """,
rk AS (SELECT id, """
    + ", ".join(f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2 AS {m}" for m in MODELS)
    + """ FROM sc)
SELECT 'exp_rate' AS model_a, 'gap_rule' AS model_b, round(corr(exp_rate, gap_rule), 6) AS rho FROM rk
UNION ALL SELECT 'exp_rate', 'blend', round(corr(exp_rate, blend), 6) FROM rk UNION ALL SELECT 'gap_rule', 'blend', round(corr(gap_rule, blend), 6) FROM rk""",
)
def _(spark, folder):
    return r6(evaluate.spearman(settle(scored(spark, folder)), MODELS))


@query(
    "score_by_current_state",
    BASE
    + """SELECT model, current_state, round(avg(p), 6) AS mean_probability, round(median(p), 6) AS median_probability, count(*) AS n FROM lg
WHERE current_state IN (SELECT current_state FROM sc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY ALL""",
)
def _(spark, folder):
    return r6(evaluate.score_by_current_state(scored(spark, folder), MODELS))


RESOLVED = "rl AS (SELECT id, (journey_status = 'successful')::INT AS label FROM lb WHERE journey_status IN ('successful', 'incomplete'))"


def resolved_labels(spark, folder):
    labels = assemble.binary_labels(assemble.labeled_journeys(adapters.orders_log(spark, folder)))
    return labels.select("id", F.col("label").cast("int").alias("label"))


@query(
    "stratified_split",
    with_(OL_LABEL, RESOLVED)
    + f"""SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {uniform(42, "id")}, id) <= round(count(*) OVER (PARTITION BY label) * 0.25) AS is_test FROM rl""",
)
def _(spark, folder):
    return evaluate.stratified_split(resolved_labels(spark, folder)).select("id", "label", "is_test")


@query(
    "stratified_folds",
    with_(OL_LABEL, RESOLVED)
    + f"""SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY {uniform(42, "id")}, id) - 1) % 5)::INT AS fold FROM rl""",
)
def _(spark, folder):
    return evaluate.stratified_folds(resolved_labels(spark, folder), 5).select("id", "label", "fold")


# Both edges over the range that the parameter search tries: the first from one to seven days, the second one to thirty days later.
GRID = [(a * DAY, d * DAY) for a in (1, 2, 3, 5, 7) for d in (1, 7, 14, 30)]


def sweep_inputs(spark, folder, folds):
    log = adapters.events_log(spark, folder)
    table = settle(transitions.transitions(log))
    labeled = assemble.labeled_journeys(log, horizon_seconds=H12)
    labels = labeled.select("id", (F.col("journey_status") == "successful").cast("int").alias("label"))
    return table, settle(evaluate.stratified_folds(labels, folds))


@query(
    "edge_sweep",
    recursive(
        EV_LABEL,
        sql.transitions("ev"),
        f"""fl AS (SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY {uniform(42, "id")}, id) - 1) % 5) AS fold
  FROM (SELECT id, (journey_status = 'successful')::INT AS label FROM lb))""",
        "gr(trial, e1, e2) AS (VALUES " + ", ".join(f"({i}, {a}.0::DOUBLE, {a + d}.0::DOUBLE)" for i, (a, d) in enumerate(GRID)) + ")",
        "ag AS (SELECT *, sum(dt_us) OVER (PARTITION BY id ORDER BY seq) / 1e6 AS age FROM tr WHERE state <> next_state)",
        """cb AS (SELECT trial, h.held, (age >= e1)::INT + (age >= e2)::INT AS bin, state AS f, next_state AS t, count(*) AS n, sum(dt_us)::BIGINT AS us
  FROM ag JOIN fl USING (id), gr, range(5) h(held) WHERE fl.fold <> h.held GROUP BY ALL)""",
        "bg AS (SELECT trial, held, bin FROM cb GROUP BY ALL HAVING sum(n) >= 200)",
        """pt AS (SELECT trial || '|' || held || '|' || bin AS segment, f, t, n, us FROM cb JOIN bg USING (trial, held, bin)
  UNION ALL SELECT trial || '|' || held || '|' || b, f, t, sum(n)::BIGINT, sum(us)::BIGINT FROM cb, range(3) r(b)
  WHERE NOT EXISTS (SELECT 1 FROM bg WHERE bg.trial = cb.trial AND bg.held = cb.held AND bg.bin = r.b) GROUP BY ALL)""",
        sql.rates(),
        PRIOR,
        sql.horizon_hits("rt", "43200"),
        "js AS (SELECT id, arg_max(next_state, seq) AS st, sum(dt_us) / 1e6 AS age FROM tr GROUP BY id)",
        """vs AS (SELECT id, label, fold, trial, e1, e2, st, trial || '|' || fold || '|' || ((age >= e1)::INT + (age >= e2)::INT) AS segment FROM js JOIN fl USING (id), gr)""",
        """br AS (SELECT trial, e1, e2, fold, avg((least(1, greatest(0, coalesce(p, prior, 0))) - label) ** 2) AS b
  FROM vs LEFT JOIN hz ON hz.segment = vs.segment AND hz.state = vs.st LEFT JOIN pr ON pr.segment = vs.segment GROUP BY ALL)""",
    )
    + "SELECT trial, e1 AS edge1, e2 AS edge2, round(avg(b), 6) AS brier_score FROM br GROUP BY ALL",
)
def _(spark, folder):
    table, labels = sweep_inputs(spark, folder, 5)
    return r6(edge_sweep(table, labels, GRID, folds=5, horizon_seconds=H12))


@query("k_sweep")
def _(spark, folder):
    table, labels = sweep_inputs(spark, folder, 5)
    return k_sweep(table, labels, list(range(2, 13)), folds=5, horizon_seconds=H12)


def chain_inputs(spark, folder):
    log = adapters.events_log(spark, folder)
    labeled = assemble.labeled_journeys(log, horizon_seconds=H12)
    labels = labeled.select("id", (F.col("journey_status") == "successful").cast("int").alias("label"))
    return chain_scores(settle(transitions.transitions(log)), labels, horizon_seconds=H12)


@query(
    "advanced_comparison",
    recursive(
        EV_LABEL,
        sql.transitions("ev"),
        f"""sp AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {uniform(42, "id")}, id) <= round(count(*) OVER (PARTITION BY label) * 0.3) AS is_test
  FROM (SELECT id, (journey_status = 'successful')::INT AS label FROM lb))""",
        "tn AS (SELECT * FROM tr WHERE id IN (SELECT id FROM sp WHERE NOT is_test))",
        sql.totals("tn"),
        sql.rates(),
        PRIOR,
        sql.horizon_hits("rt", "43200"),
        "st AS (SELECT f AS s FROM pt UNION SELECT t FROM pt)",
        """ps AS (SELECT 'all' AS segment, a.s AS f, b.s AS t, coalesce(pt.n, 0) + 0.5::DOUBLE AS n,
    (coalesce(pt.n, 0) + 0.5) / greatest(coalesce((SELECT sum(us) FROM pt x WHERE x.f = a.s), 0) / 1e6, 1e-9) AS rate
  FROM st a JOIN st b ON a.s <> b.s LEFT JOIN pt ON pt.f = a.s AND pt.t = b.s)""",
        "pq AS (SELECT sum(n) FILTER (t = 28) / sum(n) AS prior FROM ps)",
        sql.horizon_hits("ps", "43200", name="hs"),
        "js AS (SELECT id, arg_max(next_state, seq) AS st FROM tr GROUP BY id)",
        """lg AS (SELECT 'plain' AS model, id, label, least(1, greatest(0, coalesce(hz.p, prior))) AS p FROM js JOIN sp USING (id) CROSS JOIN pr LEFT JOIN hz ON hz.state = js.st WHERE is_test
  UNION ALL SELECT 'smoothed', id, label, least(1, greatest(0, coalesce(hs.p, prior))) FROM js JOIN sp USING (id) CROSS JOIN pq LEFT JOIN hs ON hs.state = js.st WHERE is_test)""",
    )
    + f"SELECT a.*, b.* EXCLUDE (model) FROM ({RANKED.format(lg='lg')}) a JOIN ({POINT.format(lg='lg')}) b ON a.model = b.model",
)
def _(spark, folder):
    return r6(compare_chains(chain_inputs(spark, folder), calibrated=False))


@query("calibrated_comparison")
def _(spark, folder):
    return r6(compare_chains(chain_inputs(spark, folder)))


# Given centres of the number of transitions, evenly over 45 to 85.
CENTRES = {k: [45 + 40 * i / (k - 1) for i in range(k)] for k in range(2, 13)}


@query(
    "k_sweep_given",
    recursive(
        EV_LABEL,
        sql.transitions("ev"),
        f"""fl AS (SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY {uniform(42, "id")}, id) - 1) % 5) AS fold
  FROM (SELECT id, (journey_status = 'successful')::INT AS label FROM lb))""",
        "js AS (SELECT id, arg_max(next_state, seq) AS st, count(*) AS m FROM tr GROUP BY id)",
        "ce(k, c, x) AS (VALUES " + ", ".join(f"({k}, {c}, {x!r}::DOUBLE)" for k, xs in CENTRES.items() for c, x in enumerate(xs)) + ")",
        "sg AS (SELECT id, st, label, fold, k, c FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY round(abs(m - x), 9), c) AS r FROM js JOIN fl USING (id), ce) WHERE r = 1)",
        """pt AS (SELECT k || '|' || held || '|' || c AS segment, state AS f, next_state AS t, count(*) AS n, sum(dt_us)::BIGINT AS us
  FROM tr JOIN sg USING (id), range(5) h(held) WHERE fold <> held AND state <> next_state GROUP BY ALL
  UNION ALL SELECT 'all|' || held, state, next_state, count(*), sum(dt_us)::BIGINT FROM tr JOIN fl USING (id), range(5) h(held)
  WHERE fold <> held AND state <> next_state GROUP BY ALL)""",
        sql.rates(),
        PRIOR,
        sql.horizon_hits("rt", "43200"),
        """br AS (SELECT k, fold, avg((least(1, greatest(0, coalesce(a.p, b.prior, c.p, d.prior, 0))) - label) ** 2) AS b FROM sg
  LEFT JOIN hz a ON a.segment = k || '|' || fold || '|' || sg.c AND a.state = st LEFT JOIN pr b ON b.segment = k || '|' || fold || '|' || sg.c
  LEFT JOIN hz c ON c.segment = 'all|' || fold AND c.state = st LEFT JOIN pr d ON d.segment = 'all|' || fold GROUP BY ALL)""",
    )
    + "SELECT k, round(avg(b), 6) AS brier_score FROM br GROUP BY k",
)
def _(spark, folder):
    table, labels = sweep_inputs(spark, folder, 5)
    found = table.groupBy("id").agg(F.max_by("next_state", "seq").alias("current_state"), F.count(F.lit(1)).alias("m")).join(labels, "id")

    def nearest(k):
        return F.array_min(F.array(*[F.struct(F.round(F.abs(F.col("m") - x), 9).alias("d"), F.lit(c).alias("c")) for c, x in enumerate(CENTRES[k])]))["c"]

    assigned = found.select("id", "current_state", "label", "fold", F.flatten(F.array(*[F.array_repeat(nearest(k), 5) for k in CENTRES])).alias("segments"))
    return r6(segment_sweep(table, settle(assigned), list(CENTRES), folds=5, horizon_seconds=H12))


@query(
    "rule_comparison",
    recursive(
        EV_LABEL,
        numbered("ev"),
        f"""sn AS (SELECT nb.id, nb.ed_id AS current_state, (journey_status = 'successful')::INT AS label FROM nb JOIN lb USING (id)
  WHERE pos = {RAND} AND journey_status IN ('successful', 'incomplete'))""",
        f"sp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {uniform(42, 'id')}, id) <= round(count(*) OVER (PARTITION BY label) * 0.25) AS is_test FROM sn)",
        """tr AS (SELECT * FROM (SELECT id, row_number() OVER w AS seq, ed_id AS state, lead(ed_id) OVER w AS next_state, lead(ts_us) OVER w - ts_us AS dt_us
  FROM ev WHERE id IN (SELECT id FROM sp WHERE NOT is_test) WINDOW w AS (PARTITION BY id ORDER BY ts_us, ed_id)) WHERE next_state IS NOT NULL)""",
        sql.totals("tr"),
        sql.rates(),
        PRIOR,
        sql.horizon_hits("rt", "86400"),
        HIT,
        """lg AS (SELECT 'global_probability' AS model, id, label, coalesce(p, prior) AS p, coalesce(p, prior) >= 0.5 AS z
  FROM sp CROSS JOIN pr LEFT JOIN hz ON hz.state = sp.current_state WHERE is_test
  UNION ALL SELECT 'global_waiting_time', id, label, exp(-days), days <= 1 FROM sp LEFT JOIN ht ON ht.state = sp.current_state WHERE is_test)""",
    )
    + f"SELECT a.model AS method, a.* EXCLUDE (model), b.* EXCLUDE (model), c.* EXCLUDE (model) FROM ({RANKED.format(lg='lg')}) a JOIN ({POINT.format(lg='lg')}) b ON a.model = b.model JOIN ({CONFUSION.format(rows='lg')}) c ON a.model = c.model",
)
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    taken = position_snapshots_for_rules(log, [], H12)
    return r6(rule_comparison(log, taken, horizon_seconds=DAY))


@query("rule_comparison_clustered")
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    taken = position_snapshots_for_rules(log, [2, 4, 12, 23, 28], H12)
    return rule_comparison(log, taken, clusters=2, horizon_seconds=DAY)


METRICS = ["roc_auc", "average_precision", "brier_score", "log_loss"]


@query(
    "metric_ranking",
    BASE
    + f"""SELECT model, metric, round(value, 6) AS value, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric IN ('roc_auc', 'average_precision') THEN -value ELSE value END, model)::INT AS rank
FROM (SELECT a.model, unnest(['roc_auc', 'average_precision', 'brier_score', 'log_loss']) AS metric, unnest([roc_auc, average_precision, brier_score, log_loss]) AS value
  FROM ({RANKED.format(lg='lg')}) a JOIN ({POINT.format(lg='lg')}) b ON a.model = b.model)""",
)
def _(spark, folder):
    table = evaluate.all_metrics(settle(scored_long(spark, folder)))
    return r6(evaluate.metric_ranking(r6(table), METRICS))


@query(
    "submission",
    BASE.rstrip() + ",\n" + TEMPLATE + "\nSELECT ordinal, tp.id, round(coalesce(blend, 0), 6) AS order_shipped FROM tp LEFT JOIN sc USING (id)",
)
def _(spark, folder):
    return r6(output.align_submission(template(spark, folder), scored(spark, folder), p="blend"))


@query("score_matrix", BASE + "SELECT id, " + ", ".join(f"round({m}, 6) AS {m}" for m in MODELS) + " FROM sc")
def _(spark, folder):
    return r6(output.score_matrix(scored_long(spark, folder), MODELS))


@query(
    "class_weights",
    with_(OL_LABEL, RESOLVED)
    + "SELECT label, count(*) AS n, round((SELECT count(*) FROM rl) / (2 * count(*)), 6) AS weight, round(((SELECT count(*) FROM rl) - count(*)) / count(*), 6) AS other_ratio FROM rl GROUP BY label",
)
def _(spark, folder):
    return r6(learn.class_weights(resolved_labels(spark, folder)))


LEARN_ACTIONS = [28, 11, 6, 4, 5, 2]


def learning_frame(spark, folder):
    """Snapshot features, label and a train/test split."""
    log = adapters.orders_log(spark, folder)
    taken = snapshots.position_snapshots(log, snapshots.random_cut(F.col("n")), actions=LEARN_ACTIONS)
    taken = settle(evaluate.stratified_split(taken.drop("final_outcome", "snapshot_us", "remaining_seconds"), 0.2))
    skipped = ("id", "label", "is_test", "full_num_actions", "snapshot_frac_of_journey")
    return taken, [c for c in taken.columns if c not in skipped]


def learner_scores(spark, folder, make):
    rows, columns = learning_frame(spark, folder)
    model = make(columns).fit(learn.with_weights(rows.where("NOT is_test")))
    return model, rows, columns, learn.probability(model, rows.where("is_test")).select("id", "label", "p")


@query("rf_scores")
def _(spark, folder):
    return learner_scores(spark, folder, learn.random_forest)[3]


@query("gbt_scores")
def _(spark, folder):
    return learner_scores(spark, folder, learn.boosting)[3]


@query("boosting_rounds")
def _(spark, folder):
    rows, columns = learning_frame(spark, folder)
    folded = evaluate.stratified_folds(rows.where("NOT is_test"), 5)
    return learn.rounds_by_fold(folded, columns, folds=5, leaf=5, rows=0.8, features="0.8")


@query("logreg_scores")
def _(spark, folder):
    return learner_scores(spark, folder, learn.logistic)[3]


@query("holdout_accuracy")
def _(spark, folder):
    return learn.holdout_accuracy(learner_scores(spark, folder, learn.random_forest)[3])


@query("importances")
def _(spark, folder):
    model, rows, columns, _scores = learner_scores(spark, folder, learn.random_forest)
    return learn.importances(model, columns, rows)


@query("model_comparison")
def _(spark, folder):
    rows, columns = learning_frame(spark, folder)
    return learn.compare_models(
        rows,
        columns,
        {
            "logistic": learn.logistic(columns),
            "random_forest": learn.random_forest(columns),
            "boosting": learn.boosting(columns),
        },
    )


@query("tuning_trials")
def _(spark, folder):
    rows, columns = learning_frame(spark, folder)
    folded = evaluate.stratified_folds(rows.drop("is_test"), 2)
    trials = learn.tune(folded, columns, "random_forest", {"trees": [10, 20], "depth": [4]}, folds=2)
    best = evaluate.best_trial(trials.withColumn("study", F.lit("random_forest")), "study", score="log_loss", params=["trial"])
    return trials.join(best.select("trial", F.lit(True).alias("is_best")), "trial", "left").na.fill(False, ["is_best"])


@query("isotonic")
def _(spark, folder):
    rows = evaluate.stratified_split(scored(spark, folder).select("id", "label", F.col("blend").alias("p")), 0.3)
    rows = settle(rows)
    return learn.isotonic(rows.where("NOT is_test"), rows.where("is_test")).select("id", "label", "p", "calibrated")


# Pooled means in min-max form: the value at a score is the largest, over all starts at or below it, of the smallest mean from
# there to any end at or above it.  Between two fitted scores the value is interpolated.
ISOTONIC = (
    BASE.rstrip()
    + f""",
sp AS (SELECT id, label, round(blend, 9) AS p, row_number() OVER (PARTITION BY label ORDER BY {uniform(42, "id")}, id) <= round(count(*) OVER (PARTITION BY label) * 0.3) AS is_test FROM sc),
po AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(y) OVER (ORDER BY p) AS y, sum(w) OVER (ORDER BY p) AS w, y AS y1, w AS w1
  FROM (SELECT p, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS w FROM sp WHERE NOT is_test GROUP BY p)),
mm AS (SELECT b.i, min((b.y - a.y + a.y1) / (b.w - a.w + a.w1)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m FROM po a JOIN po b ON a.i <= b.i),
ft AS (SELECT po.p, f FROM (SELECT i, max(m) AS f FROM mm GROUP BY i) JOIN po USING (i)),
bt AS (SELECT t.id, t.label, t.p, lo.p AS p0, lo.f AS f0 FROM sp t ASOF LEFT JOIN ft lo ON t.p >= lo.p WHERE t.is_test),
bu AS (SELECT bt.*, hi.p AS p1, hi.f AS f1 FROM bt ASOF LEFT JOIN ft hi ON bt.p <= hi.p)
SELECT id, label, round(p, 6) AS p, round(CASE WHEN p0 IS NULL THEN f1 WHEN p1 IS NULL OR p1 = p0 THEN f0 ELSE f0 + (f1 - f0) * (p - p0) / (p1 - p0) END, 6) AS calibrated FROM bu"""
)


@query("isotonic_blend", ISOTONIC)
def _(spark, folder):
    # Scores to nine places: equal ones are pooled.
    rows = scored(spark, folder).select("id", "label", F.round("blend", 9).alias("p"))
    rows = settle(evaluate.stratified_split(rows, 0.3))
    return r6(learn.isotonic(rows.where("NOT is_test"), rows.where("is_test")).select("id", "label", "p", "calibrated"))


@query(
    "holdout_accuracy_blend",
    BASE.rstrip()
    + f""",
sp AS (SELECT label, blend AS p, row_number() OVER (PARTITION BY label ORDER BY {uniform(42, "id")}, id) <= round(count(*) OVER (PARTITION BY label) * 0.25) AS is_test FROM sc)
SELECT round(avg(((p >= 0.5)::INT = label)::INT), 6) AS accuracy, count(*) AS n FROM sp WHERE is_test""",
)
def _(spark, folder):
    rows = evaluate.stratified_split(scored(spark, folder).select("id", "label", F.col("blend").alias("p")))
    return r6(learn.holdout_accuracy(rows.where("is_test")))


@query("suite")
def _(spark, folder):
    log = adapters.events_log(spark, folder)
    return score_suite(
        log,
        horizon_seconds=H12,
        timeout_seconds=DAY,
        label_horizon_seconds=H12,
        edges=(DAY, 7 * DAY, 14 * DAY),
        success_event="purchase",
    )
