"""Cases, alerts and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..operators import alerts as K
from ..operators import cases as C
from ..operators import detectors as D
from ..operators import folds
from ..operators import governance as G
from ..operators.windows import US
from .adapters import sec_events, sql_text, table
from .catalog import over_events, query
from .detection import BEHAVIOUR_SQL, BRUTE_SQL, FINDINGS_SQL, HITS_SQL, OWASP_SQL, brute, every_hit, hits
from .web import owasp_found

# ------------------------------------------------------------------- cases

AS_OF_US = 896_702_400 * US  # 1998-06-01 12:00:00 UTC
SEVERITY = {"1-URGENT": "Critical", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}


def case_requests(spark, sf_dir):
    """Orders as cases; an unspecified priority is an invalid severity."""
    severity = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("o_orderpriority")], F.lit("None"))
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "triage").otherwise("open")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.concat(F.lit(" Order "), "o_orderkey").alias("title"), severity.alias("severity"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_us"), state.alias("wanted"),
    )


CASES_SQL = """
WITH req AS (SELECT o_orderkey AS case_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
    WHEN '5-LOW' THEN 'Low' ELSE 'None' END AS severity, epoch_us(o_orderdate) AS created_us,
    CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'triage' ELSE 'open' END AS status FROM orders)
, cases AS (SELECT *, 'Order ' || case_id AS title,
    created_us + CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 24 WHEN 'Medium' THEN 72 ELSE 168 END * 3600000000 AS sla_due_us
  FROM req WHERE severity <> 'None')"""


def opened_cases(spark, sf_dir):
    good, _ = C.create_cases(case_requests(spark, sf_dir))
    return good.withColumn("status", F.col("wanted")).drop("wanted")


@query(CASES_SQL + " SELECT case_id, title, severity, created_us, sla_due_us FROM cases")
def case_sla_due(spark, sf_dir):
    return opened_cases(spark, sf_dir).drop("status")


@query(CASES_SQL + " SELECT case_id, 'invalid severity' AS reason FROM req WHERE severity = 'None'")
def case_rejects(spark, sf_dir):
    return C.create_cases(case_requests(spark, sf_dir))[1].select("case_id", "reason")


@query(CASES_SQL + " SELECT case_id, title, severity FROM cases WHERE status = 'triage' AND severity = 'High'")
def case_list(spark, sf_dir):
    return C.case_list(opened_cases(spark, sf_dir), "triage", "High").select("case_id", "title", "severity")


@query(CASES_SQL + f"""
, x AS (SELECT *, sla_due_us - {AS_OF_US} AS l, abs(sla_due_us - {AS_OF_US}) // {US} AS s FROM cases)
SELECT case_id, status, CASE WHEN status = 'closed' THEN 'closed' WHEN l <= 0 THEN 'breached'
  WHEN l / (sla_due_us - created_us) < 0.25 THEN 'warning' ELSE 'ok' END AS sla_state,
  CASE WHEN l < 0 THEN '-' ELSE '' END || (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' AS sla_remaining FROM x""")
def case_sla_status(spark, sf_dir):
    return C.sla_status(opened_cases(spark, sf_dir), AS_OF_US).select("case_id", "status", "sla_state", "sla_remaining")


def case_steps(spark, sf_dir):
    """Line items as requested status changes of their order."""
    states = F.array(*[F.lit(s) for s in R.CASE_STATES])
    target = F.when(F.col("l_partkey") % 5 == 0, "triage").otherwise(
        F.element_at(states, (F.col("l_linenumber") % 6 + 1).cast("int"))
    )
    base = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), (F.col("l_linenumber").cast("bigint") * 3600 * US).alias("ts_us"),
        (F.col("l_partkey") * 10_000_000 + F.expr("cast(round(l_extendedprice * 100) as bigint)")).alias("event_id"),
        target.alias("to_status"), base.alias("ship_us"),
    )


STEPS_SQL = f"""
raw_steps AS (SELECT l_orderkey AS case_id, l_linenumber * 3600 * {US}::BIGINT AS ts_us, l_partkey * 10000000 + round(l_extendedprice * 100)::BIGINT AS event_id,
  CASE WHEN l_partkey % 5 = 0 THEN 'triage' ELSE (['open', 'triage', 'contained', 'eradicated', 'recovered', 'closed'])[(l_linenumber % 6 + 1)::INT] END AS to_status
  FROM lineitem)
, steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts_us, event_id) AS step FROM raw_steps)
, replay AS (
  SELECT case_id, 0::BIGINT AS step, 'open' AS from_status, ''::VARCHAR AS to_status, 'open' AS status, false AS legal, 0::BIGINT AS ts_us, 0::BIGINT AS event_id
  FROM (SELECT DISTINCT case_id FROM steps)
  UNION ALL
  SELECT s.case_id, s.step, r.status, s.to_status,
    CASE WHEN (r.status, s.to_status) IN (('open', 'triage'), ('triage', 'contained'), ('contained', 'eradicated'), ('eradicated', 'recovered'),
      ('recovered', 'closed'), ('closed', 'triage')) THEN s.to_status ELSE r.status END,
    (r.status, s.to_status) IN (('open', 'triage'), ('triage', 'contained'), ('contained', 'eradicated'), ('eradicated', 'recovered'),
      ('recovered', 'closed'), ('closed', 'triage')), s.ts_us, s.event_id
  FROM replay r JOIN steps s ON s.case_id = r.case_id AND s.step = r.step + 1)"""


@query("WITH RECURSIVE " + STEPS_SQL + """
SELECT case_id, step, from_status, to_status, legal, status FROM replay WHERE step > 0""")
def case_transitions(spark, sf_dir):
    return folds.case_transitions(case_steps(spark, sf_dir)).select(
        "case_id", "step", "from_status", "to_status", "legal", "status"
    )


@query("WITH RECURSIVE " + STEPS_SQL + """
, aud AS (SELECT *, coalesce(lag(to_status) OVER (PARTITION BY case_id ORDER BY step), 'open') AS before FROM steps)
SELECT case_id, step, to_status, (before, to_status) IN (('open', 'triage'), ('triage', 'contained'), ('contained', 'eradicated'),
  ('eradicated', 'recovered'), ('recovered', 'closed'), ('closed', 'triage')) AS legal FROM aud""")
def case_transition_audit(spark, sf_dir):
    return folds.transition_audit(case_steps(spark, sf_dir)).select("case_id", "step", "to_status", "legal")


@query(CASES_SQL.replace("WITH", "WITH RECURSIVE", 1) + ", " + STEPS_SQL + """
, last AS (SELECT case_id, arg_max(status, step) AS st, max(ts_us) AS moved FROM replay WHERE legal GROUP BY 1)
, touched AS (SELECT conv_id AS case_id, max(turn) AS t FROM conversations GROUP BY 1)
SELECT case_id, coalesce(st, 'open') AS status, greatest(created_us, moved, CASE WHEN t IS NOT NULL THEN created_us + t * 60000000 END) AS updated_us,
  CASE coalesce(st, 'open') WHEN 'open' THEN 'triage' WHEN 'triage' THEN 'contained' WHEN 'contained' THEN 'eradicated' WHEN 'eradicated' THEN 'recovered'
    WHEN 'recovered' THEN 'closed' WHEN 'closed' THEN 'triage' END AS next_states
FROM cases LEFT JOIN last USING (case_id) LEFT JOIN touched USING (case_id)""")
def case_current(spark, sf_dir):
    good, _ = C.create_cases(case_requests(spark, sf_dir))
    notes = case_notes(spark, sf_dir).select("case_id", F.col("note_us").alias("ts_us"))
    current = C.case_current(good, case_steps(spark, sf_dir), notes)
    return current.select("case_id", "status", "updated_us", F.array_join("next_states", ",").alias("next_states"))


def case_notes(spark, sf_dir):
    """Conversation turns as notes of the case with the same number."""
    turns = table(spark, sf_dir, "conversations")
    created = case_requests(spark, sf_dir).select("case_id", "created_us")
    return turns.join(created, F.col("conv_id") == F.col("case_id")).select(
        "case_id", (F.col("created_us") + F.col("turn") * 60 * US).alias("note_us"), F.col("role").alias("author"), F.col("text").alias("note")
    )


@query(CASES_SQL + """
SELECT case_id, created_us AS ts_us, 'created' AS kind, 'Case #' || case_id || ' opened: ' || title AS summary, NULL::VARCHAR AS author FROM cases
UNION ALL SELECT conv_id, created_us + turn * 60000000, CASE WHEN role = 'system' THEN 'status_change' ELSE 'note' END, text, role
FROM conversations JOIN req ON conv_id = case_id""")
def case_timeline(spark, sf_dir):
    return C.case_timeline(opened_cases(spark, sf_dir), case_notes(spark, sf_dir))


# ------------------------------------------------------------------ alerts

ALERT_WINDOW = 6 * 3600


def alerts(spark, sf_dir):
    """Every pattern hit raises an alert; host-4 has nobody to notify."""
    found = hits(spark, sf_dir)
    targets = F.create_map(
        F.lit("email"), F.array(F.lit("soc@example.com"), F.lit("lead@example.com")), F.lit("webhook"), F.array(F.lit("https://hook.example.com"))
    )
    nobody = F.create_map(F.lit("email"), F.array().cast("array<string>"))
    return found.select(
        "event_id", "ts_us", "severity", F.concat("name", F.lit(" on "), "host").alias("title"),
        F.when(F.col("host") == "host-4", nobody).otherwise(targets).alias("destinations"),
    )


ALERTS_SQL = HITS_SQL + f"""
, alerts AS (SELECT event_id, ts_us, severity, name || ' on ' || host AS title, host <> 'host-4' AS reached, ts_us // {US} AS s,
    sha256(severity || chr(0) || name || ' on ' || host) AS dedup_key FROM hits)
, per_second AS (SELECT dedup_key, s, min((ts_us, event_id)) AS f, row_number() OVER (PARTITION BY dedup_key ORDER BY s) AS n
  FROM alerts WHERE reached GROUP BY 1, 2)
, fold AS (SELECT dedup_key, n, s, s AS last_sent, true AS sent, f FROM per_second WHERE n = 1
  UNION ALL SELECT p.dedup_key, p.n, p.s, CASE WHEN p.s - d.last_sent <= {ALERT_WINDOW} THEN d.last_sent ELSE p.s END, p.s - d.last_sent > {ALERT_WINDOW}, p.f
  FROM fold d JOIN per_second p ON p.dedup_key = d.dedup_key AND p.n = d.n + 1)
, dispatched AS (SELECT a.*, CASE WHEN NOT reached THEN 'unrouted' WHEN d.sent THEN 'sent' ELSE 'deduped' END AS status
  FROM alerts a LEFT JOIN fold d ON d.sent AND d.dedup_key = a.dedup_key AND d.f = (a.ts_us, a.event_id))
, routed AS (SELECT event_id, title, channel, destination, dedup_key, d.status FROM dispatched d JOIN (VALUES
    ('Critical', 'email', 'soc@example.com'), ('Critical', 'email', 'lead@example.com'), ('Critical', 'webhook', 'https://hook.example.com'),
    ('High', 'email', 'soc@example.com'), ('High', 'email', 'lead@example.com'), ('High', 'webhook', 'https://hook.example.com'),
    ('Medium', 'webhook', 'https://hook.example.com')) AS r(sev, channel, destination) ON sev = severity WHERE reached)"""


def over_alerts(body: str) -> str:
    return over_events(ALERTS_SQL + body).replace("WITH sec", "WITH RECURSIVE sec", 1)


@query(over_alerts(" SELECT event_id, title, channel, destination, dedup_key FROM routed"))
def alert_routes(spark, sf_dir):
    return K.deliveries(alerts(spark, sf_dir)).select("event_id", "title", "channel", "destination", "dedup_key")


def dispatched(spark, sf_dir):
    return K.dispatch(alerts(spark, sf_dir), window_s=ALERT_WINDOW)


@query(over_alerts(" SELECT event_id, title, status FROM dispatched"))
def alert_dedup(spark, sf_dir):
    return dispatched(spark, sf_dir).select("event_id", "title", "status")


@query(over_alerts("""
SELECT status, channel, count(*) AS n FROM (SELECT status, channel FROM routed WHERE status = 'sent'
  UNION ALL SELECT status, 'dedup' FROM dispatched WHERE status = 'deduped') GROUP BY 1, 2"""))
def alert_log(spark, sf_dir):
    return K.log_counts(K.delivery_log(dispatched(spark, sf_dir)))


@query(over_alerts("""
SELECT event_id, title, channel, destination, status FROM (
  SELECT event_id, title, channel, destination, status FROM routed WHERE status = 'sent'
  UNION ALL SELECT event_id, title, 'dedup', '-', status FROM dispatched WHERE status = 'deduped') JOIN (SELECT event_id, ts_us FROM sec) USING (event_id)
ORDER BY ts_us DESC, event_id DESC, title, channel, destination LIMIT 20"""))
def latest_deliveries(spark, sf_dir):
    found = K.latest_log(K.delivery_log(dispatched(spark, sf_dir)), 20)
    return found.select("event_id", "title", "channel", "destination", "status")


# -------------------------------------------------------------- governance


def orgs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("org"), "n_nationkey")


def with_org(rows, spark, sf_dir):
    """Users, and hosts where no user is known, belong to the nation with their number modulo 25."""
    named = F.when(F.col("user") == "-", F.col("host")).otherwise(F.col("user"))
    key = (F.regexp_extract(named, r"(\d+)$", 1).cast("bigint") % 25).cast("int")
    return rows.withColumn("n_nationkey", key).join(orgs(spark, sf_dir), "n_nationkey").drop("n_nationkey")


def org_assets(spark, sf_dir):
    """Suppliers as assets of their nation."""
    klass = F.when(F.col("s_suppkey") % 3 == 0, R.CLASS_CII).otherwise(R.CLASS_STANDARD)
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("hostname"), klass.alias("classification"),
        (F.col("s_suppkey") % 60 + 40).cast("int").alias("risk_score"),
    )
    return rows.join(orgs(spark, sf_dir), "n_nationkey").drop("n_nationkey")


def promotions(spark, sf_dir):
    return G.control_promotions(
        with_org(brute(spark, sf_dir), spark, sf_dir),
        with_org(owasp_found(spark, sf_dir), spark, sf_dir),
        with_org(D.ueba_findings(sec_events(spark, sf_dir, "AUTH_OK")), spark, sf_dir),
        with_org(every_hit(spark, sf_dir), spark, sf_dir),
    )


NATION_SQL = "((CASE WHEN \"user\" = '-' THEN substr(host, 6) ELSE substr(\"user\", 5) END)::BIGINT % 25)::INT"
PROMOTIONS_SQL = BEHAVIOUR_SQL + BRUTE_SQL + FINDINGS_SQL + f"""
, owasp_rows AS (SELECT *, {OWASP_SQL.replace('{0}', 'msg')} AS labels FROM sec WHERE event IN ('HTTP_REQ', 'APP_INPUT', 'RAW'))
, promo_raw AS (
  SELECT "user", host, event_id, ts_us, unnest(CASE WHEN asset_class = {sql_text(R.CLASS_CII)} THEN ['PISF-05.2', 'PISF-05.1', 'PISF-13.2']
    ELSE ['PISF-05.2', 'PISF-05.1'] END) AS control_id, 'brute force' AS source FROM brute
  UNION ALL SELECT "user", host, event_id, ts_us, unnest(CASE WHEN contains(labels, 'BAC') THEN ['PISF-04.2', 'PISF-10.1', 'PISF-05.1'] ELSE ['PISF-04.2', 'PISF-10.1'] END),
    'request scan' FROM owasp_rows WHERE labels <> ''
  UNION ALL SELECT "user", host, event_id, ts_us, 'PISF-05.3', 'user behaviour' FROM unique_findings
  UNION ALL SELECT "user", host, event_id, ts_us, control_id, 'pattern' FROM known)
, promo AS (SELECT n_name AS org, event_id, ts_us, control_id, source, 'Under Attack' AS status, source || ' event ' || event_id AS evidence
  FROM promo_raw JOIN nation ON n_nationkey = {NATION_SQL})"""
CONTROL_ROWS_SQL = "(VALUES " + ", ".join(
    f"('{c}', '{c.split('.')[0]}', {sql_text(R.DOMAINS[c.split('.')[0]])}, '{s}', {w})" for c, w, s, _ in R.CONTROLS
) + ") AS ctl(control_id, domain_id, domain_name, seed_status, risk_weight)"


@query(over_events(PROMOTIONS_SQL + " SELECT * FROM promo"))
def control_promotions(spark, sf_dir):
    return promotions(spark, sf_dir)


@query(over_events(PROMOTIONS_SQL + f"""
, lines AS (SELECT org, control_id, ts_us, strftime(make_timestamp(ts_us), '[%Y-%m-%d %H:%M:%S UTC] ') || evidence AS line, event_id, evidence FROM promo)
, folded AS (SELECT org, control_id, right(string_agg(line, chr(10) ORDER BY ts_us, event_id, evidence DESC), 4000) AS evidence, max(ts_us) AS last_assessment_us
  FROM lines GROUP BY 1, 2)
SELECT n_name AS org, c.control_id, CASE WHEN f.org IS NULL THEN seed_status ELSE 'Under Attack' END AS status, f.last_assessment_us, f.evidence
FROM nation CROSS JOIN {CONTROL_ROWS_SQL.replace(' AS ctl', ' AS c')} LEFT JOIN folded f ON f.org = n_name AND f.control_id = c.control_id"""))
def control_status(spark, sf_dir):
    found = G.control_status(promotions(spark, sf_dir), orgs(spark, sf_dir))
    return found.select("org", "control_id", "status", "last_assessment_us", "evidence")


# Promotions touch every organisation; the flags below keep a mix of states.
def statuses(spark, sf_dir):
    """Status after the promotions of odd-numbered minutes, later closed by even-numbered ones."""
    events = promotions(spark, sf_dir)
    even = F.expr(f"ts_us div {60 * US} % 2 = 0")
    mixed = events.withColumn("status", F.when(even, R.STATUS_COMPLIANT).otherwise(F.col("status")))
    return G.latest_status(mixed, orgs(spark, sf_dir))


STATUS_SQL = PROMOTIONS_SQL + f"""
, latest AS (SELECT org, control_id, arg_max(CASE WHEN ts_us // {60 * US} % 2 = 0 THEN 'Compliant' ELSE status END, (ts_us, event_id)) AS st FROM promo GROUP BY 1, 2)
, st AS (SELECT n_name AS org, ctl.control_id, domain_id, domain_name, risk_weight, coalesce(l.st, seed_status) AS status
  FROM nation CROSS JOIN {CONTROL_ROWS_SQL} LEFT JOIN latest l ON l.org = n_name AND l.control_id = ctl.control_id)
, assets AS (SELECT n_name AS org, s_name AS hostname, CASE WHEN s_suppkey % 3 = 0 THEN {sql_text(R.CLASS_CII)} ELSE 'Standard' END AS classification,
    (s_suppkey % 60 + 40)::INT AS risk_score FROM supplier JOIN nation ON n_nationkey = s_nationkey)
, counts AS (SELECT org, count(*) AS total, count(*) FILTER (status = 'Compliant') AS compliant, count(*) FILTER (status = 'Non-Compliant') AS non_compliant,
    count(*) FILTER (status = 'Under Attack') AS under_attack, sum(CASE WHEN status = 'Compliant' THEN risk_weight ELSE 0 END) AS earned, sum(risk_weight) AS weight
  FROM st GROUP BY 1)"""


@query(over_events(STATUS_SQL + """
SELECT org, domain_id, domain_name, count(*) AS control_count, count(*) FILTER (status = 'Compliant') AS compliant,
  count(*) FILTER (status = 'Non-Compliant') AS non_compliant, count(*) FILTER (status = 'Under Attack') AS under_attack, sum(risk_weight)::BIGINT AS weight_sum
FROM st GROUP BY 1, 2, 3"""))
def domain_rollup(spark, sf_dir):
    return G.domain_rollup(statuses(spark, sf_dir))


def incidents(spark, sf_dir):
    return with_org(D.dedup_hits(hits(spark, sf_dir)), spark, sf_dir).select("org", "event_id")


@query(over_events(STATUS_SQL + f"""
, a AS (SELECT org, count(*) FILTER (classification <> 'Standard') AS cii_assets, count(*) AS asset_count FROM assets GROUP BY 1)
, i AS (SELECT n_name AS org, count(*) AS ledger_rows FROM dedup JOIN nation ON n_nationkey = {NATION_SQL} GROUP BY 1)
, s AS (SELECT *, greatest(0.0::DOUBLE, round(100.0::DOUBLE * earned / weight - 8.0 * under_attack, 1)) AS score FROM counts)
SELECT org, score, CASE WHEN score < 45 OR under_attack > 0 THEN 'bad' WHEN score < 75 THEN 'warn' ELSE 'good' END AS tone, compliant, non_compliant, under_attack,
  total, coalesce(cii_assets, 0) AS cii_assets, coalesce(asset_count, 0) AS asset_count, coalesce(ledger_rows, 0) AS ledger_rows
FROM s LEFT JOIN a USING (org) LEFT JOIN i USING (org)"""))
def readiness(spark, sf_dir):
    return G.readiness(statuses(spark, sf_dir), org_assets(spark, sf_dir), incidents(spark, sf_dir))


@query(over_events(STATUS_SQL + """
, b AS (SELECT org, coalesce(avg(risk_score) FILTER (classification <> 'Standard'), 0) AS base, count(*) FILTER (classification <> 'Standard') AS cii_count
  FROM assets GROUP BY 1)
, s AS (SELECT org, round(least(100.0::DOUBLE, coalesce(base, 0) * (1.0::DOUBLE + 0.08::DOUBLE * under_attack + 0.03::DOUBLE * non_compliant)), 1) AS score,
    coalesce(cii_count, 0) AS cii_count, under_attack, non_compliant, round(coalesce(base, 0), 1) AS base FROM counts LEFT JOIN b USING (org))
SELECT *, CASE WHEN under_attack > 0 THEN 'SEVERE' WHEN score >= 88 OR non_compliant >= 4 THEN 'ELEVATED' ELSE 'LOW' END AS band FROM s"""))
def institutional_risk(spark, sf_dir):
    return G.institutional_risk(statuses(spark, sf_dir), org_assets(spark, sf_dir))


@query(over_events(STATUS_SQL + """
SELECT org, hostname, classification, risk_score, CASE WHEN classification = 'Standard' THEN 'STANDARD' WHEN under_attack > 0 THEN 'CII-ESCALATED'
  ELSE 'CII-PRIORITY' END AS tag FROM assets JOIN counts USING (org)"""))
def asset_grid(spark, sf_dir):
    return G.asset_grid(statuses(spark, sf_dir), org_assets(spark, sf_dir))


@query(over_events(STATUS_SQL + " SELECT * FROM assets"))
def asset_register(spark, sf_dir):
    return G.asset_register(org_assets(spark, sf_dir))


FRAMEWORK_SQL = "(VALUES " + ", ".join(
    f"('{c}', '{k}', {i}, {sql_text(ref)})" for c, k, i, ref in R.control_frameworks()
) + ") AS fw(control_id, framework_key, position, ref)"


@query(over_events(STATUS_SQL + f"""
SELECT *, round(100.0::DOUBLE * compliant / total_mapped, 1) AS coverage_pct FROM (
  SELECT org, framework_key, count(*) AS total_mapped, count(*) FILTER (status = 'Compliant') AS compliant, count(*) FILTER (status = 'Non-Compliant') AS non_compliant,
    count(*) FILTER (status = 'Under Attack') AS under_attack
  FROM st JOIN (SELECT DISTINCT control_id, framework_key FROM {FRAMEWORK_SQL}) USING (control_id) GROUP BY 1, 2)"""))
def framework_coverage(spark, sf_dir):
    return G.framework_coverage(statuses(spark, sf_dir))


@query(over_events(STATUS_SQL + ", cells AS (SELECT control_id, framework_key, string_agg(ref, ', ' ORDER BY position) AS refs FROM " + FRAMEWORK_SQL + """ GROUP BY 1, 2)
SELECT org, control_id, status, """ + ", ".join(f"max(refs) FILTER (framework_key = '{k}') AS {k}" for k in R.FRAMEWORKS) + """
FROM st JOIN cells USING (control_id) GROUP BY 1, 2, 3"""))
def framework_matrix(spark, sf_dir):
    return G.framework_matrix(statuses(spark, sf_dir))


NOTES_SQL = "(VALUES " + ", ".join(f"('{k}', {sql_text(v)})" for k, v in R.SECTION_NOTES.items()) + ") AS nt(ref, note)"


@query(over_events(STATUS_SQL + f"""
SELECT org, control_id, status, ref, note FROM st JOIN {FRAMEWORK_SQL} USING (control_id) LEFT JOIN {NOTES_SQL} USING (ref) WHERE framework_key = 'peca_2016'"""))
def framework_notes(spark, sf_dir):
    return G.framework_notes(statuses(spark, sf_dir))


@query(over_events(STATUS_SQL + f"""
SELECT org, control_id, {1_706_400_000 * US} AS ts_us, 'Compliant' AS status FROM st WHERE status = 'Under Attack'"""))
def control_restore(spark, sf_dir):
    return G.control_restore(statuses(spark, sf_dir), 1_706_400_000 * US).drop("evidence")


# Every flow record assesses a whole domain of its user's organisation.
@query(over_events(f"""
, changes AS (SELECT n_name AS org, event_id, ts_us, 'PISF-' || lpad((k % 13 + 1)::VARCHAR, 2, '0') AS domain_id,
    CASE WHEN k % 2 = 0 THEN 'Non-Compliant' ELSE 'Compliant' END AS status
  FROM sec JOIN nation ON n_nationkey = {NATION_SQL} WHERE event = 'NET_FLOW')
, last AS (SELECT org, domain_id, arg_max(status, (ts_us, event_id)) AS st FROM changes GROUP BY 1, 2)
SELECT n_name AS org, control_id, coalesce(st, seed_status) AS status FROM nation CROSS JOIN {CONTROL_ROWS_SQL}
LEFT JOIN last l ON l.org = n_name AND l.domain_id = ctl.domain_id"""))
def domain_status(spark, sf_dir):
    flows = with_org(sec_events(spark, sf_dir, "NET_FLOW"), spark, sf_dir)
    changes = flows.select(
        "org", "event_id", "ts_us", F.concat(F.lit("PISF-"), F.lpad((F.col("k") % 13 + 1).cast("string"), 2, "0")).alias("domain_id"),
        F.when(F.col("k") % 2 == 0, R.STATUS_NON_COMPLIANT).otherwise(R.STATUS_COMPLIANT).alias("status"),
    )
    return G.latest_status(G.domain_status_events(changes), orgs(spark, sf_dir)).select("org", "control_id", "status")
