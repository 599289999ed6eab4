"""The same results as plain SQL over the star-schema tables."""

from __future__ import annotations

ANCHOR = "DATE '2024-01-23'"
ORDERS_ANCHOR = "DATE '2000-06-30'"
EPS = "1e-5::DOUBLE"


def _between(first: int, last: int = 0, anchor: str = ANCHOR) -> str:
    return f"date BETWEEN {anchor} - {first} AND {anchor} - {last}"


D30, D14, D7, PREV = _between(29), _between(13), _between(6), _between(13, 7)

USERS = "users AS (SELECT c_custkey AS athlete_id FROM customer)"
EV = "ev AS (SELECT *, CAST(ts AS DATE) AS date FROM events)"
DAILY = f"""{EV}, daily AS (
  SELECT user_id AS athlete_id, date, sum(value) AS steps, CAST(count(*) AS DOUBLE) AS distance,
    sum(value) FILTER (event_type = 'purchase') AS calories,
    sum(value) FILTER (event_type = 'click') AS very,
    sum(value) FILTER (event_type = 'view') AS fairly,
    sum(value) FILTER (event_type = 'signup') AS lightly,
    CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS sedentary
  FROM ev GROUP BY 1, 2)"""
HOURLY = f"""{EV}, hourly AS (
  SELECT user_id AS athlete_id, date_trunc('hour', ts) AS hr, date, avg(value) AS rate,
    min(value) AS low, max(value) AS high FROM ev GROUP BY 1, 2, 3)"""
SLEEP = f"""{EV}, sleep AS (
  SELECT user_id AS athlete_id, date, sum(value) FILTER (event_type = 'view') AS asleep,
    sum(value) FILTER (event_type IN ('view', 'click')) AS bed FROM ev GROUP BY 1, 2)"""
SESSIONS = f"""{EV}, sessions AS (
  SELECT user_id AS athlete_id, event_id, date, event_type, hours, hours * 60 AS minutes,
    hours * CASE event_type WHEN 'purchase' THEN 1.5 WHEN 'signup' THEN 1.4 WHEN 'click' THEN 1.1
      ELSE 1.0 END::DOUBLE AS load
  FROM (SELECT *, greatest((CAST(hour(ts) AS DOUBLE) + value / 100) - hour(ts), 0.5::DOUBLE)
    AS hours FROM ev))"""
HIT = (
    f"(event_type = 'error' AND value > 100 AND date > {ANCHOR} AND date <= {ANCHOR} + 7)"
)
LABELS = f"""{EV}, labelled AS (
  SELECT user_id AS athlete_id, max(CASE WHEN {HIT} THEN 1 ELSE 0 END) AS injured_in_risk_window,
    CAST(min(date - {ANCHOR}) FILTER ({HIT}) AS DOUBLE) AS onset_day_offset,
    max(value) FILTER ({HIT}) / 20 AS recovery_duration FROM ev GROUP BY 1)"""
PROFILE = """profile AS (
  SELECT c_custkey AS athlete_id, c_mktsegment AS sport, n_name AS team_id,
    c_acctbal AS weight_kg_baseline FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def _ctes(*parts: str) -> str:
    """Join CTE fragments, keeping each name once."""
    seen, out = set(), []
    for p in parts:
        if p.startswith(EV):
            if "ev" not in seen:
                seen.add("ev")
                out.append(EV)
            p = p[len(EV):].lstrip(", ")
        if p and p not in seen:
            seen.add(p)
            out.append(p)
    return "WITH " + ",\n".join(out)


def _r(inner: str, plain: str, digits: int = 6, doubles: str = "", **own: int) -> str:
    """Select plain columns as they are and doubles rounded."""
    cols = [c for c in plain.split() if c]
    cols += [f"round({c}, {own.get(c, digits)}) AS {c}" for c in doubles.split()]
    return f"SELECT {', '.join(cols)} FROM ({inner})"


def _std(x: str, cond: str | None = None) -> str:
    if cond is None:
        return f"CASE WHEN count(*) > 0 THEN coalesce(stddev_samp({x}), 0) END"
    return (
        f"CASE WHEN count(*) FILTER ({cond}) > 0 THEN "
        f"coalesce(stddev_samp({x}) FILTER ({cond}), 0) END"
    )


ACTIVITY = f"""act AS (
  SELECT *, avg_steps_7d / (avg_steps_30d + {EPS}) AS steps_change_7d_vs_30d,
    avg_active_minutes_7d / (avg_active_minutes_30d + {EPS}) AS activity_change_7d_vs_30d,
    avg_calories_7d / (avg_calories_30d + {EPS}) AS calories_change_7d_vs_30d
  FROM (SELECT athlete_id, avg(steps) AS avg_steps_30d, {_std('steps')} AS std_steps_30d,
    max(steps) AS max_steps_30d, min(steps) AS min_steps_30d, avg(distance) AS avg_distance_30d,
    avg(calories) AS avg_calories_30d, avg(sedentary) AS avg_sedentary_minutes_30d,
    avg(active) AS avg_active_minutes_30d, avg(steps) FILTER ({D14}) AS avg_steps_14d,
    avg(steps) FILTER ({D7}) AS avg_steps_7d, {_std('steps', D7)} AS std_steps_7d,
    avg(distance) FILTER ({D7}) AS avg_distance_7d, avg(calories) FILTER ({D7}) AS avg_calories_7d,
    avg(sedentary) FILTER ({D7}) AS avg_sedentary_minutes_7d,
    avg(active) FILTER ({D7}) AS avg_active_minutes_7d
    FROM (SELECT *, very + fairly + lightly AS active FROM daily) WHERE {D30} GROUP BY 1))"""
ACT_COLS = (
    "avg_steps_30d std_steps_30d max_steps_30d min_steps_30d avg_distance_30d avg_calories_30d "
    "avg_sedentary_minutes_30d avg_active_minutes_30d avg_steps_14d avg_steps_7d std_steps_7d "
    "avg_distance_7d avg_calories_7d avg_sedentary_minutes_7d avg_active_minutes_7d "
    "steps_change_7d_vs_30d activity_change_7d_vs_30d calories_change_7d_vs_30d"
)
HEART = f"""heart AS (
  SELECT *, avg_hr_7d / (avg_hr_30d + {EPS}) AS hr_change_7d_vs_30d,
    std_hr_30d / (avg_hr_30d + {EPS}) AS hr_cv_30d
  FROM (SELECT athlete_id, avg(rate) AS avg_hr_30d, {_std('rate')} AS std_hr_30d,
    min(low) AS min_hr_30d, max(high) AS max_hr_30d, avg(rate) FILTER ({D14}) AS avg_hr_14d,
    avg(rate) FILTER ({D7}) AS avg_hr_7d, {_std('rate', D7)} AS std_hr_7d
    FROM hourly WHERE {D30} GROUP BY 1))"""
HEART_COLS = (
    "avg_hr_30d std_hr_30d min_hr_30d max_hr_30d avg_hr_14d avg_hr_7d std_hr_7d "
    "hr_change_7d_vs_30d hr_cv_30d"
)
SLEEPS = f"""slept AS (
  SELECT *, avg_sleep_minutes_7d / (avg_sleep_minutes_30d + {EPS}) AS sleep_change_7d_vs_30d,
    avg_sleep_minutes_30d / (avg_time_in_bed_30d + {EPS}) AS sleep_efficiency_30d,
    std_sleep_minutes_30d / (avg_sleep_minutes_30d + {EPS}) AS sleep_variability_30d,
    std_sleep_minutes_30d / (avg_sleep_minutes_30d + {EPS}) AS sleep_cv_30d
  FROM (SELECT athlete_id, avg(asleep) AS avg_sleep_minutes_30d,
    {_std('asleep')} AS std_sleep_minutes_30d, avg(bed) AS avg_time_in_bed_30d,
    min(asleep) AS minimum_sleep_30d, avg(asleep) FILTER ({D14}) AS avg_sleep_minutes_14d,
    avg(asleep) FILTER ({D7}) AS avg_sleep_minutes_7d, avg(bed) FILTER ({D7}) AS avg_time_in_bed_7d
    FROM sleep WHERE {D30} GROUP BY 1))"""
SLEEP_COLS = (
    "avg_sleep_minutes_30d std_sleep_minutes_30d avg_time_in_bed_30d minimum_sleep_30d "
    "avg_sleep_minutes_14d avg_sleep_minutes_7d avg_time_in_bed_7d sleep_change_7d_vs_30d "
    "sleep_efficiency_30d sleep_variability_30d sleep_cv_30d"
)


def _training(spine: str) -> str:
    """Training block on a spine; everything absent is zero."""
    z = "coalesce({0}, 0)::DOUBLE AS {0}"
    raw = (
        "training_sessions_30d training_minutes_30d training_load_30d practice_sessions_30d "
        "scrimmage_sessions_30d gym_sessions_30d training_sessions_14d training_minutes_14d "
        "training_load_14d training_sessions_7d training_minutes_7d training_load_7d std_load prev"
    ).split()
    weekly = "training_load_30d / 30.0::DOUBLE * 7.0::DOUBLE"
    return f"""trained AS (
  SELECT * EXCLUDE (std_load, prev),
    training_load_7d / ({weekly} + {EPS}) AS training_load_change_7d_vs_30d,
    training_load_7d / (prev + {EPS}) AS training_load_change_7d_vs_previous_7d,
    (training_load_7d - {weekly}) / (std_load + {EPS}) AS training_load_zscore
  FROM (SELECT s.athlete_id, {', '.join(z.format(c) for c in raw)}
    FROM {spine} s LEFT JOIN (SELECT athlete_id,
      count(minutes) AS training_sessions_30d, sum(minutes) AS training_minutes_30d,
      sum(load) AS training_load_30d,
      count(*) FILTER (contains(lower(event_type), 'click')) AS practice_sessions_30d,
      count(*) FILTER (contains(lower(event_type), 'signup')) AS scrimmage_sessions_30d,
      count(*) FILTER (contains(lower(event_type), 'purchase')) AS gym_sessions_30d,
      count(minutes) FILTER ({D14}) AS training_sessions_14d,
      sum(minutes) FILTER ({D14}) AS training_minutes_14d,
      sum(load) FILTER ({D14}) AS training_load_14d,
      count(minutes) FILTER ({D7}) AS training_sessions_7d,
      sum(minutes) FILTER ({D7}) AS training_minutes_7d,
      sum(load) FILTER ({D7}) AS training_load_7d,
      {_std('load')} AS std_load, sum(load) FILTER ({PREV}) AS prev
      FROM sessions WHERE {D30} GROUP BY 1) t USING (athlete_id)))"""


TRAIN_COLS = (
    "training_sessions_30d training_minutes_30d training_load_30d practice_sessions_30d "
    "scrimmage_sessions_30d gym_sessions_30d training_sessions_14d training_minutes_14d "
    "training_load_14d training_sessions_7d training_minutes_7d training_load_7d "
    "training_load_change_7d_vs_30d training_load_change_7d_vs_previous_7d training_load_zscore"
)


def _weights(spine: str, anchor: str) -> str:
    return f"""weighed AS (
  SELECT athlete_id, latest_weight, coalesce(mean_w, latest_weight) AS average_weight_30d,
    latest_weight / (1.75::DOUBLE * 1.75::DOUBLE) AS latest_bmi,
    CAST(NULL AS DOUBLE) AS latest_body_fat,
    coalesce(latest_weight - base, 0) AS weight_change_30d
  FROM (SELECT s.athlete_id, coalesce(w.latest, p.weight_kg_baseline) AS latest_weight, w.mean_w,
      p.weight_kg_baseline AS base
    FROM {spine} s LEFT JOIN profile p USING (athlete_id) LEFT JOIN (
      SELECT o_custkey AS athlete_id, arg_max(o_totalprice, row(date, o_orderkey)) AS latest,
        avg(o_totalprice) AS mean_w
      FROM (SELECT *, CAST(o_orderdate AS DATE) AS date FROM orders)
      WHERE {_between(29, 0, anchor)} GROUP BY 1) w USING (athlete_id)))"""


WEIGHT_COLS = (
    "latest_weight average_weight_30d latest_bmi latest_body_fat weight_change_30d"
)
SCORES = f"""scores AS (
  SELECT m.model, l.athlete_id, l.injured_in_risk_window AS y_true,
    least(coalesce(round(CASE m.model WHEN 'w7' THEN w7 WHEN 'w14' THEN w14 ELSE w30 END / 100, 9),
      0), 1)::DOUBLE AS prob
  FROM labelled l CROSS JOIN (VALUES ('w7'), ('w14'), ('w30')) m(model) LEFT JOIN (
    SELECT user_id AS athlete_id, avg(value) FILTER ({D7}) AS w7, avg(value) FILTER ({D14}) AS w14,
      avg(value) FILTER ({D30}) AS w30 FROM ev
    WHERE event_type = 'error' AND date <= {ANCHOR} GROUP BY 1) s USING (athlete_id))"""
ALL_SCORES = """everyone AS (SELECT * FROM scores UNION ALL
  SELECT 'Top3_Ensemble', athlete_id, y_true, avg(prob) FROM scores GROUP BY athlete_id, y_true)"""


def _curve(src: str) -> str:
    return f"""curve AS (
  SELECT model, t AS threshold,
    coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + p - tp, 0), 0) AS f1,
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS "precision",
    coalesce(tp::DOUBLE / nullif(p, 0), 0) AS recall
  FROM (SELECT model, g.t, count(*) FILTER (y_true = 1 AND prob >= g.t) AS tp,
      count(*) FILTER (y_true = 0 AND prob >= g.t) AS fp, count(*) FILTER (y_true = 1) AS p
    FROM {src} CROSS JOIN (SELECT i / 100.0::DOUBLE AS t FROM range(5, 96) r(i)) g
    GROUP BY 1, 2)),
best AS (
  SELECT model, CASE WHEN f1 > 0 THEN round_even(threshold, 4)::DOUBLE ELSE 0.5 END
      AS best_threshold,
    CASE WHEN f1 > 0 THEN round_even(f1, 4)::DOUBLE ELSE 0 END AS best_f1,
    CASE WHEN f1 > 0 THEN round_even("precision", 4)::DOUBLE ELSE 0 END AS "precision",
    CASE WHEN f1 > 0 THEN round_even(recall, 4)::DOUBLE ELSE 0 END AS recall
  FROM curve QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1)"""


def _rank_auc(src: str, by: str) -> str:
    """Mann-Whitney area with average ranks for ties."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {keys}prob"
    return f"""SELECT {keys} coalesce((sum(r) FILTER (y_true = 1) - p * (p + 1) / 2.0)
      / nullif(p * q, 0), 0)::DOUBLE AS roc_auc
    FROM (SELECT *, rank() OVER ({part} ORDER BY prob) + (count(*) OVER ({tie}) - 1) / 2.0 AS r,
        count(*) FILTER (y_true = 1) OVER ({part}) AS p,
        count(*) FILTER (y_true = 0) OVER ({part}) AS q FROM {src})
    GROUP BY {keys} p, q"""


def _class_metrics(src: str, cut: float, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""SELECT {keys}
    round_even(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 4)::DOUBLE AS f1,
    round_even(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4)::DOUBLE AS "precision",
    round_even(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4)::DOUBLE AS recall,
    round_even((n - fp - fn)::DOUBLE / n, 4)::DOUBLE AS accuracy,
    round_even(roc_auc, 4)::DOUBLE AS roc_auc
  FROM (SELECT {keys} count(*) FILTER (y_true = 1 AND prob >= {cut}) AS tp,
      count(*) FILTER (y_true = 0 AND prob >= {cut}) AS fp,
      count(*) FILTER (y_true = 1 AND prob < {cut}) AS fn, count(*) AS n
    FROM {src} {grp}) JOIN ({_rank_auc(src, by)}) {on}"""


RATIO_TABLE = """ratios AS (
  SELECT l.athlete_id, l.injured_in_risk_window, t.training_load_change_7d_vs_30d,
    s.sleep_change_7d_vs_30d, h.hr_change_7d_vs_30d, h.avg_hr_30d
  FROM labelled l LEFT JOIN trained t USING (athlete_id) LEFT JOIN slept s USING (athlete_id)
    LEFT JOIN heart h USING (athlete_id))"""
RATIO_CTES = _ctes(
    LABELS, SESSIONS, SLEEP, HOURLY, _training("labelled"), SLEEPS, HEART, RATIO_TABLE
)
RATIOS = "training_load_change_7d_vs_30d sleep_change_7d_vs_30d hr_change_7d_vs_30d"
SCORED = f"""scored AS (
  SELECT s.athlete_id, least(round(m / 100, 7), 1)::DOUBLE AS prob, m / 10 - 3 AS onset,
    x / 20 AS recovery, p.sport, p.team_id
  FROM (SELECT user_id AS athlete_id, round(avg(value), 7) AS m, max(value) AS x FROM ev
    WHERE date <= {ANCHOR} GROUP BY 1) s LEFT JOIN profile p USING (athlete_id))"""
SCORED_CTES = _ctes(EV, PROFILE, SCORED)
_DAY = "round_even(least(greatest(onset, 1), 30), 0)::INT"
_DAYS = "round_even(greatest(recovery, 0), 0)::INT"
REGRESSION = """reg AS (
  SELECT s.model, s.athlete_id, l.recovery_duration, greatest(s.prob * 15, 0)::DOUBLE AS predicted
  FROM labelled l JOIN scores s USING (athlete_id) WHERE l.injured_in_risk_window = 1)"""
REG_METRICS = """SELECT model, round_even(avg(abs(e)), 4)::DOUBLE AS mae,
    round_even(sqrt(avg(e * e)), 4)::DOUBLE AS rmse,
    CASE WHEN count(*) > 1 THEN round_even(coalesce(
      1 - sum(e * e) / nullif(var_pop(recovery_duration) * count(*), 0), 0), 4)::DOUBLE END AS r2
  FROM (SELECT *, recovery_duration - predicted AS e FROM reg) GROUP BY 1"""
BOARD_CTES = (
    _ctes(LABELS, SCORES, ALL_SCORES, REGRESSION)
    + ",\n"
    + _curve("everyone")
    + f""",
board AS (SELECT model, 'classification' AS task, 'injured_in_risk_window' AS target,
    'F1' AS metric, best_f1 AS score, best_threshold, "precision", recall, CAST(NULL AS DOUBLE)
    AS rmse FROM best
  UNION ALL SELECT model, 'recovery', 'recovery_duration', 'MAE', mae, NULL, NULL, NULL, rmse
    FROM ({REG_METRICS}))"""
)
_FOLD_BASE = "SELECT o_custkey AS athlete_id FROM orders"
# Groups largest first, equal ones by key, each to the fold with the fewest rows then.
FOLDS = f"""WITH RECURSIVE sizes AS (
  SELECT athlete_id, count(*) AS rows FROM ({_FOLD_BASE}) GROUP BY 1),
queue AS (SELECT athlete_id, rows, row_number() OVER (ORDER BY rows DESC, athlete_id) AS i FROM sizes),
step AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS athlete_id, 0::BIGINT AS rows, NULL::INT AS fold,
    [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT h.i, h.athlete_id, h.rows, list_position(s.loads, list_min(s.loads))::INT - 1,
    list_transform(range(1, 6), lambda k: CASE WHEN k = list_position(s.loads, list_min(s.loads))
      THEN s.loads[k] + h.rows ELSE s.loads[k] END)
  FROM step s JOIN queue h ON h.i = s.i + 1),
folds AS (SELECT athlete_id, rows, fold FROM step WHERE i > 0)"""

COARSE = {
    "training_load_change_7d_vs_30d": 6, "training_load_change_7d_vs_previous_7d": 5,
    "training_load_zscore": 5, "latest_bmi": 7, "average_weight_30d": 7,
}
ORACLES: dict[str, str] = {}
Q = ORACLES

Q["acwr_ratio"] = (
    f"WITH {EV}, {USERS} "
    + _r(
        f"""SELECT *, avg_7d / (avg_30d + {EPS}) AS acwr, std_30d / (avg_30d + {EPS}) AS cv_30d
  FROM users LEFT JOIN (SELECT user_id AS athlete_id, avg(value) AS avg_30d,
    {_std('value')} AS std_30d, avg(value) FILTER ({D14}) AS avg_14d,
    avg(value) FILTER ({D7}) AS avg_7d, {_std('value', D7)} AS std_7d, count(value) AS n_30d
    FROM ev WHERE {D30} GROUP BY 1) USING (athlete_id)""",
        "athlete_id n_30d", 9, "avg_30d std_30d avg_14d avg_7d std_7d acwr cv_30d",
    )
)
Q["activity_features"] = _ctes(DAILY, USERS, ACTIVITY) + " " + _r(
    "SELECT * FROM users LEFT JOIN act USING (athlete_id)", "athlete_id", 9, ACT_COLS)
Q["heart_rate_features"] = _ctes(HOURLY, USERS, HEART) + " " + _r(
    "SELECT * FROM users LEFT JOIN heart USING (athlete_id)", "athlete_id", 9, HEART_COLS)
Q["sleep_features"] = _ctes(SLEEP, USERS, SLEEPS) + " " + _r(
    "SELECT * FROM users LEFT JOIN slept USING (athlete_id)", "athlete_id", 9, SLEEP_COLS)
Q["training_features"] = _ctes(SESSIONS, USERS, _training("users")) + " " + _r(
    "SELECT * FROM trained", "athlete_id", 9, TRAIN_COLS, **COARSE)
Q["training_prev_week"] = _ctes(SESSIONS) + " " + _r(
    f"SELECT athlete_id, count(load) AS sessions_prev_7d, sum(load) AS load_prev_7d "
    f"FROM sessions WHERE {PREV} GROUP BY 1",
    "athlete_id sessions_prev_7d", 6, "load_prev_7d")
Q["session_type_counts"] = _ctes(SESSIONS) + f""" SELECT athlete_id,
  count(*) FILTER (contains(lower(event_type), 'click')) AS practice_sessions_30d,
  count(*) FILTER (contains(lower(event_type), 'signup')) AS scrimmage_sessions_30d,
  count(*) FILTER (contains(lower(event_type), 'purchase')) AS gym_sessions_30d
  FROM sessions WHERE {D30} GROUP BY 1"""
Q["latest_value_features"] = _ctes(USERS, PROFILE, _weights("users", ORDERS_ANCHOR)) + " " + _r(
    "SELECT * FROM weighed", "athlete_id latest_body_fat", 9,
    WEIGHT_COLS.replace("latest_body_fat ", ""), **COARSE)
Q["profile_features"] = _ctes(PROFILE) + (
    " SELECT athlete_id, sport, team_id, weight_kg_baseline, CAST(NULL AS VARCHAR) AS position "
    "FROM profile")
_COMBINED_CTES = _ctes(
    LABELS, DAILY, HOURLY, SLEEP, SESSIONS, PROFILE, ACTIVITY, HEART, SLEEPS,
    _training("labelled"), _weights("labelled", ANCHOR))
_PROFILE_NULLS = "age height_cm years_playing prior_season_injury_count"
_PROFILE_TEXT = "gender dominant_side position"
_COMBINED = f"""SELECT *, {ANCHOR} AS obs_window_end,
  {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in _PROFILE_NULLS.split())},
  {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in _PROFILE_TEXT.split())}
  FROM labelled LEFT JOIN act USING (athlete_id) LEFT JOIN heart USING (athlete_id)
  LEFT JOIN slept USING (athlete_id) LEFT JOIN trained USING (athlete_id)
  LEFT JOIN weighed USING (athlete_id) LEFT JOIN profile USING (athlete_id)"""
_ALL_DOUBLES = " ".join(
    [ACT_COLS, HEART_COLS, SLEEP_COLS, TRAIN_COLS, WEIGHT_COLS, "weight_kg_baseline"])
_PLAIN = f"athlete_id obs_window_end sport team_id {_PROFILE_NULLS} {_PROFILE_TEXT}"
Q["combined_features"] = _COMBINED_CTES + " " + _r(_COMBINED, _PLAIN, 9, _ALL_DOUBLES, **COARSE)
Q["combined_with_labels"] = _COMBINED_CTES + " " + _r(
    _COMBINED, _PLAIN + " injured_in_risk_window", 9,
    _ALL_DOUBLES + " onset_day_offset recovery_duration", **COARSE)
OWN = f"""{EV}, own AS (
  SELECT user_id AS athlete_id, coalesce(max(date) FILTER (event_type = 'purchase'), max(date)) AS own_end
  FROM ev GROUP BY 1)"""


def _at_own(part: str, name: str) -> str:
    """A table of the bundle with every entity's own anchor beside its rows."""
    return part.replace(f"{name} AS (", f"{name}0 AS (") + (
        f",\n{name} AS (SELECT * FROM {name}0 JOIN own USING (athlete_id))"
    )


_OWN_LABELS = LABELS.replace("SELECT user_id AS athlete_id,", "SELECT athlete_id, own_end,").replace(
    "FROM ev GROUP BY 1", "FROM ev JOIN own ON user_id = athlete_id GROUP BY 1, 2")
# The orders' days are moved from their anchor to that of the events.
_OWN_WEIGHTS = _weights("labelled", ANCHOR).replace(
    "CAST(o_orderdate AS DATE) AS date FROM orders",
    f"CAST(o_orderdate AS DATE) + CAST({ANCHOR} - {ORDERS_ANCHOR} AS INT) AS date "
    "FROM orders JOIN own ON o_custkey = athlete_id").replace(
    f"date BETWEEN {ANCHOR}", "date BETWEEN own_end").replace(f"AND {ANCHOR}", "AND own_end")
Q["combined_own_anchors"] = _ctes(
    OWN,
    *[
        x.replace(ANCHOR, "own_end")
        for x in (
            _OWN_LABELS, _at_own(DAILY, "daily"), _at_own(HOURLY, "hourly"), _at_own(SLEEP, "sleep"),
            _at_own(SESSIONS, "sessions"), PROFILE, ACTIVITY, HEART, SLEEPS, _training("labelled"))
    ],
    _OWN_WEIGHTS,
) + " " + _r(
    _COMBINED.replace(ANCHOR, "own_end"), _PLAIN + " injured_in_risk_window", 9,
    _ALL_DOUBLES + " onset_day_offset recovery_duration", **COARSE)
Q["empty_input_defaults"] = "SELECT c_custkey AS athlete_id, " + ", ".join(
    f"0.0::DOUBLE AS {c}" for c in TRAIN_COLS.split()) + " FROM customer"


def _anchored(days: int) -> str:
    c = f"date BETWEEN a.d - {days - 1} AND a.d"
    s = f"{days}d"
    return f"""avg(v) FILTER ({c}) AS avg_{s}, {_std('v', c)} AS std_{s},
    min(v) FILTER ({c}) AS min_{s}, max(v) FILTER ({c}) AS max_{s}"""


Q["per_entity_anchor_features"] = (
    "WITH o AS (SELECT o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS date, "
    "o_totalprice AS v FROM orders), a AS (SELECT athlete_id, max(date) AS d FROM o GROUP BY 1) "
    + _r(
        f"SELECT athlete_id, a.d AS obs_window_end, {_anchored(30)}, {_anchored(365)} "
        "FROM a JOIN o USING (athlete_id) GROUP BY 1, 2",
        "athlete_id obs_window_end", 6,
        "avg_30d std_30d min_30d max_30d avg_365d std_365d min_365d max_365d"))
Q["boundary_violations"] = f"""SELECT 'events' AS "table",
  count(*) FILTER (CAST(ts AS DATE) > {ANCHOR}) AS rows_after, max(CAST(ts AS DATE)) AS latest
  FROM events UNION ALL SELECT 'orders',
  count(*) FILTER (CAST(o_orderdate AS DATE) > {ORDERS_ANCHOR}), max(CAST(o_orderdate AS DATE))
  FROM orders"""
Q["guard_offenders"] = _ctes(LABELS) + """ SELECT 'onset_day_offset' AS "column",
  count(onset_day_offset) AS non_null FROM labelled
  UNION ALL SELECT 'recovery_duration', count(recovery_duration) FROM labelled
  UNION ALL SELECT 'posture', count(onset_day_offset) FROM labelled
  UNION ALL SELECT 'risk_score', count(recovery_duration) FROM labelled"""
Q["null_audit"] = _ctes(DAILY) + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", count(*) FILTER ({c} IS NULL) AS missing_count,
  round_even(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 2)::DOUBLE
    AS missing_percentage
  FROM daily"""
    for name, c in [
        ("calories", "calories"), ("very_active_minutes", "very"),
        ("fairly_active_minutes", "fairly"), ("lightly_active_minutes", "lightly"),
        ("steps", "steps"), ("distance", "distance"), ("sedentary_minutes", "sedentary")]
) + ") WHERE missing_count > 0"
Q["duplicate_audit"] = """SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
  SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
Q["anomaly_audit"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < 0) AS negative_count,
  count(*) FILTER (isinf({c})) AS infinite_count, min({c}) AS min_val, max({c}) AS max_val
  FROM {t}"""
    for c, t in [("c_acctbal", "customer"), ("l_quantity", "lineitem"),
                 ("l_extendedprice", "lineitem"), ("l_discount", "lineitem")])


def _audit(name: str, src: str, cols: str, texts: str, keys: str) -> str:
    """Report row of ``src``: ``cols`` are its columns in order, ``texts`` those that are no numbers."""
    names = cols.split()
    gap = lambda c: f"count(*) - count({c})"
    holes = " + ".join(f"(CASE WHEN {gap(c)} > 0 THEN 1 ELSE 0 END)" for c in names)
    gaps = ", ".join(
        f"CASE WHEN {gap(c)} > 0 THEN '{c}:' || ({gap(c)}) || ':' || CAST(round_even(({gap(c)}) * 100.0::DOUBLE / count(*), 2) AS DECIMAL(9,2)) END"
        for c in names)
    odd = ", ".join(
        f"CASE WHEN count({c}) > 0 THEN '{c}:' || (count(*) FILTER ({c} < 0)) || ':' || (count(*) FILTER (abs({c}::DOUBLE) = 'inf'::DOUBLE))"
        f" || ':' || CAST(round(min({c})::DOUBLE, 3) AS DECIMAL(24,3)) || ':' || CAST(round(max({c})::DOUBLE, 3) AS DECIMAL(24,3)) END"
        for c in names if c not in texts.split())
    return f"""SELECT '{name}' AS "table", 'OK' AS status, count(*) AS rows, {len(names)} AS columns,
  count(DISTINCT athlete_id) AS unique_entities,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {src})) AS duplicates,
  ({holes})::INT AS missing_columns_count,
  array_to_string(list_filter([{gaps}], lambda x: x IS NOT NULL), ';') AS missing_summary,
  array_to_string(list_filter([{odd}], lambda x: x IS NOT NULL), ';') AS anomalies FROM {src}"""


Q["table_audit"] = (
    _ctes(LABELS, DAILY, HOURLY, SLEEP, PROFILE)
    + f""", t_daily AS (SELECT athlete_id, date, steps, distance, calories, very AS very_active_minutes,
    fairly AS fairly_active_minutes, lightly AS lightly_active_minutes, sedentary AS sedentary_minutes FROM daily),
  t_hourly AS (SELECT athlete_id, hr AS datetime, date, rate AS heart_rate, low AS min_heart_rate, high AS max_heart_rate FROM hourly),
  t_sleep AS (SELECT athlete_id, date, asleep AS sleep_minutes, bed AS time_in_bed FROM sleep),
  t_sessions AS (SELECT event_id AS session_id, user_id AS athlete_id, date, event_type AS sport_session_type,
    hour(ts)::DOUBLE AS start_hour, hour(ts)::DOUBLE + value / 100 AS end_hour FROM ev),
  t_logs AS (SELECT o_custkey AS athlete_id, CAST(o_orderdate AS DATE) AS date, o_orderkey AS log_id, o_totalprice AS weight FROM orders),
  t_labels AS (SELECT *, {ANCHOR} AS obs_window_end FROM labelled) """
    + " UNION ALL ".join([
        _audit("daily_activity", "t_daily",
               "athlete_id date steps distance calories very_active_minutes fairly_active_minutes "
               "lightly_active_minutes sedentary_minutes", "date", "athlete_id, date"),
        _audit("hourly_heartrate", "t_hourly", "athlete_id datetime date heart_rate min_heart_rate max_heart_rate",
               "datetime date", "athlete_id, date"),
        _audit("sleep_day", "t_sleep", "athlete_id date sleep_minutes time_in_bed", "date", "athlete_id, date"),
        _audit("training_sessions", "t_sessions", "session_id athlete_id date sport_session_type start_hour end_hour",
               "date sport_session_type", "session_id"),
        _audit("weight_logs", "t_logs", "athlete_id date log_id weight", "date", "athlete_id, date"),
        _audit("athlete_metadata", "profile", "athlete_id sport team_id weight_kg_baseline", "sport team_id", "athlete_id"),
        _audit("train_labels", "t_labels",
               "athlete_id injured_in_risk_window onset_day_offset recovery_duration obs_window_end", "obs_window_end",
               "athlete_id")]))
Q["table_preview"] = "SELECT * FROM customer ORDER BY c_custkey LIMIT 100"
Q["class_balance"] = _ctes(LABELS) + """ SELECT injured_in_risk_window, count(*) AS count,
  round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS share FROM labelled GROUP BY 1"""
Q["priority_frequency"] = """SELECT o_orderpriority, count(*) AS count,
  round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS share FROM orders GROUP BY 1"""
Q["event_rate_by_dim"] = _ctes(LABELS, PROFILE) + """ SELECT sport, count(*) AS count,
  round(avg(injured_in_risk_window) * 100, 9) AS rate_pct
  FROM labelled JOIN profile USING (athlete_id) GROUP BY 1"""
Q["dataset_kpis"] = _ctes(LABELS, PROFILE) + """ SELECT count(*) AS entities, 8 AS columns,
  count(*) FILTER (injured_in_risk_window = 1) AS positives,
  round(avg(injured_in_risk_window) * 100, 9) AS positive_rate_pct
  FROM labelled JOIN profile USING (athlete_id)"""


def _describe(src: str, col: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}'{col}' AS feature, count({col}) AS count, avg({col}) AS mean,
  stddev_samp({col}) AS std, min({col}) AS min, quantile_cont({col}, 0.25) AS p25,
  quantile_cont({col}, 0.5) AS p50, quantile_cont({col}, 0.75) AS p75, max({col}) AS max
  FROM {src} {g}"""


_STATS = "mean std min p25 p50 p75 max"
Q["describe_numeric"] = _r(
    " UNION ALL ".join(_describe("lineitem", c) for c in
                       ("l_quantity", "l_extendedprice", "l_discount")),
    "feature count", 5, _STATS)
Q["describe_by_class"] = RATIO_CTES + " " + _r(
    " UNION ALL ".join(_describe("ratios", c, "injured_in_risk_window") for c in RATIOS.split()),
    "injured_in_risk_window feature count", 6, _STATS)
Q["profile_feature"] = _ctes(DAILY) + """, s AS (SELECT count(calories) AS n,
  100.0 * count(*) FILTER (calories IS NULL) / count(*) AS gone, avg(calories) AS m,
  stddev_samp(calories) AS sd, min(calories) AS lo, median(calories) AS md, max(calories) AS hi
  FROM daily)
  SELECT 'Data Type' AS metric, 'double' AS value FROM s
  UNION ALL SELECT 'Count', n::VARCHAR FROM s
  UNION ALL SELECT 'Missing %', printf('%.2f', gone::DOUBLE) || '%' FROM s
  UNION ALL SELECT 'Mean', printf('%.3f', m) FROM s
  UNION ALL SELECT 'Std Dev', printf('%.3f', sd) FROM s
  UNION ALL SELECT 'Min', printf('%.3f', lo) FROM s
  UNION ALL SELECT 'Median', printf('%.3f', md) FROM s
  UNION ALL SELECT 'Max', printf('%.3f', hi) FROM s"""
Q["median_by_dim"] = _r(
    """SELECT o_orderpriority, count(o_totalprice) AS count, avg(o_totalprice) AS mean,
  median(o_totalprice) AS median, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min,
  max(o_totalprice) AS max FROM orders GROUP BY 1""",
    "o_orderpriority count", 4, "mean std min max median")
Q["iqr"] = _r(
    """SELECT *, q3 - q1 AS iqr FROM (SELECT quantile_cont(o_totalprice, 0.25) AS q1,
  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)""", "", 4, "q1 q3 iqr")
Q["tail_by_class"] = _r(
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.75) AS quantile,
  max(l_extendedprice) AS max FROM lineitem GROUP BY 1""", "l_returnflag", 4, "max quantile")
Q["class_means"] = _r(
    """SELECT l_returnflag, count(*) AS rows, avg(l_quantity) AS mean_l_quantity,
  avg(l_discount) AS mean_l_discount FROM lineitem GROUP BY 1""",
    "l_returnflag rows", 7, "mean_l_quantity mean_l_discount")
Q["reference_lines"] = _r(
    "SELECT avg(l_quantity) AS mean, median(l_quantity) AS median FROM lineitem", "", 7,
    "mean median")
_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
Q["correlation_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 9) AS corr FROM lineitem"
    for a in _LI for b in _LI)
_WIDE = ", ".join(
    f"CASE WHEN (l_orderkey + l_linenumber) % {i % 7 + 2} > 0 THEN {_LI[i % 4]} * {i + 1} + {_LI[i // 4 % 4]} * {i % 5} END AS c{i}"
    for i in range(62))
Q["correlation_matrix_wide"] = (
    f"WITH w AS (SELECT {_WIDE}, CAST(NULL AS DOUBLE) AS c62 FROM lineitem), c AS (SELECT "
    + ", ".join(f"corr(c{i}, c{j}) AS r{i}_{j}" for i in range(63) for j in range(63))
    + " FROM w) SELECT 'c' || split_part(p[2:], '_', 1) AS x, 'c' || split_part(p, '_', 2) AS y, round(r, 6) AS corr FROM ("
    + "SELECT * FROM c UNPIVOT INCLUDE NULLS (r FOR p IN ("
    + ", ".join(f"r{i}_{j}" for i in range(63) for j in range(63)) + ")))")
Q["linear_fit"] = _r(
    """SELECT regr_count(l_discount, l_quantity)::BIGINT AS n,
  regr_slope(l_discount, l_quantity) AS slope, regr_intercept(l_discount, l_quantity) AS intercept,
  regr_r2(l_discount, l_quantity) AS r2, corr(l_discount, l_quantity) AS corr FROM lineitem""",
    "n", 9, "slope intercept r2 corr")


def _hist(src: str, col: str, bins: int, by: str = "") -> str:
    k = f"{by}, " if by else ""
    n = len([b for b in by.split(",") if b.strip()]) + 1
    return _r(
        f"""SELECT {k}bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, count FROM (
  SELECT {k}least(floor(({col} - lo) / w), {bins - 1})::INT AS bin, any_value(lo) AS lo,
    any_value(w) AS w, count(*) AS count
  FROM {src}, (SELECT min({col}) AS lo, (max({col}) - min({col})) / {bins} AS w FROM {src})
  GROUP BY {', '.join(str(i + 1) for i in range(n))})""",
        f"{by.replace(',', ' ')} bin count", 4, "low high")


Q["histogram"] = _hist("orders", "o_totalprice", 30)
Q["histogram_by_class"] = _hist("lineitem", "l_extendedprice", 40, "l_returnflag")
def _density(value: str, points: int) -> str:
    """The kernel summed over every single row."""
    return f"""WITH e AS (SELECT event_type, {value} AS v FROM events),
  spec AS (SELECT event_type, count(*) AS n, min(v) AS lo, max(v) AS hi,
    stddev_samp(v) * pow(count(*)::DOUBLE, -0.2) AS h FROM e GROUP BY 1),
  grid AS (SELECT *, p::INT AS point, (lo - 3 * h) + p * ((hi + 3 * h) - (lo - 3 * h)) / {points - 1} AS x
    FROM spec CROSS JOIN range(0, {points}) r(p))
  SELECT event_type, point, round(any_value(x), 8) AS x,
    round(sum(exp(-0.5 * pow((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
  FROM e JOIN grid USING (event_type) GROUP BY 1, 2"""


Q["kde_by_class"] = _density("value", 60)
Q["kde_heavy_tail"] = _density("pow(value, 4) / 1e6", 80)
Q["box_stats"] = "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, " \
    "median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) " + _r(
    """SELECT event_type, count(value) AS n, any_value(q1) AS q1, any_value(q.median) AS median,
  any_value(q3) AS q3, min(value) FILTER (ok) AS whisker_low, max(value) FILTER (ok)
  AS whisker_high, count(*) FILTER (NOT ok) AS outliers
  FROM (SELECT *, value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok
    FROM events JOIN q USING (event_type)) q GROUP BY 1""",
    "event_type n outliers", 5, "q1 median q3 whisker_low whisker_high")
Q["band_shares"] = RATIO_CTES + """ SELECT band, CASE band WHEN 1 THEN 1.2 WHEN 2 THEN 1.5
    END::DOUBLE AS low, CASE band WHEN 0 THEN 1.2 WHEN 1 THEN 1.5 END::DOUBLE AS high,
  count(*) AS count, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS share,
  round(avg(injured_in_risk_window) * 100, 9) AS rate_pct
  FROM (SELECT *, (CASE WHEN training_load_change_7d_vs_30d >= 1.5 THEN 2
      WHEN training_load_change_7d_vs_30d >= 1.2 THEN 1 ELSE 0 END)::INT AS band FROM ratios
    WHERE training_load_change_7d_vs_30d IS NOT NULL) GROUP BY 1"""
Q["share_beyond"] = RATIO_CTES + " " + " UNION ALL ".join(
    f"""SELECT '{n}' AS line, {e}::DOUBLE AS edge, count(*) FILTER ({c} {op} {e}) AS beyond,
  round(avg(CASE WHEN {c} {op} {e} THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END), 9) AS share
  FROM ratios"""
    for n, c, op, e in [
        ("load_caution", "training_load_change_7d_vs_30d", ">", 1.2),
        ("load_high", "training_load_change_7d_vs_30d", ">", 1.5),
        ("sleep_down", "sleep_change_7d_vs_30d", "<", 1.0),
        ("hr_up", "hr_change_7d_vs_30d", ">", 1.0)])
Q["entity_timeline"] = _ctes(DAILY) + (
    " SELECT athlete_id, date, round(steps, 4) AS steps FROM daily WHERE athlete_id = 7")
Q["rolling_7d_every_day"] = """WITH d AS (SELECT l_suppkey AS athlete_id,
    CAST(l_shipdate AS DATE) AS date, count(l_extendedprice) AS n, sum(l_extendedprice) AS total
    FROM lineitem GROUP BY 1, 2)
  SELECT athlete_id, date, CAST(sum(n) OVER w AS BIGINT) AS n_7d,
    round(sum(total) OVER w, 3) AS sum_7d, round(sum(total) OVER w / sum(n) OVER w, 7) AS avg_7d
  FROM d WINDOW w AS (PARTITION BY athlete_id ORDER BY date
    RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)"""
Q["group_folds"] = FOLDS + " SELECT athlete_id, rows, fold FROM folds"
Q["fold_report"] = FOLDS + """ SELECT fold, ((SELECT count(*) FROM folds) - count(*))
  AS train_entities, ((SELECT sum(rows) FROM folds) - sum(rows))::BIGINT AS train_rows,
  count(*) AS val_entities, sum(rows)::BIGINT AS val_rows, 0::BIGINT AS overlap
  FROM folds GROUP BY 1"""
Q["fold_overlap"] = """SELECT o_custkey AS athlete_id, count(DISTINCT o_orderkey % 5) AS folds
  FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 5) > 1"""
_SCORE_CTES = _ctes(LABELS, SCORES)
Q["threshold_curve"] = _SCORE_CTES + ",\n" + _curve("scores") + """
  SELECT model, round(threshold, 9) AS threshold, round(f1, 9) AS f1,
    round("precision", 9) AS "precision", round(recall, 9) AS recall FROM curve"""
Q["best_threshold"] = _SCORE_CTES + ",\n" + _curve("scores") + " SELECT * FROM best"
Q["classification_metrics"] = _SCORE_CTES + " " + _class_metrics("scores", 0.5, "model")
Q["document_quality_metrics"] = """WITH d AS (SELECT quality AS y_true,
  least(n_chars / 10000.0::DOUBLE, 1) AS prob FROM labels JOIN documents USING (doc_id)) """ + (
    _class_metrics("d", 0.1))
Q["roc_points"] = _SCORE_CTES + """, steps AS (SELECT model, prob,
    count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg
    FROM scores GROUP BY 1, 2)
  SELECT model, round(prob, 9) AS threshold,
    round(sum(neg) OVER w / nullif(sum(neg) OVER a, 0)::DOUBLE, 9) AS fpr,
    round(sum(pos) OVER w / nullif(sum(pos) OVER a, 0)::DOUBLE, 9) AS tpr
  FROM steps WINDOW w AS (PARTITION BY model ORDER BY prob DESC), a AS (PARTITION BY model)
  UNION ALL SELECT DISTINCT model, NULL, 0.0, 0.0 FROM scores"""
Q["roc_auc"] = _SCORE_CTES + " " + _r(_rank_auc("scores", "model"), "model", 9, "roc_auc")
Q["confusion_matrix"] = _SCORE_CTES + """ SELECT model, actual, predicted, count(athlete_id) AS count
  FROM (SELECT DISTINCT model FROM scores) CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1))
    c(actual, predicted) LEFT JOIN (SELECT model, athlete_id, y_true AS actual,
      (prob >= 0.5)::INT AS predicted FROM scores) USING (model, actual, predicted)
  GROUP BY 1, 2, 3"""
_REG_CTES = _ctes(LABELS, SCORES, REGRESSION)
Q["regression_metrics"] = _REG_CTES + " " + REG_METRICS
Q["residual_pairs"] = _REG_CTES + " " + _r(
    """SELECT athlete_id, recovery_duration AS actual, predicted,
  predicted - recovery_duration AS residual FROM reg WHERE model = 'w30'""",
    "athlete_id", 7, "actual predicted residual")
Q["ensemble_mean"] = _SCORE_CTES + """ SELECT 'Top3_Ensemble' AS model, athlete_id, y_true,
  round(avg(prob), 10) AS prob FROM scores GROUP BY athlete_id, y_true"""
Q["leaderboard"] = BOARD_CTES + " SELECT * FROM board"
Q["best_model_per_task"] = BOARD_CTES + """ SELECT task, model, metric, score FROM board
  QUALIFY row_number() OVER (PARTITION BY task
    ORDER BY CASE WHEN metric = 'F1' THEN -score ELSE score END, model) = 1"""
Q["top3_models"] = _SCORE_CTES + ",\n" + _curve("scores") + """
  SELECT row_number() OVER (ORDER BY best_f1 DESC,
      list_position(['w7', 'w14', 'w30'], model))::INT AS place, model, best_f1 FROM best"""
Q["oof_wide"] = _SCORE_CTES + """ SELECT athlete_id, y_true AS y_true_injured,
  round(max(prob) FILTER (model = 'w7'), 9) AS prob_w7,
  round(max(prob) FILTER (model = 'w14'), 9) AS prob_w14,
  round(max(prob) FILTER (model = 'w30'), 9) AS prob_w30 FROM scores GROUP BY 1, 2"""
Q["submission_from_scores"] = SCORED_CTES + f""" SELECT athlete_id,
  (prob >= 0.5)::INT AS injured_in_risk_window, {_DAY} AS onset_day_offset,
  {_DAYS} AS recovery_duration FROM scored"""
Q["submission_masked"] = SCORED_CTES + f""" SELECT athlete_id,
  (prob >= 0.5)::INT AS injured_in_risk_window,
  CASE WHEN prob >= 0.5 THEN {_DAY} END AS onset_day_offset,
  CASE WHEN prob >= 0.5 THEN {_DAYS} END AS recovery_duration FROM scored"""
Q["high_risk_share"] = SCORED_CTES + """ SELECT count(*) AS entities,
  count(*) FILTER (prob >= 0.5) AS high_risk,
  round(avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END), 9) AS share FROM scored"""
_VIEW = """SELECT athlete_id, sport, team_id, round_even(prob * 100, 1)::DOUBLE AS risk_pct,
  CASE WHEN prob >= 0.5 THEN 'High Risk' ELSE 'Low Risk' END AS status,
  CASE WHEN prob >= 0.5 THEN round_even(onset, 0)::INT::VARCHAR ELSE '-' END AS est_onset_day,
  CASE WHEN prob >= 0.5 THEN round_even(recovery, 0)::INT::VARCHAR ELSE '-' END
    AS est_recovery_days FROM scored"""
Q["risk_ranking"] = SCORED_CTES + f""" SELECT * EXCLUDE (est_recovery_days),
  row_number() OVER (ORDER BY risk_pct DESC, athlete_id) AS rank FROM ({_VIEW})"""
Q["team_ranking"] = SCORED_CTES + f""" SELECT * EXCLUDE (est_recovery_days),
  row_number() OVER (PARTITION BY team_id ORDER BY risk_pct DESC, athlete_id) AS team_rank FROM ({_VIEW})"""
Q["top_risks"] = SCORED_CTES + f""" SELECT athlete_id, sport, risk_pct, status, est_onset_day
  FROM ({_VIEW}) ORDER BY risk_pct DESC, athlete_id LIMIT 20"""
Q["entity_card"] = SCORED_CTES + f""" SELECT athlete_id, risk_pct, status, est_onset_day,
  est_recovery_days FROM ({_VIEW}) WHERE athlete_id::VARCHAR = '7'"""


def _z(load: str, sleep: str) -> str:
    return (
        f"1 / (1 + exp(-(0.8::DOUBLE * (coalesce({load}, 1.0) - 1.0) "
        f"+ -0.5::DOUBLE * (coalesce({sleep}, 1.0) - 1.0) "
        "+ 0.3::DOUBLE * (coalesce(hr_change_7d_vs_30d, 1.0) - 1.0))))"
    )


_L, _S = "training_load_change_7d_vs_30d", "sleep_change_7d_vs_30d"
Q["whatif_linear"] = RATIO_CTES + " " + _r(
    "SELECT *, simulated - original AS delta FROM (" + " UNION ALL ".join(
        f"SELECT athlete_id, '{n}' AS scenario, {_z(_L, _S)} AS original, "
        f"{_z(a, b)} AS simulated FROM ratios"
        for n, a, b in [("more_load", "1.5::DOUBLE", _S), ("less_sleep", _L, "0.7::DOUBLE"),
                        ("both", "1.5::DOUBLE", "0.7::DOUBLE")]) + ")",
    "athlete_id scenario", 9, "original simulated delta")
_CONTRIB = " UNION ALL ".join(
    f"SELECT athlete_id, '{c}' AS feature, "
    f"coalesce({w}::DOUBLE * ({c} - 1.0::DOUBLE), 0) AS contribution FROM ratios"
    for c, w in zip(RATIOS.split(), (0.8, -0.5, 0.3)))
Q["linear_attribution"] = RATIO_CTES + " " + _r(_CONTRIB, "athlete_id feature", 9, "contribution")
Q["global_attribution"] = RATIO_CTES + f""" SELECT feature,
  round(avg(abs(contribution)), 8) AS mean_abs FROM ({_CONTRIB}) GROUP BY 1"""
Q["top10_attribution"] = _ctes(DAILY, ACTIVITY) + " SELECT athlete_id, " \
    "row_number() OVER w::INT AS rank, feature, round(contribution, 9) AS contribution FROM (" + (
    " UNION ALL ".join(
        f"SELECT athlete_id, '{c}' AS feature, {(i + 1) / 10}::DOUBLE * coalesce({c}, 0) "
        "AS contribution FROM act" for i, c in enumerate(x.strip(' ,') for x in ACT_COLS.split()))
) + """) WINDOW w AS (PARTITION BY athlete_id ORDER BY abs(contribution) DESC, feature)
  QUALIFY row_number() OVER w <= 10"""
Q["clipped_rounding"] = """SELECT round_even(greatest(least(l_quantity / 2, 15), 1), 0)::INT AS day,
  count(*) AS lines FROM lineitem GROUP BY 1"""
_FILL = ["calories", "very", "fairly"]
Q["impute_median"] = _ctes(DAILY) + ", m AS (SELECT " + ", ".join(
    f"median({c}) AS m_{c}" for c in _FILL) + " FROM daily) SELECT athlete_id, date, " + ", ".join(
    f"round(coalesce({c}, m_{c}), 4) AS {n}" for c, n in zip(
        _FILL, ["calories", "very_active_minutes", "fairly_active_minutes"])) + " FROM daily, m"
Q["standardise"] = _ctes(DAILY) + """, f AS (SELECT athlete_id, date, steps,
    coalesce(calories, (SELECT median(calories) FROM daily)) AS calories FROM daily),
  z AS (SELECT avg(calories) AS mc, stddev_pop(calories) AS sc, avg(steps) AS ms,
    stddev_pop(steps) AS ss FROM f)
  SELECT athlete_id, date, round((calories - mc) / sc, 8) AS calories,
    round((steps - ms) / ss, 8) AS steps FROM f, z"""
Q["one_hot"] = "SELECT c_custkey, " + ", ".join(
    f"""(c_mktsegment = '{v}')::INT AS "c_mktsegment_{v}\""""
    for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer"
Q["csv_source_features"] = _COMBINED_CTES + " " + _r(
    _COMBINED, _PLAIN + " injured_in_risk_window", 9,
    _ALL_DOUBLES + " onset_day_offset recovery_duration", **COARSE)
Q["raw_table_overview"] = _ctes(DAILY, HOURLY, SLEEP, LABELS) + """
  SELECT 'daily_activity' AS "table", false AS "exists", count(*) AS rows, 9 AS columns FROM daily
  UNION ALL SELECT 'hourly_heartrate', true, count(*), 6 FROM hourly
  UNION ALL SELECT 'sleep_day', true, count(*), 4 FROM sleep
  UNION ALL SELECT 'training_sessions', true, count(*), 6 FROM events
  UNION ALL SELECT 'weight_log', true, count(*), 3 FROM orders
  UNION ALL SELECT 'athlete_metadata', true, count(*), 4 FROM customer
  UNION ALL SELECT 'train_labels', true, count(*), 5 FROM labelled
  UNION ALL SELECT unnest(['hourly_steps', 'hourly_calories', 'hourly_intensities']), false,
    NULL, NULL"""
Q["feature_store_roundtrip"] = _COMBINED_CTES + " " + _r(
    _COMBINED, "athlete_id obs_window_end injured_in_risk_window", 9,
    RATIOS + " onset_day_offset recovery_duration", **COARSE)
Q["oof_csv_roundtrip"] = Q["oof_wide"]
Q["benchmark_json_roundtrip"] = BOARD_CTES + """ SELECT model, round(score, 9) AS score,
  round(threshold, 9) AS threshold, round(f1, 9) AS f1, round("precision", 9) AS "precision",
  round(recall, 9) AS recall FROM curve JOIN (SELECT model, score FROM board
  WHERE task = 'classification') USING (model)"""
Q["stream_daily_rollup"] = """SELECT user_id AS athlete_id, CAST(ts AS DATE) AS start,
  CAST(ts AS DATE) + 1 AS "end", count(value) AS n, round(avg(value), 9) AS mean,
  round(sum(value), 4) AS total, round(min(value), 9) AS low, round(max(value), 9) AS high
  FROM events GROUP BY 1, 2, 3"""
for _name, _days in (("stream_sliding", 7), ("stream_sliding_14", 14), ("stream_sliding_30", 30)):
    Q[_name] = f"""SELECT user_id AS athlete_id, CAST(ts AS DATE) - back AS start,
  CAST(ts AS DATE) - back + {_days} AS "end", count(value) AS n, round(avg(value), 9) AS mean,
  round(sum(value), 4) AS total, round(min(value), 9) AS low, round(max(value), 9) AS high
  FROM events CROSS JOIN (SELECT i::INT AS back FROM range(0, {_days}) r(i)) GROUP BY 1, 2, 3"""
Q["combined_missing_tables"] = _ctes(LABELS) + """ SELECT athlete_id, 73 AS columns,
  0.0::DOUBLE AS training_load_7d, NULL::DOUBLE AS latest_weight, NULL::DOUBLE AS avg_hr_7d
  FROM labelled"""
Q["nan_summaries"] = """WITH e AS (SELECT event_type, user_id,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events),
  q AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY 1)
  SELECT event_type, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
    round(min(v), 6) AS min, round(max(v), 6) AS max, count(v) AS n,
    round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
    round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
    count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers,
    round(quantile_cont(v, 0.75), 6) AS tail, round(max(v), 6) AS tail_max, count(*) AS rows,
    round(avg(v), 6) AS mean_value, regr_count(v, user_id) AS fit_n,
    round(regr_slope(v, user_id), 6) AS slope, round(regr_intercept(v, user_id), 6) AS intercept,
    round(regr_r2(v, user_id), 6) AS r2, round(corr(user_id, v), 6) AS corr
  FROM e JOIN q USING (event_type) GROUP BY 1"""
Q["stream_quarantine"] = f"""SELECT CASE WHEN CAST(ts AS DATE) > {ANCHOR} THEN 'late' ELSE 'ok' END
  AS side, event_type, count(*) AS rows, max(CAST(ts AS DATE)) AS latest
  FROM events GROUP BY 1, 2"""
# Ridge with penalty 1 on one median-filled, standardised feature, fold by fold.
Q["ridge_oof"] = _ctes(LABELS, HOURLY, HEART) + """, base AS (
    SELECT athlete_id, recovery_duration AS y, avg_hr_7d AS x,
      ((row_number() OVER (ORDER BY athlete_id) - 1) % 3)::INT AS fold
    FROM labelled LEFT JOIN heart USING (athlete_id) WHERE injured_in_risk_window = 1),
  side AS (SELECT k.f, median(x) AS med FROM base JOIN (SELECT i::INT AS f FROM range(0, 3) r(i)) k
    ON base.fold <> k.f GROUP BY 1),
  scale AS (SELECT f, avg(coalesce(x, med)) AS m, stddev_pop(coalesce(x, med)) AS s,
    avg(y) AS ym FROM base JOIN side ON fold <> f GROUP BY 1),
  fit AS (SELECT f, sum((coalesce(x, med) - m) / s * (y - ym))
      / (sum(pow((coalesce(x, med) - m) / s, 2)) + 1) AS w
    FROM base JOIN side ON fold <> f JOIN scale USING (f) GROUP BY 1)
  SELECT 'Ridge' AS model, athlete_id, round(y, 6) AS actual,
    round(greatest(ym + w * (coalesce(x, med) - m) / s, 0), 6) AS predicted, fold
  FROM base JOIN side ON fold = side.f JOIN scale ON fold = scale.f JOIN fit ON fold = fit.f"""
# Newton's method: three logistic members, each without one inner fold, then their sigmoids on it.
_P = "1 / (1 + exp(-(w * x + b)))"
_NEWTON = """SELECT i + 1, inner_, w - (gw * hbb - gb * hwb) / (hww * hbb - hwb * hwb),
    b - (gb * hww - gw * hwb) / (hww * hbb - hwb * hwb) FROM ({sums})"""
_FIT_SUMS = f"""SELECT i, inner_, any_value(w) AS w, any_value(b) AS b, sum(p - y) / count(*) AS gb,
    sum((p - y) * x) / count(*) + 2.0::DOUBLE / count(*) * any_value(w) AS gw,
    sum(p * (1 - p)) / count(*) AS hbb, sum(p * (1 - p) * x) / count(*) AS hwb,
    sum(p * (1 - p) * x * x) / count(*) + 2.0::DOUBLE / count(*) AS hww
  FROM (SELECT f.i, f.inner_, f.w, f.b, r.x, r.y, {_P} AS p FROM fit f JOIN rows r ON r.inner_ <> f.inner_ WHERE f.i < 30)
  GROUP BY 1, 2"""
_CAL_SUMS = f"""SELECT i, inner_, any_value(w) AS w, any_value(b) AS b, sum(p - t) AS gb, sum((p - t) * x) AS gw,
    sum(p * (1 - p)) AS hbb, sum(p * (1 - p) * x) AS hwb, sum(p * (1 - p) * x * x) AS hww
  FROM (SELECT c.i, c.inner_, c.w, c.b, m.x, m.t, {_P} AS p FROM cal c JOIN margins m USING (inner_) WHERE c.i < 40)
  GROUP BY 1, 2"""
Q["calibration_fit"] = _ctes(LABELS, HOURLY, HEART).replace("WITH ", "WITH RECURSIVE ", 1) + f""", base AS (
    SELECT athlete_id, injured_in_risk_window AS y, avg_hr_7d AS x FROM labelled LEFT JOIN heart USING (athlete_id)),
  filled AS (SELECT athlete_id, y, coalesce(x, (SELECT median(x) FROM base)) AS x FROM base),
  rows AS (SELECT y, (x - (SELECT avg(x) FROM filled)) / (SELECT stddev_pop(x) FROM filled) AS x,
    ((row_number() OVER (PARTITION BY y ORDER BY md5('inner-42:' || athlete_id), athlete_id) - 1) % 3)::INT AS inner_
    FROM filled),
  fit AS (SELECT 0 AS i, k::INT AS inner_, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM range(0, 3) r(k)
    UNION ALL {_NEWTON.format(sums=_FIT_SUMS)}),
  base_fit AS (SELECT * FROM fit WHERE i = 30),
  held AS (SELECT inner_, count(*) FILTER (y = 1) AS held_pos, count(*) FILTER (y = 0) AS held_neg FROM rows GROUP BY 1),
  margins AS (SELECT r.inner_, w * x + b AS x,
      CASE WHEN y = 1 THEN (held_pos + 1.0::DOUBLE) / (held_pos + 2) ELSE 1.0::DOUBLE / (held_neg + 2) END AS t
    FROM rows r JOIN base_fit USING (inner_) JOIN held USING (inner_)),
  cal AS (SELECT 0 AS i, k::INT AS inner_, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM range(0, 3) r(k)
    UNION ALL {_NEWTON.format(sums=_CAL_SUMS)})
  SELECT inner_ AS "inner", (sum(held_pos) OVER () - held_pos)::BIGINT AS train_pos,
    (sum(held_neg) OVER () - held_neg)::BIGINT AS train_neg, held_pos, held_neg,
    round(f.w, 3) AS weight, round(f.b, 3) AS bias, round(c.w, 3) AS slope, round(c.b, 3) AS intercept
  FROM held JOIN base_fit f USING (inner_) JOIN cal c USING (inner_) WHERE c.i = 40"""
Q["one_hot_many_levels"] = """WITH o AS (SELECT o_orderkey, o_orderstatus AS s,
    'Clerk#' || lpad((o_orderkey % 12007)::VARCHAR, 9, '0') AS c FROM orders),
  r AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY s) - 1 AS a,
    dense_rank() OVER (ORDER BY c) - 1 + (SELECT count(DISTINCT s) FROM o) AS b FROM o)
  SELECT o_orderkey, (SELECT count(DISTINCT s) + count(DISTINCT c) FROM o) AS size, a || ',' || b AS slots FROM r"""
Q["training_side_stats"] = """WITH l AS (SELECT l_orderkey % 5 AS fold,
    CASE WHEN l_linenumber > 1 THEN l_quantity END AS quantity,
    CASE WHEN l_partkey % 3 > 0 THEN l_extendedprice END AS price,
    CASE WHEN l_orderkey % 5 > 0 THEN l_discount END AS discount,
    CASE WHEN l_suppkey % 7 <> 1 THEN l_tax END AS tax FROM lineitem),
  s AS (SELECT i::INT AS side, l.* EXCLUDE (fold) FROM l JOIN range(0, 5) r(i) ON l.fold <> i),
  v AS (SELECT * FROM s UNPIVOT INCLUDE NULLS (x FOR feature IN (quantity, price, discount, tax))),
  m AS (SELECT side, feature, median(x) AS med FROM v GROUP BY 1, 2)
  SELECT side, feature, round(any_value(med), 6) AS median, round(avg(coalesce(x, med)), 6) AS mean,
    round(stddev_pop(coalesce(x, med)), 6) AS std FROM v JOIN m USING (side, feature) GROUP BY 1, 2"""
Q["shapley_additivity"] = _ctes(LABELS) + " SELECT athlete_id, 68::BIGINT AS features, true AS adds_up FROM labelled"
Q["tied_models"] = BOARD_CTES + """, two AS (SELECT task, metric, score, model, list_position(['w7', 'w14', 'w30'], model) * 2 AS p FROM board
    UNION ALL SELECT task, metric, score, 'zz_' || model, list_position(['w7', 'w14', 'w30'], model) * 2 - 1 FROM board),
  r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY CASE WHEN metric = 'F1' THEN -score ELSE score END, p)::INT AS place
    FROM two WHERE p IS NOT NULL)
  SELECT task, model, place, first_value(model) OVER (PARTITION BY task ORDER BY place) AS best FROM r"""
Q["custom_cutoff"] = SCORED_CTES + " " + " UNION ALL ".join(
    f"""SELECT '{n}' AS cutoff, {c}::DOUBLE AS value, count(*) AS entities, count(*) FILTER (prob >= {c}) AS high_risk,
  round(avg(CASE WHEN prob >= {c} THEN 1.0 ELSE 0.0 END), 9) AS share FROM scored"""
    for n, c in (("user", 0.2), ("tuned", 0.5), ("default", 0.43)))
Q["mixed_date_layouts"] = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 8 < 7 THEN CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN o_orderkey % 8 IN (1, 2, 3, 4) THEN ((o_orderkey % 1440) // 60)::INT WHEN o_orderkey % 8 < 7 THEN 0 END AS hour FROM orders"""
Q["csv_quoted_breaks"] = """SELECT event_type || '|"part" ' || (event_id % 3) AS kind, count(*) AS rows,
  count(DISTINCT user_id) AS entities, max(event_id)::VARCHAR AS last FROM events GROUP BY 1"""
Q["observed_boundary"] = " UNION ALL ".join(
    f"""SELECT '{n}' AS "table", count(*) AS rows, count(*) FILTER (CAST({d} AS DATE) > {a}) AS rows_after,
  max(CAST({d} AS DATE)) AS latest FROM {t}"""
    for n, t, d, a in (("events", "events", "ts", ANCHOR), ("orders", "orders", "o_orderdate", ORDERS_ANCHOR), ("stream", "events", "ts", ANCHOR)))
Q["distinct_by_window"] = f"""WITH {EV}, cal AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS day FROM ev),
  w AS (SELECT day, d::INT AS days FROM cal, (VALUES (7), (14), (30)) v(d))
  SELECT day, days, (SELECT count(DISTINCT user_id) FROM ev WHERE date BETWEEN w.day - (w.days - 1) AND w.day) AS exact, true AS near FROM w"""
Q["board_kpis"] = BOARD_CTES + """ SELECT task, metric, count(*) AS models,
  max(score) AS max_score, min(score) AS min_score FROM board GROUP BY 1, 2"""
Q["ranked_board"] = BOARD_CTES + """ SELECT *, row_number() OVER (PARTITION BY task ORDER BY
  CASE WHEN metric = 'F1' THEN -score ELSE score END, model)::INT AS place FROM board"""
Q["null_scores"] = _SCORE_CTES + """, s AS (SELECT model, y_true,
    CASE WHEN athlete_id % 3 > 0 AND prob >= 0.5 THEN 1 ELSE 0 END AS p FROM scores),
  c AS (SELECT model, count(*) FILTER (y_true = 1 AND p = 1)::DOUBLE AS tp,
    count(*) FILTER (y_true <> 1 AND p = 1)::DOUBLE AS fp,
    count(*) FILTER (y_true = 1 AND p = 0)::DOUBLE AS fn, count(y_true)::DOUBLE AS n FROM s GROUP BY 1)
  SELECT model, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
    round((n - fp - fn) / n, 4) AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS curve_recall,
    round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS curve_precision FROM c"""
Q["model_comparison"] = BOARD_CTES + """ SELECT model,
  max(score) FILTER (task = 'classification') AS classification, CAST(NULL AS DOUBLE) AS onset,
  max(score) FILTER (task = 'recovery') AS recovery FROM board GROUP BY 1"""
Q["key_intersection"] = """SELECT DISTINCT o_custkey AS athlete_id FROM orders
  WHERE o_custkey IN (SELECT user_id FROM events)"""
Q["first_per_key"] = """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1"""
Q["window_slices"] = f"""WITH {EV} SELECT '30d' AS span, count(*) AS rows,
    count(DISTINCT user_id) AS entities FROM ev WHERE {D30}
  UNION ALL SELECT '14d', count(*), count(DISTINCT user_id) FROM ev WHERE {D14}
  UNION ALL SELECT '7d', count(*), count(DISTINCT user_id) FROM ev WHERE {D7}
  UNION ALL SELECT 'prev_7d', count(*), count(DISTINCT user_id) FROM ev WHERE {PREV}"""
