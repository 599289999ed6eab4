"""Feature groups per entity and their assembly into one wide table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import (
    as_anchor,
    bmi_from,
    category_weight,
    cell,
    has_text,
    ratio,
    session_hours,
    weekly_share,
)
from tidemark.operators.guards import assert_unique, guard_columns
from tidemark.operators.windows import (
    DAYS_7,
    DAYS_14,
    DAYS_30,
    WEEK_BEFORE,
    Measure,
    anchor_windows,
    at_anchors,
    window_agg,
)
from tidemark.schema import (
    ANCHOR,
    DATE,
    DEFAULT_ANCHOR,
    KEY,
    NOT_FEATURES,
    SESSION_PATTERNS,
    SESSION_WEIGHTS,
    TABLES,
    TARGETS,
)

Anchor = str | dt.date | Column

WINDOW_TABLES = ["daily_activity", "hourly_heartrate", "sleep_day", "training_sessions", "weight_logs"]
PROFILE_COLUMNS = list(TABLES["athlete_metadata"].columns)


def _value(df: DataFrame, name: str) -> Column:
    """A metric column, null throughout where the table lacks it."""
    return cell(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def on_spine(spine: DataFrame | None, features: DataFrame, key: str = KEY) -> DataFrame:
    """All entities of the spine; those without rows keep nulls."""
    return features if spine is None else spine.select(key).join(features, key, "left")


def with_active_minutes(df: DataFrame) -> DataFrame:
    """Sum of the three activity levels: an absent level counts as 0, a null one as unknown."""
    levels = ["very_active_minutes", "fairly_active_minutes", "lightly_active_minutes"]
    total = F.lit(0.0)
    for level in levels:
        total = total + (cell(level) if level in df.columns else F.lit(0.0))
    return df.withColumn("total_active_minutes", total)


def activity_features(
    df: DataFrame, anchor: Anchor, spine: DataFrame | None = None, key: str = KEY, date: str = DATE
) -> DataFrame:
    rows = with_active_minutes(df)
    steps, active = _value(rows, "steps"), F.col("total_active_minutes")
    distance, calories = _value(rows, "distance"), _value(rows, "calories")
    sedentary = _value(rows, "sedentary_minutes")
    measures = [
        Measure("avg_steps_30d", DAYS_30, "mean", steps),
        Measure("std_steps_30d", DAYS_30, "std", steps),
        Measure("max_steps_30d", DAYS_30, "max", steps),
        Measure("min_steps_30d", DAYS_30, "min", steps),
        Measure("avg_distance_30d", DAYS_30, "mean", distance),
        Measure("avg_calories_30d", DAYS_30, "mean", calories),
        Measure("avg_sedentary_minutes_30d", DAYS_30, "mean", sedentary),
        Measure("avg_active_minutes_30d", DAYS_30, "mean", active),
        Measure("avg_steps_14d", DAYS_14, "mean", steps),
        Measure("avg_steps_7d", DAYS_7, "mean", steps),
        Measure("std_steps_7d", DAYS_7, "std", steps),
        Measure("avg_distance_7d", DAYS_7, "mean", distance),
        Measure("avg_calories_7d", DAYS_7, "mean", calories),
        Measure("avg_sedentary_minutes_7d", DAYS_7, "mean", sedentary),
        Measure("avg_active_minutes_7d", DAYS_7, "mean", active),
    ]
    out = window_agg(rows, anchor, measures, key, date).withColumns(
        {
            "steps_change_7d_vs_30d": ratio("avg_steps_7d", "avg_steps_30d"),
            "activity_change_7d_vs_30d": ratio("avg_active_minutes_7d", "avg_active_minutes_30d"),
            "calories_change_7d_vs_30d": ratio("avg_calories_7d", "avg_calories_30d"),
        }
    )
    return on_spine(spine, out, key)


def heart_rate_features(
    df: DataFrame, anchor: Anchor, spine: DataFrame | None = None, key: str = KEY, date: str = DATE
) -> DataFrame:
    rate = _value(df, "heart_rate")
    low = _value(df, "min_heart_rate") if "min_heart_rate" in df.columns else rate
    high = _value(df, "max_heart_rate") if "max_heart_rate" in df.columns else rate
    measures = [
        Measure("avg_hr_30d", DAYS_30, "mean", rate),
        Measure("std_hr_30d", DAYS_30, "std", rate),
        Measure("min_hr_30d", DAYS_30, "min", low),
        Measure("max_hr_30d", DAYS_30, "max", high),
        Measure("avg_hr_14d", DAYS_14, "mean", rate),
        Measure("avg_hr_7d", DAYS_7, "mean", rate),
        Measure("std_hr_7d", DAYS_7, "std", rate),
    ]
    out = window_agg(df, anchor, measures, key, date).withColumns(
        {
            "hr_change_7d_vs_30d": ratio("avg_hr_7d", "avg_hr_30d"),
            "hr_cv_30d": ratio("std_hr_30d", "avg_hr_30d"),
        }
    )
    return on_spine(spine, out, key)


def sleep_features(
    df: DataFrame, anchor: Anchor, spine: DataFrame | None = None, key: str = KEY, date: str = DATE
) -> DataFrame:
    asleep, in_bed = _value(df, "sleep_minutes"), _value(df, "time_in_bed")
    measures = [
        Measure("avg_sleep_minutes_30d", DAYS_30, "mean", asleep),
        Measure("std_sleep_minutes_30d", DAYS_30, "std", asleep),
        Measure("avg_time_in_bed_30d", DAYS_30, "mean", in_bed),
        Measure("minimum_sleep_30d", DAYS_30, "min", asleep),
        Measure("avg_sleep_minutes_14d", DAYS_14, "mean", asleep),
        Measure("avg_sleep_minutes_7d", DAYS_7, "mean", asleep),
        Measure("avg_time_in_bed_7d", DAYS_7, "mean", in_bed),
    ]
    spread = ratio("std_sleep_minutes_30d", "avg_sleep_minutes_30d")
    out = window_agg(df, anchor, measures, key, date).withColumns(
        {
            "sleep_change_7d_vs_30d": ratio("avg_sleep_minutes_7d", "avg_sleep_minutes_30d"),
            "sleep_efficiency_30d": ratio("avg_sleep_minutes_30d", "avg_time_in_bed_30d"),
            "sleep_variability_30d": spread,
            "sleep_cv_30d": spread,
        }
    )
    return on_spine(spine, out, key)


TRAINING_COLUMNS = [
    "training_sessions_30d", "training_minutes_30d", "training_load_30d", "practice_sessions_30d",
    "scrimmage_sessions_30d", "gym_sessions_30d", "training_sessions_14d", "training_minutes_14d",
    "training_load_14d", "training_sessions_7d", "training_minutes_7d", "training_load_7d",
    "training_load_change_7d_vs_30d", "training_load_change_7d_vs_previous_7d",
    "training_load_zscore",
]


def with_session_load(
    df: DataFrame, weights: dict[str, float] | None = None, kind: str = "sport_session_type"
) -> DataFrame:
    """Duration in hours and minutes and the weighted load of every session."""
    has_hours = "start_hour" in df.columns and "end_hour" in df.columns
    hours = (
        session_hours(cell("start_hour"), cell("end_hour")) if has_hours else session_hours(None, None)
    )
    table = SESSION_WEIGHTS if weights is None else weights
    weight = category_weight(cell(kind), table) if kind in df.columns else F.lit(1.0)
    return (
        df.withColumn("duration_hours", hours)
        .withColumn("duration_minutes", F.col("duration_hours") * F.lit(60.0))
        .withColumn("training_load", F.col("duration_hours") * weight)
    )


def session_type_counts(
    df: DataFrame,
    anchor: Anchor,
    patterns: dict[str, str] | None = None,
    kind: str = "sport_session_type",
    key: str = KEY,
    date: str = DATE,
) -> DataFrame:
    """Sessions per entity in the last 30 days whose type text contains each pattern."""
    words = patterns or {f"{p}_sessions_30d": p for p in SESSION_PATTERNS}
    measures = [Measure(n, DAYS_30, "hits", has_text(cell(kind), w)) for n, w in words.items()]
    return window_agg(df, anchor, measures, key, date)


def training_block(
    df: DataFrame,
    anchor: Anchor,
    weights: dict[str, float] | None = None,
    patterns: dict[str, str] | None = None,
    kind: str = "sport_session_type",
    key: str = KEY,
    date: str = DATE,
) -> DataFrame:
    """Counts, minutes, loads and load ratios of the entities that have sessions."""
    rows = with_session_load(df, weights, kind)
    minutes, load = F.col("duration_minutes"), F.col("training_load")
    words = patterns or {f"{p}_sessions_30d": p for p in SESSION_PATTERNS}
    text = cell(kind) if kind in df.columns else F.lit(None).cast("string")
    measures = [
        Measure("training_sessions_30d", DAYS_30, "count", minutes),
        Measure("training_minutes_30d", DAYS_30, "sum", minutes),
        Measure("training_load_30d", DAYS_30, "sum", load),
        *[Measure(n, DAYS_30, "hits", has_text(text, w)) for n, w in words.items()],
        Measure("training_sessions_14d", DAYS_14, "count", minutes),
        Measure("training_minutes_14d", DAYS_14, "sum", minutes),
        Measure("training_load_14d", DAYS_14, "sum", load),
        Measure("training_sessions_7d", DAYS_7, "count", minutes),
        Measure("training_minutes_7d", DAYS_7, "sum", minutes),
        Measure("training_load_7d", DAYS_7, "sum", load),
        Measure("_std_load_30d", DAYS_30, "std", load),
        Measure("_load_prev_7d", WEEK_BEFORE, "sum", load),
    ]
    out = window_agg(rows, anchor, measures, key, date)
    counts = [m.name for m in measures if m.how in ("count", "hits")]
    weekly = weekly_share("training_load_30d")
    recent = F.col("training_load_7d")
    return out.withColumns(
        {
            **{c: F.col(c).cast("double") for c in counts},
            "training_load_change_7d_vs_30d": ratio(recent, weekly),
            "training_load_change_7d_vs_previous_7d": ratio(recent, "_load_prev_7d"),
            "training_load_zscore": ratio(recent - weekly, "_std_load_30d"),
        }
    ).drop("_load_prev_7d", "_std_load_30d")


def zero_training(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Entities without sessions: every load column, ratios included, is zero."""
    names = TRAINING_COLUMNS if columns is None else columns
    return df.withColumns({c: F.coalesce(cell(c), F.lit(0.0)) for c in names if c in df.columns})


def training_features(
    df: DataFrame,
    anchor: Anchor,
    spine: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    patterns: dict[str, str] | None = None,
    kind: str = "sport_session_type",
    key: str = KEY,
    date: str = DATE,
) -> DataFrame:
    """The training block on a spine, zeros where an entity has no sessions."""
    block = training_block(df, anchor, weights, patterns, kind, key, date)
    out = on_spine(spine, block, key)
    return zero_training(out, [c for c in out.columns if c != key])


def one_per_key(
    df: DataFrame, key: str = KEY, order: list[str] | None = None, newest: bool = False
) -> DataFrame:
    """One row per key: the smallest (or largest) by the declared order.

    A plain grouped minimum over structs, so copies of one key are combined before
    the shuffle and never gathered.
    """
    rest = [c for c in df.columns if c != key]
    lead = list(order or [])
    packed = F.struct(*[cell(c) for c in [*lead, *[c for c in rest if c not in lead]]])
    pick = F.max(packed) if newest else F.min(packed)
    return (
        df.where(cell(key).isNotNull())
        .groupBy(key)
        .agg(pick.alias("_r"))
        .select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
    )


WEIGHT_COLUMNS = [
    "latest_weight", "average_weight_30d", "latest_bmi", "latest_body_fat", "weight_change_30d",
]


def weight_block(
    df: DataFrame,
    anchor: Anchor,
    tiebreak: list[str] | None = None,
    key: str = KEY,
    date: str = DATE,
) -> DataFrame:
    """Latest known readings and mean weight of the last 30 days, where there are any."""
    newest = F.struct(cell(date), *[cell(c) for c in (tiebreak or [])])
    weight = _value(df, "weight")
    measures = [
        Measure("latest_weight", DAYS_30, "latest", weight, newest),
        Measure("average_weight_30d", DAYS_30, "mean", weight),
        Measure("latest_bmi", DAYS_30, "latest", _value(df, "bmi"), newest),
        Measure("latest_body_fat", DAYS_30, "latest", _value(df, "body_fat"), newest),
    ]
    return window_agg(df, anchor, measures, key, date)


def weight_fallbacks(df: DataFrame, baseline: Column, height: Column) -> DataFrame:
    """Latest weight falls back to the baseline, the mean to the latest, BMI to a computed one."""
    latest = F.coalesce(F.col("latest_weight"), baseline)
    return df.withColumns(
        {
            "latest_weight": latest,
            "average_weight_30d": F.coalesce(F.col("average_weight_30d"), latest),
            "latest_bmi": F.coalesce(F.col("latest_bmi"), bmi_from(latest, height)),
            "weight_change_30d": F.coalesce(latest - baseline, F.lit(0.0)),
        }
    )


def weight_features(
    df: DataFrame,
    profile: DataFrame | None,
    anchor: Anchor,
    spine: DataFrame | None = None,
    tiebreak: list[str] | None = None,
    profile_order: list[str] | None = None,
    key: str = KEY,
    date: str = DATE,
) -> DataFrame:
    """Latest and mean weight with profile fallbacks, weight change, BMI and body fat.

    ``tiebreak`` columns order readings of one day, newest last.
    """
    out = on_spine(spine, weight_block(df, anchor, tiebreak, key, date), key)
    base, height = F.lit(None).cast("double"), F.lit(None).cast("double")
    if profile is not None:
        wanted = ["weight_kg_baseline", "height_cm"]
        known = profile_features(profile, None, profile_order, wanted, key)
        out = out.join(known, key, "left")
        base, height = F.col("weight_kg_baseline"), F.col("height_cm")
    return weight_fallbacks(out, base, height).select(key, *WEIGHT_COLUMNS)


def profile_features(
    df: DataFrame,
    spine: DataFrame | None = None,
    order: list[str] | None = None,
    columns: list[str] | None = None,
    key: str = KEY,
) -> DataFrame:
    """Profile attributes, one row per entity; attributes the table lacks are null."""
    wanted = columns or PROFILE_COLUMNS
    types = TABLES["athlete_metadata"].columns
    present = [c for c in wanted if c in df.columns]
    lead = [c for c in (order or []) if c not in present and c != key]
    picked = one_per_key(df.select(key, *present, *lead), key, order)
    out = picked.select(
        key,
        *[
            cell(c)
            if c in present
            else F.lit(None).cast(types[c][1] if c in types else T.StringType()).alias(c)
            for c in wanted
        ],
    )
    return on_spine(spine, out, key)


def entity_spine(
    labels: DataFrame | None, profile: DataFrame | None, activity: DataFrame | None, key: str = KEY
) -> DataFrame:
    """Distinct entities of the first table that has any: labels, profile, activity."""
    for table in (labels, profile, activity):
        if table is not None and key in table.columns and table.select(key).limit(1).count():
            return table.select(cell(key).cast("long").alias(key)).dropna().distinct()
    raise ValueError("no table names any entity")


def anchor_of(labels: DataFrame | None, anchor: str | dt.date | None) -> dt.date:
    """Anchor for the run: the given one, else the earliest the labels carry, else the default.

    The earliest is the only choice that lies after no entity's own anchor.
    """
    if anchor is not None:
        return anchor if isinstance(anchor, dt.date) else dt.date.fromisoformat(str(anchor)[:10])
    if labels is not None and ANCHOR in labels.columns:
        found = labels.agg(F.min(cell(ANCHOR).cast("date"))).first()[0]
        if found is not None:
            return found
    return dt.date.fromisoformat(DEFAULT_ANCHOR)


def merge_groups(spine: DataFrame, groups: list[DataFrame], key: str = KEY) -> DataFrame:
    """Left-join feature groups; a column name belongs to the first group that brings it."""
    out = spine
    for g in groups:
        fresh = [c for c in g.columns if c != key and c not in out.columns]
        if fresh:
            out = out.join(g.select(key, *[cell(c) for c in fresh]), key, "left")
    return out


def attach_labels(
    features: DataFrame,
    labels: DataFrame,
    targets: list[str] | None = None,
    key: str = KEY,
    unique: bool = True,
) -> DataFrame:
    """Left-join targets; a label key that comes twice fails the job instead of doubling rows."""
    have = [t for t in (targets or TARGETS) if t in labels.columns]
    if not have:
        return features
    side = labels.select(key, *have)
    return features.join(assert_unique(side, key) if unique else side, key, "left")


def _window_groups(
    have: dict[str, DataFrame],
    at: Anchor,
    weights: dict[str, float] | None,
    patterns: dict[str, str] | None,
    tiebreak: list[str] | None,
    key: str,
) -> list[DataFrame]:
    """The feature groups that come from time-stamped tables."""
    return [
        activity_features(have["daily_activity"], at, key=key),
        heart_rate_features(have["hourly_heartrate"], at, key=key),
        sleep_features(have["sleep_day"], at, key=key),
        training_block(have["training_sessions"], at, weights, patterns, key=key),
        weight_block(have["weight_logs"], at, tiebreak, key),
    ]


def _tables(raw: dict[str, DataFrame], session: SparkSession) -> dict[str, DataFrame]:
    """The raw tables; one that is not there acts as an empty one: the columns are always the same."""
    return {
        name: raw[name] if raw.get(name) is not None else session.createDataFrame([], TABLES[name].schema)
        for name in [*WINDOW_TABLES, "athlete_metadata"]
    }


def _filled(wide: DataFrame, patterns: dict[str, str] | None) -> DataFrame:
    """Fills that need the spine, as plain expressions on the joined rows, and the column guard."""
    wide = zero_training(wide, [*TRAINING_COLUMNS, *(patterns or {})])
    none = F.lit(None).cast("double")
    held = {c: cell(c).cast("double") if c in wide.columns else none
            for c in ("weight_kg_baseline", "height_cm")}
    place = wide.columns.index("latest_weight")
    own = [c for c in wide.columns if c not in WEIGHT_COLUMNS]
    filled = weight_fallbacks(wide, held["weight_kg_baseline"], held["height_cm"])
    order = [*own[:place], *WEIGHT_COLUMNS, *own[place:]]
    wide = filled.select(*[cell(c) for c in order])
    guard_columns(wide, allowed=[ANCHOR, *TARGETS])
    return wide


def combine_features(
    raw: dict[str, DataFrame],
    anchor: str | dt.date | None = None,
    include_labels: bool = True,
    weights: dict[str, float] | None = None,
    patterns: dict[str, str] | None = None,
    tiebreak: list[str] | None = None,
    profile_order: list[str] | None = None,
    spine: DataFrame | None = None,
    key: str = KEY,
) -> DataFrame:
    """The wide feature table: one row per entity, guarded, labels attached last."""
    labels, profile = raw.get("train_labels"), raw.get("athlete_metadata")
    activity = raw.get("daily_activity")
    entities = spine if spine is not None else entity_spine(labels, profile, activity, key)
    at = anchor_of(labels, anchor)
    have = _tables(raw, entities.sparkSession)
    groups = _window_groups(have, at, weights, patterns, tiebreak, key)
    groups.append(profile_features(have["athlete_metadata"], order=profile_order, key=key))
    base = entities.select(key).withColumn(ANCHOR, as_anchor(at))
    wide = _filled(merge_groups(base, groups, key), patterns)
    if include_labels and labels is not None:
        wide = attach_labels(wide, labels, key=key)
    return wide


def combine_at_anchors(
    raw: dict[str, DataFrame],
    anchors: DataFrame | None = None,
    include_labels: bool = True,
    weights: dict[str, float] | None = None,
    patterns: dict[str, str] | None = None,
    tiebreak: list[str] | None = None,
    profile_order: list[str] | None = None,
    default: str | dt.date | None = None,
    key: str = KEY,
) -> DataFrame:
    """The wide feature table with every entity at its own anchor, or at several.

    ``anchors`` has (key, anchor) rows, the labels by default; an entity without an anchor
    takes ``default``, else the earliest of all.  One row per entity and anchor.  Labels that
    carry anchors are attached to the row of their anchor, others to all rows of the entity.
    """
    labels = raw.get("train_labels")
    named = labels if anchors is None else anchors
    if named is None or ANCHOR not in named.columns:
        raise ValueError(f"no table names anchors: '{ANCHOR}' is missing")
    at = F.coalesce(cell(ANCHOR).cast("date"), as_anchor(anchor_of(named, default)))
    pairs = named.where(cell(key).isNotNull()).select(cell(key).cast("long").alias(key), at.alias(ANCHOR)).distinct()
    days = DAYS_30.first + 1
    windows = anchor_windows(pairs, days, key)
    # From here on an entity at an anchor is one key.
    who = F.struct(cell(key), cell(ANCHOR)).alias("_who")
    have = _tables(raw, pairs.sparkSession)
    near = {name: at_anchors(have[name], windows, days, key).select(who, "*") for name in WINDOW_TABLES}
    groups = _window_groups(near, F.col("_who")[ANCHOR], weights, patterns, tiebreak, "_who")
    met = merge_groups(pairs.select(who), groups, "_who")
    met = met.select(F.col("_who")[key].alias(key), F.col("_who")[ANCHOR].alias(ANCHOR), "*").drop("_who")
    profile = profile_features(have["athlete_metadata"], order=profile_order, key=key)
    wide = _filled(merge_groups(met, [profile], key), patterns)
    if not include_labels or labels is None:
        return wide
    if ANCHOR not in labels.columns:
        return attach_labels(wide, labels, key=key)
    have_targets = [t for t in TARGETS if t in labels.columns]
    side = labels.select(F.struct(cell(key).cast("long").alias(key), at.alias(ANCHOR)).alias("_who"), *have_targets)
    both = attach_labels(wide.withColumn("_who", F.struct(cell(key), cell(ANCHOR))), side, key="_who")
    return both.drop("_who")


def feature_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Every column a model may see: all but the key, the anchor and the targets."""
    out = set(NOT_FEATURES if exclude is None else exclude)
    return [c for c in df.columns if c not in out]
