"""From probabilities to decisions: submission, ranking, cards and what-if scoring."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cell, clip, half_even_int, meets, round4, same_entity
from tidemark.operators.ordering import global_rank, running_totals
from tidemark.schema import DEFAULT_CUTOFF, KEY

ENSEMBLE = "Top3_Ensemble"
ONSET_BOUNDS = (1.0, 30.0)
RECOVERY_BOUNDS = (0.0, None)


def choose_classifier(
    board: DataFrame, stored: list[str], members: list[str], fallback: str = "GBT"
) -> tuple[str, float]:
    """(model, cutoff) for scoring.

    The ensemble wins when two of its members are stored and no stored single model
    scores higher; else the best stored single model; else a default.  The board has
    one row per model, so it is read on the driver.
    """
    rows = board.where(F.col("task") == "classification").collect()
    meta = {r["model"]: r for r in rows}

    def cutoff(name: str) -> float:
        r = meta.get(name)
        return 0.5 if r is None or r["best_threshold"] is None else r["best_threshold"]

    single = {m: r["score"] for m, r in meta.items() if m in stored and m != ENSEMBLE}
    best = max(single, key=lambda m: (single[m], -stored.index(m))) if single else None
    if ENSEMBLE in meta and len([m for m in members if m in stored]) >= 2:
        if meta[ENSEMBLE]["score"] >= (single[best] if best else 0.0):
            return ENSEMBLE, cutoff(ENSEMBLE)
    if best is not None:
        return best, cutoff(best)
    if not stored:
        raise FileNotFoundError("no stored classification models")
    name = fallback if fallback in stored else stored[0]
    return name, cutoff(name)


def choose_regressor(
    board: DataFrame, task: str, stored: list[str], wanted: str | None = None, fallback: str = "GBT"
) -> str:
    """Lowest error among stored models; an unknown request falls back to the first stored."""
    if not stored:
        raise FileNotFoundError(f"no stored {task} models")
    if wanted is not None:
        return wanted if wanted in stored else stored[0]
    rows = board.where((F.col("task") == task) & F.col("model").isin(*stored)).collect()
    if rows:
        return min(rows, key=lambda r: (r["score"], stored.index(r["model"])))["model"]
    return fallback if fallback in stored else stored[0]


def fold_mean(columns: list[str], bounds: tuple[float | None, float | None] | None = None) -> Column:
    """Mean of per-fold predictions; with bounds, clipped per fold and again as a mean."""
    parts = [cell(c) for c in columns]
    if bounds:
        parts = [clip(p, *bounds) for p in parts]
    mean = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
    return clip(mean, *bounds) if bounds else mean


def submission(
    scored: DataFrame,
    cutoff: float | Column,
    key: str = KEY,
    prob: str = "prob",
    onset: str = "onset",
    recovery: str = "recovery",
    mask_negative: bool = False,
) -> DataFrame:
    """Key, 0/1 decision, onset day and recovery days for every entity."""
    hit = meets(cell(prob), cutoff)
    day = half_even_int(clip(cell(onset), *ONSET_BOUNDS))
    days = half_even_int(clip(cell(recovery), *RECOVERY_BOUNDS))
    if mask_negative:
        day, days = F.when(hit == 1, day), F.when(hit == 1, days)
    return scored.select(
        key,
        hit.alias("injured_in_risk_window"),
        day.alias("onset_day_offset"),
        days.alias("recovery_duration"),
    )


def predicted_rate(sub: DataFrame) -> DataFrame:
    y = F.col("injured_in_risk_window")
    return sub.agg(
        F.count("*").alias("entities"),
        F.sum(y).alias("positives"),
        (F.avg((y == 1).cast("double")) * 100).alias("rate_pct"),
    )


def high_risk_share(scored: DataFrame, cutoff: float = DEFAULT_CUTOFF, prob: str = "prob") -> DataFrame:
    high = cell(prob) >= F.lit(cutoff)
    return scored.agg(
        F.count("*").alias("entities"),
        F.count_if(high).alias("high_risk"),
        F.avg(high.cast("double")).alias("share"),
    )


def checked_cutoff(cutoff: float | None, tuned: float | None) -> float:
    """A user's cutoff (0.05 to 0.95) replaces the tuned one; without either, the default."""
    if cutoff is None:
        return DEFAULT_CUTOFF if tuned is None else tuned
    if not 0.05 <= cutoff <= 0.95:
        raise ValueError("a custom cutoff lies between 0.05 and 0.95")
    return cutoff


def risk_view(
    scored: DataFrame,
    cutoff: float = DEFAULT_CUTOFF,
    keep: list[str] | None = None,
    key: str = KEY,
    prob: str = "prob",
    onset: str | None = "onset",
    recovery: str | None = None,
) -> DataFrame:
    """Percent, tier and, above the cutoff only, expected onset and recovery."""
    p = cell(prob)
    high = p >= F.lit(cutoff)

    def shown(c: str) -> Column:
        return F.when(high, half_even_int(cell(c)).cast("string")).otherwise(F.lit("-"))

    cols = [F.bround(p * 100, 1).alias("risk_pct"),
            F.when(high, "High Risk").otherwise("Low Risk").alias("status")]
    if onset:
        cols.append(shown(onset).alias("est_onset_day"))
    if recovery:
        cols.append(shown(recovery).alias("est_recovery_days"))
    return scored.select(key, *(keep or []), *cols)


def risk_ranking(
    scored: DataFrame,
    cutoff: float = DEFAULT_CUTOFF,
    keep: list[str] | None = None,
    key: str = KEY,
    **names: str | None,
) -> DataFrame:
    """All entities by falling risk with a 1-based rank; the key settles ties."""
    view = risk_view(scored, cutoff, keep, key, **names)
    return global_rank(view, [F.desc("risk_pct"), F.asc(key)])


def team_ranking(
    scored: DataFrame,
    team: str,
    cutoff: float = DEFAULT_CUTOFF,
    keep: list[str] | None = None,
    key: str = KEY,
    **names: str | None,
) -> DataFrame:
    """Rank by falling risk within each team; a large team is ranked in ranges, not one task."""
    view = risk_view(scored, cutoff, [team, *(keep or [])], key, **names)
    order = [F.desc("risk_pct"), F.asc(key)]
    return running_totals(view, order, {"team_rank": F.lit(1)}, by=[team])


def top_risks(
    scored: DataFrame, k: int, cutoff: float = DEFAULT_CUTOFF, keep: list[str] | None = None,
    key: str = KEY, **names: str | None,
) -> DataFrame:
    """The ``k`` highest risks, kept by per-task heaps instead of a full sort."""
    view = risk_view(scored, cutoff, keep, key, **names)
    return view.orderBy(F.desc("risk_pct"), F.asc(key)).limit(k)


def entity_card(scored: DataFrame, entity: str | int, cutoff: float = DEFAULT_CUTOFF,
                key: str = KEY, **names: str | None) -> DataFrame:
    """The card of one entity, found by the text of its key."""
    one = scored.where(same_entity(scored, key, entity))
    names.setdefault("recovery", "recovery")
    return risk_view(one, cutoff, None, key, **names)


def scenario_rows(
    features: DataFrame, scenarios: dict[str, dict[str, float]], key: str = KEY
) -> DataFrame:
    """Every entity under every scenario: named columns take the scenario's value.

    The scenarios are a short literal list, unfolded per row; nothing is shuffled.
    """
    touched = sorted({c for s in scenarios.values() for c in s})
    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                *[
                    (F.lit(float(s[c])) if c in s else F.lit(None).cast("double")).alias(f"_n{i}")
                    for i, c in enumerate(touched)
                ],
            )
            for name, s in scenarios.items()
        ]
    )
    rows = features.select("*", F.inline(options))
    changes = {
        c: F.coalesce(F.col(f"_n{i}"), cell(c).cast("double"))
        for i, c in enumerate(touched)
        if c in features.columns
    }
    return rows.withColumns(changes).drop(*[f"_n{i}" for i in range(len(touched))])


def what_if(
    features: DataFrame,
    scenarios: dict[str, dict[str, float]],
    score: Callable[[DataFrame], DataFrame],
    key: str = KEY,
    prob: str = "prob",
) -> DataFrame:
    """Risk before and after each scenario and the difference.

    ``score`` adds column ``prob``.  The untouched scores ride along under the
    scenario rows, so no join brings the two together.
    """
    before = score(features).withColumn("original", cell(prob)).select(*features.columns, "original")
    after = score(scenario_rows(before, scenarios, key))
    return after.select(
        key, "scenario", "original", cell(prob).alias("simulated"),
        (cell(prob) - F.col("original")).alias("delta"),
    )
