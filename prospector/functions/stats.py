"""Rates, intervals and costs as column expressions; a zero denominator gives null, never zero."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(events: Column, trials: Column) -> Column:
    return F.when(trials > 0, events / trials)


def coverage_corrected_rate(events: Column, trials: Column, uncovered: Column) -> Column:
    """The rate over rows that were evaluated; null if there are none."""
    return rate(events, trials - uncovered)


def checked_counts(events: Column, trials: Column) -> Column:
    """trials, if they are positive and at least the events, which are not negative; else an error."""
    good = (trials > 0) & (events >= 0) & (events <= trials)
    return F.when(good, trials).otherwise(F.raise_error(F.lit("events must be 0 to trials, and trials positive")).cast("long"))


def wilson(events: Column, trials: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    p, n = events / trials, trials
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    known = trials > 0
    return F.when(known, F.greatest(F.lit(0.0), middle - half)), F.when(known, F.least(F.lit(1.0), middle + half))


def zero_event_bound(trials: Column, confidence: float = 0.95) -> Column:
    return F.when(trials > 0, 1 - F.pow(F.lit(1 - confidence), 1 / trials))


def candidate_rate(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    return prevalence * tpr + (1 - prevalence) * fpr


def precision_at(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    return rate(prevalence * tpr, candidate_rate(tpr, fpr, prevalence))


def alerts_per_1000(tpr: Column, fpr: Column, prevalence: Column) -> Column:
    return 1000 * candidate_rate(tpr, fpr, prevalence)


def cascade_cost(triage: Column, review: Column, candidates: Column) -> Column:
    return triage + candidates * review


def recency_weight(at: Column, now: Column, half_life_days: float = 730.0) -> Column:
    """0.5 ** (age / half life); the future counts as now, an unknown time as one half life."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0)
    return F.when(at.isNull(), 0.5).otherwise(F.pow(F.lit(0.5), age / half_life_days))
