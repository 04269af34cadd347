"""Score arithmetic: argmax, softmax, margin, level, policy, learning rate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LABEL_NAMES = ("Negative", "Neutral", "Positive")

# Thresholds of level and policy, and the learning-rate schedule.
HIGH, MEDIUM, LOW, CLEAR_MARGIN = 0.80, 0.60, 0.45, 0.15
RATE, RATE_FLOOR, RATE_DECAY = 0.0010, 0.00008, 0.12


def argmax(scores: list[Column]) -> Column:
    """Index of the largest score, the lowest index on ties."""
    best = F.greatest(*scores)
    out = F.lit(len(scores) - 1)
    for k in reversed(range(len(scores) - 1)):
        out = F.when(scores[k] == best, F.lit(k)).otherwise(out)
    return out


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    powers = [F.exp(s - top) for s in scores]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def clamped_confidence(scores: list[Column]) -> Column:
    """Largest softmax probability with exponents held within -50..50; 0 where the sum is no valid number."""
    top = F.greatest(*scores)
    powers = [F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), s - top))) for s in scores]
    total = sum(powers[1:], powers[0])
    return F.when(total.isNotNull() & ~F.isnan(total) & (total > 0) & (total < float("inf")), F.greatest(*powers) / total).otherwise(0.0)


def margin(scores: list[Column]) -> Column:
    """Best minus second-best score."""
    s = F.sort_array(F.array(*scores), asc=False)
    return s[0] - s[1]


def level(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "HIGH").when(confidence >= MEDIUM, "MEDIUM").when(confidence >= LOW, "LOW").otherwise("UNCERTAIN")


def policy(confidence: Column, gap: Column) -> Column:
    return F.when(confidence < LOW, "ABSTAIN").when((confidence < MEDIUM) | (gap < CLEAR_MARGIN), "REVIEW").otherwise("ACCEPT")


def label_name(label: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABEL_NAMES)), label + 1)


def learning_rate(epoch: int) -> float:
    """Rate of a 1-based epoch: inverse decay down to a floor."""
    return max(RATE_FLOOR, RATE / (1 + RATE_DECAY * (epoch - 1)))


def learning_rate_column(epoch: Column) -> Column:
    return F.greatest(F.lit(RATE_FLOOR), F.lit(RATE) / (1 + F.lit(RATE_DECAY) * (epoch - 1)))
