"""Choices by gates and an order, and small schedules computed on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gated_choice(candidates: DataFrame, gates: list[Column], prefer: list[Column], name: str, fallback=None) -> DataFrame:
    """One row: the name of the candidate that passes all gates and comes first in the order; the fallback if none does."""
    passes = F.lit(True)
    for g in gates:
        passes = passes & F.coalesce(g, F.lit(False))
    best = F.min_by(F.when(passes, F.col(name)), F.when(passes, F.struct(*[c.alias(f"k{k}") for k, c in enumerate(prefer)])))
    return candidates.agg(F.coalesce(best, F.lit(fallback)).alias(name), F.count_if(passes).alias("qualifying"))


def best_epoch(history: DataFrame, map50: str, map50_95: str, epoch: str) -> DataFrame:
    """The epoch with the largest checkpoint fitness, a tenth of AP50 and nine tenths of mAP50-95; the first on a tie."""
    fitness = F.round(0.1 * F.col(map50) + 0.9 * F.col(map50_95), 9)
    return history.agg(F.max_by(epoch, F.struct(fitness, -F.col(epoch))).alias("epoch"), F.max(fitness).alias("fitness"))


def optimizer_updates(images: int, batch_size: int, epochs: int, nominal_batch: int = 64, warmup_epochs: float = 0.5) -> dict[str, int]:
    """Micro-batches and optimizer updates of a training run whose gradients are accumulated up to a nominal batch.

    During warm-up the number of micro-batches for an update rises evenly from 1; rounding is half to even.
    """
    per_epoch = -(-images // batch_size)
    warmup, target = round(warmup_epochs * per_epoch), nominal_batch / batch_size
    updates = waiting = 0
    for step in range(per_epoch * epochs):
        share = min(1.0, step / warmup) if warmup else 1.0
        waiting += 1
        if waiting >= max(1, round(1 + (target - 1) * share)):
            updates, waiting = updates + 1, 0
    return {"batches_per_epoch": per_epoch, "micro_batches": per_epoch * epochs, "warmup": warmup, "updates": updates}
