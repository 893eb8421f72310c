"""What to do about failed writes: classes of errors, delays, retries, and splitting of batches."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CONNECTION, CONTENTION, INVALID_ID, DUPLICATE, OTHER = "connection", "contention", "invalid_id", "duplicate", "other"

# What an error's text holds, by class, in the order in which classes are tried. All texts of a group must occur.
SIGNS = (
    (CONNECTION, (("socket was unexpectedly closed",), ("EOF",), ("connection reset by peer",), ("i/o timeout",))),
    (CONTENTION, (("too much contention",), ("lock timeout",), ("OperationFailed", "Aborted"), ("TransientTransactionError",), ("WriteConflict",), ("exceeded time limit",))),
    (INVALID_ID, (("_id must be an objectId, string, long",),)),
)
#: Seconds waited in full on contention, and on top of the delay on lost connections.
SETTLE_S = 5.0


def classify(message: str | None) -> str:
    """The class of an error's text."""
    for name, groups in SIGNS:
        if message and any(all(sign in message for sign in group) for group in groups):
            return name
    return OTHER


def classified(message: Column) -> Column:
    """The same on a column."""
    out = F.lit(OTHER)
    for name, groups in reversed(SIGNS):
        hit = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains(message, F.lit(s)) for s in group)) for group in groups))
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def delay_ms(attempt: Column, base: int, most: int, jitter: Column | float) -> Column:
    """Milliseconds before a try: base doubled each attempt, times a jitter of 0.5 to 1.5, at most `most`."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt) * jitter, F.lit(float(most)))


@dataclass
class Policy:
    max_retries: int = 5
    base_ms: int = 100
    max_ms: int = 5000
    split: bool = True
    min_batch: int = 10
    sleep: Callable[[float], None] = time.sleep
    jitter: Callable[[], float] = random.random

    def delay(self, attempt: int, kind: str) -> float:
        """Seconds before the next try."""
        if kind == CONTENTION:
            return SETTLE_S
        own = min(self.base_ms * 2**attempt * (0.5 + self.jitter()), self.max_ms) / 1000
        return own + SETTLE_S if kind == CONNECTION else own

    def again(self, write: Callable[[], None]) -> None:
        """Call write until it works, max_retries times."""
        for attempt in range(self.max_retries):
            try:
                return write()
            except Exception as error:
                if attempt == self.max_retries - 1:
                    raise
                self.sleep(self.delay(attempt, classify(str(error))))

    def write(self, batch: Sequence, write: Callable[[Sequence], None], coerce: Callable[[Sequence], Sequence] = lambda b: b) -> None:
        """Write a batch: unsupported ids are coerced once, contention halves the batch down to min_batch, the rest is retried."""
        try:
            return write(batch)
        except Exception as error:
            kind = classify(str(error))
        if kind == INVALID_ID:
            batch = coerce(batch)
            try:
                return write(batch)
            except Exception as error:
                kind = classify(str(error))
        if kind == CONTENTION and self.split and len(batch) > self.min_batch:
            self.sleep(self.delay(0, kind))
            half = len(batch) // 2
            self.write(batch[:half], write, coerce)
            self.write(batch[half:], write, coerce)
            return None
        return self.again(lambda: write(batch))


def leaves(size: int, least: int) -> list[int]:
    """Sizes of the batches that endless contention splits one of `size` into; a batch of at most `least` isn't split."""
    return [size] if size <= least else leaves(size // 2, least) + leaves(size - size // 2, least)
