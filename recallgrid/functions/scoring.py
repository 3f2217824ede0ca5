"""Score arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallgrid.config import Tuning

T = Tuning()


def idf(total: Column, df: Column, floor: float = T.idf_floor) -> Column:
    """Logarithm of the odds that a memory lacks the cue (half a memory added to both sides), the floor at least."""
    odds = (F.lit(0.5) + total - df) / (F.lit(0.5) + df)
    return F.greatest(F.when(odds > 0, F.ln(odds)), F.lit(floor))


def ratio(pos: Column, size: Column) -> Column:
    return pos / F.sqrt(size)


def recency_weight(r: Column, t: Tuning = T) -> Column:
    return F.lit(t.max_rec_weight) / (r + 1.0)


def frequency_weight(r: Column, t: Tuning = T) -> Column:
    return 1.0 + t.max_freq_weight * (1.0 - 1.0 / (r + 1.0))


def frequency_score(count: Column) -> Column:
    return F.when(count > 0, F.log10(count)).otherwise(F.lit(0.0))


def effective_salience(intrinsic: Column, dynamic: Column, boosted: Column, now, t: Tuning = T) -> Column:
    age = F.greatest(F.lit(now) - boosted, F.lit(0))
    return intrinsic + dynamic * F.pow(F.lit(2.0), -age / t.half_life_s)


def decayed(dynamic: Column, boosted: Column, now, rate: float) -> Column:
    """Exponential decay by the hour; nothing in the first 0.1 hours, 0 under 0.01."""
    hours = F.greatest(F.lit(now) - boosted, F.lit(0)) / 3600.0
    left = dynamic * F.exp(-rate * hours)
    return F.when(hours > 0.1, F.when(left < 0.01, F.lit(0.0)).otherwise(left)).otherwise(dynamic)


def boosted(start: Column, amounts: Column) -> Column:
    """dynamic + amount / (1 + dynamic) for each amount in order."""
    return F.aggregate(amounts, start.cast("double"), lambda acc, a: acc + a / (1.0 + acc))


def integrity(weight: Column, matches: Column, cues: Column, freq: Column) -> Column:
    agree = F.when(cues > 0, matches / cues).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), 0.5 * weight / F.greatest(matches, F.lit(1)) + 0.3 * agree + 0.2 * F.least(freq / 2, F.lit(1.0)))


def estimate_tokens(content: Column) -> Column:
    return F.ceil(F.octet_length(content) / 4.0).cast("bigint")


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is under 1e-6; in double precision."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-6) | (nb < 1e-6), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def label(content: Column, chars: int = 50) -> Column:
    return F.when(F.octet_length(content) > chars, F.concat(F.left(content, F.lit(chars)), F.lit("..."))).otherwise(content)


def stamp(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
