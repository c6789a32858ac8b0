"""Equi-joins that stay balanced when a few keys hold most rows."""

from pyspark.sql import DataFrame, functions as F

from ..session import fits

# A side of up to so many bytes in all, as text, is joined by broadcast.
BROADCAST_BYTES = 1 << 20


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[str],
                how: str = "inner", salts: int = 1) -> DataFrame:
    """Join on ``on``; a key that holds much of ``big`` is split over tasks.

    The adaptive skew join splits keys by their measured size. With ``salts`` each key of ``big`` is split into that
    many shares beforehand, by the columns ``spread`` that differ within a key, and ``small`` is repeated once per
    share: a plan estimates it without the repeats, so it is never broadcast then. No row is dropped on either side.
    """
    if salts == 1:
        return big.join(small, on, how)
    shares = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = big.withColumn("_share", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_share", shares)
    return left.join(right.hint("merge"), on + ["_share"], how).drop("_share")


def join_few(big: DataFrame, few: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``salted_join`` with a side that has few rows by nature: broadcast if it fits, so ``big`` isn't shuffled."""
    if fits(few, BROADCAST_BYTES):
        return big.join(F.broadcast(few), on, how)
    return salted_join(big, few, on, spread, how)
