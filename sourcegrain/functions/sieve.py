"""A sieve of fixed size that drops most rows without a partner before a join deals them out.

Keys of one side set bits by their hash; rows of the other side whose bit is not set have no partner. The sieve has the
same size whatever the number of keys. It only ever drops rows that the join would drop: with very many keys it lets
more rows pass, and the join decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 16  # longs: four million bits, half a megabyte


def sieve(keys: DataFrame, key: str) -> Column:
    """The bits of all values of ``key``, as a column that any query may use."""
    spark = keys.sparkSession
    bit = F.xxhash64(key)
    places = keys.where(F.col(key).isNotNull()).select(_word(bit).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(bit)).alias("bits"))
    every = places.unionByName(spark.range(0, WORDS, 1, 1).select("id", F.lit(0).cast("long").alias("bits"))).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    rows = F.sort_array(F.collect_list(F.struct("id", "bits")))  # as many as the sieve has words
    return every.agg(F.transform(rows, lambda r: r["bits"]).alias("bits")).scalar()


def may_hold(bits: Column, key: Column) -> Column:
    """False only where no key equals ``key``; a null is no key."""
    bit = F.xxhash64(key)
    return key.isNotNull() & (F.call_function("shiftright", F.get(bits, _word(bit).cast("int")), _bit(bit)).bitwiseAND(F.lit(1)) == 1)


def _word(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit(WORDS - 1))


def _bit(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(63)).cast("int")
