"""Bloom filters over keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime of the hash step, seeds of the three hashes, bits a key, least bits of a filter.
PRIME, SEEDS, BITS_PER_KEY, LEAST_BITS = 0x01000193, (0x12345678, 0x87654321, 0xABCDEF01), 10, 64
#: Bits of a word, and words (a power of two) of a part of a filter that is put together by itself.
WORD, PART = 64, 1024


def bloom_hash(key: Column, seed: int) -> Column:
    """32-bit hash of a key's bytes: xor a byte, multiply by the prime. No key has no bytes."""
    byte = lambda i: F.conv(F.hex(F.substring(key, i, F.lit(1))), 16, 10).cast("long")
    steps = F.aggregate(F.sequence(F.lit(1), F.octet_length(key)), F.lit(seed).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * PRIME).bitwiseAND(0xFFFFFFFF))
    return F.when(F.coalesce(F.octet_length(key), F.lit(0)) == 0, F.lit(seed).cast("long")).otherwise(steps)


def filter_bits(n_keys: Column) -> Column:
    """Bits of a filter for so many keys, in whole bytes."""
    return (F.ceil(F.greatest(n_keys * BITS_PER_KEY, F.lit(LEAST_BITS)) / 8) * 8).cast("long")


def positions(key: Column, n_bits: Column) -> Column:
    return F.array(*(F.pmod(bloom_hash(key, seed), n_bits) for seed in SEEDS))


def _sized(keys: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The distinct keys, and n_bits of each group. Without a group there is one filter, of no keys too."""
    distinct = keys.select(*group, "key").distinct()
    return distinct, distinct.groupBy(*group).agg(filter_bits(F.count("*")).alias("n_bits"))


def _bits(keys: DataFrame, sizes: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """Adds n_bits, and of each position of a key the word it falls into and its bit there: a word's hex digits are those
    of its eight bytes in their order. ``sizes`` is one row a group."""
    placed = keys.join(F.broadcast(sizes), group or F.lit(True), how).select("*", F.explode(positions(F.col("key"), F.col("n_bits"))).alias("_bit"))
    inside = F.col("_bit").bitwiseAND(WORD - 1).cast("int")
    shift = WORD - 8 - F.shiftright(inside, 3) * 8 + inside.bitwiseAND(7)
    return placed.withColumns({"at": F.shiftright("_bit", 6), "mask": F.call_function("shiftleft", F.lit(1).cast("long"), shift)}).drop("_bit")


def _words(distinct: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """Group, n_bits, at and word of the words that are not zero, and of the first."""
    first = sizes.select(*group, "n_bits", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("mask"))
    bits = _bits(distinct, sizes, group).select(*group, "n_bits", "at", "mask").unionByName(first)
    return bits.groupBy(*group, "n_bits", "at").agg(F.bit_or("mask").alias("word"))


def _digits(entries: Column, before: Column, size: int, digits) -> Column:  # noqa: ANN001
    """``digits`` of sorted entries (at, ...) one after the other, zeros for those that are missing after ``before``."""

    def padded(x: Column, i: Column) -> Column:
        missing = x["at"] - F.coalesce(F.get(entries, i - 1)["at"], before) - 1
        return F.concat(F.repeat(F.lit("0"), (missing * size).cast("int")), digits(x))

    return F.array_join(F.transform(entries, padded), "")


def build(keys: DataFrame, group: list[str]) -> DataFrame:
    """One filter a group of distinct keys: the group, n_bits and filter (bytes).

    Bits meet in partial aggregates: a word's bits are or-ed on the way, never gathered as rows of a group. Words are put
    together by parts, and only these as a whole filter; both by one walk over what is sorted, without lookups.
    """
    words = _words(*_sized(keys, group), group)
    digits = WORD // 4
    parts = words.groupBy(*group, "n_bits", F.shiftright("at", PART.bit_length() - 1).alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    written = _digits(F.col("words"), F.col("part") * PART - 1, digits, lambda x: F.lpad(F.hex(x["word"]), digits, "0"))
    parts = parts.select(*group, "n_bits", F.struct(F.col("part").alias("at"), F.rpad(written, PART * digits, "0").alias("digits")).alias("part"))
    whole = parts.groupBy(*group, "n_bits").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = _digits(F.col("parts"), F.lit(-1), PART * digits, lambda x: x["digits"])
    return whole.select(*group, "n_bits", F.unhex(F.rpad(joined, (F.col("n_bits") / 4).cast("int"), F.lit("0"))).alias("filter"))


def probe(probes: DataFrame, keys: DataFrame, group: list[str]) -> DataFrame:
    """The distinct probes (group, key) and may: as ``may_contain`` with the filter of the group's ``keys``, which is never
    put together; positions meet the words they fall into. A group without keys has no filter."""
    distinct, sizes = _sized(keys, group)
    words = _words(distinct, sizes, group).select(*group, "at", "word")
    asked = _bits(probes.select(*group, "key").distinct(), sizes, group, "left").join(words, [*group, "at"], "left")
    has = F.col("n_bits").isNull() | (F.coalesce(F.col("word"), F.lit(0)).bitwiseAND(F.col("mask")) != 0)
    return asked.groupBy(*group, "key").agg(F.bool_and(has).alias("may"))


def may_contain(bloom: Column, key: Column) -> Column:
    """False: the key is not in the set. A missing or empty filter tells nothing."""
    n_bits = (F.octet_length(bloom) * 8).cast("long")

    def has(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bloom, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1

    return F.when(bloom.isNull() | (F.octet_length(bloom) == 0), F.lit(True)).otherwise(F.forall(positions(key, n_bits), has))


def union(filters: DataFrame, group: list[str]) -> DataFrame:
    """Or of equally long filters of a group (hex digits joined position by position)."""
    bytes_ = filters.select(*group, F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("filter")), lambda i: F.conv(F.hex(F.substring(F.col("filter"), i, F.lit(1))), 16, 10).cast("int"))).alias("at", "byte"))
    ored = bytes_.groupBy(*group, "at").agg(F.bit_or("byte").alias("byte"))
    joined = ored.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "byte"))).alias("bytes"))
    return joined.select(*group, F.unhex(F.array_join(F.transform("bytes", lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), "")).alias("filter"))
