"""Byte layouts as column expressions: fixed-width integers, packed keys, log, table and wire records.

All are built-in functions, so that they run inside generated code next to the scan. Integers are little-endian.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SEQ_MASK

#: Fixed values of the wire frame.
WIRE_MAGIC, WIRE_PUT, WIRE_GET, WIRE_DELETE, WIRE_ERROR = 0x4B, 1, 2, 3, 255


def fixed(value: Column, width: int) -> Column:
    """A whole number as ``width`` little-endian bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(width))))


def number(data: Column, at: Column | int, width: int) -> Column:
    """The unsigned number in ``width`` (up to 8) little-endian bytes from the 1-based place ``at``; 8 bytes wrap to a signed
    long, as two's complement."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(data, at, F.lit(width)))
    turned = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))))
    if width < 8:
        return F.conv(turned, 16, 10).cast("long")
    high, low = (F.conv(F.substring(turned, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def pack_key(seq: Column, op: Column) -> Column:
    """Sequence number and operation in one number: the operation is the low byte."""
    return F.shiftleft(seq.bitwiseAND(SEQ_MASK), 8).bitwiseOR(op.cast("long"))


def unpack_seq(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 8)


def unpack_op(packed: Column) -> Column:
    return packed.bitwiseAND(255).cast("tinyint")


def log_record(op: Column, seq: Column, key: Column, value: Column) -> Column:
    """A log record: operation, sequence number, key and value with their lengths before them."""
    return F.concat(fixed(op, 1), fixed(seq, 8), fixed(F.octet_length(key), 4), key, fixed(F.octet_length(value), 4), value)


def log_size(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(value) + 17).cast("long")


def table_record(key: Column, seq: Column, op: Column, value: Column) -> Column:
    """A table record: length of the internal key, key, packed sequence number, value with its length before it."""
    return F.concat(fixed(F.octet_length(key) + 8, 4), key, fixed(pack_key(seq, op), 8), fixed(F.octet_length(value), 4), value)


def table_size(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(value) + 16).cast("long")


def decode_table_record(data: Column) -> Column:
    """key, seq, op and value of a table record."""
    n = number(data, 1, 4).cast("int") - 8
    packed = number(data, n + 5, 8)
    size = number(data, n + 13, 4).cast("int")
    return F.struct(F.substring(data, F.lit(5), n).alias("key"), unpack_seq(packed).alias("seq"), unpack_op(packed).alias("op"), F.substring(data, n + 17, size).alias("value"))


def index_entry(key: Column, offset: Column) -> Column:
    return F.concat(fixed(F.octet_length(key), 4), key, fixed(offset, 8))


def footer(index_offset: Column, bloom_offset: Column) -> Column:
    return F.concat(fixed(index_offset, 8), fixed(bloom_offset, 8))


def wire_header(opcode: Column, key: Column, value: Column) -> Column:
    """The ten bytes before a framed request: magic, opcode, lengths of key and value."""
    return F.concat(fixed(F.lit(WIRE_MAGIC), 1), fixed(opcode, 1), fixed(F.octet_length(key), 4), fixed(F.octet_length(value), 4))


def wire_request(opcode: Column, key: Column, value: Column) -> Column:
    return F.concat(wire_header(opcode, key, value), key, value)


def decode_wire(data: Column) -> Column:
    """valid, opcode, key and value of a framed request; not valid if magic or length are off."""
    n, m = number(data, 3, 4).cast("int"), number(data, 7, 4).cast("int")
    valid = (F.octet_length(data) >= 10) & (number(data, 1, 1) == WIRE_MAGIC) & (F.octet_length(data) == n + m + 10)
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), number(data, 2, 1).cast("int").alias("opcode"), F.substring(data, F.lit(11), n).alias("key"), F.substring(data, n + 11, m).alias("value"))


def table_file_name(sst_id: Column) -> Column:
    """At least six digits; larger ids keep all of theirs."""
    return F.format_string("%06d.sst", sst_id)
