"""The one relation of the engine: a change log of versioned keys."""

from __future__ import annotations

from pyspark.sql import types as T

DELETE, PUT = 0, 1
#: Of a lookup: no version of the key, its newest version is a value, or a deletion.
MISSING, VALUE, DELETED = 0, 1, 2
#: Sequence numbers use 56 bits.
SEQ_MASK = (1 << 56) - 1

LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), False),
    ]
)
MANIFEST = T.StructType([T.StructField("level", T.IntegerType(), False), T.StructField("ord", T.IntegerType(), False), T.StructField("sst_id", T.LongType(), False)])
LEVELS = 7
