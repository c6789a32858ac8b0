"""Column contracts of the tables the operators exchange."""

from pyspark.sql import types as T

# A log position is unsigned 64-bit, so landed data keeps it as decimal(20,0).
# Operators only compare and subtract it and also accept bigint, which is faster
# wherever positions are known to stay below 2^63.
LSN = T.DecimalType(20, 0)

RELATION_COLUMN = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type_oid", T.IntegerType()),
    T.StructField("is_key", T.BooleanType()),
])
# kind: 'n' null, 'u' unchanged out-of-line value, 't' text
TUPLE_FIELD = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()),
])

MESSAGES = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("pos", LSN),
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("xid", T.LongType()),
    T.StructField("commit_lsn", LSN),
    T.StructField("commit_ts", T.TimestampType()),
    T.StructField("relation_oid", T.LongType()),
    T.StructField("rel_schema", T.StringType()),
    T.StructField("rel_table", T.StringType()),
    T.StructField("rel_columns", T.ArrayType(RELATION_COLUMN)),
    T.StructField("new_tuple", T.ArrayType(TUPLE_FIELD)),
    T.StructField("old_tuple", T.ArrayType(TUPLE_FIELD)),
])

# One transaction is identified by session, xid and commit position: xid alone wraps.
# The most telling column comes first: sorts and sort-based joins compare by its prefix.
TX = ["tx_id", "commit_lsn", "session_id"]
CHANGE_OPS = ["insert", "update", "delete"]
