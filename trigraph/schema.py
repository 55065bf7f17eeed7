"""Fixed schemas. A graph term is always a string."""

from pyspark.sql import types as T

EDGE = T.StructType([T.StructField("s", T.StringType(), False), T.StructField("p", T.StringType(), False), T.StructField("o", T.StringType(), False)])
NODE = T.StructType([T.StructField("id", T.StringType(), False)])
PREDICATE = T.StructType([T.StructField("p", T.StringType(), False)])
EMBEDDING = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("vec", T.ArrayType(T.DoubleType()), False)])
#: op: P put, R replace all objects of (s, p), D delete.
EDGE_LOG = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), *EDGE.fields])
EMBEDDING_LOG = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("id", T.StringType(), False), T.StructField("vec", T.ArrayType(T.DoubleType()))])
#: op: P put a scalar, L prepend to a list, U add to a set, D delete. A value begins with the letter of its type.
KV_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("tbl", T.StringType(), False),
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.StringType()),
    ]
)
ROW = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("edges", T.ArrayType(T.StringType()), False),
        T.StructField("path", T.ArrayType(T.StringType()), False),
    ]
)
