"""Fixed schemas of the tables that pass between operators."""

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("text", T.StringType())]
)

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

RECOGNIZER = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("pattern_name", T.StringType()),
        T.StructField("regex", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("priority", T.IntegerType()),
    ]
)

# The leading fields give findings their natural order under ``array_sort``:
# start, longest first, best score first, then entity priority.
FINDING = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("neg_end", T.IntegerType()),
        T.StructField("neg_score", T.DoubleType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("entity", T.StringType()),
        T.StructField("pattern_name", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

FINDINGS = T.ArrayType(FINDING)

VERDICT = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)

POLICY = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("mask_char", T.StringType()),
        T.StructField("mask_n", T.IntegerType()),
        T.StructField("from_end", T.BooleanType()),
    ]
)
