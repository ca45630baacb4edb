"""Schemas of the engine's tables."""

from pyspark.sql import types as T

#: Field names of a record, in the order of the feed's columns.
FIELDS = ("recordId", "businessName", "pan", "gstin", "address", "pinCode", "sector", "phone", "registrationDate")
RECORD = T.StructType([T.StructField(n, T.StringType()) for n in (*FIELDS, "source")])
#: Features and the weight that each takes, in the order of the sum.
FEATURES = (("identifier", "pan"), ("name", "name"), ("address", "address"), ("pinCode", "pinCode"), ("sector", "sector"), ("phone", "phone"))
FEATURE_STRUCT = T.StructType([T.StructField(f, T.DoubleType()) for f, _ in FEATURES])
REGISTRY = T.StructType([
    T.StructField("ubid", T.StringType()), T.StructField("businessName", T.StringType()), T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("records", T.ArrayType(RECORD)), T.StructField("evidence", T.StringType()),
    T.StructField("linkedAt", T.StringType()), T.StructField("autoLinked", T.BooleanType()), T.StructField("humanVerified", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("key", T.StringType()),
])
REVIEW_ITEM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("record1", RECORD), T.StructField("record2", RECORD), T.StructField("score", T.DoubleType()), T.StructField("features", FEATURE_STRUCT), T.StructField("evidence", T.StringType()), T.StructField("createdAt", T.StringType()),
])
DECISION = T.StructType([T.StructField("id", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("note", T.StringType()), T.StructField("seq", T.LongType())])
