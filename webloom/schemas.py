"""StructTypes of the data model."""

from pyspark.sql import types as T

STRING_MATCHER = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("type", T.StringType()),      # EXACT | REGEX
    T.StructField("default", T.StringType()),
])

URL_CLASS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("class", T.StringType(), False),  # FILE | POST | LIST | IGNORE
    T.StructField("priority", T.LongType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("path", T.ArrayType(STRING_MATCHER)),
    T.StructField("query", T.MapType(T.StringType(), STRING_MATCHER)),
    T.StructField("allow_http", T.BooleanType()),
    T.StructField("match_subdomain", T.BooleanType()),
    T.StructField("allow_subdomain", T.BooleanType()),
    T.StructField("ordinal", T.IntegerType(), False),
])

OPERATION = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("type", T.StringType()),  # VALUE | XPATH | REGEX | PREFIX | SUFFIX
])

PARSER = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),  # TAG | CONTENT | FOLLOW | SOURCE | MD5SUM | NEXT
    T.StructField("operations", T.ArrayType(OPERATION)),
    T.StructField("urls", T.ArrayType(T.StringType())),
    T.StructField("ordinal", T.IntegerType(), False),
])

# Long form of ParseResults: one row per value.  ``pos`` orders the values of
# one (page, parser) in document order (lexicographic over the array).
RESULT_LONG = T.StructType([
    T.StructField("page_key", T.LongType()),
    T.StructField("parser", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("pos", T.ArrayType(T.IntegerType())),
    T.StructField("value", T.StringType()),
])

# Node table of the HTML-as-a-relation stage.
HTML_NODE = T.StructType([
    T.StructField("pre", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("kind", T.StringType()),  # elem | text
    T.StructField("name", T.StringType()),
    T.StructField("sib_pos", T.IntegerType()),  # 1-based among same-name siblings
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("at", T.IntegerType()),  # place in the array, from 0
    T.StructField("last", T.IntegerType()),  # place of the last node below it, or its own
    T.StructField("value", T.StringType()),  # string-value when requested
])

CLASS_TYPES = ("FILE", "POST", "LIST", "IGNORE")
RESULT_TYPES = ("TAG", "CONTENT", "FOLLOW", "SOURCE", "MD5SUM", "NEXT")
OP_TYPES = ("VALUE", "XPATH", "REGEX", "PREFIX", "SUFFIX")
