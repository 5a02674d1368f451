"""Schemas of the records that the engine reads and writes."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType()),
}


def _struct(spec: str) -> T.StructType:
    """Fields as ``name type``; Spark's own parser would need a session when this is imported."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in spec.split(","))])


def extended(schema: T.StructType, spec: str) -> T.StructType:
    return T.StructType([*schema.fields, *_struct(spec).fields])


SOURCE = _struct(
    "name string, language string, sitemap_index string, dated_sitemap string, sections array<string>, nested_include array<string>"
)
#: A candidate article; ``published`` without zone is in the session's.
ARTICLE = _struct(
    "url string, source string, published timestamp_ntz, title string, keywords string, language string, "
    "matched array<string>, where string, body_text string"
)
DOC = _struct(
    "url string, source string, published string, title string, text string, lang string, score double, dupe_of string, partial boolean"
)
ARCHIVE_RECORD = _struct(
    "url string, source string, language string, title string, published string, text string, words long, fetched string"
)
RUN_META = _struct(
    "id string, status string, subject string, window string, started string, finished string, min_relevance double, deep boolean, "
    "source string, matched long, extracted long, duplicates long, ranked long, corpus_chars long, error string, report_error string"
)
RUN_ARTICLE = _struct(
    "url string, source string, published string, title string, lang string, score double, dupe_of string, partial boolean, "
    "relevance double, words long"
)
PROFILE = _struct(
    "id string, name string, subject string, terms array<string>, system_prompt string, created string, updated string"
)
