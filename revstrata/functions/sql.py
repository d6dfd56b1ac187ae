"""The functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from revstrata.functions import markup

#: As SQL functions over expressions, so that Catalyst sees through them.
_SQL = {
    "iso_of_millis(ms BIGINT) RETURNS STRING": "date_format(timestamp_millis(ms), \"yyyy-MM-dd'T'HH:mm:ss\")",
    "day_of_millis(ms BIGINT) RETURNS STRING": "date_format(timestamp_millis(ms), 'yyyyMMdd')",
    "hour_to_day(s STRING) RETURNS STRING": "date_format(to_timestamp(s, 'yyyyMMddHH'), 'yyyyMMdd')",
    "next_day_of(s STRING) RETURNS STRING": "date_format(date_add(to_date(s, 'yyyyMMdd'), 1), 'yyyyMMdd')",
    "cut_last(s STRING, n INT) RETURNS STRING": "left(s, greatest(length(s) - n, 0))",
    "http_references(s STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(s, 'http://\\S+?\\s', 0)",
}


def register(spark: SparkSession) -> None:
    """Temporary functions of the session: dates and strings as SQL, markup as Arrow UDFs."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name in ("clean_markup", "plain_text", "annotated", "compacted"):
        spark.udf.register(name, getattr(markup, name).udf())
