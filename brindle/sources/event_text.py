"""Server-sent-event files: events parted by an empty line, read in splits that begin and end between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOUND = "\n\n"


def write_events(texts: DataFrame, path: str, text: str = "text") -> None:
    """One event each row, with or without the empty line behind it."""
    texts.select(F.regexp_replace(text, "\n+$", "").alias("value")).write.option("lineSep", BOUND).text(path)


def _field(lines: Column, name: str) -> Column:
    """The values of all lines of the field, one space behind the colon left out, joined by newlines; null without such a line."""
    own = F.filter(lines, lambda x: F.startswith(x, F.lit(f"{name}:")))
    values = F.transform(own, lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    return F.when(F.size(own) > 0, F.array_join(values, "\n"))


def parsed(raw: DataFrame) -> DataFrame:
    """id, event, data of each event; comments (lines that begin with a colon) and unknown fields are left out, and so are
    events without data."""
    lines = F.split("value", "\n")
    rows = raw.select(*[_field(lines, name).alias(name) for name in ("id", "event", "data")])
    return rows.filter(F.col("data").isNotNull())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.option("lineSep", BOUND).text(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.readStream.option("lineSep", BOUND).text(path))
