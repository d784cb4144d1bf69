"""Tables as spans. A span frame has trace_id, is_root, arrival (a sortable struct) and one column per field.

Envelope columns (api_key, dataset, environment, sample_rate, annotation, ts) are optional.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracesift.functions.values import kind_of
from tracesift.operators.conditions import ROOT, Field

#: Columns that are not fields.
ENVELOPE = ("trace_id", "is_root", "arrival")


def member(payload: Column, name: str) -> Column:
    """The variant under a key of a variant object, whatever signs the key has; null where it's missing."""
    if "'" in name or "\\" in name:
        return F.try_variant_get(payload, "$", "map<string,variant>")[name]
    return F.try_variant_get(payload, f"$['{name}']", "variant")


@dataclass(frozen=True)
class Spans:
    """A span frame. ``payload``: a variant column with further fields, for schemaless records."""

    df: DataFrame
    payload: str | None = None

    def names(self) -> list[str]:
        return [c for c in self.df.columns if c not in ENVELOPE and c != self.payload]

    def field(self, name: str) -> Field | None:
        if name in self.names():
            c = F.col(f"`{name}`")
            return Field(kind_of(self.df.schema[name].dataType), c)
        if self.payload:
            return Field("variant", member(F.col(self.payload), name))
        return None

    def nested(self, name: str):
        """Text at a dotted path of the payload."""
        return F.get_json_object(F.to_json(F.col(self.payload)), json_path(name)) if self.payload else None

    def narrowed(self, fields: set[str]) -> Spans:
        """Only the envelope and the fields asked for, so that the scan reads no more."""
        plain = {f.removeprefix(ROOT) for f in fields}
        keep = [c for c in self.df.columns if c in ENVELOPE or c in plain or (c == self.payload and not plain <= set(self.names()))]
        return Spans(self.df.select(*[F.col(f"`{c}`") for c in keep]), self.payload if self.payload in keep else None)


def json_path(name: str) -> str:
    """A dotted path as JSONPath; parts with signs of its syntax are bracketed."""
    parts = [p if re.fullmatch(r"\w+", p) else f"['{p}']" for p in name.split(".")]
    return "$" + "".join(p if p.startswith("[") else f".{p}" for p in parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_spans(spark: SparkSession, sf_dir: str) -> Spans:
    """Order lines as spans of their order; the first line is the root, arrival follows the shipping date."""
    t = table(spark, sf_dir, "lineitem")
    return Spans(
        t.select(
            F.col("l_orderkey").cast("string").alias("trace_id"),
            (F.col("l_linenumber") == 1).alias("is_root"),
            F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber").alias("arrival"),
            F.col("l_quantity").cast("double").alias("quantity"),
            F.col("l_extendedprice").cast("double").alias("price"),
            F.col("l_discount").cast("double").alias("discount"),
            F.col("l_tax").cast("double").alias("tax"),
            F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.col("l_partkey").cast("long").alias("part"),
            F.col("l_suppkey").cast("long").alias("supplier"),
            F.col("l_linenumber").cast("long").alias("line"),
            F.when(F.col("l_linenumber") <= 4, F.col("l_suppkey").cast("string")).alias("depot"),
            (F.col("l_quantity") > 25).alias("bulky"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
        )
    )


#: The same rows in SQL.
LINES = """l AS (SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, l_linenumber = 1 AS is_root, row(l_shipdate, l_partkey, l_suppkey, l_linenumber) AS arrival,
  CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax,
  l_returnflag AS flag, l_linestatus AS status, CAST(l_partkey AS BIGINT) AS part, CAST(l_suppkey AS BIGINT) AS supplier, CAST(l_linenumber AS BIGINT) AS line,
  CASE WHEN l_linenumber <= 4 THEN CAST(l_suppkey AS VARCHAR) END AS depot, l_quantity > 25 AS bulky, CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem)"""


def event_spans(spark: SparkSession, sf_dir: str) -> Spans:
    """Events as spans of a user's day; sign-ups are roots, errors are span events and views are links."""
    t = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return Spans(
        t.select(
            F.concat_ws("-", "user_id", F.date_format(ts, "yyyy-MM-dd")).alias("trace_id"),
            (F.col("event_type") == "signup").alias("is_root"),
            F.struct(ts.alias("ts"), F.col("event_id").cast("long").alias("id")).alias("arrival"),
            F.col("event_id").cast("long").alias("event_id"),
            F.col("user_id").cast("long").alias("user"),
            F.col("event_type").alias("type"),
            F.col("value").cast("double").alias("value"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
            ts.alias("ts"),
            F.when(F.col("event_type") == "error", "span_event").when(F.col("event_type") == "view", "link").otherwise("").alias("annotation"),
            F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).otherwise(0).cast("long").alias("sample_rate"),
            F.col("props"),
        )
    )


EVENTS = """e AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_type = 'signup' AS is_root, row(ts, event_id) AS arrival,
  CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS "user", event_type AS type, CAST(value AS DOUBLE) AS value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'error' THEN 'span_event' WHEN 'view' THEN 'link' ELSE '' END AS annotation,
  CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 7 ELSE 0 END AS BIGINT) AS sample_rate, props FROM events)"""
