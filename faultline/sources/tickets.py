"""Issue JSON as tickets, attachments and change events."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import as_col, strings
from faultline.functions.tickets import detect_app, issue_priority, ticket_text

ATTACHMENT = "struct<id:string,filename:string,size:bigint,mimeType:string,content:string>"
# The description stays text: a plain string or a rich-text tree.
FIELDS = (f"summary string, description string, priority struct<name:string>, labels array<string>, "
          f"created string, attachment array<{ATTACHMENT}>")
ISSUE = f"key string, fields struct<{FIELDS.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>"
EVENT_TYPES = ["jira:issue_created", "jira:issue_updated", "issue_created", "issue_updated"]


def _walk(node) -> list[str]:
    """Texts of a rich-text tree, depth first."""
    out, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            if item.get("type") == "text":
                out.append(item.get("text", ""))
            stack.extend(reversed(item.get("content", [])))
        elif isinstance(item, list):
            stack.extend(reversed(item))
    return out


def _text_of(value) -> str:
    if value is None:
        return ""
    if not value.lstrip().startswith(("{", "[")):
        return value
    try:
        return " ".join(_walk(json.loads(value))).strip()
    except ValueError:
        return value


def doc_text(value: Column | str) -> Column:
    """Plain text of a description that is a string or a rich-text tree of any depth."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(_text_of, na_action=None)

    return text(as_col(value))


def shape_tickets(issues: DataFrame) -> DataFrame:
    """Tickets from ``(key, fields)`` rows."""
    f = F.col("fields")
    out = issues.select(
        F.coalesce("key", F.lit("UNKNOWN")).alias("ticket_id"), F.coalesce(f["summary"], F.lit("")).alias("summary"),
        doc_text(f["description"]).alias("description"), F.coalesce(f["labels"], strings([])).alias("labels"),
        issue_priority(f["priority"]["name"]).alias("priority"),
        f["created"].try_cast("timestamp").alias("created_at"), F.coalesce(f["attachment"], F.array()).alias("attachments"))
    return out.withColumn("streaming_app", detect_app(ticket_text("summary", "description", "labels")))


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """Issue files, one JSON document each, as tickets with nested attachments."""
    return shape_tickets(spark.read.schema(ISSUE).option("multiLine", "true").json(path))


def ticket_attachments(tickets: DataFrame) -> DataFrame:
    """One row per attachment."""
    return tickets.select("ticket_id", F.explode("attachments").alias("a")).select(
        "ticket_id", F.coalesce("a.id", F.lit("")).alias("attachment_id"),
        F.coalesce("a.filename", F.lit("")).alias("filename"), F.coalesce("a.size", F.lit(0)).alias("size"),
        F.coalesce("a.mimeType", F.lit("application/octet-stream")).alias("mime_type"),
        F.coalesce("a.content", F.lit("")).alias("url"))


def ticket_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Created and updated issues among webhook payloads; works on streams too."""
    event = F.from_json(F.col(payload), f"webhookEvent string, issue struct<key:string,fields:string>")
    rows = df.select(event.alias("e"), F.get_json_object(payload, "$.issue").alias("issue"))
    rows = rows.select(F.col("e.webhookEvent").alias("event_type"), F.col("e.issue.key").alias("ticket_key"), "issue")
    return rows.where(F.col("event_type").isin(EVENT_TYPES) & (F.coalesce("ticket_key", F.lit("")) != ""))
