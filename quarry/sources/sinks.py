"""Writing tables and small JSON documents."""

from __future__ import annotations

import json
import logging
import os
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", single: bool = False) -> None:
    """Parquet or CSV with a header. single makes one CSV file and is for small tables."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite")
    out.csv(path, header=True) if fmt == "csv" else out.parquet(path)


def append_log(spark: SparkSession, events: list[dict], path: str) -> None:
    """Appends events as JSON lines."""
    spark.createDataFrame([(json.dumps(e, default=str, sort_keys=True),) for e in events], "value string").coalesce(1).write.mode("append").text(path)


def json_log(name: str, path: str, most_bytes: int = 10_000_000, kept: int = 5) -> logging.Logger:
    """The driver's logger of that name, which also writes its lines as JSON to a local file; a full file is set aside, up to `kept` of them."""

    class Lines(logging.Formatter):
        def format(self, record: logging.LogRecord) -> str:
            extra = {k: v for k, v in vars(record).items() if k not in vars(logging.makeLogRecord({})) and k != "message"}
            return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage(), **extra}, default=str)

    log = logging.getLogger(name)
    if not any(getattr(h, "baseFilename", None) == os.path.abspath(path) for h in log.handlers):
        handler = RotatingFileHandler(path, maxBytes=most_bytes, backupCount=kept, encoding="utf-8")
        handler.setFormatter(Lines())
        log.addHandler(handler)
    log.setLevel(logging.INFO)
    return log


def to_document(df: DataFrame) -> list[dict]:
    """A result table of aggregates as plain data."""
    return [r.asDict(recursive=True) for r in df.collect()]


def markdown(df: DataFrame, title: str) -> str:
    rows = df.collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows], ""])


def write_preview(df: DataFrame, path: str) -> None:
    """A small table of previews as one CSV file with a header, beside the tables it previews."""
    write_table(df, path, "csv", single=True)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A document of plain data (see to_document) as one JSON text file in a folder, replacing what is there."""
    spark.createDataFrame([(json.dumps(document, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def report_text(title: str, sections: dict[str, DataFrame | str]) -> str:
    """A Markdown report: a heading and a table, or text, for each section."""
    parts = [f"# {title}", ""]
    for name, body in sections.items():
        parts += [markdown(body, name).replace("# ", "## ", 1) if isinstance(body, DataFrame) else f"## {name}\n\n{body}\n"]
    return "\n".join(parts)
