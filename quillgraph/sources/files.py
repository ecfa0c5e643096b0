"""Rows and triples from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_rows(spark: SparkSession, path: str, headers: bool = False, sep: str = ",", kind: str | None = None) -> DataFrame:
    """One column `row` for each line of a CSV, JSON-lines or Parquet file.

    CSV cells are texts, empty ones null; blank lines are skipped and a byte-order mark is dropped. With headers, and for JSON and Parquet, a row
    is a struct, else a list.
    """
    kind = kind or ("json" if path.endswith((".json", ".jsonl", ".ndjson")) else "parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind == "csv":
        df = spark.read.csv(path, header=headers, sep=sep, inferSchema=False, nullValue="", emptyValue=None, encoding="UTF-8")
        named = [c.lstrip("﻿") for c in df.columns]
        df = df.toDF(*named)
        return df.select((F.struct("*") if headers else F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("row"))
    df = spark.read.json(path) if kind == "json" else spark.read.parquet(path)
    return df.select(F.struct("*").alias("row"))


NTRIPLE = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'


def load_ntriples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Triples (s, p, o, o_type, o_lang, g) of N-Triples files; lines that are comments, blank or malformed are skipped."""
    part = lambda i: F.nullif(F.regexp_extract("value", NTRIPLE, i), F.lit(""))
    literal = F.regexp_extract("value", NTRIPLE, 6)
    plain = F.replace(F.replace(F.replace(literal, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    return spark.read.text(path).where(F.col("value").rlike(NTRIPLE)).select(
        F.coalesce(part(1), part(2)).alias("s"),
        part(3).alias("p"),
        F.coalesce(part(4), part(5), plain).alias("o"),
        F.when(part(4).isNotNull(), "iri").when(part(5).isNotNull(), "bnode").otherwise(F.coalesce(part(8), F.lit("literal"))).alias("o_type"),
        part(7).alias("o_lang"),
        F.lit(graph).cast("string").alias("g"),
    )
