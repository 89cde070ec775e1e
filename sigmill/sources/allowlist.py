"""CSV allow-list of symbols: whole files, accepted or refused as one."""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns and the accepted values of the exchange's file.
COLUMNS = {"code": "단축코드", "name": "한글 종목약명", "market": "시장구분", "stock_type": "주식종류"}
MARKETS = {"KOSPI": "KOSPI", "KOSDAQ": "KOSDAQ", "KOSDAQ GLOBAL": "KOSDAQ"}
STOCK_TYPE = "보통주"
CODE = re.compile(r"[0-9A-Z]{6}")
ROW = "code string, name string, market string, source_market string, stock_type string"
PARSED = f"struct<error:string,encoding:string,rows:array<struct<{ROW.replace(' string', ':string').replace(', ', ',')}>>>"


def parse(raw: bytes):
    """(error, encoding, rows); the first fault refuses the file."""
    for encoding in ("utf-8-sig", "cp949"):
        try:
            text = raw.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    else:
        return ("UNDECODABLE", None, None)
    reader = csv.reader(io.StringIO(text, newline=""))
    header = [h.strip() for h in next(reader, [])]
    if len(set(header)) != len(header):
        return ("DUPLICATE_COLUMN", encoding, None)
    if not set(COLUMNS.values()) <= set(header):
        return ("MISSING_COLUMN", encoding, None)
    place = {k: header.index(v) for k, v in COLUMNS.items()}
    rows, seen = [], set()
    for line in reader:
        if not any(c.strip() for c in line):
            continue
        if len(line) < len(header):
            return ("SHORT_ROW", encoding, None)
        value = {k: line[i].strip() for k, i in place.items()}
        if value["market"] not in MARKETS or value["stock_type"] != STOCK_TYPE:
            continue
        if not CODE.fullmatch(value["code"]) or not value["name"]:
            return ("BAD_VALUE", encoding, None)
        if value["code"] in seen:
            return ("DUPLICATE_CODE", encoding, None)
        seen.add(value["code"])
        rows.append((value["code"], value["name"], MARKETS[value["market"]], value["market"], value["stock_type"]))
    return ("EMPTY", encoding, None) if not rows else (None, encoding, sorted(rows))


def parsed(content: Column) -> Column:
    """Struct (error, encoding, rows) of a file's bytes."""
    return F.pandas_udf(lambda s: pd.DataFrame([parse(bytes(x)) for x in s], columns=["error", "encoding", "rows"]), PARSED)(content)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, error, encoding, rows) of each file under a path that Spark reads."""
    files = spark.read.format("binaryFile").load(path).select("path", parsed(F.col("content")).alias("p"))
    return files.select("path", "p.*")


def symbols(files: DataFrame) -> DataFrame:
    """The rows of the accepted files."""
    return files.filter(F.col("error").isNull()).select("path", F.inline("rows"))
