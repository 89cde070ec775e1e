"""Paged JSON snapshots of listed symbols, and a batch data source that reads their pages from files.

    spark.dataSource.register(ListedPages)
    spark.read.format("listed_pages").option("path", folder).load()

Pages are files named <source>-<number>.json. Each page is a partition; what a page holds is checked where it is read, and what
only all pages of a source can tell (totals, number of pages, doubled codes, the basis date) by `faults`. A source with a fault
gives no symbols: `snapshot` takes sound sources alone.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_PAGES = 100
MAX_BYTES = 5 << 20
#: Result codes of an accepted request, the markets that count, and a symbol's form.
ACCEPTED = ("00", "0000")
MARKETS = ("KOSPI", "KOSDAQ")
CODE = re.compile(r"[0-9A-Z]{6}")

ITEMS = "source string, page int, size long, fault string, total long, items int, basis date, code string, market string, name string"


def _refused(source: str, page: int, size: int, fault: str) -> list[tuple]:
    return [(source, page, size, fault, None, 0, None, None, None, None)]


def parse(source: str, page: int, body: bytes) -> list[tuple]:
    """ITEMS of one page: a row for each symbol of the markets, one without symbol if there is none, or one with its fault.

    Of a page over MAX_BYTES nothing is read. Names and markets are trimmed and composed (NFC); a code loses its leading A.
    """
    import datetime as dt
    import json

    if len(body) > MAX_BYTES:
        return _refused(source, page, MAX_BYTES + 1, "PAGE_TOO_LARGE")
    try:
        response = json.loads(body)["response"]
        result, content = str(response["header"]["resultCode"]), response["body"]
        total, held = int(content["totalCount"]), content.get("items")
    except (KeyError, TypeError, ValueError, AttributeError):
        return _refused(source, page, len(body), "INVALID_RESPONSE")
    if result not in ACCEPTED:
        return _refused(source, page, len(body), "REQUEST_REJECTED")
    if total < 0:
        return _refused(source, page, len(body), "INVALID_TOTAL")
    if held not in (None, "") and not isinstance(held, dict):
        return _refused(source, page, len(body), "INVALID_ITEMS")
    entries = held.get("item", []) if held else []
    entries = [entries] if isinstance(entries, dict) else entries
    if not isinstance(entries, list) or not all(isinstance(x, dict) for x in entries):
        return _refused(source, page, len(body), "INVALID_ITEMS")

    def said(entry: dict, key: str) -> str:
        return unicodedata.normalize("NFC", str(entry.get(key, "")).strip())

    rows = []
    for entry in entries:
        if (market := said(entry, "mrktCtg")) not in MARKETS:
            continue
        code, name, day = said(entry, "srtnCd").upper(), said(entry, "itmsNm"), said(entry, "basDt")
        code = code[1:] if len(code) == 7 and code.startswith("A") else code
        if not CODE.fullmatch(code) or not name:
            return _refused(source, page, len(body), "BAD_ITEM")
        try:
            basis = dt.date.fromisoformat(f"{day[:4]}-{day[4:6]}-{day[6:8]}")
        except ValueError:
            return _refused(source, page, len(body), "BAD_BASIS_DATE")
        rows.append((source, page, len(body), None, total, len(entries), basis, code, market, name))
    return rows or [(source, page, len(body), None, total, len(entries), None, None, None, None)]


class Page(InputPartition):
    def __init__(self, source: str, number: int, path: str):
        self.source, self.number, self.path = source, number, path


class PageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Page]:
        found = []
        for name in sorted(os.listdir(self.folder)):
            if match := re.fullmatch(r"(.+)-(\d+)\.json", name):
                found.append(Page(match[1], int(match[2]), os.path.join(self.folder, name)))
        return found

    def read(self, partition: Page) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            # One byte more than is allowed tells a page that is too large.
            body = file.read(MAX_BYTES + 1)
        yield from parse(partition.source, partition.number, body)


class ListedPages(DataSource):
    """Pages in a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "listed_pages"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])


def items(pages: DataFrame) -> DataFrame:
    """ITEMS of pages (source, page, body) that a table holds."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.date32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [r for source, page, body in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in parse(source, page, (body or "").encode())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in ITEMS.split(", ")])

    return pages.select("source", F.col("page").cast("int"), "body").mapInArrow(run, ITEMS)


def faults(rows: DataFrame, basis: Column) -> DataFrame:
    """(source, fault): the first reason, in fixed order, to refuse a source; null if it is sound.

    A fault of a page comes first, that of the earliest page. The totals of all pages must agree and be reached by their items
    in not more than MAX_PAGES pages without gaps; symbols must be there, once each, of the basis date.
    """
    by_page = rows.groupBy("source", "page").agg(F.max("size").alias("size"), F.max("fault").alias("fault"), F.max("total").alias("total"), F.max("items").alias("items"))
    pages = by_page.groupBy("source").agg(
        F.min(F.when(F.col("fault").isNotNull(), F.struct("page", "fault")))["fault"].alias("page_fault"),
        F.count("*").alias("pages"), F.max("page").alias("last"), F.count_distinct("total").alias("totals"), F.max("total").alias("total"), F.sum("items").alias("n"),
    )
    symbols = rows.groupBy("source").agg(F.count("code").alias("codes"), F.count_distinct("code").alias("different"), F.count_if(F.col("basis") != basis).alias("other_days"))
    checked = pages.join(symbols, "source")
    return checked.select(
        "source",
        F.when(F.col("page_fault").isNotNull(), F.col("page_fault"))
        .when(F.col("last") > MAX_PAGES, "TOO_MANY_PAGES")
        .when(F.col("totals") != 1, "TOTAL_CHANGED")
        .when((F.col("n") < F.col("total")) | (F.col("pages") != F.col("last")), "INCOMPLETE")
        .when(F.col("codes") == 0, "NO_SYMBOLS")
        .when(F.col("different") != F.col("codes"), "DUPLICATE_CODE")
        .when(F.col("other_days") > 0, "OTHER_BASIS_DATE")
        .alias("fault"),
    )


def snapshot(rows: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """The listed symbols of the sources that `found` (faults) holds sound, one row each, with the columns `more`."""
    sound = found.filter("fault IS NULL").select("source")
    return rows.filter("code IS NOT NULL").join(F.broadcast(sound), "source", "left_semi").select("source", "basis", "code", "market", "name", *more)


def digest(rows: DataFrame, *ties: str) -> DataFrame:
    """(source, sha256) of a snapshot: its symbols in code order, then by `ties`, as compact JSON; a source has a few thousand symbols."""
    quoted = lambda c: F.regexp_replace(c, r'(["\\])', r"\\$1")
    entry = F.concat(F.lit('{"code":"'), "code", F.lit('","market":"'), "market", F.lit('","name_ko":"'), quoted("name"), F.lit('","source_as_of":"'), F.col("basis").cast("string"), F.lit('"}'))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("code", *ties, entry.alias("json")))), lambda e: e["json"])
    return rows.groupBy("source").agg(F.sha2(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), 256).alias("sha256"))
