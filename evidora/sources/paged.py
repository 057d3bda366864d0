"""A paged search service as a Spark data source. The pages come from a folder
of recorded responses; a live service needs only another ``Transport``."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "pass string, place int, pmid string, doi string, title string, year int, cited_by int"


class Transport:
    """Answers (query, cursor) from ``{folder}/{query}.{cursor}.json``: an
    object with ``records`` and ``next``."""

    def __init__(self, folder: str):
        self.folder = folder

    def page(self, query: str, cursor: str) -> dict:
        path = os.path.join(self.folder, f"{query}.{cursor}.json")
        if not os.path.exists(path):
            raise FileNotFoundError(f"no response for {query} at {cursor}")
        with open(path) as f:
            return json.load(f)


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.queries, self.most = options["path"], options["queries"].split("|"), int(options["maxrecords"]) if "maxrecords" in options else None

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries]

    def read(self, partition: _Query) -> Iterator[tuple]:
        transport, cursor, n = Transport(self.folder), "*", 0
        while True:
            page = transport.page(partition.query, "start" if cursor == "*" else cursor)
            for r in page.get("records", []):
                if self.most is not None and n >= self.most:
                    return
                yield (partition.query, n, r.get("pmid"), r.get("doi"), r.get("title"), r.get("year"), r.get("cited_by"))
                n += 1
            if not page.get("records") or not page.get("next") or page["next"] == cursor:
                return
            cursor = page["next"]


class PagedSearch(DataSource):
    """``spark.dataSource.register(PagedSearch)``, then
    ``spark.read.format("paged_search").option("queries", "a|b").load(folder)``:
    a partition a query, following cursors until one is empty or repeats; an
    option ``maxrecords`` ends each query there."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def first_by_pass(records: DataFrame, order: list[str]) -> DataFrame:
    """One row a record (by doi, else pmid, else title), from the first pass
    that found it; records without any of them are left out."""
    key = F.coalesce(F.nullif(F.lower(F.trim("doi")), F.lit("")), F.nullif(F.trim("pmid"), F.lit("")), F.nullif(F.lower(F.trim("title")), F.lit("")))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), F.col("pass")), F.lit(len(order) + 1))
    kept = records.withColumn("key", key).where("key is not null").withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(rank, "place")))
    return kept.where("_r = 1").drop("_r")
