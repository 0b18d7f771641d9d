"""JSON over HTTP (or any URL) as a batch data source: one task a page."""

from __future__ import annotations

import json
import random
import time
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class JsonApi(DataSource):
    """Options: ``url`` with ``{page}``, ``first`` and ``pages``, ``items`` (dotted path of the list in a reply), ``tries``, ``timeout``.

    Rows: page, pos, record (the item's JSON). A page that is missing or no
    JSON after all tries fails its task, so a retried task reads it again and
    nothing is lost silently.
    """

    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "page int, pos int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.first, self.pages = int(options.get("first", 1)), int(options.get("pages", 1))
        self.path = [p for p in options.get("items", "").split(".") if p]
        self.tries, self.timeout = int(options.get("tries", 3)), float(options.get("timeout", 30))

    def partitions(self):
        return [Page(i) for i in range(self.first, self.first + self.pages)]

    def _fetch(self, page: int):
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(self.url.replace("{page}", str(page)), timeout=self.timeout) as reply:
                    return json.loads(reply.read())
            except (OSError, ValueError):
                if n + 1 == self.tries:
                    raise
                time.sleep(random.random() * 2**n)

    def read(self, partition):
        items = self._fetch(partition.number)
        for key in self.path:
            items = items[key]
        for pos, item in enumerate(items if isinstance(items, list) else [items]):
            yield partition.number, pos, json.dumps(item, ensure_ascii=False, sort_keys=True)


def read_api(spark: SparkSession, url: str, **options) -> DataFrame:
    """page, pos, record of every page of ``url``."""
    spark.dataSource.register(JsonApi)
    return spark.read.format("json_api").options(url=url, **{k: str(v) for k, v in options.items()}).load()


def discovered(records: DataFrame, fields: dict[str, str], required: str) -> DataFrame:
    """Named fields (JSON paths) of records; rows without the required one are left out."""
    rows = records.select("page", "pos", *[F.nullif(F.trim(F.get_json_object("record", path)), F.lit("")).alias(name) for name, path in fields.items()])
    return rows.filter(F.col(required).isNotNull())
