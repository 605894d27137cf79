"""Sources: paged REST, folders of documents, records, inboxes, logs and price catalogues."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual, SimpleDataSourceStreamReader

MAX_BYTES, MIN_WORDS = 1_000_000, 20


@dataclass
class Page(InputPartition):
    url: str


def pages(template: str, limit: int, most: int) -> list[str]:
    """Request URLs of a paged source: {limit}, {offset} and {page} are filled in until `most` records are covered."""
    return [template.format(limit=min(limit, most - at), offset=at, page=at // limit + 1) for at in range(0, most, limit)]


class RestSource(DataSource):
    """spark.read.format("paged_rest") with options url (a template), limit, max and records (path of the list in a reply): one partition a page,
    one JSON text a record. With the option `filters`, names between commas, each of them is a column too, read from the record, and an equality or bound on it
    that a query asks for goes into the request as the parameter name, name_min or name_max; Spark applies it again. As a stream, each trigger reads on
    from the offset that the last one has reached, until a page comes that is not full."""

    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return ", ".join(["page string, record string", *(f"{n} string" for n in filtered(self.options))])

    def reader(self, schema) -> DataSourceReader:
        return (FilteredRestReader if filtered(self.options) else RestReader)(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return RestStream(dict(self.options))


def filtered(options) -> list[str]:
    return [n.strip() for n in (options.get("filters") or "").split(",") if n.strip()]


def fetched(url: str, options: dict[str, str]) -> list[tuple]:
    """Rows of one page."""
    with urllib.request.urlopen(url, timeout=60) as reply:
        found = json.load(reply)
    for part in filter(None, options.get("records", "").split(".")):
        found = found[part]
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return [(url, json.dumps(r, ensure_ascii=False), *(text(r.get(n)) for n in filtered(options))) for r in found]


class RestReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.asked = options, {}

    def partitions(self) -> list[InputPartition]:
        o = self.options
        more = urllib.parse.urlencode(self.asked)
        add = lambda u: u + ("&" if "?" in u else "?") + more if more else u
        return [Page(add(u)) for u in pages(o["url"], int(o.get("limit", 50)), int(o.get("max", 200)))]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from fetched(partition.url, self.options)


class FilteredRestReader(RestReader):
    """Needs spark.sql.python.filterPushdown.enabled."""

    #: What a filter adds to the name of its column in a request.
    SUFFIX = {EqualTo: "", GreaterThanOrEqual: "_min", LessThanOrEqual: "_max"}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what the service knows into the request, and leaves every filter to Spark too, since a service may ignore parameters."""
        for f in filters:
            if type(f) in self.SUFFIX and len(f.attribute) == 1 and f.attribute[0] in filtered(self.options):
                self.asked[f.attribute[0] + self.SUFFIX[type(f)]] = str(f.value)
            yield f


class RestStream(SimpleDataSourceStreamReader):
    """Offsets are numbers of records; a batch is read again from its bounds alone."""

    def __init__(self, options: dict[str, str]):
        self.options, self.limit = options, int(options.get("limit", 50))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _page(self, at: int, limit: int) -> list[tuple]:
        return fetched(self.options["url"].format(limit=limit, offset=at, page=at // self.limit + 1), self.options)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start["at"]
        for _ in range(-(-int(self.options.get("max", 200)) // self.limit)):
            found = self._page(at, self.limit)
            rows, at = rows + found, at + len(found)
            if len(found) < self.limit:
                break
        return iter(rows), {"at": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start["at"]
        while at < end["at"]:
            found = self._page(at, min(self.limit, end["at"] - at))
            if not found:
                return
            yield from found
            at += len(found)


def map_records(raw: DataFrame, fields: dict[str, list[str]], record: str = "record") -> DataFrame:
    """Standard columns from JSON texts: for each, the first of its paths that is not empty."""
    pick = lambda paths: F.coalesce(*[F.nullif(F.trim(F.get_json_object(record, f"$.{p}")), F.lit("")) for p in paths])
    return raw.select("*", *[pick(paths).alias(name) for name, paths in fields.items()])


def documents(spark: SparkSession, folder: str, types: dict[str, str]) -> DataFrame:
    """Text files under type folders: doc_id from the name, README and short files left out, the first of equal names kept."""
    rows = spark.read.text(f"{folder}/*/*", wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    rows = rows.withColumns({"folder": F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), "doc_id": F.regexp_extract("path", r"/([^/]+?)(?:\.[^./]*)?$", 1)})
    kind = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    rows = rows.withColumn("doc_type", F.try_element_at(kind, "folder"))
    n_words = F.size(F.filter(F.split("value", r"\s+"), lambda w: w != ""))
    rows = rows.filter(F.col("doc_type").isNotNull() & (F.upper("doc_id") != "README") & (n_words >= MIN_WORDS))
    return rows.groupBy("doc_id").agg(F.min_by("doc_type", "path").alias("doc_type"), F.min_by("value", "path").alias("text"))


def records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): JSON records against a schema; a bad row keeps its text and the reason."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    parsed = raw.withColumn("r", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reason = F.when(F.length("value") > MAX_BYTES, "too large").when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), "not the contract")
    parsed = parsed.withColumn("reason", reason)
    return parsed.filter("reason is null").select("file", "r.*").drop("_corrupt"), parsed.filter("reason is not null").select("file", "value", "reason")


def usage_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def catalogue(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prices, rejected) of a key,value file: unknown keys, non-numbers and values out of bounds are rejected with the reason."""
    rows = spark.read.option("header", True).csv(path, schema="key string, value string").withColumn("number", F.col("value").try_cast("double"))
    rows = rows.join(known.select("key", F.lit(True).alias("_known")), "key", "left")
    reason = F.when(F.col("_known").isNull(), "unknown key").when(F.col("number").isNull(), "not a number").when((F.col("number") < 0) | (F.col("number") > 1e9), "out of bounds")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select("key", F.col("number").alias("value")), rows.filter("reason is not null").select("key", "value", "reason")


def feed(rows: DataFrame, today: str) -> DataFrame:
    """Relative day offsets as dates of a given day."""
    day = F.lit(today).cast("date")
    return rows.withColumn("published", F.date_sub(day, F.col("pub_days_ago"))).withColumn("deadline", F.date_add(day, F.col("deadline_in_days")))


Reader = Callable[[SparkSession, str], DataFrame]
