"""Keyed state: corrections before and after their record, over several runs of one stream."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quern.sources import sinks
from quern.streaming import keyed

SCHEMA = "key string, value string, version long, correction boolean"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(keyed.PROVIDER[0], None)
    spark.conf.set(*keyed.PROVIDER)
    yield spark
    spark.conf.set(keyed.PROVIDER[0], before) if before else spark.conf.unset(keyed.PROVIDER[0])


def test_corrections_in_the_stream(rocks, tmp_path):
    spark = rocks
    source = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")

    def run(*rows):
        spark.createDataFrame(list(rows), SCHEMA).repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = keyed.upserted(keyed.corrected(source()), f"{tmp_path}/store", f"{tmp_path}/log", once=True)
        assert query.awaitTermination(120)
        return {r["key"]: (r["value"], r["version"], r["status"]) for r in sinks.load(spark, f"{tmp_path}/store").collect()}

    assert run(("a", "1", 1, False), ("b", "x", 5, False), ("c", "late", 9, True)) == {"a": ("1", 1, "new"), "b": ("x", 5, "new")}  # c waits for its record
    got = run(("a", "2", 2, True), ("b", "old", 3, True), ("c", "first", 4, False), ("a", "2", 2, True))
    assert got == {"a": ("2", 2, "corrected"), "b": ("x", 5, "new"), "c": ("late", 9, "new")}  # an older version changes nothing
    assert run(("a", "2", 2, True), ("d", "y", 1, True)) == got


def test_orphans_after_the_timer(rocks, tmp_path):
    spark = rocks
    spark.createDataFrame([("d", "y", 1, True), ("e", "z", 1, False)], SCHEMA).write.parquet(f"{tmp_path}/in")
    changes = keyed.corrected(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), wait_ms=1000)
    query = keyed.upserted(changes, f"{tmp_path}/store", f"{tmp_path}/log", processingTime="1 second")
    try:
        for _ in range(90):
            query.awaitTermination(1)
            if sinks.current(spark, f"{tmp_path}/store"):
                got = {r["key"]: r["status"] for r in sinks.load(spark, f"{tmp_path}/store").collect()}
                if len(got) == 2:
                    break
    finally:
        query.stop()
    assert got == {"d": "orphan", "e": "new"}


@pytest.fixture
def service():
    """Records 0.. of two countries; requests are kept."""
    seen, records = [], [{"id": k, "country": "FR" if k % 2 else "DE", "day": f"2026-01-{k + 1:02d}"} for k in range(7)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            seen.append(q)
            found = [r for r in records if q.get("country", r["country"]) == r["country"] and q.get("day_min", "") <= r["day"]]
            at = int(q.get("offset", 0))
            body = json.dumps({"data": {"rows": found[at : at + int(q.get("limit", 50))]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/api", seen, records
    server.shutdown()


def rest(reader, url):
    return reader.format("paged_rest").option("url", url + "?limit={limit}&offset={offset}").option("limit", 3).option("max", 9).option("records", "data.rows").option("filters", "country,day").load()


def test_filters_reach_the_service(spark, service):
    from quern.sources import readers

    url, seen, _ = service
    spark.dataSource.register(readers.RestSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = rest(spark.read, url).filter("country = 'FR' and day >= '2026-01-04' and page is not null").select("record").collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert [json.loads(r["record"])["id"] for r in rows] == [3, 5]
    assert seen and all(q["country"] == "FR" and q["day_min"] == "2026-01-04" for q in seen)


def test_rest_stream_reads_on(spark, service, tmp_path):
    from quern.sources import readers

    url, seen, records = service
    spark.dataSource.register(readers.RestSource)

    def run():
        query = rest(spark.readStream, url).select("record").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").option("path", f"{tmp_path}/out").trigger(once=True).start()
        assert query.awaitTermination(60)
        return sorted(json.loads(r["record"])["id"] for r in spark.read.schema("record string").parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(7))
    records += [{"id": 7, "country": "FR", "day": "2026-02-01"}, {"id": 8, "country": "DE", "day": "2026-02-02"}]
    seen.clear()
    assert run() == list(range(9)) and min(int(q["offset"]) for q in seen) == 7  # nothing that was read is asked for again
