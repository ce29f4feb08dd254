"""The data source for table services, against a service on this machine that speaks its grammar."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlparse

import pytest
from pyspark.sql import functions as F

from tradewind.sources.service import TableService, condition, literal, ranges

ROWS = [{"id": i * 3, "name": None if i % 10 == 9 else f"card {i % 7}, no. {i}", "cents": i % 13 * 25, "day": f"2024-01-{i % 28 + 1:02d}"} for i in range(1000)]
SEEN: list[list[tuple[str, str]]] = []
FAILS: list[int] = []


def holds(value, said):
    if said.startswith("not."):
        return value is not None and not holds(value, said[4:]) if said != "not.is.null" else value is not None
    op, _, arg = said.partition(".")
    if op == "is":
        return value is None
    if value is None:
        return False
    if op == "in":
        given = [x.replace('\\"', '"') if x.startswith('"') else x for x in re.findall(r'"(?:[^"\\]|\\.)*"|[^,]+', arg[1:-1])]
        return str(value) in [x.strip('"') for x in given]
    if op == "like":
        return bool(re.fullmatch(".*".join(map(re.escape, arg.split("*"))), value))
    other = type(value)(arg)
    return {"eq": value == other, "neq": value != other, "gt": value > other, "gte": value >= other, "lt": value < other, "lte": value <= other}[op]


class Service(BaseHTTPRequestHandler):
    def do_GET(self):
        if FAILS:
            self.send_response(FAILS.pop())
            self.end_headers()
            return
        asked = parse_qsl(urlparse(self.path).query)
        SEEN.append(asked)
        opts = dict(asked)
        found = [r for r in ROWS if all(holds(r[c], said) for c, said in asked if c in r)]
        found.sort(key=lambda r: r["id"])
        body = json.dumps([{c: r[c] for c in opts["select"].split(",")} for r in found[: int(opts["limit"])]]).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(TableService)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def read(schema="id bigint, name string, cents bigint, day date", **options):
        given = {"url": f"http://127.0.0.1:{server.server_port}", "table": "cards", "key": "id", "least": "0", "most": "2997", "partitions": "4", "pagesize": "50", "wait": "0.01"} | options
        return spark.read.format("table_service").schema(schema).options(**given).load()

    yield read
    server.shutdown()


def test_whole_table(service):
    got = sorted((r.id, r.name, r.cents, str(r.day)) for r in service().collect())
    assert got == [(r["id"], r["name"], r["cents"], r["day"]) for r in ROWS]
    # ranges that fit badly lose nothing
    assert service(least="500", most="600", partitions="7").count() == 1000


@pytest.mark.parametrize(
    "where, pushed",
    [
        ("cents = 100", "cents=eq.100"), ("cents > 100 AND id <= 900", "id=lte.900"), ("cents IN (25, 50)", "cents=in.(25,50)"), ("name IN ('card 1, no. 1', 'card 2, no. 2')", 'name=in.("card 1, no. 1","card 2, no. 2")'),
        ("name IS NULL", "name=is.null"), ("name LIKE 'card 3%'", "name=like.card 3*"), ("name LIKE '%no. 5%'", "name=like.*no. 5*"), ("NOT cents = 100", "cents=not.eq.100"), ("day >= DATE '2024-01-20'", "day=gte.2024-01-20"),
        ("cents % 2 = 1", None), ("name LIKE '%_1'", None), ("cents = 25 OR id < 30", None),
    ],
)
def test_filters_reach_the_service(service, where, pushed):
    want = service().where("id IS NOT NULL").toPandas()
    SEEN.clear()
    rows = service().where(where)
    got = rows.toPandas().sort_values("id")
    sent = {f"{c}={v}" for asked in SEEN for c, v in asked}
    assert pushed is None or pushed in sent
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    same = spark.createDataFrame(want).withColumn("day", F.col("day").cast("date")).where(where).toPandas().sort_values("id")
    assert got["id"].tolist() == same["id"].tolist() and 0 < len(got) < 1000


def test_columns_and_pages(service):
    SEEN.clear()
    assert service("name string").where("name = 'card 1, no. 1'").count() == 1
    assert all(dict(a)["select"] == "name,id" for a in SEEN)
    SEEN.clear()
    service("id bigint", partitions="1").count()
    assert len(SEEN) == 21 and [dict(a).get("id") for a in SEEN][:2] == [None, "gt.147"]


def test_requests_are_tried_again(service):
    FAILS.extend([503, 429, 500])
    assert service(partitions="1").count() == 1000
    FAILS.append(400)
    with pytest.raises(Exception, match="400"):
        service(partitions="1").count()


def test_grammar():
    from pyspark.sql import datasource as D

    assert [(r.least, r.most) for r in ranges(0, 9, 3)] == [(None, 3), (3, 6), (6, None)] and len(ranges(5, 5, 9)) == 1
    assert [literal("a,b", True), literal('q"', True), literal(True), literal(1.5)] == ['"a,b"', '"q\\""', "true", None]
    assert condition(D.EqualTo(("a", "b"), 1)) is None and condition(D.Not(D.In(("a",), (1, 2)))) == ("a", "not.in.(1,2)")
