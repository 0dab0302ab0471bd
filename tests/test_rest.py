"""The REST sink and stream against a server in this process."""

import http.server
import json
import threading
import urllib.parse
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql.types import StructType

from catalith.sources import rest

ROWS = "op string, id bigint, body string"
START = datetime(2024, 1, 1, tzinfo=UTC)


class Server:
    """Resources by id; ``slips`` holds answers that a request gets once after it has been carried out, or not at all."""

    def __init__(self):
        self.items, self.seen, self.slips, self.shift, self.lock = {}, [], {}, None, threading.Lock()
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def reply(self, code, body=None):
                self.send_response(code)
                self.send_header("X-Total-Count", str(len(outer.items)))
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def body(self):
                return json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")

            def do_GET(self):
                q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
                with outer.lock:
                    outer.seen.append(("GET", q))
                    found = [r for r in outer.items.values() if q.get("property[0][text]") in (None, r.get("name"))]
                    found = [r for r in found if r["o:modified"]["@value"] > q.get("modified_after", "")]
                    found.sort(key=lambda r: (r["o:modified"]["@value"], r["o:id"]), reverse=q.get("sort_order") == "desc")
                    at = (int(q["page"]) - 1) * int(q["per_page"])
                    self.reply(200, found[at : at + int(q["per_page"])])
                    if outer.shift and q.get("sort_order") == "asc":
                        outer.shift()

            def change(self, method):
                with outer.lock:
                    body, number = self.body(), self.path.split("?")[0].rsplit("/", 1)[-1]
                    name = (body or {}).get("name") or (body or {}).get("t", [{}])[0].get("@value")
                    outer.seen.append((method, name or number, self.headers["Idempotency-Key"]))
                    slip = outer.slips.pop((method, name or number), None)
                    if slip and not slip[1]:
                        return self.reply(slip[0])
                    if method == "POST":
                        number = len(outer.items) + 1
                        outer.add(number, name)
                    elif method == "DELETE" and int(number) not in outer.items:
                        return self.reply(404)
                    elif method == "DELETE":
                        del outer.items[int(number)]
                    self.reply(slip[0] if slip else 200, {"o:id": int(number)})

            def do_POST(self):
                self.change("POST")

            def do_PATCH(self):
                self.change("PATCH")

            def do_DELETE(self):
                self.change("DELETE")

            def log_message(self, *args):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.http.server_port}"

    def add(self, number, name=None, second=0):
        self.items[number] = {"o:id": number, "name": name, "o:modified": {"@value": (START + timedelta(seconds=second)).isoformat()}}

    def created(self):
        return sorted(r["name"] for r in self.items.values())


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def creates(names):
    return [("create", None, json.dumps({"t": [{"@value": n}]})) for n in names]


def sink(df, server, ledger, **more):
    df.write.format("catalogue_rest").options(base=server.base, ledger=str(ledger), property="10", term="t", **more).mode("append").save()


def test_each_row_arrives_once_though_a_task_fails(spark, rows, server, tmp_path, monkeypatch):
    """A task fails after half of its rows; the next run sends the others."""
    rest.register(spark)
    names = [f"n{k:02}" for k in range(12)]
    df = spark.createDataFrame(creates(names), ROWS).coalesce(2)
    # n03: carried out, the answer lost, and so are all answers to looking it up: 501 isn't repeated
    server.slips[("POST", "n03")], server.slips[("POST", "n09")] = (501, True), (501, False)
    with pytest.raises(Exception, match="501"):
        sink(df, server, tmp_path / "ledger")
    assert 0 < len(server.items) < 12
    sink(df, server, tmp_path / "ledger")
    assert server.created() == names
    done = rows(rest.outcomes(spark, str(tmp_path / "ledger")), "op", "id", "state")
    assert done == sorted((("create", k + 1, "done") for k in range(12)), key=repr)
    before = len(server.seen)
    sink(df, server, tmp_path / "ledger")
    assert len(server.seen) == before  # nothing is left to send
    jobs = spark.read.json(str(tmp_path / "ledger" / "_jobs" / "*" / "*.json")).collect()
    assert len(jobs) == 2 and {r["passed"] for r in jobs} >= {12}


def writer(server, ledger, call=rest.call, **more):
    schema = StructType.fromDDL(ROWS)
    return rest.RestWriter({"base": server.base, "ledger": str(ledger), **more}, schema, call)


def as_rows(spark, data):
    return spark.createDataFrame(data, ROWS).collect()


def test_a_repeated_task_and_a_server_that_stumbles(spark, server, tmp_path, monkeypatch):
    monkeypatch.setattr(rest, "BACKOFF", 0)
    data = as_rows(spark, [*creates(["a", "b"]), ("patch", 7, '{"x": 1}'), ("delete", 99, None)])
    # b is carried out, but the answer is a 503: it is found by its identifier, not made again
    server.slips[("POST", "b")] = (503, True)
    task = writer(server, tmp_path, property="10", term="t")
    assert task.write(iter(data)).counts == {"sent": 3, "found": 1, "failed": 0, "passed": 0}
    assert task.write(iter(data)).counts == {"sent": 0, "found": 0, "failed": 0, "passed": 4}
    assert server.created() == ["a", "b"] and [x[0] for x in server.seen].count("PATCH") == 1
    assert all(len(x[2]) == 64 for x in server.seen if x[0] != "GET")


def test_rows_turned_down_are_sent_by_the_next_run(spark, rows, server, tmp_path):
    data = as_rows(spark, creates(["a", "b", "a"]))
    server.slips[("POST", "a")] = (422, False)
    task = writer(server, tmp_path)
    # the second a is the same request, so it is the next try
    assert task.write(iter(data)).counts == {"sent": 2, "found": 0, "failed": 1, "passed": 0}
    assert server.created() == ["a", "b"]
    server.slips[("POST", "c")] = (422, False)
    task.write(iter(as_rows(spark, creates(["c"]))))
    failed = [tuple(r) for r in rest.outcomes(spark, str(tmp_path)).where("state = 'failed'").select("op", "error").collect()]
    assert failed == [("create", "422 Unprocessable Entity")] or failed[0][1].startswith("422")
    task.write(iter(as_rows(spark, creates(["c"]))))
    assert server.created() == ["a", "b", "c"]


def test_keys_tell_equal_requests_apart_and_rows_need_their_columns(spark, server, tmp_path):
    schema = StructType.fromDDL(ROWS + ", key string")
    data = spark.createDataFrame([(*c, k) for c, k in zip(creates(["a", "a", "a"]), ["1", "2", "2"], strict=True)], schema).collect()
    rest.RestWriter({"base": server.base, "ledger": str(tmp_path)}, schema).write(iter(data))
    assert server.created() == ["a", "a"]
    with pytest.raises(ValueError, match="lack"):
        rest.RestWriter({"base": server.base, "ledger": str(tmp_path)}, StructType.fromDDL("op string"))


def scan(reader, start, end):
    return [r[0] for part in reader.partitions(start, end) for r in reader.read(part)]


def test_only_what_changed_is_read(server):
    for k in range(250):
        server.add(k, second=k // 7)
    reader = rest.RestStreamReader({"base": server.base})
    first = reader.latestOffset()
    assert sorted(scan(reader, reader.initialOffset(), first)) == list(range(250))
    assert scan(reader, first, reader.latestOffset()) == []
    server.add(3, second=100)
    server.add(900, second=101)
    server.seen.clear()
    second = reader.latestOffset()
    assert scan(reader, first, second) == [3, 900] and len(server.seen) <= 3
    assert json.loads(json.dumps(second)) == second and scan(reader, first, second) == [3, 900]


def test_a_second_that_fills_pages(server):
    for k in range(430):
        server.add(k, second=5 if 20 <= k < 400 else k // 50)
    reader = rest.RestStreamReader({"base": server.base})
    got = scan(reader, reader.initialOffset(), reader.latestOffset())
    assert sorted(got) == list(range(430)) and len(set(got)) == 430


def test_a_scan_under_shifting_pages_loses_and_repeats_nothing(server):
    for k in range(600):
        server.add(k, second=k)
    reader = rest.RestStreamReader({"base": server.base})
    end, moved = reader.latestOffset(), iter(range(0, 600, 37))

    def shift():
        k = next(moved, None)
        if k is not None:
            server.add(k, second=1000 + k)

    server.shift = shift
    got = scan(reader, reader.initialOffset(), end)
    server.shift = None
    later = scan(reader, end, reader.latestOffset())
    assert len(set(got)) == len(got) and set(got) | set(later) == set(range(600))


def test_stream_through_spark(spark, rows, server, tmp_path):
    rest.register(spark)
    for k in range(130):
        server.add(k, second=k)
    read = lambda: spark.readStream.format("catalogue_rest").options(base=server.base, requests_per_second=200).load()
    counted = []

    def run():
        def keep(batch, number):
            counted.append(batch.count())
            batch.select("id").write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

        read().writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start().awaitTermination()

    run()
    server.add(5, second=300)
    server.add(777, second=301)
    run()
    assert counted[0] == 130 and sorted(rows(spark.read.parquet(f"{tmp_path}/out"), "id")) == sorted([(k,) for k in range(130)] + [(5,), (777,)])


def test_the_budget_is_shared():
    made, now = [], [0.0]
    ask = rest.paced(lambda: made.append(now[0]), 0.5, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(4):
        ask()
    assert made == [0.0, 0.5, 1.0, 1.5] and rest.paced(len, 0) is len
    reader = rest.RestReader({"base": "http://h", "pages_per_partition": "1", "requests_per_second": "2", "total_header": "n"})
    reader.call = lambda m, u: ([], {"n": "1000"})
    assert [p.interval for p in reader.partitions()] == [5.0] * 10
