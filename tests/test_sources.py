import http.server
import io
import json
import threading
import urllib.error
import urllib.parse

import pytest
from pyspark.sql import functions as F

from catalith.sources import files, rest
from catalith.streaming import batches


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_tables_with_returns_and_quotes(spark, rows, tmp_path):
    path = put(tmp_path / "t.tsv", '﻿a \tb\nx\ry\t"say ""hi"""\nא\tz\r\n')
    df = files.read_table(spark, path)
    assert df.columns == ["a", "b", "pos"]
    assert rows(df, "a", "b") == [("x\ry", 'say "hi"'), ("א", "z")]


def test_positional_lines(spark, rows, tmp_path):
    path = put(tmp_path / "p.tsv", 'h\th\th\nh2\nk\t"q\tv\nshort\nk2\tw\tv2\textra\n')
    assert rows(files.read_positional(spark, path, {0: "k", 2: "v"}, 3, skip=2), "k", "v") == [("k", "v"), ("k2", "v2")]


def test_bounded_lines_lists_and_json(spark, rows, tmp_path):
    path = put(tmp_path / "l.tsv", "1\ta\tb\n\n2\n3\tc\n")
    assert rows(files.read_lines(spark, path, ["id", "v"]), "id", "v") == [("1", "a\tb"), ("3", "c")]
    assert rows(files.read_list(spark, put(tmp_path / "ids", "a\n a \n\nb\n"))) == [("a",), ("b",)]
    assert rows(files.read_json(spark, put(tmp_path / "m.json", json.dumps([[1, 2], [3, 4]])), "array<array<bigint>>"), "value") == [([1, 2],), ([3, 4],)]
    assert rows(files.read_json(spark, put(tmp_path / "c.json", json.dumps({"A": {"n": 1}})), "map<string,struct<n:int>>").select("key", "value.n")) == [("A", 1)]


def test_images_and_checkpoints(spark, rows, tmp_path):
    folder = tmp_path / "img" / "cats"
    folder.mkdir(parents=True)
    for name in ("a.png", "b.PNG", "c.jpg", "d.JPG", "e.jpeg", "f.JPEG"):
        (folder / name).write_bytes(b"x")
    df = files.read_images(spark, str(tmp_path / "img"))
    assert df.count() == 4 and {r["label"] for r in df.select("label").collect()} == {"cats"}
    assert files.read_checkpoint(spark, str(tmp_path / "none"), "a int").count() == 0
    assert files.read_excel(spark, str(tmp_path / "none.xlsx"), "a int").count() == 0


def test_sinks(spark, rows, tmp_path):
    df = spark.createDataFrame([("Legal Document", 'a "b"'), ("Image", "c")], "class string, v string")
    files.write_csv(df, str(tmp_path / "csv"), single=True)
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text.startswith("﻿class,v".encode()) and b'"a ""b"""' in text
    files.write_by_class(df, str(tmp_path / "by"), "class")
    assert sorted(p.name for p in (tmp_path / "by").glob("slug=*")) == ["slug=image", "slug=legal_document"]
    assert list(json.loads(files.as_sorted_json(df, "class", "v").first()[0])) == ["Image", "Legal Document"]
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert files.read_checkpoint(spark, str(tmp_path / "log"), "class string, v string").count() == 4
    files.write_missing(df, df.where("class = 'Image'"), "class", str(tmp_path / "ids"))
    assert rows(files.read_list(spark, str(tmp_path / "ids"))) == [("Legal Document",)]
    assert files.write_snapshot(df, str(tmp_path / "s"), 3).endswith("version=3")
    files.write_manifest(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


class Reply(io.BytesIO):
    headers = {"X-Total-Count": "250"}


def test_retries():
    seen = []

    def opener(request, timeout):
        seen.append(request.method)
        if len(seen) < 3:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return Reply(b"[1]")

    assert rest.call("GET", "http://h", opener=opener, pause=lambda s: None)[0] == [1]
    seen.clear()
    with pytest.raises(urllib.error.HTTPError):
        rest.call("PUT", "http://h", {}, opener=opener, pause=lambda s: None)
    assert seen == ["PUT"]


def server(n):
    def call(method, url, body=None):
        q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(url.split("?")[1]).items()}
        first = (q["page"] - 1) * q["per_page"]
        return [{"o:id": i} for i in range(first, min(n, first + q["per_page"]))], {"X-Total-Count": str(n)}

    return call


@pytest.mark.parametrize("n", [0, 1, 100, 250])
def test_pages(n):
    assert [r["o:id"] for r in rest.pages("http://h", "items", 1, None, call=server(n))] == list(range(n))
    assert rest.count("http://h", "items", call=server(n)) == n


def test_pushed_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = rest.RestReader({"base": "http://h"})
    other = GreaterThan(("id",), 3)
    assert list(reader.pushFilters([EqualTo(("class_id",), 23), other])) == [other]
    assert reader.filters == {"resource_class_id": "23"}
    assert rest.to_row({"o:id": 1, "o:resource_class": {"o:id": 2}, "o:resource_template": None})[:3] == (1, 2, None)


@pytest.fixture
def catalogue():
    """A server of 250 resources that answers signed requests of a known client only."""

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            found = [i for i in range(250) if q.get("property[0][text]", str(i)) == str(i)]
            signed = q.get("key_identity") == "me" and q.get("key_credential") == "secret" and self.headers["User-Agent"] == "reader/2"
            self.send_response(200 if signed else 403)
            self.send_header("X-Total-Count", str(len(found)))
            self.end_headers()
            first = (int(q["page"]) - 1) * int(q["per_page"])
            self.wfile.write(json.dumps([{"o:id": i} for i in found[first : first + int(q["per_page"])]]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_reading_through_spark(spark, rows, catalogue):
    rest.register(spark)
    reader = spark.read.format("catalogue_rest").options(base=catalogue, pages_per_partition=1, user_agent="reader/2", key_identity="me", key_credential="secret")
    table = reader.load()
    assert table.rdd.getNumPartitions() == 3 and sorted(rows(table, "id")) == [(i,) for i in range(250)]
    assert rows(reader.options(property="10", text="7").load(), "id") == [(7,)]


def test_credentials_and_missing_totals():
    assert rest.credentials("a", None) == {} and rest.credentials("a", "b") == {"key_identity": "a", "key_credential": "b"}
    seen = []
    with pytest.warns(UserWarning, match="set total_header"):
        assert rest.count("http://h", "items", rest.property_filter(10, "x y"), call=lambda m, u: seen.append(u) or ([], {})) == 0
    assert urllib.parse.parse_qs(seen[0].split("?")[1])["property[0][text]"] == ["x y"]


def test_sending_is_a_dry_run_by_default(spark, rows):
    df = spark.createDataFrame([("delete", 1, None)], "op string, id bigint, body string")
    assert rows(rest.send(df, "http://nowhere.invalid")) == [("delete", 1, None)]


def test_resumable_stream(spark, rows, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    stream = lambda: spark.readStream.schema("k int, v string").parquet(source)
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(source)
    batches.run_available(stream(), lambda b: b.withColumn("n", F.length("v")), "k", out, state).awaitTermination()
    spark.createDataFrame([(2, "again"), (3, "c")], "k int, v string").write.mode("append").parquet(source)
    batches.run_available(stream(), lambda b: b.withColumn("n", F.length("v")), "k", out, state).awaitTermination()
    assert rows(batches.read_output(spark, out), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]


def test_a_batch_reads_only_what_is_new(spark, rows, tmp_path):
    """Earlier output isn't read, even where it is broken, and the rows read are those of the new files."""
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda step: batches.run_available(spark.readStream.schema("k int, v string").parquet(source), step, "k", out, state)
    read = []
    for n in range(4):
        spark.createDataFrame([(10 * n + k, "v") for k in range(5)] + [(0, "old")], "k int, v string").coalesce(1).write.mode("append").parquet(source)
        query = run(lambda b: b)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        for f in (tmp_path / "out").glob(f"batch={n}/*.parquet"):
            f.with_suffix(".kept").write_bytes(f.read_bytes())
            f.write_bytes(b"broken")
    assert read == [6, 6, 6, 6]
    for f in (tmp_path / "out").glob("batch=*/*.kept"):
        f.rename(f.with_suffix(".parquet"))
    for f in (tmp_path / "out").glob("batch=*/.*.crc"):
        f.unlink()
    assert sorted(rows(batches.read_output(spark, out), "k")) == sorted((10 * n + k,) for n in range(4) for k in range(5))


def test_a_batch_that_failed_is_repeated_whole(spark, rows, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.createDataFrame([(k, "v") for k in range(10)], "k int, v string").write.parquet(source)
    stream = lambda: spark.readStream.schema("k int, v string").parquet(source)
    slip = F.when(F.col("k") == 7, F.raise_error(F.lit("slip"))).otherwise(F.col("v"))
    with pytest.raises(Exception, match="slip"):
        batches.run_available(stream(), lambda b: b.withColumn("v", slip.cast("string")), "k", out, state).awaitTermination()
    for _ in range(2):
        batches.run_available(stream(), lambda b: b, "k", out, state).awaitTermination()
    assert sorted(rows(batches.read_output(spark, out), "k")) == [(k,) for k in range(10)]


def test_distinct_events(spark, rows, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = [("a", 0), ("a", 10), ("b", 20), ("a", 30), ("c", 7200)]
    spark.createDataFrame(events, "event_id string, s long").select("event_id", F.timestamp_seconds("s").alias("ts")).write.parquet(source)
    stream = batches.distinct_events(spark.readStream.schema("event_id string, ts timestamp").parquet(source))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    assert rows(spark.read.parquet(out), "event_id") == [("a",), ("b",), ("c",)]
