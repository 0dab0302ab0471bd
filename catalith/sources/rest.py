"""A paged REST collection as a Spark data source, stream and sink.

One partition per range of pages, a pushed equality filter as a query parameter,
retries on 500, 502, 503 and 504 for reads, creates and patches, not for
replacements and deletions. Every request names its client and carries the
credentials, if any, as query parameters, as the server wants them. ``call`` can
be replaced in tests.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PER_PAGE, RETRIES, BACKOFF = 100, 5, 1.0
RETRY_ON = frozenset({500, 502, 503, 504})
RETRY_METHODS = frozenset({"GET", "POST", "PATCH"})
METHODS = {"create": "POST", "patch": "PATCH", "replace": "PUT", "delete": "DELETE"}
#: Name of the client; some servers turn nameless ones away.
AGENT = "catalith/1.0"
#: Reply header with the number of rows.
TOTAL = "X-Total-Count"
SCHEMA = "id bigint, class_id int, template_id int, body string"


def call(
    method: str, url: str, body: dict | None = None, opener: Callable = urllib.request.urlopen, pause: Callable = time.sleep, agent: str = AGENT,
    retries: int = RETRIES, headers: dict[str, str] | None = None,
):
    """(decoded reply, headers) of a request."""
    data = None if body is None else json.dumps(body).encode()
    fields = {"Content-Type": "application/json", "Connection": "close", "User-Agent": agent} | (headers or {})
    for attempt in range(retries + 1):
        request = urllib.request.Request(url, data, fields, method=method)
        try:
            with opener(request, timeout=60) as reply:
                text = reply.read()
                return (json.loads(text) if text else None), reply.headers
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_ON or method not in RETRY_METHODS or attempt == retries:
                raise
            pause(BACKOFF * 2**attempt)
    raise AssertionError


def credentials(identity: str | None, credential: str | None) -> dict[str, str]:
    """Query parameters that sign a request; none without both halves."""
    return {"key_identity": identity, "key_credential": credential} if identity and credential else {}


def property_filter(property_id: str | int, text: str) -> dict[str, str]:
    """Query parameters of a search for a property's exact value, such as an identifier."""
    return {"property[0][property]": str(property_id), "property[0][type]": "eq", "property[0][text]": text}


def page_url(base: str, path: str, page: int, filters: dict[str, str] | None = None) -> str:
    return f"{base}/{path}?{urllib.parse.urlencode({**(filters or {}), 'per_page': PER_PAGE, 'page': page})}"


def count(base: str, path: str, filters: dict[str, str] | None = None, call: Callable = call, header: str = TOTAL) -> int:
    """The number of rows that the server reports; 0 with a warning where it reports none."""
    _, headers = call("GET", page_url(base, path, 1, filters))
    total = headers.get(header)
    if total is None:
        warnings.warn(f"no header {header}: pages of {path} are read one after another; set total_header", stacklevel=2)
    return int(total or 0)


def pages(base: str, path: str, first: int, last: int | None, filters: dict[str, str] | None = None, call: Callable = call) -> Iterator[dict]:
    """Resources of pages from ``first``; ends at an empty or short page, or after ``last``."""
    page = first
    while last is None or page <= last:
        rows, _ = call("GET", page_url(base, path, page, filters))
        yield from rows or []
        if len(rows or []) < PER_PAGE:
            return
        page += 1


def to_row(resource: dict) -> tuple:
    def number(key: str):
        return (resource.get(key) or {}).get("o:id")

    return resource.get("o:id"), number("o:resource_class"), number("o:resource_template"), json.dumps(resource, ensure_ascii=False, sort_keys=True)


class Pages(InputPartition):
    def __init__(self, first: int, last: int | None, interval: float = 0.0):
        self.first, self.last, self.interval = first, last, interval


def paced(call: Callable, interval: float, clock: Callable = time.monotonic, pause: Callable = time.sleep) -> Callable:
    """The call, begun at most once in ``interval`` seconds."""
    if interval <= 0:
        return call
    last = [float("-inf")]

    def run(*args, **kwargs):
        wait = last[0] + interval - clock()
        if wait > 0:
            pause(wait)
        last[0] = clock()
        return call(*args, **kwargs)

    return run


class RestReader(DataSourceReader):
    """Options: base, path, pages_per_partition, total_header, key_identity, key_credential, user_agent, requests_per_second, property and text.

    ``property`` (an id) with ``text`` asks the server for resources with just that value.
    ``requests_per_second`` is a budget that all partitions share: each gets its part of it.
    """

    def __init__(self, options):
        self.base, self.path = options["base"], options.get("path", "items")
        self.width = int(options.get("pages_per_partition", 20))
        self.header = options.get("total_header", TOTAL)
        self.call = partial(call, agent=options.get("user_agent", AGENT))
        self.rate = float(options.get("requests_per_second", 0))
        self.filters = credentials(options.get("key_identity"), options.get("key_credential"))
        if options.get("property"):
            self.filters |= property_filter(options["property"], options.get("text", ""))

    def pushFilters(self, filters):
        """Class and template equality go to the server; others stay with Spark."""
        names = {("class_id",): "resource_class_id", ("template_id",): "resource_template_id"}
        for f in filters:
            if isinstance(f, EqualTo) and tuple(f.attribute) in names:
                self.filters[names[tuple(f.attribute)]] = str(f.value)
            else:
                yield f

    def partitions(self):
        n = -(-count(self.base, self.path, self.filters, self.call, self.header) // PER_PAGE)
        starts = range(1, n + 1, self.width)
        interval = max(len(starts), 1) / self.rate if self.rate else 0.0
        return [Pages(i, min(i + self.width - 1, n), interval) for i in starts] or [Pages(1, None, interval)]

    def read(self, partition):
        for resource in pages(self.base, self.path, partition.first, partition.last, self.filters, paced(self.call, partition.interval)):
            yield to_row(resource)


# --- stream ------------------------------------------------------------------------


def stamp(resource: dict) -> str:
    """When a resource was changed last, or made, in UTC."""
    text = (resource.get("o:modified") or resource.get("o:created") or {}).get("@value")
    if not text:
        return ""
    at = datetime.fromisoformat(text)
    return at.astimezone(UTC).isoformat(timespec="seconds") if at.tzinfo else at.replace(tzinfo=UTC).isoformat(timespec="seconds")


class Since(InputPartition):
    def __init__(self, start: tuple[str, int], end: tuple[str, int]):
        self.start, self.end = start, end


class RestStreamReader(DataSourceStreamReader):
    """Resources by the time of their last change; an offset is (modified, id).

    Options as of the reader, and ``since`` (name of the parameter that asks for
    changes after a time; modified_after). A batch reads what lies between two offsets,
    so a restart asks only for what changed after the last one.

    A batch doesn't count pages over a set that may shift under it. Each request asks anew for
    what changed since just before the last resource seen, and resources up to that
    one are passed over; further pages are asked for only while a whole page shows nothing new.
    A resource that changes during the scan leaves the batch for a later one.
    """

    def __init__(self, options):
        self.base, self.path, self.since = options["base"], options.get("path", "items"), options.get("since", "modified_after")
        rate = float(options.get("requests_per_second", 0))
        self.agent, self.interval = options.get("user_agent", AGENT), 1 / rate if rate else 0.0
        self.filters = credentials(options.get("key_identity"), options.get("key_credential"))

    def _call(self) -> Callable:
        return paced(partial(call, agent=self.agent), self.interval)

    def initialOffset(self):
        return {"modified": "", "id": 0}

    def latestOffset(self):
        newest, _ = self._call()("GET", page_url(self.base, self.path, 1, self.filters | {"sort_by": "modified", "sort_order": "desc"}))
        modified, number = max(((stamp(r), r["o:id"]) for r in newest or []), default=("", 0))
        return {"modified": modified, "id": number}

    def partitions(self, start, end):
        return [Since((start["modified"], start["id"]), (end["modified"], end["id"]))]

    def read(self, partition):
        ask, seen, page = self._call(), partition.start, 1
        while seen < partition.end:
            filters = self.filters | {"sort_by": "modified", "sort_order": "asc"}
            if seen[0]:
                filters[self.since] = (datetime.fromisoformat(seen[0]) - timedelta(seconds=1)).isoformat(timespec="seconds")
            rows, _ = ask("GET", page_url(self.base, self.path, page, filters))
            new = sorted(((stamp(r), r["o:id"]), to_row(r)) for r in rows or [] if seen < (stamp(r), r["o:id"]) <= partition.end)
            full = len(rows or []) >= PER_PAGE
            if full and new and new[-1][0][0] == stamp(rows[-1]):
                # others of the last second may follow on the next page: they come with the next request
                settled = [n for n in new if n[0][0] < stamp(rows[-1])]
                if settled:
                    new = settled
                else:
                    yield from self._second(ask, new[0][0][0], seen, partition.end)
                    seen, page = (new[0][0][0], 1 << 62), 1
                    continue
            yield from (row for _, row in new)
            if new:
                seen, page = new[-1][0], 1
            elif full and stamp(rows[-1]) <= partition.end[0]:
                page += 1
            else:
                return

    def _second(self, ask: Callable, second: str, seen: tuple, end: tuple) -> Iterator[tuple]:
        """All resources of one second that fills whole pages, each once."""
        found: dict[int, tuple] = {}
        filters = self.filters | {"sort_by": "modified", "sort_order": "asc", self.since: (datetime.fromisoformat(second) - timedelta(seconds=1)).isoformat(timespec="seconds")}
        before = -1
        while before < len(found):  # again, until a pass over the pages shows nothing new
            before, page = len(found), 1
            while True:
                rows, _ = ask("GET", page_url(self.base, self.path, page, filters))
                found |= {r["o:id"]: to_row(r) for r in rows or [] if stamp(r) == second and seen < (second, r["o:id"]) <= end}
                if len(rows or []) < PER_PAGE or stamp(rows[-1]) > second:
                    break
                page += 1
        yield from (found[k] for k in sorted(found))


# --- sink --------------------------------------------------------------------------


class Ledger:
    """One small file for each request, under a folder that driver and executors share: sent, then done or failed."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (fs.LocalFileSystem(), folder)

    def _path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def read(self, key: str) -> dict | None:
        try:
            with self.fs.open_input_stream(self._path(key)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def write(self, key: str, entry: dict) -> None:
        """Put the entry in place whole: a reader sees the old one or the new one."""
        path, draft = self._path(key), f"{self.root}/_drafts/{uuid.uuid4().hex}"
        for folder in (path, draft):
            self.fs.create_dir(folder.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps({"key": key} | entry).encode())
        self.fs.move(draft, path)


def outcomes(spark: SparkSession, ledger: str) -> DataFrame:
    """(key, op, id, state, error) of all requests in the ledger; id is a created resource's new one."""
    return spark.read.schema("key string, op string, id bigint, state string, error string").json(f"{ledger}/[0-9a-f][0-9a-f]/*.json")


@dataclass
class Sent(WriterCommitMessage):
    """What a task did."""

    counts: dict[str, int]


class RestWriter(DataSourceWriter):
    """K8: rows (op, id, body[, key]) as requests, each of which the server gets once, however often tasks and jobs are repeated.

    Options: base, path, ledger (a shared folder), key_identity, key_credential,
    user_agent, and property with term: the identifier's property and its name in bodies.

    A request is known by ``key``, or by its op, id and body. The ledger holds it as sent before it
    goes out and as done after the reply. A repeated task passes over what is done. A create that was sent
    but never answered may have arrived: it is looked up by its identifier first, with
    property and term, and every create carries its key as Idempotency-Key for servers that
    know that header. Without either, such a create is sent again. Patches,
    replacements and deletions may be repeated without harm; a deletion of what is gone is done.

    Requests that the server turns down (4xx) are failed, with the error, and are sent
    again by the next run. Other errors end the task, and Spark or the next run goes on from
    the ledger. Speculative execution would run a request twice at a time: leave it off.
    """

    def __init__(self, options, schema: StructType, call: Callable = call):
        self.base, self.path, self.folder = options["base"], options.get("path", "items"), options["ledger"]
        self.sign = credentials(options.get("key_identity"), options.get("key_credential"))
        self.property, self.term, self.agent = options.get("property"), options.get("term"), options.get("user_agent", AGENT)
        missing = {"op", "id", "body"} - set(schema.names)
        if missing:
            raise ValueError(f"rows lack {sorted(missing)}")
        self.call = call

    def write(self, iterator):
        ledger, counts = Ledger(self.folder), dict.fromkeys(("sent", "found", "failed", "passed"), 0)
        for row in iterator:
            given = row["key"] if "key" in row else None
            key = hashlib.sha256(json.dumps([given] if given is not None else [row["op"], row["id"], row["body"]]).encode()).hexdigest()
            had = ledger.read(key)
            if had and had["state"] == "done":
                counts["passed"] += 1
                continue
            counts[self._send(ledger, key, row, bool(had) and had["state"] == "sent")] += 1
        return Sent(counts)

    def _send(self, ledger: Ledger, key: str, row, doubt: bool) -> str:
        op, body = row["op"], json.loads(row["body"]) if row["body"] else None
        entry = {"op": op, "id": row["id"]}
        url = f"{self.base}/{self.path}" if op == "create" else f"{self.base}/{self.path}/{int(row['id'])}"
        for attempt in range(RETRIES + 1):
            found = self._find(body) if op == "create" and doubt else None
            if found is not None:
                ledger.write(key, entry | {"id": found, "state": "done"})
                return "found"
            ledger.write(key, entry | {"state": "sent"})
            try:
                retries = 0 if op == "create" else RETRIES
                reply, _ = self.call(METHODS[op], url + self._query(self.sign), body, agent=self.agent, retries=retries, headers={"Idempotency-Key": key})
            except urllib.error.HTTPError as e:
                if op == "delete" and e.code in (404, 410):
                    reply = None
                elif 400 <= e.code < 500:
                    ledger.write(key, entry | {"state": "failed", "error": f"{e.code} {e.reason}"})
                    return "failed"
                elif op == "create" and e.code in RETRY_ON and attempt < RETRIES:
                    doubt = True  # it may have arrived all the same
                    time.sleep(BACKOFF * 2**attempt)
                    continue
                else:
                    raise
            new = (reply or {}).get("o:id") if op == "create" else row["id"]
            ledger.write(key, entry | {"id": new, "state": "done"})
            return "sent"
        raise AssertionError

    def _query(self, fields: dict[str, str]) -> str:
        return f"?{urllib.parse.urlencode(fields)}" if fields else ""

    def _find(self, body: dict | None) -> int | None:
        """The id of the resource that has the body's identifier, if the server has one."""
        values = (body or {}).get(self.term or "") or []
        text = next((v.get("@value") for v in values if v.get("@value")), None)
        if not self.property or text is None:
            return None
        rows, _ = self.call("GET", page_url(self.base, self.path, 1, self.sign | property_filter(self.property, text)), agent=self.agent)
        return min((r["o:id"] for r in rows or []), default=None)

    def commit(self, messages):
        """Note the sums of the whole job."""
        total: dict[str, int] = {}
        for m in messages:
            for name, n in (m.counts if m else {}).items():
                total[name] = total.get(name, 0) + n
        Ledger(f"{self.folder}/_jobs").write(uuid.uuid4().hex, total)

    def abort(self, messages):
        """What was sent stays sent and noted; the next run goes on from there."""


class RestSource(DataSource):
    """``spark.read.format("catalogue_rest").options(base=..., path=...).load()``, the same with ``readStream``, and

    ``rows.write.format("catalogue_rest").options(base=..., ledger=...).mode("append").save()``
    """

    @classmethod
    def name(cls):
        return "catalogue_rest"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RestReader(self.options)

    def streamReader(self, schema):
        return RestStreamReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a catalogue can only be appended to")
        return RestWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RestSource)


def send(rows: DataFrame, base: str, path: str = "items", parallel: int = 4, apply: bool = False, call: Callable = call, sign: dict[str, str] | None = None) -> DataFrame:
    """(op, id, body) to the server, with (op, id, error) back, over ``parallel`` connections.

    op is create, patch, replace or delete. Without ``apply`` it is a dry run.
    A patch must carry whole resources: absent properties are erased (M12).
    ``sign`` holds ``credentials``. A task that is run again repeats its requests;
    ``RestWriter`` keeps a ledger, so that it repeats none.
    """
    query = f"?{urllib.parse.urlencode(sign)}" if sign else ""

    def run(batches):
        import pandas as pd

        for batch in batches:
            errors = []
            for op, key, body in zip(batch["op"], batch["id"], batch["body"], strict=True):
                error = None
                if apply:
                    url = f"{base}/{path}" if op == "create" else f"{base}/{path}/{int(key)}"
                    try:
                        call(METHODS[op], url + query, json.loads(body) if body else None)
                    except Exception as e:
                        error = str(e)
                errors.append(error)
            yield pd.DataFrame({"op": batch["op"], "id": batch["id"], "error": pd.Series(errors, index=batch.index, dtype="object")})

    return rows.select("op", "id", "body").repartition(parallel).mapInPandas(run, "op string, id bigint, error string")
