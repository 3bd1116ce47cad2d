"""Delivery of rows, one request each, from the tasks that hold them."""

import http.client
import threading
import time
import urllib.parse
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.errors import DeliveryError
from tidegate.functions.missing import column
from tidegate.functions.patterns import stripped

Send = Callable[[str, str], int]


@dataclass
class HttpSender:
    """Sends a payload to ``url`` and returns the response status."""

    url: str
    method: str = "POST"
    headers: dict = field(default_factory=dict)
    timeout: float = 60.0

    def __post_init__(self):
        self.method = self.method.upper()
        if self.method not in ("POST", "PUT"):
            raise ValueError(f"method must be POST or PUT, not '{self.method}'.")

    def __getstate__(self):
        return {name: value for name, value in vars(self).items() if name != "_threads"}

    def _connected(self) -> http.client.HTTPConnection:
        """The connection that the requests of this thread share."""
        own = vars(self).setdefault("_threads", threading.local())
        if not hasattr(own, "connection"):
            parts = urllib.parse.urlsplit(self.url)
            secure = parts.scheme == "https"
            kind = http.client.HTTPSConnection if secure else http.client.HTTPConnection
            own.connection = kind(parts.hostname, parts.port, timeout=self.timeout)
        return own.connection

    def __call__(self, payload: str, key: str) -> int:
        headers = {"Content-Type": "application/json", **self.headers}
        if key:
            headers.setdefault("Idempotency-Key", key)
        parts = urllib.parse.urlsplit(self.url)
        target = urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, ""))
        connection = self._connected()
        try:
            connection.request(self.method, target, payload.encode("utf-8"), headers)
            response = connection.getresponse()
            response.read()
        except Exception:
            # The next request opens a new one.
            connection.close()
            del self._threads.connection
            raise
        return response.status


#: Statuses that a later try may change.
BUSY = (408, 425, 429, 500, 502, 503, 504)
_NOT_SENT = "NotSent: an earlier request of the task failed"


class _Window:
    """Sends the payloads of a task: so many in flight, spaced by a rate, tried again with back-off."""

    def __init__(self, send: Send, size: int, gap: float, retries: int, backoff: float, stop: bool):
        self.send, self.gap, self.retries, self.backoff, self.stop = send, gap, retries, backoff, stop
        self.pool = ThreadPoolExecutor(size)
        self.lock, self.free, self.failed = threading.Lock(), 0.0, threading.Event()

    def _wait(self) -> None:
        """Until the next request may start."""
        if self.gap:
            with self.lock:
                start = max(self.free, time.monotonic())
                self.free = start + self.gap
            time.sleep(max(0.0, start - time.monotonic()))

    def _one(self, payload: str, key: str) -> tuple[int | None, str | None, int]:
        for tries in range(1, self.retries + 2):
            if self.stop and self.failed.is_set():
                return None, _NOT_SENT, tries - 1
            self._wait()
            try:
                status = self.send(payload, key)
                error = f"HTTP status {status}" if status >= 400 else None
                again = status in BUSY
            except Exception as raised:  # a failed request is a result row
                status, error, again = None, f"{type(raised).__name__}: {raised}", True
            if not error or not again or tries > self.retries:
                break
            time.sleep(self.backoff * 2 ** (tries - 1))
        if error:
            self.failed.set()
        return status, error, tries

    def outcomes(self, payloads, keys) -> list[tuple[int | None, str | None, int]]:
        return list(self.pool.map(self._one, payloads, keys))


def _shape(spark, concurrency: int, tasks: int | None) -> tuple[int, int, int]:
    """Tasks, how many of them run at once, and the requests that each has in flight."""
    slots = spark.sparkContext.defaultParallelism
    if concurrency < slots:
        # Each running task has a request in flight, so there are no more tasks than requests.
        tasks = min(tasks or concurrency, concurrency)
        return tasks, tasks, 1
    tasks = tasks or max(slots, int(spark.conf.get("spark.sql.shuffle.partitions")))
    running = min(tasks, slots)
    return tasks, running, concurrency // running


def deliver(
    df: DataFrame,
    payload: str,
    send: Send,
    status_path: str,
    concurrency: int = 10,
    keep: list[str] | None = None,
    key: str | None = None,
    resume: bool = False,
    tasks: int | None = None,
    retries: int = 0,
    backoff: float = 0.5,
    rate: float | None = None,
    stop_on_fail: bool = False,
) -> DataFrame:
    """Send each non-blank payload once and return ``(*keep, key, status, error, attempt, tries)``.

    At most ``concurrency`` requests are in flight: the tasks that run at once share them, each with
    a window of its own, and a table has as many ``tasks`` as shuffles have partitions by default
    (``concurrency`` of them if that is less than there are cores). They also share ``rate``, the requests
    a second. A request that raises or finds the receiver busy is tried ``retries`` times more, after
    ``backoff`` seconds, then twice as many, and so on. With ``stop_on_fail`` a task sends nothing more
    once a request has failed; rows that were not sent say so in ``error``.

    The outcome is written below ``status_path`` and read back, so using the result again does
    not send again. A task that is run again repeats its requests; name a column that identifies
    rows as ``key``, and receivers can drop such repeats by it. With ``resume``, rows that an
    earlier run delivered are left out; this needs a ``key``, as equal payloads are not one row.
    Of a key that was sent in several runs only the rows of the latest one are returned. ``send`` is
    called by several threads of a task.
    """
    if concurrency < 1 or retries < 0 or (rate is not None and rate <= 0):
        raise ValueError("concurrency and rate have to be positive, retries not negative.")
    if resume and key is None:
        raise ValueError("To resume, rows must be identified by a key column.")
    spark = df.sparkSession
    keep = keep or []
    identity = F.lit("") if key is None else column(key).cast("string")
    rows = df.select(
        *map(column, keep), identity.alias("key"), stripped(column(payload)).alias("_payload")
    ).where("_payload != ''")
    fields = [df.schema[name] for name in keep] + [
        T.StructField("key", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("tries", T.IntegerType()),
    ]
    number = 1
    if resume:
        earlier = _statuses(spark, status_path, fields)
        if earlier is not None:
            number += earlier.agg(F.max("attempt")).first()[0] or 0
            done = earlier.where(F.col("error").isNull()).select("key").distinct()
            rows = rows.join(done, "key", "left_anti").select(*map(column, keep), "key", "_payload")

    tasks, running, window = _shape(spark, concurrency, tasks)
    gap = running / rate if rate else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Window(send, window, gap, retries, backoff, stop_on_fail)
        with own.pool:
            for batch in batches:
                outcomes = own.outcomes(batch["_payload"], batch["key"])
                status, error, tries = zip(*outcomes) if outcomes else ([], [], [])
                yield batch.drop(columns="_payload").assign(
                    status=pd.array(status, dtype="Int32"),
                    error=pd.Series(error, index=batch.index, dtype=object),
                    attempt=number,
                    tries=pd.array(tries, dtype="Int32"),
                )

    sent = rows.repartition(tasks).mapInPandas(run, T.StructType(fields))
    sent.write.mode("append" if resume else "overwrite").parquet(status_path)
    statuses = _statuses(spark, status_path, fields)
    if number == 1:
        return statuses
    latest = statuses.groupBy("key").agg(F.max("attempt").alias("attempt"))
    return statuses.join(latest, ["key", "attempt"]).select(*[f.name for f in fields])


def _statuses(spark, path: str, fields: list) -> DataFrame | None:
    try:
        return spark.read.schema(T.StructType(fields)).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def delivery_summary(statuses: DataFrame) -> DataFrame:
    """``(requests_sent, succeeded, failed)``."""
    return statuses.agg(
        F.count("*").alias("requests_sent"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def delivery_gate(statuses: DataFrame, stop_on_fail: bool = True) -> DataFrame:
    """Raise if nothing was sent, or if a request failed and ``stop_on_fail`` is set."""
    found = statuses.agg(
        F.count("*").alias("sent"),
        F.count("error").alias("failed"),
        F.min("error").alias("example"),
    ).first()
    if not found.sent:
        raise DeliveryError("There were no payloads to send.")
    if found.failed and stop_on_fail:
        raise DeliveryError(f"{found.failed} requests failed, such as: {found.example}")
    return statuses
