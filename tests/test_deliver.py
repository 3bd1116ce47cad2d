import os
import threading
import time

import pytest
from conftest import rows

from tidegate.errors import DeliveryError
from tidegate.operators.deliver import HttpSender, deliver, delivery_gate, delivery_summary


def send(payload, key):
    if "boom" in payload:
        raise OSError("no route")
    return 422 if "bad" in payload else 201


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "i int, value string")


def test_statuses(spark, tmp_path):
    df = lines(spark, ' {"a":1} ', "", "   ", "bad", "boom", None)
    sent = deliver(df, "value", send, str(tmp_path / "s"), concurrency=3, keep=["i"])
    assert rows(sent.select("i", "status", "error")) == [
        (0, 201, None), (3, 422, "HTTP status 422"), (4, None, "OSError: no route"),
    ]
    assert tuple(delivery_summary(sent).first()) == (3, 1, 2)
    assert delivery_gate(sent, stop_on_fail=False) is sent
    with pytest.raises(DeliveryError, match="2 requests failed"):
        delivery_gate(sent)


def test_each_payload_is_sent_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def record(payload, key):
        with open(log / key, "a") as file:
            file.write(payload + "\n")
        return 422 if "bad" in payload else 200

    df = lines(spark, "one", "two", "bad")
    sent = deliver(df, "value", record, str(tmp_path / "s"), key="i")
    assert sent.count() == sent.count() == 3
    assert all(len(f.read_text().splitlines()) == 1 for f in log.iterdir())
    more = lines(spark, "one", "two", "bad", "two")
    again = deliver(more, "value", record, str(tmp_path / "s"), key="i", resume=True)
    assert {f.name: f.read_text().split() for f in log.iterdir()} == {
        "0": ["one"], "1": ["two"], "2": ["bad", "bad"], "3": ["two"],
    }
    assert rows(again.select("key", "status", "attempt")) == [("0", 200, 1), ("1", 200, 1), ("2", 422, 2), ("3", 200, 2)]
    with pytest.raises(DeliveryError, match="1 requests failed"):
        delivery_gate(again)
    healed = deliver(more, "value", lambda payload, key: 200, str(tmp_path / "s"), key="i", resume=True)
    assert tuple(delivery_summary(delivery_gate(healed)).first()) == (4, 4, 0)
    with pytest.raises(ValueError, match="key"):
        deliver(df, "value", record, str(tmp_path / "s"), resume=True)


def test_equal_payloads_are_all_sent(spark, tmp_path):
    sent = deliver(lines(spark, "same", "same", "same"), "value", send, str(tmp_path / "s"))
    assert sent.count() == 3


def test_nothing_to_send(spark, tmp_path):
    sent = deliver(lines(spark, "", " "), "value", send, str(tmp_path / "s"))
    with pytest.raises(DeliveryError, match="no payloads"):
        delivery_gate(sent)


def test_http_sender_settings():
    assert HttpSender("http://x", "put").method == "PUT"
    with pytest.raises(ValueError):
        HttpSender("http://x", "GET")


class Receiver:
    """Notes when each request starts and ends, and is busy for the first tries of some."""

    def __init__(self, folder, busy=0, pause=0.0):
        self.folder, self.busy, self.pause, self.seen = str(folder), busy, pause, {}

    def __call__(self, payload, key):
        start = time.time()
        time.sleep(self.pause)
        self.seen[key] = self.seen.get(key, 0) + 1
        name = f"{self.folder}/{key}-{self.seen[key]}-{os.getpid()}-{threading.get_ident()}"
        with open(name, "w") as file:
            file.write(f"{start} {time.time()}")
        if "boom" in payload:
            raise OSError("no route")
        if "bad" in payload:
            return 422
        return 503 if self.seen[key] <= self.busy else 200


def most_at_once(folder):
    times = [tuple(map(float, f.read_text().split())) for f in folder.iterdir()]
    changes = sorted([(start, 1) for start, _ in times] + [(end, -1) for _, end in times])
    at = most = 0
    for _, change in changes:
        at += change
        most = max(most, at)
    return most


@pytest.mark.parametrize("concurrency, tasks", [(2, None), (12, None), (8, 2), (1, None)])
def test_requests_in_flight(spark, tmp_path, concurrency, tasks):
    """As many as allowed at most, spread over threads and tasks."""
    log = tmp_path / "log"
    log.mkdir()
    df = lines(spark, *(f"p{i}" for i in range(60)))
    sent = deliver(df, "value", Receiver(log, pause=0.05), str(tmp_path / "s"), concurrency, key="i", tasks=tasks)
    assert sent.count() == 60 == len(list(log.iterdir()))
    assert most_at_once(log) <= concurrency
    if concurrency >= 8:
        assert most_at_once(log) > 3
        assert len({f.name.split("-")[2:][1] for f in log.iterdir()}) > 3


def test_busy_receivers_are_tried_again(spark, tmp_path):
    df = lines(spark, "one", "bad", "boom")
    for folder, retries, expected in (
        ("a", 0, [("0", 503, 1), ("1", 422, 1), ("2", None, 1)]), ("b", 1, [("0", 503, 2), ("1", 422, 1), ("2", None, 2)]),
        ("c", 3, [("0", 200, 3), ("1", 422, 1), ("2", None, 4)]),
    ):
        (tmp_path / folder).mkdir()
        receiver = Receiver(tmp_path / folder, busy=2)
        sent = deliver(df, "value", receiver, str(tmp_path / f"s{folder}"), key="i", retries=retries, backoff=0.01)
        assert rows(sent.select("key", "status", "tries")) == expected


def test_rate_and_stop(spark, tmp_path):
    for name in ("rate", "stop"):
        (tmp_path / name).mkdir()
    df = lines(spark, *(f"p{i}" for i in range(20)))
    deliver(df, "value", Receiver(tmp_path / "rate"), str(tmp_path / "r"), 4, key="i", tasks=1, rate=40)
    starts = sorted(float(f.read_text().split()[0]) for f in (tmp_path / "rate").iterdir())
    assert len(starts) == 20 and starts[-1] - starts[0] > 0.4
    bad = lines(spark, "bad", *(f"p{i}" for i in range(20)))
    sent = deliver(bad.coalesce(1), "value", Receiver(tmp_path / "stop", pause=0.01), str(tmp_path / "t"), 1, key="i", tasks=1, stop_on_fail=True)
    found = rows(sent.select("key", "error", "tries"), "key")
    stopped = [r for r in found if r[1] and r[1].startswith("NotSent")]
    assert ("0", "HTTP status 422", 1) in found and all(r[2] == 0 for r in stopped)
    assert len(stopped) + len(list((tmp_path / "stop").iterdir())) == 21
    done = deliver(bad.filter("i > 0"), "value", Receiver(tmp_path / "stop"), str(tmp_path / "t"), key="i", resume=True)
    assert done.filter("status = 200").count() == 20
    with pytest.raises(ValueError):
        deliver(df, "value", send, str(tmp_path / "u"), 0)
