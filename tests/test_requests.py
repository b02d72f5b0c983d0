"""Requests sent once, kept lookups and sessions."""

import collections
import http.server
import threading
import time

import pytest

from vigilake.sources import readers, requests, sinks


@pytest.fixture
def host():
    asked, times, state = collections.Counter(), [], {"down": True}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            times.append(time.monotonic())
            n = int(self.path.rpartition("/")[2])
            status = 404 if n == 3 else 429 if n == 4 and asked[self.path] < 3 else 500 if n == 5 and state["down"] else 200
            self.send_response(status)
            self.end_headers()
            if status == 200:
                self.wfile.write(f"é{n}".encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked, times, state
    server.shutdown()


def test_each_request_is_sent_once(spark, host, tmp_path):
    base, asked, times, state = host
    path = str(tmp_path / "answers")
    rows = [(i, f"{base}/q/{i % 8}") for i in range(24)] + [(100, None), (101, "http://127.0.0.1:1/none")]
    frame = spark.createDataFrame(rows, "i int, request string").repartition(6)
    run = lambda frame: {r["i"]: (r["status"], r["body"], r["error"]) for r in requests.answered(frame, path, rate=20, lanes=2, timeout=5, waits=(0.01, 0.01)).collect()}
    got = run(frame)
    assert len(got) == 26 and got[100] == (None, None, None) and got[101][0] is None and "URLError" in got[101][2]
    expected = {n: (200, f"é{n}", None) for n in range(8)} | {3: (404, None, None), 5: (500, None, "status 500")}
    assert all(got[i] == expected[i % 8] for i in range(24))
    assert asked == {f"/q/{n}": 3 if n == 4 else 1 for n in range(8)}
    # again: only what has no final answer is sent
    state["down"] = False
    got = run(frame.where("i != 101"))
    assert got[5] == (200, "é5", None) and asked["/q/5"] == 2 and sum(asked.values()) == 11
    assert run(frame.where("i < 100"))[13] == (200, "é5", None) and sum(asked.values()) == 11
    assert requests.answered(frame.limit(0), path).count() == 0


def test_a_host_is_not_asked_faster_than_its_rate(spark, host, tmp_path):
    base, _, times, _ = host
    frame = spark.createDataFrame([(f"{base}/q/{i}",) for i in range(10, 18)], "request string").repartition(4)
    requests.answered(frame, str(tmp_path / "slow"), rate=5, lanes=1, timeout=5).collect()
    assert len(times) == 8 and all(b - a > 0.15 for a, b in zip(times, times[1:], strict=False))


def test_lookups_that_are_kept(spark, monkeypatch):
    monkeypatch.setattr(readers, "KEPT", 2)
    made = []
    make = lambda n: lambda: made.append(n) or spark.range(n + 1)
    for n in (0, 1, 0, 2, 0, 1):
        assert readers.kept(spark, f"lookup-{n}", make(n)).count() == n + 1
    assert made == [0, 1, 2, 1]


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "sessions")
    for version in ("one", "two"):
        sinks.save_sessions(spark.createDataFrame([("a", version, {"x": version}), ("b" + version, version, None), (None, version, None)], "session_id string, text string, `more.of` map<string,string>"), path)
    rows = spark.read.parquet(path)
    assert sinks.load_session(rows, "a").first()["text"] == "two" and sinks.load_session(rows, "none").count() == 0
    assert {(r["session_id"], r["text"]) for r in sinks.latest_sessions(rows).collect()} == {("a", "two"), ("bone", "one"), ("btwo", "two")}
    minutes = spark.createDataFrame([("m", "b", 1), ("a", "z", 2), ("a", "b", 3)], "source string, date string, n int")
    assert [r["n"] for r in sinks.by_source_and_date(minutes).collect()] == [3, 2, 1]
