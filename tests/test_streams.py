"""Streams: a paged listing with refusals and restarts, and events of cases."""

import collections
import http.server
import json
import threading
import time

import pytest

from vigilake.operators.reports import SOURCES
from vigilake.streaming import case_events, listing


@pytest.fixture
def site():
    """A listing of five pages, then an empty one; page 2 is refused twice at first."""
    asked, pages = collections.Counter(), {i: f'<a href="/doc/minutes-{i}a.pdf">x</a><a href="minutes-{i}b.pdf?v=1">no</a><a href="../agenda-{i}.pdf">y</a>' for i in range(5)}
    refusals = {2: 2}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("=")[2])
            asked[page] += 1
            refused = asked[page] <= refusals.get(page, 0)
            self.send_response(429 if refused else 200)
            self.end_headers()
            if not refused:
                self.wfile.write(pages.get(page, "<p>nothing here</p>").encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/list/x?page={{page}}", pages, asked, refusals
    server.shutdown()


def test_a_listing_is_read_page_by_page_and_resumed(spark, site, tmp_path):
    url, pages, asked, refusals = site
    target, checkpoint = str(tmp_path / "links"), str(tmp_path / "checkpoint")
    options = {"pages": "2", "pace": "0.001", "waits": "[0.01, 0.01]"}
    assert listing.collect_links(spark, url, target, checkpoint, **options) == 5
    base = url.partition("/list")[0]
    found = lambda: {tuple(r) for r in spark.read.parquet(target).collect()}
    assert found() == {(i, f"minutes-{i}a.pdf", f"{base}/doc/minutes-{i}a.pdf") for i in range(5)} | {(i, f"agenda-{i}.pdf", f"{base}/agenda-{i}.pdf") for i in range(5)}
    assert asked[2] == 3 and all(asked[i] == 1 for i in (0, 1, 3, 4)) and max(asked) == 5
    # a later run goes on behind what is there; a page that is refused for good is asked for again the next time
    pages[5], pages[6] = pages[0].replace("-0", "-5"), pages[0].replace("-0", "-6")
    refusals[6] = 10**9
    assert listing.collect_links(spark, url, target, checkpoint, **options) == 1
    assert all(asked[i] == 1 for i in (0, 1, 3, 4)) and len(found()) == 12
    refusals[6] = 0
    assert listing.collect_links(spark, url, target, checkpoint, **options) == 1 and len(found()) == 14


def test_waits():
    wait, seen = listing.FIRST, []
    for refused in (True, True, True, True, False, False, False):
        wait = listing.next_wait(wait, refused)
        seen.append(round(wait, 4))
    assert seen == [2, 4, 8, 8, 6.8, 5.78, 4.913]


NAMES = [x[0] for x in SOURCES]


def put(folder, name, rows):
    keys = ("case_id", "kind", "source", "status", "text", "refs", "header")
    (folder / f".{name}").write_text("".join(json.dumps(dict(zip(keys, r, strict=True))) + "\n" for r in rows))
    (folder / f".{name}").rename(folder / f"{name}.json")


def answer(case, source, status="ok", text="said", refs=None):
    return case, "answer", source, status, text, refs, None


def request(case, **header):
    return case, "request", None, None, None, None, json.dumps(header)


def test_case_events_over_restarts_and_silent_sources(spark, tmp_path):
    """A case that is complete, one that is in the middle at a restart and then loses two sources, and answers before their request."""
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()

    def start(seconds):
        rows = spark.readStream.schema(case_events.INPUT).json(str(source))
        return case_events.case_events(rows, seconds).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime="500 milliseconds").start(target)

    def events():
        found = collections.defaultdict(list)
        if not (tmp_path / "out" / "_spark_metadata").exists():
            return found
        for r in sorted(spark.read.schema(case_events.EVENTS).parquet(target).collect(), key=lambda r: (r["case_id"], r["seq"])):
            found[r["case_id"]].append((r["seq"], r["tipo"], json.loads(r["payload"])))
        return found

    def until(done, seconds=60):
        """Timers keep a query busy, so it is watched by what it gives."""
        end = time.time() + seconds
        while time.time() < end and not done():
            time.sleep(0.5)
        assert done()

    put(source, "1", [request("a", farmaco="x", ram="y"), *(answer("a", s) for s in NAMES[:4]), answer("b", NAMES[2], "error", "down"), answer("b", "nobody"), (None, "request", None, None, None, None, "{}")])
    query = start(300)
    until(lambda: len(events()["a"]) == 10)
    query.stop()
    assert [k for _, k, _ in events()["a"]] == ["cabecera", "progreso", *["seccion", "progreso"] * 4] and "b" not in events()
    put(source, "2", [answer("a", NAMES[0], text="again"), *(answer("a", s, refs='[{"pmid": "1"}]' if s == "PubMed" else None) for s in NAMES[4:]), request("b", farmaco="z"), *(answer("b", s, text=f"text of {s}", refs='[{"ft_url": "u"}]' if s == "CIMA" else "broken") for s in NAMES[:5] if s != NAMES[2])])
    query = start(12)
    until(lambda: [k for _, k, _ in events()["b"]].count("seccion") == 5)
    query.stop()
    query = start(12)
    until(lambda: events()["b"][-1][1] == "fin")
    put(source, "3", [answer("b", NAMES[6]), answer("a", NAMES[1]), request("a", farmaco="again")])
    until(lambda: any(s["numInputRows"] == 3 and "File" in s["description"] for p in query.recentProgress for s in p["sources"]))
    query.stop()
    got = events()
    assert set(got) == {"a", "b"} and all([n for n, *_ in x] == list(range(len(x))) for x in got.values())
    assert [k for _, k, _ in got["a"]] == ["cabecera", "progreso", *["seccion", "progreso"] * 7, "referencias", "fin"]
    assert got["a"][0][2] == {"farmaco": "x", "ram": "y"} and got["a"][-2][2] == {"ft_url": "", "pubmed": [{"pmid": "1"}] if "PubMed" in NAMES[4:] else [], "pathway_commons": [], "fda": {}, "prac": []}
    cards = {p["fuentes"][0]: (p["estado"], p["contenido"]["texto"]) for _, k, p in got["b"] if k == "seccion"}
    assert cards == {s: ("ok", f"text of {s}") for s in NAMES[:5]} | {NAMES[2]: ("error", "Error: down")} | {s: ("error", case_events.SILENT) for s in NAMES[5:]}
    assert got["b"][-2][2]["ft_url"] == "u" and got["b"][-1][2] == {"mensaje": case_events.DONE, "session_id": "b"}


def test_requests_and_answers_are_one_table(spark):
    cases = spark.createDataFrame([(1, "x", None)], "case_id int, farmaco string, `a.b` string")
    found = spark.createDataFrame([(1, "CIMA", "ok", "t", None)], "case_id int, source string, status string, text string, refs string")
    rows = case_events.requests_and_answers(cases, found)
    assert rows.schema.simpleString() == spark.createDataFrame([], case_events.INPUT).schema.simpleString()
    assert {(r["case_id"], r["kind"], r["header"]) for r in rows.collect()} == {("1", "request", '{"farmaco":"x","a.b":null}'), ("1", "answer", None)}


def test_postings_are_kept_up_to_date(spark, tmp_path):
    """Counts equal a full recount after each batch; a batch that is run again and a file that comes again count once."""
    from vigilake.sources.readers import SIGNALS
    from vigilake.streaming import postings

    source, target, checkpoint = str(tmp_path / "minutes"), str(tmp_path / "postings"), str(tmp_path / "checkpoint")
    terms = spark.createDataFrame([(x,) for x in ("fever", "High Fever", "fiébre", "absent", "?", None, "fever")], "term string")
    counts = lambda: {r["term"]: r["n_docs"] for r in postings.phrase_counts(spark, target, terms).collect()}
    assert counts() == {"fever": 0, "High Fever": 0, "fiébre": 0, "absent": 0, "?": 0}
    rows = lambda *x: spark.createDataFrame([(n, "minutes", "d", t, "ok", len(t or "")) for n, t in x], SIGNALS)
    first = rows(("a", "high fever, fever"), ("b", "Fever. high"), ("c", None), (None, "fever"), ("a", "high fever, fever"))
    first.write.mode("append").parquet(source)
    postings.maintain(spark, source, target, checkpoint)
    assert counts() == {"fever": 2, "High Fever": 1, "fiébre": 0, "absent": 0, "?": 0}
    postings.write_batch(first, 0, target)  # the batch again
    postings.maintain(spark, source, target, checkpoint)  # nothing new
    assert counts() == {"fever": 2, "High Fever": 1, "fiébre": 0, "absent": 0, "?": 0}
    rows(("b", "fiebre only"), ("d", "a HIGH  fever")).write.mode("append").parquet(source)
    postings.maintain(spark, source, target, checkpoint)
    assert counts() == {"fever": 2, "High Fever": 2, "fiébre": 1, "absent": 0, "?": 0}
