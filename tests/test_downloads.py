"""Documents as files: once each, whole, under failing and repeated attempts."""

import os
import threading

import pytest

from vigilake.sources import files, sinks


def source_of(fetch):
    class Own(files.DocumentFiles):
        fetcher = staticmethod(fetch)

        @classmethod
        def name(cls):
            return "vigilake_documents_in_tests"

    return Own


LINKS = [(f"http://h/x/minutes-{i % 12}.pdf?v={i // 12}",) for i in range(24)] + [("http://h/bad.pdf",), ("http://h/",), (None,)]


def test_each_name_has_one_whole_file(spark, tmp_path):
    from vigilake.session import shared_dir

    shared_dir(spark)
    folder = str(tmp_path / "docs")

    def fetch(url, timeout):
        if "bad" in url:
            raise OSError("refused")
        return url.encode() * 1000

    links = spark.createDataFrame(LINKS, "link string")
    got = dict(map(tuple, files.download(links, folder, source_of(fetch), tasks=3).collect()))
    assert got == {f"minutes-{i}.pdf": "downloaded" for i in range(12)} | {"bad.pdf": "error", "h": "downloaded"}
    names = sorted(x for x in os.listdir(folder) if not x.startswith("_"))
    assert names == sorted([f"minutes-{i}.pdf" for i in range(12)] + ["h"])
    assert open(os.path.join(folder, "minutes-3.pdf"), "rb").read() == b"http://h/x/minutes-3.pdf?v=0" * 1000
    assert not any(x.startswith("_temporary") for x in os.listdir(folder)) and any(x.startswith("_errors") for x in os.listdir(folder))
    # again: what is there is neither fetched nor written over
    again = files.download(links, folder, source_of(lambda url, timeout: b"other" if "bad" in url else 1 / 0))
    assert {r["outcome"]: r["n"] for r in sinks.download_counters(again).collect()} == {"there": 13, "downloaded": 1}


def test_attempts_that_fail_leave_nothing(tmp_path):
    """A first attempt is aborted, a second and a speculative third are committed: one file a name, of the first committed."""
    folder = str(tmp_path)
    first = files.DocumentWriter({"folder": folder}, lambda url, timeout: b"one")
    first.write(iter([("a.pdf", "u")]))
    first.abort([None])
    assert os.listdir(folder) == []
    writer = files.DocumentWriter({"folder": folder}, lambda url, timeout: threading.current_thread().name.encode())
    done = []
    twins = [threading.Thread(target=lambda: done.append(writer.write(iter([("a.pdf", "u"), ("b.pdf", "u")]))), name=f"twin{i}") for i in range(2)]
    for t in twins:
        t.start()
    for t in twins:
        t.join()
    writer.commit([done[0], None])
    assert sorted(os.listdir(folder)) == ["a.pdf", "b.pdf"] and open(f"{folder}/a.pdf").read() == open(f"{folder}/b.pdf").read()
    late = files.DocumentWriter({"folder": folder}, lambda url, timeout: b"late")
    rows = iter([("c.pdf", "u")])
    message = late.write(rows)
    open(f"{folder}/c.pdf", "w").write("earlier")  # another run was faster
    late.commit([message])
    assert open(f"{folder}/c.pdf").read() == "earlier" and sorted(os.listdir(folder)) == ["a.pdf", "b.pdf", "c.pdf"]


@pytest.mark.parametrize("rows", [[], [(None,)]])
def test_no_links(spark, tmp_path, rows):
    assert files.download(spark.createDataFrame(rows, "link string"), str(tmp_path / "none")).count() == 0
