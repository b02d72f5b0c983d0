"""Operators 5, 6 and 8: round trips and brute force."""

import collections
import hashlib
import io
import random
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilake.llm import chat, oracle, url_filter, warc
from vigilake.session import shared_dir


def test_op5(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    html = pages.first()["html"]
    more = [(-1, None, None), (-2, "http://a b\n", ""), (-3, "x", html), (-4, "y", html), (None, "z", html), (-5, "q", "é" * 600), (-6, "q", "é" * 600), (-7, "q", "é" * 499), (-8, "q", "é" * 499)]
    pages = pages.union(spark.createDataFrame(more, "page_id long, url string, html string"))
    folder = f"{shared_dir(spark)}/warc-test"
    manifest = warc.write(pages, folder, archive=30_000)
    got = [tuple(r)[:5] for r in warc.read_archives(manifest, folder).collect()]
    rows, by = pages.collect(), collections.defaultdict(list)
    for r in rows:
        by[r["html"] or ""].append(r["page_id"])
    expected = []
    for r in rows:
        data = (r["html"] or "").encode()
        keeper = max(x for x in [*by[r["html"] or ""], -(10**9)] if x is not None)
        revisit = len(data) >= 1000 and len(by[r["html"] or ""]) > 1 and r["page_id"] != keeper
        expected.append((r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(got, key=str) == sorted(expected, key=str) and manifest.count() > 1


def test_op5_empty(spark):
    folder = f"{shared_dir(spark)}/warc-empty"
    manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.count() == 0 and warc.read_archives(manifest, folder).count() == 0


def archive(*raws, dictionary=b""):
    import zstandard

    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    return warc.dictionary_frame(dictionary) + b"".join(map(pack.compress, raws))


def test_reader_checks():
    good = warc.page_record(5, "http://x", 5, hashlib.sha1(b"hello").digest(), b"hello")
    for dictionary in (b"", b"WARC/1.1 hello dictionary " * 20):
        found = list(warc.read(io.BytesIO(archive(good, good, dictionary=dictionary)), piece=7))
        assert [x.payload for x in found] == [b"hello"] * 2 and warc.page_of(found[0].headers["warc-record-id"]) == 5
    assert list(warc.read(io.BytesIO(b""))) == []
    broken = [good.replace(b"hello", b"hellO"), good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-2], good.replace(b"WARC-Date: ", b"WARC-Date "), good.replace(b"WARC-Type: response\r\n", b"")]
    for raw in broken:
        with pytest.raises(warc.WarcError):
            list(warc.read(io.BytesIO(archive(raw))))
    with pytest.raises(warc.WarcError):
        list(warc.read(io.BytesIO(archive(good)[:-3])))
    with pytest.raises(warc.WarcError):
        list(warc.read(io.BytesIO(archive(good, dictionary=b"x" * 100)[:50])))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def test_op6(spark, monkeypatch):
    urls = ["http://www.EXAMPLE.com/en/1", "http://a.example.com/en/", "http://a.example.com/En/", "https://x.net/es/1?q", "https://x.net", "https://net/fr/#", "http://aexample.com/en/", None, "no scheme", "http://x.org/1", "http://x.org/2", "http://x.org/3", "http://É.NET/es/a\nb", "http://u.org/a", "http://x.com", "a://b://c/d"]
    link = {"http://x.org/1": '<link rel="canonical" href="https://x.net/es/9">', "http://x.org/2": '<META http-equiv=refresh content="0; URL=http://x.org/1">', "http://u.org/a": "<link href='http://www.example.com/en/z' rel='canonical'><link rel=canonical href=https://x.net/es/8>"}
    pages = spark.createDataFrame([(i, u, link.get(u, "<p>"), "c") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, RULES).collect()}
    expected = {0: ("www.example.com/en/", "allow"), 1: ("example.com/en/", "block"), 2: ("com/", "allow"), 3: ("net/es/", "block"), 4: (None, "allow"), 5: ("net/fr/", "block"), 6: ("com/", "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "block"), 10: (None, "block"), 11: (None, "allow"), 12: ("net/es/", "block"), 13: (None, "allow"), 14: (None, "allow"), 15: (None, "allow")}
    assert {k: (r["rule"], r["verdict"]) for k, r in got.items()} == expected
    assert (got[0]["host"], got[0]["path"]) == ("www.example.com", "/en/1") and (got[4]["host"], got[4]["path"]) == ("x.net", "") and (got[7]["host"], got[7]["path"]) == ("", "")
    assert (got[12]["host"], got[12]["path"]) == ("É.net", "/es/a\nb") and (got[15]["host"], got[15]["path"]) == ("b:", "//c/d")
    monkeypatch.setattr(url_filter, "COMPILED", 0)
    joined = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, RULES).collect()}
    assert joined == expected
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_op6_targets(spark):
    """A block goes to the page through each form of a link's target; the others name nothing that is blocked."""
    blocked = [
        '<link rel=canonical href="/es/p">', '<meta http-equiv=refresh content="0; url=/es/p">', '<link rel="canonical" href="//x.net/es/p">',
        "<meta http-equiv=refresh content=0;url=/es/p>", "<meta content='0;URL=\"/es/p\"' http-equiv='Refresh'>", '<meta http-equiv="refresh" content="3, ../es/p">',
        '<link rel="alternate canonical" href="/es/p">', '<link href="../x/.././es/p" rel="CANONICAL">', '<base href="https://y.net/es/q/"><link rel=canonical href="p">',
        '<link rel=canonical href="https&#58;//x.net&#x2F;es/p">', '<link rel=canonical href=/es/p/>',
    ]
    free = ['<link rel=canonical href="">', '<link rel="notcanonical" href="/es/p">', '<link rel=canonical href="mailto:a@x.net">', '<meta http-equiv=refresh content="5">', '<link rel=canonical href="es/p">', '<link rel=canonical data-href="/es/p">', '<link rel=canonical href="?u=http://x.net/es/p">']
    rows = [(i, f"https://x.net/a{i}/b?q", h) for i, h in enumerate(blocked + free)]
    rows += [(100, "https://z.net/1", '<link rel=canonical href="/2?a=1&amp;b=2">'), (101, "https://z.net/2?a=1&b=2", '<link rel=canonical href="https://x.net/es/p">')]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert [got[i]["verdict"] for i in range(len(blocked + free))] == ["block"] * len(blocked) + ["allow"] * len(free)
    assert got[100]["verdict"] == got[101]["verdict"] == "block" and got[100]["alias_of"] == got[101]["alias_of"]


def test_op6_tags_in_comments_scripts_and_attributes(spark):
    """Text that only looks like a tag makes no edge; fragments take no part in aliases."""
    tag = '<link rel=canonical href="https://x.net/es/p">'
    free = [f"<!-- {tag} -->", f"<!-- > {tag}", f"<script>var a = '{tag}'; // canonical</script>", f"<STYLE>{tag}</STYLE >", f"<title>{tag}</title>", f"<textarea>{tag}", f"<a title='{tag}'>", f'<script src="a>b">{tag}</scripty></script>', "<!--x--!><linky rel=canonical href='https://x.net/es/p'>"]
    blocked = [f"<!-->{tag}", f"<!--a-->{tag}<!--b-->", f"<script>1</script>{tag}", f"<script><!-- </script>{tag}", f"<a title='<!--'>{tag}", f"<p title=\"<script>\">{tag}", f"<scripty>{tag}", f"<!--a--!>{tag}"]
    rows = [(i, f"https://x.net/a{i}", h) for i, h in enumerate(free + blocked)]
    chain = [(100, "https://z.net/1#top", '<link rel=canonical href="/2#x">'), (101, "https://z.net/2", '<link rel=canonical href="/3#y">'), (102, "https://z.net/3#a?b", tag), (103, "https://z.net/1", None), (104, "https://z.net/1#other", "")]
    frames = (spark.createDataFrame(x, "page_id long, url string, html string") for x in (rows, chain))
    got = {r["page_id"]: r for frame in frames for r in url_filter.judge(frame, RULES).collect()}
    assert [got[i]["verdict"] for i in range(len(rows))] == ["allow"] * len(free) + ["block"] * len(blocked)
    assert {(got[i]["verdict"], got[i]["alias_of"]) for i in range(100, 105)} == {("block", "https://x.net/es/p")}


def test_op6_sql_has_the_rules_of_tags(spark):
    """The SQL and the operator agree where tags stand in comments and scripts, name several relations, or have references and fragments."""
    rows = [(1, "https://x.net/1", '<!-- <link rel="canonical" href="https://x.net/es/p"> -->'), (2, "https://x.net/2", '<script>"<link rel=canonical href=https://x.net/es/p>"</script>'), (3, "https://x.net/3", '<link rel="alternate canonical" href="https://x.net/es/p#a">'), (4, "https://x.net/4#f", '<link rel="canonical" href="https://y.org/?a=1&amp;b=2">'), (5, "https://y.org/?a=1&b=2", '<meta http-equiv="refresh" content="0; url=https://x.net/fr/p">'), (6, "https://x.net/6", '<link rel="notcanonical" href="https://x.net/es/p">'), (7, None, None), (8, "https://x.net/4", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", frame.toArrow())
    found = con.execute(oracle.op6(RULES))
    names = [x[0] for x in found.description]
    got = url_filter.judge(frame, RULES).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {3, 4, 5, 8}


def test_resolve(spark):
    refs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "g?y/../x", "g#s/../x"]
    got = spark.createDataFrame([(x,) for x in refs], "x string").select("x", url_filter.resolve(F.lit("http://a/b/c/d?q"), F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == {x: urljoin("http://a/b/c/d?q", x) for x in refs}


def test_chat_round_trip():
    r, alphabet = random.Random(2), "<|>\\ turndosay\n</s>[INST]é"
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", "", "a<|b\\"]), "".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))) for _ in range(r.randint(0, 5))]
        done = chat.format_turns(turns)
        assert [(role, text) for role, text, _, _ in chat.parse(done.text)] == turns
        assert chat.loss_text(done.text, done.loss) == "".join(t for role, t in turns if role == "assistant")


def test_parts():
    done = chat.format_turns([("user", [{"type": "text", "text": "see <|image:0|>"}, {"type": "image", "ref": "a", "width": 28, "height": 15}, {"type": "audio", "ref": "b", "seconds": 1.5}, {"type": "document", "ref": "c", "pages": 2}])])
    assert [(x.kind, x.ref, x.tokens) for x in done.attachments] == [("image", "a", 4), ("audio", "b", 38), ("document", "c", 1200)] and done.expanded_tokens == 1242
    assert all(done.text[x.at :].startswith(f"<|{x.kind}:{i}|>") for i, x in enumerate(done.attachments))


def test_op8(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.union(spark.createDataFrame([(-2, 0, "user", None), (-2, 1, None, "x"), (-3, 5, "assistant", "<|done|>"), (-3, 5, "assistant", "<|done|>"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string"))
    groups = collections.defaultdict(list)
    for r in turns.collect():
        groups[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    got = chat.digest_conversations(turns.selectExpr("*", "1 as n_turns")).collect()
    assert len(got) == len(groups)
    for r in got:
        rows = sorted(groups[r["conv_id"]])
        loss = "".join(t for _, role, t in rows if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(rows), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = chat.format_conversations(turns, limit=500)
    assert whole.count() > len(groups)
    assert chat.digest_conversations(turns.limit(0)).count() == chat.format_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("extra", [61, 62])
def test_rule_ties(spark, monkeypatch, extra):
    """64 and 65 rules (compiled and joined) decide ties alike."""
    rules = [("block", "tie.org", "/a"), ("allow", "tie.org", "/a"), ("block", "b.tie.org", "/")] + [("block", f"h{i}.net", "/") for i in range(extra)]
    rows = [(1, "http://tie.org/a/x"), (2, "http://b.tie.org/a"), (3, "http://c.b.tie.org/"), (4, "http://h3.net/q"), (5, "http://none.net/"), (6, None)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, html_col=None).collect()
    assert (len(rules) > url_filter.COMPILED) == (extra == 62)
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {1: ("tie.org/a", "block"), 2: ("b.tie.org/", "block"), 3: ("b.tie.org/", "block"), 4: ("h3.net/", "block"), 5: (None, "allow"), 6: (None, "allow")}


def test_malformed_parts(spark):
    """Null refs, fields of other types, unknown and null types, null parts and sizes that aren't sound."""
    parts = [{"type": "image", "ref": None, "width": 28, "height": 14}, {"type": "audio", "ref": "a", "seconds": float("nan"), "width": 9, "text": "no"}, {"type": "document", "ref": "d", "pages": -2}, {"type": "video", "text": "as text"}, {"type": None, "text": None}, None, {"type": "text", "ref": "ignored", "text": "<|done|>"}]
    done = chat.format_turns([("user", parts)])
    assert [(x.kind, x.ref, x.tokens) for x in done.attachments] == [("image", "", 2), ("audio", "a", 0), ("document", "d", 0)]
    (role, content, _, _), = chat.parse(done.text)
    assert role == "user" and content == "<|image:0|><|audio:1|><|document:2|>as text<|done|>"
    schema = "conv_id long, turn int, role string, text array<struct<type:string,ref:string,text:string,width:int,height:int,seconds:double,pages:int>>"
    names = ("type", "ref", "text", "width", "height", "seconds", "pages")
    rows = [(1, 0, "user", [x and tuple(x.get(k) for k in names) for x in parts]), (1, 1, "assistant", None)]
    (row,) = chat.format_conversations(spark.createDataFrame(rows, schema)).collect()
    assert row["formatted"].startswith(done.text) and row["loss"] == [[len(row["formatted"]) - len(chat.END)] * 2]
