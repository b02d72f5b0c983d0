"""Operators on small hand-made tables with expected values derived from the rules."""

import collections
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from vigilake.operators import drugs, judge, literature, pgx, reports, signals, terminology
from vigilake.sources import readers, rest, sinks
from vigilake.streaming import ingest


@pytest.fixture(scope="module")
def vocabulary(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("terms")
    (folder / "pt.asc").write_bytes("1$Fever$\n2$Pain$\n\n1$Pyrexia$\n".encode("latin-1"))
    (folder / "pt_es.asc").write_bytes("1$Fiebre$\n2$Dolor$\n".encode("latin-1"))
    (folder / "llt.asc").write_bytes("10$Hot$1$\n11$Burning up$1$\n2$Pain$2$\n20$Ache \xf1$2$\n".encode("latin-1"))
    (folder / "mdhier.asc").write_bytes(b"1$a$b$c$First$\n1$a$b$c$Second$\n")
    read = lambda n: readers.terminology(spark, str(folder / n))
    es = readers.preferred_names(read("pt_es.asc")).select("code", F.col("name").alias("name_es"))
    pt = readers.preferred_names(read("pt.asc")).withColumnRenamed("name", "name_en").join(es, "code", "left")
    llt = readers.lower_terms(read("llt.asc")).select("code", F.col("name").alias("name_en"), F.lit(None).cast("string").alias("name_es"), "pt_code", "ord")
    return pt.cache(), llt.cache(), readers.hierarchy(read("mdhier.asc")).cache()


def codes(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "code string")


def test_terminology(spark, vocabulary):
    pt, llt, hier = vocabulary
    names = {r["code"]: r["name"] for r in terminology.code_to_name(codes(spark, "1", "10", "2", "99"), pt, llt).collect()}
    assert names == {"1": "Pyrexia", "10": "Pyrexia", "2": "Pain", "99": None}
    assert {r["code"] for r in terminology.is_llt(codes(spark, "2", "10", "99"), pt, llt).collect()} == {"10"}
    assert {r["code"]: r["pt_name"] for r in terminology.hierarchy(codes(spark, "10", "1"), llt, hier).collect()} == {"10": "First", "1": "First"}
    got = {r["code"]: r for r in terminology.resolve(codes(spark, "1", "20", "x"), pt, llt).collect()}
    assert got["1"]["type"] == "PT" and got["1"]["llts_en"] == ["Hot", "Burning up"] and got["20"]["type"] == "LLT" and got["20"]["pt_name"] == "Pain" and got["x"]["type"] is None
    assert {r["pt_code"]: r["codes"] for r in readers.terms_of_preferred(llt).collect()}["1"] == ["10", "11"]


@pytest.mark.parametrize(("q", "expected"), [("pain", ["2"]), ("1", []), ("10", ["10"]), ("DOLOR", ["2"]), ("ache", ["20"]), ("x" * 3, []), ("ai", ["2"])])
def test_search(vocabulary, q, expected):
    pt, llt, _ = vocabulary
    assert [r["code"] for r in terminology.search(q, pt, llt).collect()] == expected


def test_drug_files(spark, tmp_path):
    (tmp_path / "lookup.json").write_text('{"aspirin": {"drugbank_id": "D1", "inn": "Aspirin"}}')
    (tmp_path / "inter.json").write_text('{"D1": [{"drugbank_id": "D2", "name": "Warfarin", "description": "bleeding"}]}')
    lookup = readers.drug_file(spark, str(tmp_path / "lookup.json"), "lookup").select("key", "value.*")
    asked = spark.createDataFrame([(" ASPIRIN ",), ("none",)], "name string")
    got = {r["name"]: r for r in drugs.with_payload(drugs.resolve(asked, lookup), readers.drug_file(spark, str(tmp_path / "inter.json"), "interactions"), "interactions").collect()}
    assert got[" ASPIRIN "]["inn"] == "Aspirin" and got[" ASPIRIN "]["interactions"][0]["name"] == "Warfarin" and got["none"]["interactions"] == []
    assert readers.drug_file(spark, str(tmp_path / "missing.json"), "pgx").count() == 0 and [r["status"] for r in readers.signals(spark, str(tmp_path / "missing.json")).collect()] == ["not_available"]
    table = readers.drug_table(spark, str(tmp_path / "inter.json"), "interactions", str(tmp_path / "inter.parquet"))
    assert table.first()["value"][0]["name"] == "Warfarin" and readers.kept(spark, "t", lambda: table) is readers.kept(spark, "t", lambda: lookup)


def test_direct_interactions(spark):
    cases = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 2, "C")], "case_id int, pos int, inn string")
    known = spark.createDataFrame([("B", 0, "a", "from B"), ("A", 0, "A", "self"), ("A", 1, "b", "from A"), ("C", 0, "z", "other")], "inn string, int_pos int, name string, description string")
    assert [tuple(r) for r in drugs.direct_interactions(cases, known).collect()] == [(1, "A", "B", "from A")]


def test_cross_mentions(spark):
    rows = [(1, 0, "abc", "abcd", "text with Abcd and wxyz"), (1, 1, "wxyz", "wx", "about ABC and nothing")]
    got = drugs.cross_mentions(spark.createDataFrame(rows, "case_id int, i int, inn string, name string, text string")).collect()
    assert [(r["i"], r["j"], r["source"], r["mentioned"]) for r in got] == [(0, 1, "abcd", "wx")] and got[0]["snippet"] == "text with Abcd and wxyz"


def test_suggested(spark):
    rows = spark.createDataFrame([(" asprin ",), ("ibu",), ("x",), ("nothing",)], "query string")
    hints = spark.createDataFrame([("asprin", "aspirin"), ("ibu", "ibux")], "query string, suggestion string")
    known = spark.createDataFrame([("aspirin", "Aspirin", "1"), ("ibu", "Ibuprofen", "2"), ("x", "X", "3")], "name string, inn string, rxcui string")
    assert sorted(map(tuple, drugs.suggested(rows, hints, known).collect())) == [("asprin", "aspirin", "Aspirin", "1"), ("ibu", "ibux", "Ibuprofen", "2")]
    ids = spark.createDataFrame([("a", '{"idGroup":{"rxnormId":["7","8"]}}'), ("b", "{}")], "name string, body string")
    properties = spark.createDataFrame([("7", '{"properties":{"name":"Alpha"}}')], "rxcui string, body string")
    assert sorted(map(tuple, readers.concept_names(ids, properties).collect()), key=str) == [("a", "7", "Alpha"), ("b", None, None)]


def test_profile_text(spark):
    schema = f"p {readers.DRUG_FILES['profiles']}, g {readers.DRUG_FILES['pgx']}"
    row = ({"inn": "Aspirin", "drugbank_id": "D1", "mechanism": "m", "targets": [{"name": "T", "gene_symbol": "G", "actions": ["x", "y"]}, {"name": "U", "gene_symbol": None, "actions": []}], "pathways": [{"name": "P", "smpdb_id": "S"}]}, {"snp_effects": [{"gene": None, "rs_id": "r", "description": "d"}]})
    got = spark.createDataFrame([row], schema).select(drugs.summary(F.col("p"), F.col("g")).alias("t")).first()["t"]
    assert got == "=== DrugBank: Aspirin (D1) ===\n\nmechanism:\nm\n\ntargets:\n  - T [G]: x, y\n  - U: \n\nsnp_effects:\n  - gene=? rs_id=r description=d\n\npathways:\n  - P [S]"


@pytest.mark.parametrize(("sections", "expected"), [([(0, 0), (3, 10), (2, 50)], [0, 1, 2]), ([(0, 0), (0, 0), (2, 5)], [0, 0, 2]), ([(1, 9), (2, 5), (2, 5)], [1, 1, 1]), ([(0, 0), (2, 5), (2, 5)], [0, 2, 1])])
def test_slots(spark, sections, expected):
    rows = spark.createDataFrame([(1, str(i), i, a, b) for i, (a, b) in enumerate(sections)], "case_id int, section string, ord int, n_ids int, n_found int")
    assert [r["slots"] for r in literature.slots(rows).orderBy("ord").collect()] == expected


def test_articles(spark, tmp_path):
    xml = "<Set><PubmedArticle><PMID>1</PMID><ArticleTitle>T</ArticleTitle><AbstractText> a </AbstractText><AbstractText>b</AbstractText></PubmedArticle><PubmedArticle><PMID>2</PMID></PubmedArticle></Set>"
    (tmp_path / "a.xml").write_text(xml)
    fetched = readers.articles(spark, str(tmp_path / "a.xml"))
    assert [tuple(r) for r in fetched.collect()] == [("1", "T", "a b")]
    hits = spark.createDataFrame([(1, "s", 0, "x", 0, "1"), (1, "s", 1, "y", 0, "1"), (1, "s", 1, "y", 1, "9")], "case_id int, section string, term_ord int, term string, id_ord int, pmid string")
    seen = literature.enrich(literature.first_seen(hits), fetched)
    got = literature.section_text(seen).first()
    assert got["text"] == "PMID: 1\nTitle: T\nAbstract: a b\nOrigen: x, y\n\nPMID: 9\nTitle: \nAbstract: \nOrigen: y" and got["urls"].count(" | ") == 1


def annotation(level, gene, **more):
    base = {"levelOfEvidence": {"term": level}, "location": {"genes": [{"symbol": gene}] if gene else []}, "allelePhenotypes": [{"allele": "a", "phenotype": "p", "limitedEvidence": None}, {"allele": "b", "phenotype": "q", "limitedEvidence": True}], "relatedDiseases": [{"name": "d"}], "relatedGuidelines": [], "relatedLabels": ["l"], "types": ["z", "", "y"]}
    return base | more


def test_genes(spark):
    rows = [("d1", i, annotation(lv, g)) for i, (lv, g) in enumerate([("2A", "A"), ("1B", "A"), ("3", "A"), ("2B", "")])] + [("d2", i, annotation("3", g)) for i, g in enumerate(["A", "A", "B", "C"])]
    own = spark.createDataFrame(rows, f"drug string, ord int, x {readers.ANNOTATION}")
    flat = own.select("drug", "ord", *(c.alias(k) for k, c in pgx.extract(F.col("x")).items()))
    used = pgx.fallback(flat)
    assert [(r["drug"], r["ord"]) for r in used.orderBy("drug", "ord").collect()] == [("d1", 0), ("d1", 1), ("d1", 3), ("d2", 0), ("d2", 2)]
    genes = {(r["drug"], r["strength"], r["gene"]): r for r in pgx.consolidate(used).collect()}
    assert genes["d1", "strong", "A"]["level"] == "1B" and genes["d1", "secondary", "?"]["level"] == "2B" and genes["d2", "low", "B"]["level"] == "3"
    assert genes["d1", "strong", "A"]["pairs"][0]["allele"] == "a" and len(genes["d1", "strong", "A"]["pairs"]) == 1 and genes["d1", "strong", "A"]["contexts"] == ["y", "z"] and genes["d1", "strong", "A"]["has_label"] and not genes["d1", "strong", "A"]["has_guideline"]
    text = {r["drug"]: r["text"] for r in pgx.text(pgx.consolidate(used)).collect()}["d1"]
    assert text.startswith("PharmGKB + CPIC — d1\n\nGenes evidencia fuerte (1A/1B):\n  · A [evidencia: 1B] ✓ ETIQUETA FDA/EMA (1 alelo-fenotipo; 2 contextos; 1 enfermedades)")


def test_report_counts(spark):
    rows = [(i, "d", "Fever") for i in range(5)] + [(i, "d", "hot") for i in (3, 4, 9)] + [(1, "d", "other")]
    asked = spark.createDataFrame([("q", "fever", t) for t in ("fever", "HOT", "cold", "FEVER")], "question string, pt string, term string")
    got = reports.report_counts(spark.createDataFrame(rows, "case_id int, drug string, term string"), asked).first()
    assert (got["total_pt"], got["total_combined"], got["n_cases"]) == (5, 8, 6)
    line = spark.range(1).select(reports.report_text(F.lit("fever"), F.lit(5), F.lit(got["lines"]), F.lit(8)).alias("t")).first()["t"]
    assert line == "PT 'fever': 5 casos\nLLTs (sinónimos MedDRA):\n  'hot': 3 casos\nTotal combinado (PT + LLTs): 8 casos"


def minutes(spark):
    direct = "4.1. Ibuprofen and fever\nx\n4.2. Ibuprofen and rash\ny"
    rows = [("a", "d", "minutes", direct), ("b", None, "minutes", "4.1. ibuprofen only"), ("c", "", "agendas", "nothing"), ("e", "", "agendas", "4.1. about\n4.2. IBUPROFEN twice fever")]
    return spark.createDataFrame(rows, "filename string, date string, source string, section4 string")


def test_signals(spark):
    got = {r["filename"]: r for r in signals.evidence(minutes(spark), "ibuprofen", ["Fever"]).collect()}
    assert set(got) == {"a", "b", "e"} and got["a"]["with_reaction"] and got["a"]["n_fragments"] == 1 and got["a"]["terms"] == "Fever"
    assert not got["b"]["with_reaction"] and got["b"]["n_fragments"] == 1 and got["b"]["date"] == "sin fecha" and got["e"]["with_reaction"]
    yes = signals.evidence(minutes(spark), "ibuprofen", ["Fever"], judge=lambda p: ['{"ram_presente": true}'] * len(p))
    assert {r["filename"]: r["n_fragments"] for r in yes.collect()} == {"a": 2, "b": 1, "e": 1}
    assert tuple(signals.counts(signals.evidence(minutes(spark), "ibuprofen", ["Fever"], judged=False)).first()) == (2, 1)
    assert signals.block_text(signals.evidence(minutes(spark), "ibuprofen", ["x"])).where("filename = 'b'").first()["block"] == "── MINUTES | sin fecha | b\n\n4.1. ibuprofen only"


def test_judges_and_generators(spark):
    def slow(prompts):
        import time

        time.sleep(5)
        return prompts

    rows = spark.createDataFrame([("s", "h", "hello"), (None, None, None)], "system string, history string, message string")
    assert [r["response"] for r in judge.chat(rows).collect()] == ["hello", ""]
    assert judge.chat(rows.limit(1), slow, seconds=0.2).first()["response"] == judge.NO_TIME
    asked = spark.createDataFrame([("x",), (None,)], "prompt string")
    assert [r["answer"] for r in judge.ask(asked, judge=lambda p: [f"{len(p)}{x}" for x in p]).collect()] == ["1x", None]
    sheets = spark.createDataFrame([(1, "about Fiébre", "fiebre"), (2, "none", "pain"), (3, "y" * 7999 + "ZQ", "pain"), (4, "x", ""), (5, None, "pain")], "i int, text string, reaction string")
    found = judge.datasheet_found(sheets, lambda p: [f'{{"ram_presente": {str("Z" in x and "Q" not in x).lower()}}}' for x in p])
    assert {r["i"]: r["ram_encontrada"] for r in found.collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    assert judge.reports_of(spark.createDataFrame([(1, "p")], "case_id int, prompt string")).first()["report"] == "{}"


def test_judge_failure_is_a_row(spark):
    def broken(prompts):
        raise RuntimeError("down")

    got = judge.ask(spark.createDataFrame([("x",)], "prompt string"), judge=broken).first()
    assert got["answer"] is None and "down" in got["error"]


def test_judges_are_asked_prompt_by_prompt(spark):
    """Of 1,000 prompts one fails and one gives two answers; all others keep their answers."""

    def odd(prompts):
        if prompts[0] == "7":
            raise ValueError("not this one")
        return prompts * (1 + (prompts[0] == "8"))

    rows = spark.range(1000).selectExpr("cast(id as string) as prompt", "id").coalesce(1)
    got = {r["id"]: r for r in judge.ask(rows, judge=odd).collect()}
    assert {i for i, r in got.items() if r["answer"] is None} == {7, 8} and all(r["answer"] == str(i) for i, r in got.items() if i not in (7, 8))
    assert got[7]["error"] == "ValueError: not this one" and "ValueError" in got[8]["error"]


def test_reports_are_written_by_all_cores(spark):
    """Prompts of one small file are dealt to several tasks, and a task's calls share its threads."""

    def who(prompts):
        import os
        import threading

        from pyspark import TaskContext

        return [f"{os.getpid()} {threading.get_ident()} {TaskContext.get() is not None}"]

    rows = spark.range(4000).selectExpr("id as case_id", "cast(id as string) as prompt").coalesce(1)
    got = judge.reports_of(rows, who).selectExpr("case_id", "report", "spark_partition_id() as part").collect()
    assert sorted(r["case_id"] for r in got) == list(range(4000))
    assert len({r["part"] for r in got}) >= 4 and min(collections.Counter(r["part"] for r in got).values()) > 500
    calls = judge.Calls(who, None)
    assert len({x for x, _ in calls.run(["p"] * 2000)}) <= judge.AT_ONCE
    calls.close()


def test_a_judge_gets_prompts_and_not_whole_sheets(spark, monkeypatch):
    """Only kept columns and the prompt go to the judge's processes, and a prompt once."""
    sheets = spark.createDataFrame([(1, "about Fiébre", "fiebre"), (2, "Z" + "y" * 9000, "pain"), (3, None, "pain")], "i int, text string, reaction string")
    said, seen, ask = (lambda p: [f'{{"ram_presente": {str("Z" in x).lower()}}}' for x in p]), [], judge.ask
    monkeypatch.setattr(judge, "ask", lambda rows, *a: seen.append(rows.columns) or ask(rows, *a))
    found = judge.datasheet_found(sheets, said, keep=["i"])
    assert found.columns == ["i", "ram_encontrada"] and {tuple(x) for x in found.collect()} == {(1, True), (2, True), (3, False)}
    assert judge.datasheet_found(sheets, said).columns == ["i", "text", "reaction", "ram_encontrada"]
    assert seen == [["i", "direct", "asked"], ["i", "text", "reaction", "direct", "asked"]]


def test_a_hung_call_costs_its_own_prompt():
    import threading
    import time

    hold = threading.Event()

    def hanging(prompts):
        if prompts[0].startswith("hang"):
            hold.wait(20)
        return prompts

    calls = judge.Calls(hanging, 0.3, at_once=2)
    began = time.monotonic()
    got = calls.run(["a", "hang", "b", "c", "d"])
    assert [x[0] for x in got] == ["a", None, "b", "c", "d"] and got[1][1] == "TimeoutError: no answer in 0.3 s"
    got = calls.run(["e", "hang too", "f", "g"])
    assert [x[0] for x in got] == ["e", None, None, None] and "hang" in got[3][1] and time.monotonic() - began < 5
    hold.set()
    time.sleep(0.2)
    assert [x[0] for x in calls.run(["h", "i"])] == ["h", "i"] and calls.run([]) == []


def test_signals_of_cases(spark):
    """A table of cases gives for each case what one call for it gives, with one scan."""
    docs = minutes(spark).union(spark.createDataFrame([("g", "d", "minutes", "4.1. ibu\n4.2 profen, naproxen"), ("g", "d2", "minutes", "intro NAPROXEN\n4.1. rash with naproxen\n4.1.2. fiébre high  fever of naproxen"), ("h", "d", "minutes", None), ("i", "", "agendas", "ibuprofen\n4.1. x ibuprofen4.2")], "filename string, date string, source string, section4 string"))
    cases = [("1", "ibuprofen", ["Fever"]), ("2", "IBUPROFEN", ["rash", " ", None]), ("3", "naproxen", ["high fever", "fiebre", "rash"]), ("4", "absent", ["x"]), ("5", " ", ["x"]), ("6", None, ["x"]), ("7", "profen", []), ("8", "ibu\n4.2 profen", ["x"])]
    frame = spark.createDataFrame(cases, "case_id string, inn string, terms array<string>")
    flat = lambda rows: sorted((r["filename"], r["date"], r["source"], r["with_reaction"], r["n_fragments"], r["terms"], [tuple(f) for f in r["fragments"]]) for r in rows)
    said = lambda p: [f'{{"ram_presente": {str("only" in x).lower()}}}' for x in p]
    for judged, shipped in ((False, 10_000), (True, 10_000), (True, 0)):
        got = signals.evidence_of_cases(docs, frame, said, judged, shipped).collect()
        for c, drug, asked in cases:
            one = flat(signals.evidence(docs.where("section4 is not null"), drug, [x for x in asked if x is not None], said, judged).collect()) if drug and drug.strip() else []
            assert flat(r for r in got if r["case_id"] == c) == one, c
        assert {r["case_id"] for r in got} == {"1", "2", "3", "7", "8"}
    assert signals.evidence_of_cases(docs.limit(0), frame).count() == 0 == signals.evidence_of_cases(docs, frame.limit(0)).count()


def test_cards_and_reports(spark):
    found = spark.createDataFrame([(1, "CIMA", "ok", "text"), (1, "PubMed", "timeout", None), (1, "nobody", "ok", "x")], "case_id int, source string, status string, text string")
    got = {r["source"]: r for r in reports.cards(found).collect()}
    assert set(got) == {"CIMA", "PubMed"} and got["PubMed"]["state"] == "error" and '"contradiccion":null' in got["CIMA"]["content"]
    parts = reports.report_sections(spark.createDataFrame([(1, 'ok {"d1": "a", "d2": "b"}')], "case_id int, report string"), ("d1", "d2", "d3"))
    more = reports.cards(found.withColumn("fields", reports.card_fields(ft_url=F.lit("u"), ram_encontrada=F.lit(True)))).where("source = 'CIMA'").first()["content"]
    assert more == '{"texto":"text","contradiccion":null,"ft_url":"u","ram_encontrada":true}'
    assert {r["dimension"]: r["state"] for r in parts.collect()} == {"d1": "ok", "d2": "ok", "d3": "error"}
    assert reports.report_map(parts).first()["report"] == {"d1": "a", "d2": "b", "d3": ""}
    assert reports.prompt(found, F.lit("case"), "head").first()["prompt"] == "head\n\ncase\n\n--- CIMA — Ficha Técnica AEMPS ---\ntext"
    lines = sinks.event_stream(found.withColumn("tipo", F.lit("seccion")), ["case_id", "text"]).collect()
    assert lines[1]["line"] == 'data: {"tipo":"seccion","case_id":1,"text":null}\n\n'


def test_links_and_forms(spark):
    html = '<a href="/x/agenda-1.pdf">a</a><a href="https://h/minutes-2.pdf">b</a><a href="/x/other.pdf">c</a><a href="/y">d</a>'
    got = readers.pdf_links(spark.createDataFrame([(1, html)], "p int, html string")).select(readers.absolute("https://h/list/page", F.col("href")).alias("u")).collect()
    assert [r["u"] for r in got] == ["https://h/x/agenda-1.pdf", "https://h/minutes-2.pdf"]
    base, hrefs = "https://h/list/sub/page?p=1", ["../a.pdf", "./b", "?q=2", "#top", "//o/c", "", "mailto:x", "/../d", "e/../f/.", "../../../g", "h?i#j"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(hrefs)], "i int, x string").select("i", readers.absolute(base, F.col("x")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in got] == [urljoin(base, x) for x in hrefs]
    forms = spark.createDataFrame([('["a"]',), ("bad",), (None,)], "x string").select(readers.form_list(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in forms] == [["a"], [], []]


def test_rest_source(spark):
    import json

    rest.register(spark)
    url = rest.request("https://api/x", name="a b")
    got = spark.read.format("vigilake_rest").option("urls", json.dumps([url, "https://none"])).option("recorded", json.dumps({url: '{"meta":{"results":{"total":7}}}'})).load()
    assert [(r["status"], r["total"]) for r in readers.report_counts_of(got).orderBy("status").collect()] == [(200, 7), (404, None)]
    ids = spark.createDataFrame([('{"esearchresult":{"idlist":["1"],"count":"12"}}',), ("oops",)], "body string")
    assert [(r["ids"], r["total"]) for r in readers.literature_ids(ids).collect()] == [(["1"], 12), ([], 0)]


def test_incremental_minutes(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    body = "4. Signals assessment and prioritisation\nbody\n5. Risk Management\n"
    for names in (["a"], ["b"]):
        for n in names:
            (source / f"{n}.pdf").write_text(f"10-13 February 2025\n{body}")
        ingest.ingest_minutes(spark, str(source), str(target), str(tmp_path / "cp"), "minutes", extractor=lambda data: [data.decode()])
    rows = spark.read.parquet(str(target)).orderBy("filename").collect()
    assert [(r["filename"], r["date"], r["section4"], r["status"], r["chars"]) for r in rows] == [(f"{n}.pdf", "10-13 February 2025", "body", "ok", 4) for n in "ab"]
    assert sinks.merge_signals(spark.read.parquet(str(target)), spark.read.parquet(str(target))).count() == 2


def test_few_interactions_go_to_the_pairs(spark):
    """A few drugs that all cases have are no keys of a shuffle."""
    cases = spark.range(300).selectExpr("id as case_id", "explode(array('a', 'b', 'c')) as inn").withColumn("pos", F.ascii("inn"))
    known = spark.createDataFrame([("a", 1, "B", "x"), ("c", 2, "a", "y")], "inn string, int_pos int, name string, description string").repartition("inn")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = drugs.direct_interactions(cases, known)
        assert collections.Counter(tuple(x)[1:] for x in found.collect()) == {("a", "b", "x"): 300, ("c", "a", "y"): 300}
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
