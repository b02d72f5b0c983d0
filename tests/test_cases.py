"""Whole cases through sources, cards, events and prompts."""

from pyspark.sql import functions as F

from vigilake.plans import cases


def forms(spark):
    rows = [("1", " Aspirin ", None, "Fever", "Fiebre", '["Hot", "fever", ""]', "40", None), ("2", "", None, "Pain", None, None, None, None), ("3", "Ibuprofen", "ibuprofen", "Pain", None, "bad", None, "F")]
    return spark.createDataFrame(rows, "case_id string, drug string, drug_inn string, reaction_en string, reaction_es string, llts_json string, age string, sex string")


def test_single_case(spark):
    own = cases.cases_of(forms(spark))
    got = {r["case_id"]: r for r in own.collect()}
    assert got["1"]["terms"] == ["Fever", "Hot"] and got["1"]["inn"] == "Aspirin" and got["2"]["error"] == "no drug" and got["3"]["terms"] == ["Pain"]

    def broken(_):
        raise OSError("down")

    sources = {"CIMA": lambda c: c.select("case_id", F.lit("ok").alias("status"), F.concat(F.lit("text of "), "inn").alias("text")), "PubMed": broken, "PRAC/EMA": lambda c: c.select("case_id", F.lit("ok").alias("status"), F.lit("No disponible").alias("text"))}
    cards = cases.case_cards(own, sources).collect()
    assert len(cards) == 6 and {c["state"] for c in cards if c["source"] == "PubMed"} == {"error"}
    events = cases.case_events(own, sources).where("case_id = '1'").orderBy("seq").collect()
    assert [e["tipo"] for e in events] == ["cabecera", "seccion", "seccion", "seccion", "fin"]
    prompts = {r["case_id"]: r["prompt"] for r in cases.case_prompts(own, sources, "head").collect()}
    assert set(prompts) == {"1", "3"} and prompts["1"] == "head\n\nFármaco:  Aspirin \nRAM sospechada: Fever\nEdad: 40\n\n--- CIMA — Ficha Técnica AEMPS ---\ntext of Aspirin"
    assert cases.collect_evidence(own, {}).count() == 0


def test_combination(spark):
    rows = [("1", '[{"inn": "aspirin", "name_es": "Aspirina"}, {"inn": "warfarin"}, {"inn": "heparin"}]'), ("2", '[{"inn": "aspirin"}]'), ("3", "bad")]
    own = cases.combination_cases(spark.createDataFrame(rows, "case_id string, drugs_json string"))
    assert own.where("error is null").count() == 3
    sheet = "4.5 Interacción con otros medicamentos y otras formas de interacción\nAvoid WARFARIN.\n4.6 Fertilidad"
    sheets = spark.createDataFrame([("aspirin", sheet), ("warfarin", "none")], "inn string, text string")
    known = spark.createDataFrame([("warfarin", 0, "Aspirin", "bleeding")], "inn string, int_pos int, name string, description string")
    mentions, pairs, queries = cases.interaction_evidence(own, sheets, known)
    assert [(r["source"], r["mentioned"]) for r in mentions.collect()] == [("Aspirina", "warfarin")]
    assert [tuple(r) for r in pairs.collect()] == [("1", "warfarin", "aspirin", "bleeding")]
    assert queries.count() == 4 and queries.orderBy("nth").first()["query"] == '"aspirin" AND "warfarin" AND "heparin"'
