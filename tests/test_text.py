"""Text functions against Python's own on random Unicode strings, and cases derived by hand."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vigilake.functions import arrays, json, text
from vigilake.operators import terms


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_fold_and_strip_like_python(spark):
    r = random.Random(1)
    pool = "aZéÉñüÅøßŞ ́  \t\n1²_-.漢"
    rows = [("".join(r.choice(pool) for _ in range(r.randint(0, 15))),) for _ in range(500)]
    out = spark.createDataFrame(rows, "x string").select("x", text.unaccent(F.col("x")).alias("u"), text.ascii_fold(F.col("x")).alias("a"), text.strip(F.col("x")).alias("s")).collect()
    for x in out:
        nfd = unicodedata.normalize("NFD", x["x"])
        assert unicodedata.normalize("NFD", x["u"]) == "".join(c for c in nfd if unicodedata.category(c) != "Mn")
        assert x["a"] == unicodedata.normalize("NFD", x["x"].lower()).encode("ascii", "ignore").decode()
        assert x["s"] == x["x"].strip()


@pytest.mark.parametrize(("value", "terms", "expected"), [
    ("áfiebre", ["fiebre"], []),
    ("la FIEBRE.", ["fiebre"], ["fiebre"]),
    ("REACCION grave", ["reacción"], ["reacción"]),
    ("anything", ["", None, " "], []),
    ("liver  failure, liver", ["liver failure", "liver", "liver"], ["liver failure", "liver", "liver"]),
    ("a c++ case", ["c++"], ["c++"]),
    ("groß", ["gross"], []),
    ("pré  natal", ["pre natal"], []),
    ("pré natal", ["pre natal"], ["pre natal"]),
    ("pré  natal", ["pré natal"], ["pré natal"]),
    ("pre \u00a0\n natal", ["Pre natal"], ["Pre natal"]),
    ("pre\tnatal", ["pre\tnatal", "pre natal"], ["pre\tnatal", "pre natal"]),
    ("thing\u0301s", ["thing"], ["thing"]),
    ("a thing\u0301 x things", ["thing"], ["thing"]),
    ("nothing; things; Thing", ["thing"], ["thing"]),
    ("x-ray, of the  day", ["x-ray", "of the", "the day"], ["x-ray", "of the", "the day"]),
])
def test_terms(spark, value, terms, expected):
    assert one(spark, value, lambda c: text.matching_terms(c, terms)) == expected
    assert one(spark, value, lambda c: text.contains_any(c, terms)) == bool(expected)


BEYOND_LATIN = [
    ("肺 がん です", "がん", True),
    ("肺 かん です", "がん", True),
    ("肺 がん です", "がん", True),
    ("肺 がんの", "がん", False),
    ("약 한국 약", "한국", True),
    ("약 한국 약", unicodedata.normalize("NFD", "한국"), True),
    (unicodedata.normalize("NFD", "약 한국 약"), "한국", True),
    ("약 한국어 약", "한국", False),
    ("약 각 약", "가", False),
    ("ক কো ক", unicodedata.normalize("NFD", "কো"), True),
    ("ſing a ſong", "sing", True),
    ("ΟΔΟΣ", "οδος", True),
    ("cafe\u0301s", "cafe", True),
    ("été", "e\u0301te", True),
    ("kilo \u212a", "k", True),
    ("x", "한국", False),
]


def test_terms_beyond_latin(spark):
    docs = spark.createDataFrame([(i, value) for i, (value, _, _) in enumerate(BEYOND_LATIN)], "doc_id long, text string").cache()
    names = list(dict.fromkeys(term for _, term, _ in BEYOND_LATIN))
    found = {r["doc_id"]: r for r in docs.select("doc_id", *(f(F.col("text"), [t]).alias(f"{k}{i}") for i, t in enumerate(names) for k, f in (("any", text.contains_any), ("all", text.matching_terms), ("first", text.first_fragment)))).collect()}
    # at the bound terms are compiled, beyond it joined
    compiled, joined = ({(r["doc_id"], r["term"]) for r in terms.match_terms(docs, [*names, *(f"none{i}" for i in range(n - len(names)))]).collect()} for n in (terms.COMPILED, terms.COMPILED + 1))
    for i, (value, term, hit) in enumerate(BEYOND_LATIN):
        k = names.index(term)
        assert [found[i][f"{x}{k}"] for x in ("any", "all", "first")] == [hit, [term] * hit, value * hit], (value, term)
        assert ((i, term) in compiled) is hit, (value, term)
    assert joined == compiled


def test_compiled_and_joined_terms_agree(spark):
    """At the bound and beyond it: null and repeated ids, repeated rows, terms of signs only, several blanks."""
    rows = [(None, "a thing here"), (None, "the  end"), (1, "thing"), (1, "thing"), (1, "pre  natal"), (2, "pré natal ++ $$"), (3, None), (4, ""), (5, "++"), (6, "c+ +")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["thing", "pre natal", "the end", "++", "$", " thing ", *(f"none{i}" for i in range(terms.COMPILED - 6))]
    compiled, joined = (sorted((str(r["doc_id"]), r["term"]) for r in terms.match_terms(docs, x).collect()) for x in (names, [*names, "more"]))
    assert compiled == joined and ("None", "thing") in compiled and compiled.count(("1", "thing")) == 2 and ("2", "++") in compiled


def like_the_source(value, names):
    """The matching rule in plain Python: blanks flexible in the text as it is, literal in the text without accents."""
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn").lower()
    out = []
    for name in names:
        term = name.strip()
        exact = r"(?<!\w)" + r"\s+".join(map(re.escape, term.split(" "))) + r"(?!\w)"
        if term and (re.search(exact, value, re.IGNORECASE) or re.search(r"(?<!\w)" + re.escape(plain(term)) + r"(?!\w)", plain(value))):
            out.append(name)
    return out


def test_terms_like_python(spark):
    r = random.Random(8)
    parts = ["fever", "Fiébre", "pre", "natal", "é", "a", "x-1", " ", "  ", "\t", "\u00a0", ".", "_", "é", "\u0301", "ÑU", "ñu", "1"]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    names = ["fever", "fiebre", "pre natal", "é", "a", "x-1", "ñu", "fever pre", "NU", "natal a"]
    for x in spark.createDataFrame([(x,) for x in rows], "x string").select("x", text.matching_terms(F.col("x"), names).alias("y"), text.first_fragment(F.col("x"), names).alias("f")).collect():
        assert x["y"] == like_the_source(x["x"], names), x["x"]
        assert x["f"] == next((p.strip() for p in re.split(r"(?<=[\.!?])\s+", x["x"]) if like_the_source(p, names)), ""), x["x"]


def test_folding_keeps_word_characters():
    """What ends a word also ends it when folded, so the folded text has each hit of an ASCII word of the text without marks."""
    for c, base in {**text._decompositions(), **text._match_map()}.items():
        assert re.match(r"\w", c) or not any(re.match(r"\w", x) for x in base), (c, base)


def test_folds_agree(spark):
    r = random.Random(5)
    pool = "aÉſıςΣµßK각가힣ᄒ한がカ゛≠ỗকোொ \u0301\u3099豈"
    rows = ["".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(300)]
    for x in spark.createDataFrame([(x,) for x in rows], "x string").select("x", text.match_fold(F.col("x")).alias("y")).collect():
        assert x["y"] == text.match_key(x["x"])


def test_mention_is_a_substring(spark):
    assert one(spark, "xIBUprofeno", lambda c: text.mentions(c, "ibuprofeno"))


def test_sections(spark):
    assert one(spark, "intro\n4.1. A\n4.1.1. B\n4.2 C", text.subsections) == ["intro", "4.1. A", "4.1.1. B", "4.2 C"]
    assert one(spark, "plain", text.subsections) == ["plain"]
    minutes = "4. Signals assessment and prioritisation 12\n5. Risk Management 20\n\n\n\n4. Signals assessment and prioritisation\nbody text\n5. Risk Management plans\nx"
    assert one(spark, minutes, text.last_section).strip() == "body text"
    assert one(spark, "nothing", text.last_section) is None
    sheet = "4.5 Interacción con otros medicamentos y otras formas de interacción\nA\n4.6 Fertilidad, embarazo y lactancia\nB\n4.8 Reacciones adversas\nC\n4.9 Sobredosis\nD"
    assert one(spark, sheet, text.datasheet_sections).count("---") == 1 and one(spark, "none", text.datasheet_sections) == "none"
    assert one(spark, sheet, text.interaction_section).endswith("\nA") and one(spark, "none", text.interaction_section) == ""


def test_fragment_clean_snippet(spark):
    assert one(spark, "One. Two fever here! Three fever", lambda c: text.first_fragment(c, ["fever"])) == "Two fever here!"
    assert one(spark, "One.", lambda c: text.first_fragment(c, ["fever"])) == ""
    assert one(spark, "  a thing here  \n", lambda c: text.first_fragment(c, ["thing"])) == "a thing here"
    assert one(spark, " a—–b\r\nc   d  \n\n\n\ne\x07\tf ", text.clean) == "a-b\nc d\n\ne\tf"
    long = "x" * 100 + " drug " + "y" * 200
    cut = one(spark, long, lambda c: text.snippet(c, "DRUG"))
    assert cut == "…" + long[21:225] + "…" and one(spark, "x" * 90 + " " * 80 + "drug " + "y" * 5, lambda c: text.snippet(c, "drug")) == "…drug yyyyy" and one(spark, "a drug", lambda c: text.snippet(c, "drug")) == "a drug"
    assert one(spark, "none", lambda c: text.snippet(c, "drug")) is None


@pytest.mark.parametrize(("head", "name", "expected"), [
    ("x 10-13 February 2025 y", "a.pdf", "10-13 February 2025"),
    ("10 to 13 February 2025", "a.pdf", "10 to 13 February 2025"),
    ("in February 2025", "a.pdf", "February 2025"),
    ("x" * 500 + "February 2025", "minutes-prac-meeting-10-13-february-2025_en.pdf", "10 13 February 2025"),
    ("", "a.pdf", "Fecha no encontrada"),
])
def test_dates(spark, head, name, expected):
    got = spark.createDataFrame([(head, name)], "x string, n string").select(text.find_date(F.col("x"), F.col("n")).alias("d")).withColumn("m", text.month_of(F.col("d"))).first()
    assert got["d"] == expected and (str(got["m"]) == "2025-02-01" or expected.startswith("Fecha"))


def test_no_info(spark):
    assert [one(spark, x, text.is_no_info) for x in ("Error al consultar CIMA: x", "Error: x", " ", None, "No disponible.")] == [True, False, True, True, True]
    assert one(spark, "", lambda c: text.or_canned(c, text.NO_MINUTES, F.lit("aspirina"), F.lit("fiebre"))) == "No se ha identificado evaluación regulatoria formal de la RAM 'fiebre' para el fármaco 'aspirina' en las actas PRAC/EMA disponibles."
    assert one(spark, "texto", lambda c: text.or_canned(c, text.NO_DATASHEET, F.lit("a"), F.lit("b"))) == "texto"
    assert one(spark, "https://a/b/agenda-x.pdf?v=1/", text.file_name) == "agenda-x.pdf"


def test_json(spark):
    got = [str(one(spark, x, lambda c: F.to_json(json.parse_cascade(c)))) for x in ('{"a": 1}', '```json\n{"a": 1}\n```', 'Sure: {"a": 1} ok', "no json")]
    assert got == ['{"a":1}'] * 3 + ['{"texto_libre":"no json"}']
    verdict = one(spark, 'x {"ram_presente": true, "fragmento": "f"}', json.verdict)
    assert verdict["present"] and verdict["fragment"] == "f" and not one(spark, "?", json.verdict)["present"]
    assert one(spark, " ", json.or_unavailable) == "No disponible"


def test_arrays(spark):
    assert [len(one(spark, list("abcd")[:n], arrays.combinations, "array<string>")) for n in (2, 3, 4)] == [1, 4, 11]
    assert round(one(spark, [True, True, False, False, True], arrays.pacing, "array<boolean>"), 2) == 5.78
    assert one(spark, ["b", "", "a", "b"], arrays.sorted_distinct, "array<string>") == ["a", "b"]
    assert one(spark, [" a ", "", None], arrays.cleaned, "array<string>") == ["a"]
    assert one(spark, ["PT", "x"], lambda c: arrays.term_list(F.lit("pt"), c), "array<string>") == ["pt", "x"]


def test_term_regex_is_a_word_match():
    assert re.search(r"Q|\\", text.term_regex("a.b")) and "[" in text.term_regex("a b")
