"""Column functions over text: folding, word-bounded matching, sections, cleaning, snippets.

"""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word characters and blanks as regular-expression classes of the JVM.
W = r"[\p{L}\p{N}_]"
S = r"[\s\x1c-\x1f\x85\p{Z}]"


def _bases(c: str) -> str:
    """The decomposition without marks."""
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")


@functools.lru_cache(maxsize=1)
def _decompositions() -> dict[str, str]:
    """Characters (but Hangul syllables) that decompose, without marks, into other ones, and those; by rule, over all of Unicode."""
    found = (chr(p) for p in range(0xC0, 0x110000) if unicodedata.decomposition(chr(p))[:1] not in ("", "<"))
    return {c: base for c in found if (base := _bases(c)) and base != c}


@functools.lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Characters that decompose into one base character and marks, and their bases."""
    one = {c: base for c, base in _decompositions().items() if len(base) == 1}
    return "".join(one), "".join(one.values())


@functools.lru_cache(maxsize=1)
def _match_map() -> dict[str, str]:
    """accent_map, with the small letters that (?iu) takes for another one (long s, dotless i, final sigma) as that one."""
    out = dict(zip(*accent_map(), strict=True))
    for c in map(chr, range(0xB5, 0x3000)):
        twin = c.upper().lower()
        if unicodedata.category(c) != "Mn" and len(c.upper()) == len(twin) == 1 and c == c.lower() != twin:
            out[c] = out.get(twin, twin)
    return {c: out.get(base, base) for c, base in out.items()}


def unaccent(text: Column) -> Column:
    """STR-01: drop combining marks; letters such as ø and ß stay."""
    src, dst = accent_map()
    return F.regexp_replace(F.translate(text, src, dst), r"\p{Mn}", "")


def ascii_fold(text: Column) -> Column:
    """STR-02: lower case, no accents, nothing beyond ASCII."""
    return F.regexp_replace(unaccent(F.lower(text)), r"[^\x00-\x7F]", "")


def strip(text: Column) -> Column:
    """Trim all Unicode blanks."""
    return F.regexp_replace(text, rf"\A{S}+|{S}+\z", "")


def fold(text: str) -> str:
    """unaccent(lower(text)) of a driver-side string."""
    return "".join(x for x in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(x) != "Mn")


def match_key(term: str) -> str:
    """match_fold() of a driver-side string."""
    return fold(term.lower().translate(str.maketrans(_match_map())))


#: Letters of Hangul syllables: beginnings, vowels and ends.
_JAMO = tuple("".join(map(chr, range(a, b))) for a, b in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once for the row however often f takes it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _spelled(text: Column) -> Column:
    """Characters that decompose into several bases as those; texts without one stay as they are."""
    several = {c: base for c, base in _decompositions().items() if len(base) > 1}
    known = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))

    def bases(c):
        n = F.ascii(c) - 0xAC00
        letters = (F.substr(F.lit(x), k.cast("int"), F.lit(1)) for x, k in zip(_JAMO, (F.floor(n / 588) + 1, F.floor(n % 588 / 28) + 1, n % 28), strict=True))
        begin, vowel, end = letters
        return F.when((c >= "가") & (c <= "힣"), F.concat(begin, vowel, F.when(n % 28 > 0, end).otherwise(""))).otherwise(F.coalesce(F.try_element_at(known, c), c))

    # one range is looked for first: a class of many parts is slow on the texts that have nothing of it
    some = lambda x: x.rlike(f"[{min(several)}-{max(several)}]") & x.rlike(f"[가-힣{''.join(several)}]")
    return bound(text, lambda x: F.when(some(x), F.array_join(F.transform(F.split(x, ""), bases), "")).otherwise(x))


def match_fold(text: Column, marks: bool = False) -> Column:
    """Text in which words are compared: lower case, decomposed, with the marks or without them."""
    letters = _match_map()

    def fold_of(low):
        out = _spelled(F.translate(low, "".join(letters), "".join(letters.values())))
        return out if marks else F.regexp_replace(out, r"\p{Mn}", "")

    return bound(F.lower(text), lambda low: F.when(low.rlike(r"[^\x00-\x7F]"), fold_of(low)).otherwise(low))


def _quoted(x: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", x, flags=re.UNICODE)


def term_regex(term: str) -> str:
    """FLT-01: the term as a whole word, blanks flexible, case ignored. What stands before is looked at after the first word has been found, which is the rarer test."""
    first, *more = map(_quoted, term.split())
    return rf"(?iu){first}(?<!{W}{first}){''.join(f'{S}+{x}' for x in more)}(?!{W})"


def key_regex(key: str) -> str:
    """The folded term as a whole word, blanks as they are."""
    return rf"{_quoted(key)}(?<!{W}{_quoted(key)})(?!{W})"


def _real(terms: Sequence[str | None]) -> list[str]:
    return [t for t in terms if t is not None and t.strip()]


def term_hit(text: Column, known: Column, term: str) -> Column:
    """FLT-02 for one term: in the text as it is, blanks flexible, or folded with its blanks literally; known: of _known.

    Substring tests of the folded text go before the regular expressions. The text as it is can only have a term of one word
    in ASCII letters that the folded one hasn't if it has marks of its own (they end words, and are gone when folded).
    """
    folded, key = known["folded"], match_key(term.strip())
    words = re.findall(r"\w+", key)
    plain = bool(words) and key.isascii()
    loose = folded.contains(key) & folded.rlike(key_regex(key))
    exact = text.rlike(term_regex(term))
    if plain:
        exact = functools.reduce(operator.and_, (folded.contains(x) for x in dict.fromkeys(words)), known["marked"] if len(term.split()) == 1 else F.lit(True)) & exact
    return loose | exact


def has_marks(text: Column) -> Column:
    """Whether the text has marks of its own."""
    return text.rlike(r"[^\x00-\x7F]") & text.rlike(r"\p{Mn}")


def _known(text: Column) -> Column:
    """folded, and marked: whether the text has marks of its own."""
    return F.struct(match_fold(text).alias("folded"), has_marks(text).alias("marked"))


def contains_any(text: Column, terms: Sequence[str | None]) -> Column:
    """FLT-02: whether any term occurs, in the text as it is or without accents; blank terms are skipped."""
    hits = lambda known: (F.coalesce(term_hit(text, known, t), F.lit(False)) for t in _real(terms))
    return bound(_known(text), lambda known: functools.reduce(operator.or_, hits(known))) if _real(terms) else F.lit(False)


def matching_terms(text: Column, terms: Sequence[str | None]) -> Column:
    """STR-03: the terms that occur, in their order, repetitions kept."""
    if not _real(terms):
        return F.array().cast("array<string>")
    hits = lambda known: F.array(*(F.when(term_hit(text, known, t), F.lit(t)) for t in _real(terms)))
    return bound(_known(text), lambda known: F.filter(hits(known), lambda x: x.isNotNull()))


def mentions(text: Column, name: Column | str) -> Column:
    """FLT-03: substring, case ignored, no word boundary."""
    return F.lower(text).contains(F.lower(F.lit(name) if isinstance(name, str) else name))


def sentences(text: Column) -> Column:
    return F.split(text, rf"(?<=[.!?]){S}+")


def first_fragment(text: Column, terms: Sequence[str]) -> Column:
    """STR-04: the first sentence with a term, without outer blanks, else empty. Sentences are looked at only in texts with a term."""
    found = F.filter(sentences(text), lambda x: contains_any(x, terms))
    return F.when(contains_any(text, terms), strip(F.coalesce(F.get(found, F.lit(0)), F.lit("")))).otherwise("")


def subsections(text: Column) -> Column:
    """STR-05: split before headings such as 4.1 or 4.1.2.; blank parts are dropped."""
    parts = F.split(text, r"(?m)(?=(?:^|\n)4\.\d+(?:\.\d+)*\.?\s)")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


#: Sections of a datasheet that matter (STR-06), as number and words of the heading, then of the heading that ends it.
DATASHEET = (
    ("4.3", "Contraindicaciones", "4.4", "Advertencias"),
    ("4.4", "Advertencias y precauciones especiales de empleo", "4.5", "Interacción"),
    ("4.5", "Interacción con otros medicamentos y otras formas de interacción", "4.6", "Fertilidad, embarazo y lactancia"),
    ("4.8", "Reacciones adversas", "4.9", "Sobredosis"),
    ("4.9", "Sobredosis", "5", "Propiedades farmacológicas"),
    ("5.1", "Propiedades farmacodinámicas", "5.2", "Propiedades farmacocinéticas"),
    ("5.2", "Propiedades farmacocinéticas", "5.3", "Datos preclínicos sobre seguridad"),
)
#: Fixed value: its section of interactions (STR-07).
INTERACTIONS = (("4.5", "Interacción con otros medicamentos y otras formas de interacción", "4.6", "Fertilidad"),)
#: The minutes' section of signals (STR-08) and the lines that end it, as number and words (an "s" in [sz] stands for both spellings).
SIGNALS = ("4", "Signals? assessment and prioriti[sz]ation")
AFTER_SIGNALS = (("5", "Risk Management"), ("5", "Pharmacovigilance"), ("6", ""))


def _heading(number: str, words: str) -> str:
    """A datasheet's heading: the number, perhaps a dot and blanks, the words with or without their accents."""
    plain = "".join(f"[{c}{b}]" if (b := _bases(c)) != c else re.escape(c).replace("\\ ", " ") for c in words)
    return rf"{re.escape(number)}\.?{S}*{plain}"


def _stretches(parts: Column, opens: Callable[[Column], Column], closes: Callable[[Column], Column], kinds: int, to_the_end: bool) -> Column:
    """Stretches of parts (first part from 1, number of parts) that begin at an opening part and go on to the next part that closes their kind.

    opens: the kind (from 1) that a part opens, or null; closes: for each kind, whether the part closes it. A part that closes a stretch
    may open the next one; other openings inside a stretch are part of it. An opening that nothing closes opens nothing, unless to_the_end.
    """
    marked = F.transform(parts, lambda p: F.struct(opens(p).cast("int").alias("opens"), closes(p).alias("closes")))
    number = F.sequence(F.lit(1), F.size(parts))
    none = F.expr("cast(array() as array<struct<first:int,n:int>>)")

    def fold(all_: Column) -> Column:
        # the last part that closes each kind
        last = F.transform(F.sequence(F.lit(1), F.lit(kinds)), lambda k: F.coalesce(F.array_max(F.filter(number, lambda i: F.element_at(F.element_at(all_, i)["closes"], k))), F.lit(0)))

        def step(state: Column, i: Column) -> Column:
            part = F.element_at(all_, i)
            shut = (state["kind"] > 0) & F.element_at(part["closes"], F.greatest(state["kind"], F.lit(1)))
            done = F.when(shut, F.concat(state["done"], F.array(F.struct(state["first"].alias("first"), (i - state["first"]).alias("n"))))).otherwise(state["done"])
            free = (state["kind"] == 0) | shut
            begins = free & part["opens"].isNotNull() & (F.lit(to_the_end) | (F.element_at(state["last"], F.coalesce(part["opens"], F.lit(1))) > i))
            kind = F.when(begins, part["opens"]).when(free, 0).otherwise(state["kind"])
            return F.struct(done.alias("done"), F.coalesce(kind, F.lit(0)).alias("kind"), F.when(begins, i).otherwise(state["first"]).alias("first"), state["last"].alias("last"))

        begin = F.struct(none.alias("done"), F.lit(0).alias("kind"), F.lit(0).alias("first"), last.alias("last"))
        end = lambda x: F.when(F.lit(to_the_end) & (x["kind"] > 0), F.concat(x["done"], F.array(F.struct(x["first"].alias("first"), (F.size(parts) + 1 - x["first"]).alias("n"))))).otherwise(x["done"])
        return F.aggregate(number, begin, step, end)

    return bound(marked, fold)


def _sections(text: Column, table: Sequence[tuple[str, str, str, str]]) -> Column:
    """The sections of a table that a text has, in its order, from their heading up to the next one that ends them."""
    starts, ends = [_heading(n, w) for n, w, _, _ in table], [_heading(n, w) for _, _, n, w in table]
    parts = F.split(text, f"(?iu)(?={'|'.join(dict.fromkeys(starts + ends))})")

    def opens(p: Column) -> Column:
        kind = F.lit(None).cast("int")
        for k in range(len(table), 0, -1):
            kind = F.when(p.rlike(rf"(?iu)\A{starts[k - 1]}"), k).otherwise(kind)
        return kind

    closes = lambda p: F.array(*(p.rlike(rf"(?iu)\A{x}") for x in ends))
    found = lambda all_: F.transform(_stretches(all_, opens, closes, len(table), False), lambda x: F.array_join(F.slice(all_, x["first"], x["n"]), ""))
    return bound(parts, found)


def datasheet_sections(text: Column, table: Sequence[tuple[str, str, str, str]] = DATASHEET, separator: str = "\n\n---\n\n") -> Column:
    """STR-06: the known sections in order of the text, joined; the whole text where none is found."""
    return bound(_sections(text, table), lambda found: F.when(F.size(found) > 0, F.array_join(F.transform(found, strip), separator)).otherwise(text))


def interaction_section(text: Column) -> Column:
    """STR-07: section 4.5 up to 4.6; empty without it."""
    return strip(F.when(text.isNotNull(), F.coalesce(F.get(_sections(text, INTERACTIONS), F.lit(0)), F.lit(""))))


def last_section(text: Column) -> Column:
    """STR-08/TOP-09: what follows the last heading of signals (the first may be a table of contents), up to a line that ends the section or the text's end; null without one."""
    blank = r"[.\s]+"
    title = rf"{SIGNALS[0]}{blank}{SIGNALS[1].replace(' ', chr(92) + 's+')}\w*"
    lines = [rf"{n}{blank if w else '[.' + chr(92) + 's]'}{w.replace(' ', chr(92) + 's+')}" for n, w in AFTER_SIGNALS]
    line = rf"^[^\S\n]*(?:{'|'.join(lines)})"
    parts = F.split(F.regexp_replace(text, r"\n{3,}", "\n\n"), rf"(?im)(?={title}|{line})")
    opens = lambda p: F.when(p.rlike(rf"(?i)\A{title}"), 1)
    closes = lambda p: F.array(p.rlike(rf"(?i)\A[^\S\n]*(?:{'|'.join(lines)})"))

    def found(all_: Column) -> Column:
        last = F.try_element_at(_stretches(all_, opens, closes, 1, True), F.lit(-1))
        return F.when(last.isNotNull(), F.regexp_replace(F.array_join(F.slice(all_, last["first"], last["n"]), ""), rf"(?i)\A{title}", ""))

    return bound(parts, found)


def clean(text: Column) -> Column:
    """STR-09: line ends, blank runs, line tails, dash runs and control characters."""
    out = F.regexp_replace(text, r"\r\n", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r" {2,}", " ")
    out = F.array_join(F.transform(F.split(out, "\n"), lambda x: F.regexp_replace(x, rf"{S}+\z", "")), "\n")
    out = F.regexp_replace(out, "[-–—]+", "-")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b-\x1f]", "")
    return strip(out)


def snippet(text: Column, name: Column | str, before: int = 80, after: int = 120) -> Column:
    """STR-10: the text around the first mention without outer blanks, with an ellipsis where it is cut; null without a mention."""
    name = F.lit(name) if isinstance(name, str) else name
    at = F.position(F.lower(name), F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + F.length(name) - 1 + after, F.length(text))
    body = strip(F.substr(text, start, end - start + 1))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise("")))


def is_code(query: Column) -> Column:
    """STR-13: digits only: a code prefix, else a name."""
    return query.rlike("^[0-9]+$")


def file_name(url: Column) -> Column:
    """SNK-07: the last part of a url's path."""
    return F.get(F.split(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1), r"\?"), F.lit(0))


#: Beginnings of texts that say that a source had nothing (FLT-14).
NO_INFO = (
    "sin resultados en cima",
    "ficha técnica no disponible",
    "la ram ",
    "error al consultar",
    "datos prac/ema no disponibles",
    "sin respuesta (timeout)",
    "no disponible",
)


def is_no_info(text: Column, prefixes: Sequence[str] = NO_INFO) -> Column:
    """FLT-14: blank, or begins with one of the prefixes, case ignored."""
    low = F.lower(strip(F.coalesce(text, F.lit(""))))
    out = low == ""
    for p in prefixes:
        out = out | low.startswith(p)
    return out


#: What a prompt says in place of a datasheet or minutes without information (FLT-15).
NO_DATASHEET = "En la ficha técnica de CIMA/AEMPS no se ha encontrado información relacionada con la RAM '{ram}' para el fármaco '{farmaco}'."
NO_MINUTES = "No se ha identificado evaluación regulatoria formal de la RAM '{ram}' para el fármaco '{farmaco}' en las actas PRAC/EMA disponibles."


def or_canned(text: Column, canned: str, drug: Column, reaction: Column, prefixes: Sequence[str] = NO_INFO) -> Column:
    """FLT-15: a fixed sentence about the drug and the reaction in place of a text without information."""
    blank = F.lit("")
    said = F.replace(F.replace(F.lit(canned), F.lit("{ram}"), F.coalesce(reaction, blank)), F.lit("{farmaco}"), F.coalesce(drug, blank))
    return F.when(is_no_info(text, prefixes), said).otherwise(text)


#: English month names.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def find_date(text: Column, name: Column) -> Column:
    """DAT-01: a date in the first 500 characters, else in the file name, else a fixed sentence."""
    head = F.substring(text, 1, 500)
    none = lambda x: F.nullif(x, F.lit(""))
    day = F.regexp_extract(head, rf"(?i)\b(\d{{1,2}}(?:\s*[-–to]+\s*\d{{1,2}})?\s+(?:{MONTHS})\s+\d{{4}})\b", 1)
    month = F.regexp_extract(head, rf"(?i)\b((?:{MONTHS})\s+\d{{4}})\b", 1)
    named = F.regexp_extract(F.lower(name), rf"((?:\d{{1,2}}-)?\d{{1,2}}-(?:{MONTHS.lower()})-\d{{4}})", 1)
    named = F.initcap(F.replace(named, F.lit("-"), F.lit(" ")))
    return F.coalesce(none(day), none(month), none(named), F.lit("Fecha no encontrada"))


def month_of(date: Column) -> Column:
    """DAT-02: the first day of a date string's month, for true chronological order; null if there is none."""
    found = F.regexp_extract(date, rf"(?i)((?:{MONTHS})\s+\d{{4}})", 1)
    return F.to_date(F.try_to_timestamp(F.concat(F.lit("1 "), F.initcap(found)), F.lit("d MMMM yyyy")))
