"""

Input rows are of two kinds in one stream: a request opens a case, an answer is one source's evidence for it. State of a case: its next
event number, what its sources said (for the references and the session), and a timer at the end of their time. A source that is
silent until then becomes an error card of its own; once all sources are in, or the time is up, come the
references and the end. State of a finished case shrinks to one mark, so that late and repeated answers change nothing.

The timer is part of the state, so a query that is started again in the middle of a case goes on with the number and the
time that it had. Events of one case are numbered from 0 without gaps; the number orders them wherever they are stored.

Defined results: answers that come before their request wait for it; the first answer of a source counts; answers of unknown
sources are left out; a second request for a case is ignored; rows without a case_id go.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilake.operators.reports import SOURCES
from vigilake.session import ship

#: Fixed value: seconds that a source has (STM-02).
SECONDS = 45
EVENTS = "case_id string, seq long, tipo string, payload string"
INPUT = "case_id string, kind string, source string, status string, text string, refs string, header string"
#: What a card says of a source that was silent, and messages of progress and end ({} is the source).
SILENT, BEGUN, DONE = "Sin respuesta (timeout)", "Buscando evidencia en fuentes externas...", "Análisis completado"
NOTES = {"ok": "✓ {} obtenida", "timeout": "⏱ {} — sin respuesta (timeout)", "error": "✗ {} — error"}
#: The references of the event by the sources that give them, with what stands for none.
REFERENCES = {"pubmed": ("PubMed", []), "pathway_commons": ("PathwayCommons", []), "fda": ("FDA FAERS", {}), "prac": ("PRAC/EMA", [])}
_CARDS = {name: (card, title) for name, card, title, _ in SOURCES}


def requests_and_answers(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Both kinds of rows as one table or stream. cases: case_id and further columns, which the header event shows; evidence: case_id, source, status, text, refs (JSON)."""
    none = F.lit(None).cast("string")
    head = F.to_json(F.struct(*(F.col(f"`{c}`") for c in cases.columns if c != "case_id")), {"ignoreNullFields": "false"}) if len(cases.columns) > 1 else F.lit("{}")
    opened = cases.select(F.col("case_id").cast("string"), F.lit("request").alias("kind"), none.alias("source"), none.alias("status"), none.alias("text"), none.alias("refs"), head.alias("header"))
    return opened.unionByName(evidence.select(F.col("case_id").cast("string"), F.lit("answer").alias("kind"), "source", "status", "text", "refs", none.alias("header")))


def card(source: str, status: str, text: str | None) -> dict:
    """The card of a source, as ``reports.cards`` makes it."""
    said = SILENT if status == "timeout" else f"Error: {text or ''}" if status == "error" else (text or "").strip() or "No disponible"
    card_id, title = _CARDS[source]
    return {"id": card_id, "titulo": title, "estado": "ok" if status == "ok" else "error", "contenido": {"texto": said, "contradiccion": None}, "fuentes": [source]}


def parsed(refs: str | None, none: object) -> object:
    """References as JSON; what can't be read is none."""
    try:
        return json.loads(refs) if refs else none
    except ValueError:
        return none


class CaseEvents(StatefulProcessor):
    """States of a case: the next number, the answers by source, whether it was opened, whether it is done."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, opened boolean, done boolean")
        self.answers = handle.getMapState("answers", "source string", "status string, text string, refs string")

    def _event(self, key: tuple, kind: str, **payload) -> dict:
        seq = self.next
        self.next += 1
        return {"case_id": key[0], "seq": seq, "tipo": kind, "payload": json.dumps(payload, ensure_ascii=False, separators=(",", ":"))}

    def _said(self, key: tuple, source: str, status: str, text: str | None) -> list[dict]:
        note = NOTES.get(status, NOTES["error"]).format(source)
        return [self._event(key, "seccion", **card(source, status, text)), self._event(key, "progreso", mensaje=note)]

    def _end(self, key: tuple) -> list[dict]:
        """References and end, once no source is missing; the answers are not needed any more."""
        known = {k[0]: v for k, v in self.answers.iterator()}
        refs = lambda source, none: parsed(known[source][2], none) if source in known else none
        first = refs("CIMA", [])
        url = first[0].get("ft_url", "") if isinstance(first, list) and first and isinstance(first[0], dict) else ""
        out = [self._event(key, "referencias", ft_url=url, **{k: refs(source, none) for k, (source, none) in REFERENCES.items()}), self._event(key, "fin", mensaje=DONE, session_id=key[0])]
        self.answers.clear()
        self.done = True
        return out

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        self.next, opened, self.done = self.place.get() if self.place.exists() else (0, False, False)
        if self.done:
            return iter([])
        fresh, head, out = [], None, []
        for row in rows:
            if row["kind"] == "request":
                head = row["header"] if head is None else head
            elif row["source"] in _CARDS and row["source"] not in fresh and not self.answers.containsKey((row["source"],)):
                self.answers.updateValue((row["source"],), (row["status"], row["text"], row["refs"]))
                fresh.append(row["source"])
        if head is not None and not opened:
            opened, fresh = True, [k[0] for k in self.answers.keys()]
            out += [self._event(key, "cabecera", **json.loads(head)), self._event(key, "progreso", mensaje=BEGUN)]
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.seconds))
        if opened:
            for source in sorted(fresh, key=list(_CARDS).index):
                status, text, _ = self.answers.getValue((source,))
                out += self._said(key, source, status, text)
            if all(self.answers.containsKey((x,)) for x in _CARDS):
                out += self._end(key)
        self.place.update((self.next, opened, self.done))
        return self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        self.next, opened, self.done = self.place.get()
        out = []
        if not self.done:
            for source in _CARDS:
                if not self.answers.containsKey((source,)):
                    out += self._said(key, source, "timeout", None)
            out += self._end(key)
            self.place.update((self.next, opened, self.done))
        return self._rows(out)

    @staticmethod
    def _rows(events: list[dict]) -> Iterator:
        return iter([Row(**e) for e in events])

    def close(self) -> None:
        pass


def case_events(rows: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """Events (case_id, seq, tipo, payload) of a stream of ``requests_and_answers``. The session needs the RocksDB state store."""
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # the process that prepares states on the driver doesn't see shipped code, so the processor travels by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    # a query that was started again runs no batch before there are new rows, so timers would wait for them: a beat without a case runs one
    beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    beat = beat.select(*(F.lit(None).cast("string").alias(c) for c in rows.columns))
    keyed = rows.unionByName(beat).where("case_id is not null").groupBy("case_id")
    return keyed.transformWithState(CaseEvents(seconds), EVENTS, "append", "ProcessingTime")
