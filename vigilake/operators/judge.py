"""

Each prompt is a call of its own, with an answer, an error and a time limit of its own; a few are made at once in a task.
A call that is over its limit is left behind and counts against the calls at once until it ends, so hung calls never pile
up: when all are hung, the prompts that are left fail at once.

The defaults are deterministic and offline. Rows with a null prompt never reach a judge, so a cheap predicate that sets it
to null decides who is asked, whatever the optimizer does around Python functions.
"""

from __future__ import annotations

import collections
import threading
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vigilake.functions.json import verdict
from vigilake.functions.text import strip
from vigilake.operators.terms import reaction_hit
from vigilake.session import ship, spread

Judge = Callable[[list[str]], list[str]]
#: Calls of a task that are made at once.
AT_ONCE = 6
#: Rows whose prompts are taken as Python strings at once.
SLICE = 512
#: Characters of a text that a datasheet judge is shown (TOP-06).
SHOWN = 8000


def never(prompts: list[str]) -> list[str]:
    """The offline judge: the reaction is not present."""
    return ['{"ram_presente": false, "fragmento": ""}' for _ in prompts]


class Calls:
    """Calls of a judge with one prompt each, ``at_once`` at a time; lives as long as a task. Threads are begun once and take one prompt after the other."""

    def __init__(self, judge: Judge, seconds: float | None, at_once: int = AT_ONCE):
        self.judge, self.seconds, self.at_once = judge, seconds, at_once
        self.lock = threading.RLock()
        self.more, self.over = threading.Condition(self.lock), threading.Condition(self.lock)
        self.threads, self.active, self.run_nth, self.closed = 0, 0, 0, False  # active: calls that have not ended, those that were given up included
        self.prompts: list[str] = []
        self.left: collections.deque[int] = collections.deque()
        self.began: dict[tuple[int, int], float] = {}
        self.out: dict[int, tuple[str | None, str | None]] = {}

    def _work(self) -> None:
        while True:
            with self.lock:
                while not self.left and not self.closed:
                    self.more.wait()
                if self.closed:
                    return
                nth = self.left.popleft()
                key, prompt = (self.run_nth, nth), self.prompts[nth]
                self.began[key] = time.monotonic()
                self.active += 1
            try:
                (answer,) = self.judge([prompt])
                if answer is not None and not isinstance(answer, str):
                    raise TypeError(f"an answer must be text, not {type(answer).__name__}")
                found = (answer, None)
            except BaseException as e:  # whatever a judge raises is its prompt's error
                found = (None, f"{type(e).__name__}: {e}")
            with self.lock:
                self.active -= 1
                if self.began.pop(key, None) is not None:
                    self.out[nth] = found
                if not self.left and not self.began:
                    self.over.notify_all()

    def run(self, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        """(answer, error) of each prompt, in order."""
        with self.lock:
            self.run_nth += 1
            self.prompts, self.out = prompts, {}
            self.left.extend(range(len(prompts)))
            while self.threads < min(self.at_once, self.active + len(prompts)):
                threading.Thread(target=self._work, daemon=True).start()
                self.threads += 1
            self.more.notify_all()
            while self.left or self.began:
                if self.left and not self.began and self.active >= self.at_once:
                    # all calls hang: nothing is left to wait for
                    self.out |= {nth: (None, "TimeoutError: all calls of the task hang") for nth in self.left}
                    self.left.clear()
                    break
                # a call that begins while this waits isn't over its limit before the wait ends
                wait = None if self.seconds is None else max(0.0, min(self.began.values(), default=time.monotonic()) + self.seconds - time.monotonic())
                if not self.over.wait(wait):
                    now = time.monotonic()
                    for key in [k for k, at in self.began.items() if now - at >= self.seconds]:
                        del self.began[key]
                        self.out[key[1]] = (None, f"TimeoutError: no answer in {self.seconds:g} s")
            return [self.out[i] for i in range(len(prompts))]

    def close(self) -> None:
        """Let the threads that wait end."""
        with self.lock:
            self.closed = True
            self.more.notify_all()


def ask(rows: DataFrame, prompt: str = "prompt", judge: Judge = never, answer: str = "answer", seconds: float | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """UDF-01: rows with the judge's answer and an error, both null where the prompt is null.

    A prompt whose call fails, or takes longer than ``seconds`` (STM-03), has a null answer and the error; the others keep theirs. A
    judge is called with lists of one prompt, by ``at_once`` threads of a task. Only prompts become Python strings, a few at a time.
    """
    where = rows.columns.index(prompt)
    kind = StructType([*rows.schema.fields, StructField(answer, StringType()), StructField("error", StringType())])
    names = kind.names
    ship(rows.sparkSession)

    def run(batches: Iterator):
        calls = Calls(judge, seconds, at_once)
        try:
            for whole in batches:
                for begin in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(begin, SLICE)
                    prompts = batch.column(where).to_pylist()
                    asked = [i for i, x in enumerate(prompts) if x is not None]
                    found = dict(zip(asked, calls.run([prompts[i] for i in asked]), strict=True))
                    answers, errors = zip(*(found.get(i, (None, None)) for i in range(len(prompts))), strict=True)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names)
        finally:
            calls.close()

    return rows.mapInArrow(run, kind)


def gated(rows: DataFrame, direct: str, prompt: str = "prompt", judge: Judge = never, enabled: bool = True) -> DataFrame:
    """UDF-04/05: present is true where direct is; only the others are judged, if judging is enabled. One pass over rows, which lose their prompt."""
    sure = F.coalesce(F.col(direct), F.lit(False))
    if not enabled:
        return rows.withColumn("present", sure).drop(prompt)
    asked = ask(rows.withColumn("asked", F.when(~sure, F.coalesce(prompt, F.lit("")))).drop(prompt), "asked", judge)
    said = F.coalesce(verdict(F.coalesce("answer", F.lit("")))["present"], F.lit(False))
    return asked.withColumn("present", sure | said).drop("asked", "answer", "error")


#: What a judge is told (own wording): the answer's keys are those that ``functions.json.verdict`` reads.
TASK = 'Decide whether the text reports the reaction. Answer with one JSON object and nothing else: {"ram_presente": true or false, "fragmento": the sentence that reports it, or null}.'


def datasheet_prompt(text: Column, reaction: Column) -> Column:
    """UDF-05/TOP-06: what a judge is asked about a datasheet, of which it is shown the beginning."""
    return F.concat(F.lit(TASK + "\nReaction: "), reaction, F.lit("\nText of the datasheet:\n"), F.substring(text, 1, SHOWN))


def datasheet_found(sheets: DataFrame, judge: Judge = never, enabled: bool = True, keep: Sequence[str] | None = None) -> DataFrame:
    """UDF-05: sheets (text, reaction, ...) with ram_encontrada: by a direct match, else by the judge; true without a reaction.

    keep: the columns of sheets that the result has (all, if None); the others, such as long texts, don't go to the judge's processes.
    """
    none = F.coalesce(strip(F.col("reaction")), F.lit("")) == ""
    hit = F.coalesce(reaction_hit(F.col("text"), F.col("reaction")), F.lit(False))
    rows = sheets.withColumns({"direct": none | hit, "prompt": datasheet_prompt(F.coalesce("text", F.lit("")), F.coalesce("reaction", F.lit("")))})
    if keep is not None:
        rows = rows.select(*keep, "direct", "prompt")
    return gated(rows, "direct", "prompt", judge, enabled).drop("direct", "prompt").withColumnRenamed("present", "ram_encontrada")


def no_report(prompts: list[str]) -> list[str]:
    """The offline generator: a report without content."""
    return ["{}" for _ in prompts]


def reports_of(prompts: DataFrame, generator: Judge = no_report, seconds: float | None = 300) -> DataFrame:
    """UDF-02: prompts (case_id, prompt) with the report and the error; one that fails has an empty report. All cores share the prompts."""
    return ask(spread(prompts, "case_id", "prompt"), "prompt", generator, "report", seconds).withColumn("report", F.coalesce("report", F.lit("{}")))


def echo(prompts: list[str]) -> list[str]:
    """The offline chat partner: the last line it was sent."""
    return [x.rsplit("\n", 1)[-1] for x in prompts]


#: Answers of a chat that failed (UDF-03, STM-03).
NO_TIME = "❌ Tiempo de espera agotado al consultar el modelo (70s). Intenta de nuevo."
NO_ANSWER = "❌ Error al contactar con el modelo: "


def chat(turns: DataFrame, partner: Judge = echo, seconds: float | None = 70) -> DataFrame:
    """UDF-03: turns (system, history, message) with the response, or a fixed sentence where the partner failed.

    The partner is sent the system text, the history and the message, as far as there are any, divided by newlines.
    """
    rows = turns.withColumn("sent", F.concat_ws("\n", F.nullif("system", F.lit("")), F.nullif("history", F.lit("")), F.coalesce("message", F.lit(""))))
    out = ask(rows, "sent", partner, "response", seconds)
    failed = F.when(F.col("error").startswith("TimeoutError"), F.lit(NO_TIME)).otherwise(F.concat(F.lit(NO_ANSWER), F.regexp_replace("error", r"\A\w+: ", "")))
    return out.withColumn("response", F.coalesce("response", failed)).drop("sent", "error")
