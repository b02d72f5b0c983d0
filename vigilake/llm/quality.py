"""Quality rules: a learned decision list over text statistics (operator 2, native).

Statistics are Spark expressions over one row, without explode, shuffle or Python: repeated five-word windows
are found by hashing each window (64 bits), sorting hash and place inside the row and comparing neighbours, so
cost is n log n in a text's words and memory linear in the longest text. Sequential covering learns, from a
bounded sample of labelled rows, ordered conjunctions of thresholds that describe poor texts: each rule is grown
by FOIL gain on two thirds of the sample, pruned on the rest and kept only if it is precise there. The list is
applied as one conditional expression, so applying it is a map over the documents.

Bounds of learning, all parameters: ``SAMPLE`` labelled documents, ``STEPS`` thresholds by rank and as many by value for each
feature, ``RULES`` rules of at most ``CONDITIONS`` conditions. Thresholds lie midway between neighbouring values.

Defined results: a null or blank text has no words, all statistics are 0 and it fails the base rules; an empty table gives
an empty one; repeated rows each give a row; columns of any name are kept as they are, and the verdict is one struct column
whose name must be free; without labelled rows of both kinds the list is empty and only the base rules decide. Several
labels of a document count by their mean, and of several texts of a labelled id the one of the least hash is learned from.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: blanks that divide words, symbols, window length.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: At most so many labelled documents (those of the least hashes) are learned from.
SAMPLE = 10_000
STEPS, RULES, CONDITIONS = 40, 12, 6


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for the row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five found twice or more in the same text."""
    n = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    hashes = F.transform(F.arrays_zip(*(F.slice(words, i + 1, n) for i in range(WINDOW))), lambda x: F.xxhash64(x))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("at"))))

        def same(s: Column) -> Column:
            twin = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["at"]))

        spread = lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
        return _let(_let(placed, same), spread)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


#: The statistics of a text.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with STATISTICS (all long), each name after the prefix; the names must be free."""
    words, line_list = f"{prefix}_words", f"{prefix}_lines"
    if taken := sorted({words, line_list, *(prefix + x for x in STATISTICS)} & {*docs.columns}):
        raise ValueError(f"columns have names of statistics: {taken}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    stripped = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    first = docs.withColumns({words: F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, BLANK_RUN)), line_list: lines})
    found = (
        F.size(words),
        F.length(F.translate(text, BLANKS, "")),
        F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        F.size(line_list) - F.size(F.array_distinct(line_list)),
        F.when(F.size(words) > WINDOW, repeated_words(F.col(words))).otherwise(F.lit(0)),
        F.size(line_list),
        F.regexp_count(text, F.lit(r"\p{Lu}")),
        F.regexp_count(text, F.lit("[!?]")),
    )
    return first.withColumns({prefix + k: c.cast("long") for k, c in zip(STATISTICS, found, strict=True)}).drop(words, line_list)


def features(prefix: str = "") -> dict[str, Column]:
    """What thresholds are set on, from the statistics."""
    col = lambda k: F.col(prefix + k)
    ratio = lambda a, b: F.when(col(b) > 0, col(a) / col(b)).otherwise(F.lit(0.0))
    return {
        "words": col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbols_a_word": ratio("n_symbols", "n_words"),
        "marks_a_word": ratio("n_marks", "n_words"),
        "upper_share": ratio("n_upper", "word_chars"),
        "words_a_line": ratio("n_words", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
    }


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 10) | (100 * F.col(f"{prefix}n_repeat_words") > 20 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        value = features(prefix)[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that fits rejects, and what fits none is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def kept(self, prefix: str = "") -> Column:
        verdict = None
        for rule in self.rules:
            fits = rule[0].column(prefix)
            for condition in rule[1:]:
                fits = fits & condition.column(prefix)
            verdict = F.when(fits, F.lit(False)) if verdict is None else verdict.when(fits, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _bits(flags: Iterable[bool]) -> int:
    """The set of places that are true, as a bit set."""
    return int("".join("1" if x else "0" for x in flags)[::-1] or "0", 2)


def learn(rows: Sequence[dict[str, float]], poor: Sequence[bool], steps: int = STEPS, precision: float = 0.9, support: int = 3, most: int = RULES, conditions: int = CONDITIONS) -> DecisionList:
    """Sequential covering. Sets of rows are bit sets; steps: thresholds tried for each feature, by rank and by value."""
    from math import log2

    names = list(rows[0]) if rows else []
    literals: list[tuple[Condition, int]] = []
    for name in names:
        values = [r[name] for r in rows]
        distinct = sorted(set(values))
        ranked = sorted(values)
        marks = {ranked[i * (len(ranked) - 1) // steps] for i in range(steps + 1)} | {distinct[i * (len(distinct) - 1) // steps] for i in range(steps + 1)}
        following = dict(zip(distinct, distinct[1:], strict=False))
        for value in sorted(marks):
            cut = (value + following.get(value, value)) / 2
            high = _bits(v > cut for v in values)
            full = (1 << len(rows)) - 1
            literals += [(Condition(name, True, cut), high), (Condition(name, False, cut), full ^ high)]
    target = _bits(poor)
    other = ((1 << len(rows)) - 1) ^ target
    prune_set = _bits(k % 3 == 2 for k in range(len(rows)))
    left, out = target | other, DecisionList()
    while len(out.rules) < most and (target & left).bit_count() >= support:
        grow = left & ~prune_set
        covered, rule = grow, []
        while (covered & other).bit_count() and len(rule) < conditions:
            p0, n0 = (covered & target).bit_count(), (covered & other).bit_count()
            base, best = log2(p0 / (p0 + n0)) if p0 else 0.0, (1e-9, None)
            for condition, has in literals:
                p = (has & covered & target).bit_count()
                if p >= support:
                    gain = p * (log2(p / (p + (has & covered & other).bit_count())) - base)
                    if gain > best[0]:
                        best = (gain, (condition, has))
            if best[1] is None:
                break
            rule.append(best[1])
            covered &= best[1][1]
        if not rule:
            break
        check, chosen, worth = left & prune_set, rule, -2.0
        for size in range(len(rule), 0, -1):
            has = check
            for _, own in rule[:size]:
                has &= own
            p, n = (has & target).bit_count(), (has & other).bit_count()
            value = (p - n) / (p + n) if p + n else -1.0
            if value >= worth:
                chosen, worth = rule[:size], value
        has = left
        for _, own in chosen:
            has &= own
        p, n = (has & target).bit_count(), (has & other).bit_count()
        if p < support or p < precision * (p + n) or worth < 2 * precision - 1:
            break
        out.rules.append(tuple(c for c, _ in chosen))
        left &= ~has
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Learn from the sample of labelled documents; labels: doc_id, quality (0 poor, 1 good)."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample's ids are few by its bound, so they go to the texts and no text is shuffled
    own, names = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), list(features())
    got = statistics(own).select("doc_id", F.xxhash64("text").alias("h"), F.struct((F.col("quality") < 0.5).alias("poor"), base_failed().alias("failed"), *(c.alias(k) for k, c in features().items())).alias("x"))
    got = got.groupBy("doc_id").agg(F.min(F.struct("h", "x")).alias("y")).select("y.x.*").collect()
    rows = sorted(tuple(r) for r in got if not r["failed"])
    random.Random(7).shuffle(rows)
    return learn([dict(zip(names, map(float, r[2:]), strict=True)) for r in rows], [r[0] for r in rows])


def judge(docs: DataFrame, labels: DataFrame | None, rules: DecisionList | None = None, text_col: str = "text", verdict: str = "verdict") -> DataFrame:
    """docs with one more column, a struct of STATISTICS, base_failed and kept. rules: by default, learned from labels."""
    if verdict in docs.columns:
        raise ValueError(f"there is a column {verdict}")
    rules = rules or fit(docs, labels)
    prefix = free_name(docs.columns, "_q")
    found = statistics(docs, text_col, prefix).withColumn(f"{prefix}base_failed", base_failed(prefix))
    found = found.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & rules.kept(prefix))
    names = (*STATISTICS, "base_failed", "kept")
    return found.withColumn(verdict, F.struct(*(F.col(prefix + k).alias(k) for k in names))).drop(*(prefix + k for k in names))


def free_name(columns: Iterable[str], name: str) -> str:
    """name, with as many _ after it as it takes so that no column begins with it, whatever its case."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name
