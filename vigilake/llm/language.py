"""Language identification by nearest centroids of TF-IDF n-gram vectors (operator 9).

A text's vector counts its character n-grams of one to three letters (words lower-cased and framed by blanks,
hashed to ``SIZE`` features), scaled by 1 + log(count) and idf and brought to length one. Each language has
several centroids: spherical k-means of its training vectors. A text gets the language of the nearest centroid
by cosine; it is rejected if the cosine is below the language's limit, which is set from the distances of
training texts. Training uses a bounded sample of labelled rows (``SAMPLE`` whole texts of any length, those of the least
hashes), whose n-grams are counted on the executors; the model (a few hundred kB whatever the corpus) goes to the workers with the function. Prediction is a pure
map over whole texts; memory is linear in a chunk or the longest text.

Defined results: a null text or one without a letter is "und" with score 0 and rejected; an empty table gives an empty one;
repeated rows each give a row (in training, equal rows count once); columns of any name are kept as they are, and the
prediction is one struct column whose name must be free; equally near centroids go to the first language by name; without
training rows everything is "und".
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigilake.llm import pieces as P
from vigilake.session import ship

SIZE, CENTROIDS, SAMPLE, ROUNDS = 4096, 4, 6000, 8
#: A text is rejected below this share of the least cosine of nearly all training texts of its language.
MARGIN, QUANTILE = 0.5, 0.005


def counts(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse n-gram counts of texts: (text, feature, count), and the letters of each text."""
    cp, off = P.codepoints([x.lower() for x in texts])
    letter = P.char_classes()[cp] == P.LETTER
    letters = np.add.reduceat(np.append(letter, False).astype(np.int64), off[:-1]) * (off[1:] > off[:-1]) if len(texts) else np.zeros(0, np.int64)
    # other characters become one blank for each run; texts begin and end with one
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[off[:-1][off[:-1] < len(cp)]] = True
    sign = np.where(letter, cp, 32).astype(np.uint64)[keep]
    doc = np.repeat(np.arange(len(texts)), np.diff(off))[keep]
    found = []
    state = np.zeros(len(sign), np.uint64)
    for n in range(3):
        if len(sign) <= n:
            break
        state = state[: len(sign) - n] * np.uint64(0x1F3D5B79) + sign[n:] + np.uint64(1)
        same = doc[: len(sign) - n] == doc[n:]
        h = (state + np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)
        feature = (h >> np.uint64(40)) % np.uint64(SIZE)
        found.append((doc[: len(sign) - n][same] * SIZE + feature[same].astype(np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    flat = np.concatenate(found)
    if len(texts) * SIZE <= 1 << 23:
        dense = np.bincount(flat, minlength=len(texts) * SIZE)
        key = np.flatnonzero(dense)
        n = dense[key]
    else:
        key, n = np.unique(flat, return_counts=True)
    return key // SIZE, key % SIZE, n, letters


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by feature
    centroids: np.ndarray  # (centroids, features), each of length one
    owner: np.ndarray  # language of each centroid
    limit: np.ndarray  # least cosine of each language

    def vectors(self, doc: np.ndarray, feature: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
        out = np.zeros((texts, SIZE), np.float32)
        out[doc, feature] = (1 + np.log(n)) * self.idf[feature]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(size, 1e-12)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and cosines."""
        near = vectors @ self.centroids.T
        best = near.argmax(axis=1)
        return self.owner[best], np.clip(near[np.arange(len(near)), best], 0.0, 1.0)


def train(texts: Sequence[str], languages: Sequence[str]) -> Model:
    """train_counts of texts."""
    found = []
    for a, b in P.chunks(texts, 1 << 18):
        found += _sparse(texts[a:b])
    return train_counts(found, languages)


def _sparse(texts: Sequence[str]) -> list[tuple[bytes, bytes, bool]]:
    """Features, their scaled counts, and whether there is a letter, of each text."""
    doc, feature, n, letters = counts(texts)
    edge = np.searchsorted(doc, np.arange(len(texts) + 1))
    feature, scaled = feature.astype(np.uint16), (1 + np.log(n)).astype(np.float16)
    return [(feature[a:b].tobytes(), scaled[a:b].tobytes(), bool(x)) for a, b, x in zip(edge, edge[1:], letters > 0, strict=False)]


def train_counts(found: Sequence[tuple[bytes, bytes, bool]], languages: Sequence[str]) -> Model:
    """The model of texts given as features, scaled counts and whether there is a letter."""
    names = sorted(set(languages))
    model = Model(names, np.ones(SIZE, np.float32), np.zeros((0, SIZE), np.float32), np.zeros(0, np.int64), np.zeros(0))
    if not names:
        return model
    # one matrix, filled and scaled in place: the driver's memory holds it once (rows by language, so parts are views)
    order = np.argsort(np.array([names.index(x) for x in languages]), kind="stable")
    number = np.array([names.index(languages[i]) for i in order])
    vectors, lettered, frequency = np.zeros((len(order), SIZE), np.float32), np.array([found[i][2] for i in order]), np.zeros(SIZE)
    for row, i in enumerate(order):
        feature = np.frombuffer(found[i][0], np.uint16)
        vectors[row, feature] = np.frombuffer(found[i][1], np.float16)
        frequency[feature] += 1
    model.idf = (np.log((1 + len(order)) / (1 + frequency)) + 1).astype(np.float32)
    for a in range(0, len(order), 512):
        part = vectors[a : a + 512]
        part *= model.idf
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    means, owner = [], []
    for k in range(len(names)):
        own, real = vectors[slice(*np.searchsorted(number, [k, k + 1]))], lettered[number == k]
        if not real.any():
            continue
        # k-means from spread seeds: each next seed is the vector farthest from those chosen
        seeds = [own.sum(axis=0) / real.sum()]
        for _ in range(min(CENTROIDS, int(real.sum())) - 1):
            seeds.append(own[int(np.where(real, (own @ np.stack(seeds).T).max(axis=1), np.inf).argmin())])
        center = np.stack(seeds)
        for _ in range(ROUNDS):
            to = (own @ center.T).argmax(axis=1)
            member = ((to[:, None] == np.arange(len(center))) & real[:, None]).astype(np.float32)
            center = np.where(member.any(axis=0)[:, None], member.T @ own, center)
            center /= np.maximum(np.linalg.norm(center, axis=1, keepdims=True), 1e-12)
        # a cluster of a few odd texts is no typical form of the language
        size = np.bincount((own @ center.T).argmax(axis=1)[real], minlength=len(center))
        center = center[size >= max(1, 0.01 * real.sum())]
        means.append(center)
        owner += [k] * len(center)
    if not means:
        return model
    model.centroids, model.owner = np.concatenate(means).astype(np.float32), np.array(owner)
    got, near = model.nearest(vectors)
    model.limit = np.array([MARGIN * np.quantile(near[(number == k) & (got == k) & lettered], QUANTILE) if ((number == k) & (got == k) & lettered).any() else 0.0 for k in range(len(names))])
    return model


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` different rows of labelled (those of the least hashes; a row that is repeated counts once), whole texts."""
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    edge = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if edge is None:
        return train([], [])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in P.chunks(texts, 1 << 18):
                own = [pa.array(x, t) for x, t in zip(zip(*_sparse(texts[a:b]), strict=True), (pa.binary(), pa.binary(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *own, batch.column(2).slice(a, b - a)], ["h", "feature", "scaled", "lettered", "lang"])

    few = rows.where(F.col("h") <= edge).dropDuplicates(["h", "lang"]).mapInArrow(run, "h long, feature binary, scaled binary, lettered boolean, lang string")
    got = sorted(few.collect(), key=lambda r: (r["h"], r["lang"]))[:sample]
    return train_counts([(bytes(r["feature"]), bytes(r["scaled"]), r["lettered"]) for r in got], [r["lang"] for r in got])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, text_col: str = "text", result: str = "language") -> DataFrame:
    """docs with one more column, a struct of lang_pred, score (cosine, 0 to 1) and rejected."""
    ship(docs.sparkSession)
    names = list(docs.columns)
    if result in names:
        raise ValueError(f"there is a column {result}")
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            lang, score, rejected = [], [], []
            for a, b in P.chunks(texts, 1 << 20):
                for lo in range(a, b, 1024):
                    part = texts[lo : min(b, lo + 1024)]
                    doc, feature, n, letters = counts(part)
                    if len(model.owner):
                        own, near = model.nearest(model.vectors(doc, feature, n, len(part)))
                    else:
                        own, near, letters = np.zeros(len(part), np.int64), np.zeros(len(part)), letters * 0
                    for i in range(len(part)):
                        known = letters[i] > 0
                        lang.append(model.languages[own[i]] if known else "und")
                        score.append(float(near[i]) if known else 0.0)
                        rejected.append(bool(not known or near[i] < model.limit[own[i]]))
            found = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, result])

    # by position, as names may hold dots
    return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(f"`{result}` struct<lang_pred:string,score:double,rejected:boolean>").fields]))
