"""Language identification with string kernels.

The kernel of two texts is the number of distinct letter n-grams of one to three letters that both
have (blended spectrum, presence only), divided by the root of the product of their own numbers.
Landmarks are some training texts of each language; the inverse root of their kernel matrix maps a
text's kernels with them to Nystrom features, on which one ridge regression for each language against
the rest is solved. Scoring is one matrix product of a batch's presence matrix with the landmarks' and
one with the folded weights.

Letters are taken in lower case, everything else separates. Classifier and landmarks are fitted on
documents drawn by hash, ``per_language`` of each language in expectation; every language of the table is
learnt. Beyond ``full_languages`` of them, each has fewer landmarks and documents, so that the sums stay near
those of so many, but a landmark and ``LEAST`` documents (or all of its own) at least. Every text is read and
scored whole. Texts that are null or have no letter are ``und``, as
are all when there is nothing to learn from. Equal scores go to the first language in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodfeed.llm.arrow import annotate, text_bytes
from moodfeed.llm.ship import ship

PER_LANGUAGE = 300
LANDMARKS = 40
FULL_LANGUAGES = 128
LEAST = 40
RIDGE = 1e-2
UNKNOWN = "und"
#: Classes of letters: 0 separates, 1-26 are a-z, other letters share the rest by hash.
CLASSES = 64
SPACE = CLASSES + CLASSES**2 + CLASSES**3
#: Presence matrix of a batch: so many cells at most, but one text.
CELLS = 1 << 21

PREDICTION = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
)


@cache
def _class_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            table[code] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 8) % 37
    return table


def presence(text: bytes) -> np.ndarray:
    """The distinct n-grams of a text, as ascending numbers; none without a letter."""
    codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letters = _class_table()[codes].astype(np.int32)
    letters = np.concatenate([[0], letters, [0]]).astype(np.int32)
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0  # one separator between words
    letters = letters[keep]
    if not len(letters):
        return np.zeros(0, np.int32)
    letters = np.concatenate([[0], letters]).astype(np.int32)
    found = np.zeros(SPACE, bool)
    found[letters] = True
    pairs = letters[:-1] * CLASSES + letters[1:]
    found[CLASSES + pairs] = True
    triples = pairs[:-1] * CLASSES + letters[2:]
    found[CLASSES + CLASSES**2 + triples] = True
    found[0] = False
    return np.flatnonzero(found).astype(np.int32)


def texts_of(column: pa.Array) -> list[bytes]:
    data, offsets = text_bytes(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets, offsets[1:])]


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray  # of each n-gram in the landmarks' presence matrix, or -1
    landmarks: np.ndarray  # presence / root of the number
    weights: np.ndarray

    def kernels(self, grams: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(grams), self.landmarks.shape[1]))
        step = max(1, CELLS // max(1, len(self.landmarks)))
        for a in range(0, len(grams), step):
            batch = grams[a : a + step]
            present = np.zeros((len(batch), len(self.landmarks)), np.float32)
            for i, g in enumerate(batch):
                at = self.rows[g]
                present[i, at[at >= 0]] = 1
            norms = np.sqrt([max(1, len(g)) for g in batch])
            out[a : a + step] = (present @ self.landmarks) / norms[:, None]
        return out

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        k = self.kernels(grams)
        return np.column_stack([k, np.ones(len(k))]) @ self.weights


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int, ridge: float) -> Model:
    """Fit on (language, n-grams), of which the first of each language are its landmarks."""
    samples = [s for s in samples if len(s[1])]
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return Model([], np.full(SPACE, -1, np.int32), np.zeros((0, 0), np.float32), np.zeros((1, 0)))
    chosen, seen = [], dict.fromkeys(languages, 0)
    for lang, grams in samples:
        if seen[lang] < landmarks:
            seen[lang] += 1
            chosen.append(grams)
    vocabulary = np.unique(np.concatenate(chosen))
    rows = np.full(SPACE, -1, np.int32)
    rows[vocabulary] = np.arange(len(vocabulary))
    matrix = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for j, grams in enumerate(chosen):
        matrix[rows[grams], j] = 1 / np.sqrt(len(grams))
    model = Model(languages, rows, matrix, np.zeros((0, 0)))
    values, vectors = np.linalg.eigh(model.kernels(chosen))
    good = values > 1e-6 * values[-1]
    to_features = vectors[:, good] / np.sqrt(values[good])
    features = model.kernels([g for _, g in samples]) @ to_features
    centre = features.mean(0)
    place = {lang: i for i, lang in enumerate(languages)}
    wanted = np.full((len(samples), len(languages)), -1.0)
    wanted[np.arange(len(samples)), [place[lang] for lang, _ in samples]] = 1.0
    mean = wanted.mean(0)
    moved = features - centre
    gram = moved.T @ moved + ridge * len(samples) / len(languages) * np.eye(moved.shape[1])
    solution = np.linalg.solve(gram, moved.T @ (wanted - mean))
    model.weights = np.vstack([to_features @ solution, mean - centre @ solution])
    return model


def held_out(modulus: int, id_column: str = "doc_id") -> Column:
    """Whether the document is kept from learning."""
    known = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(known) % modulus == 1


def train(
    docs: DataFrame,
    per_language: int = PER_LANGUAGE,
    landmarks: int = LANDMARKS,
    full_languages: int = FULL_LANGUAGES,
    ridge: float = RIDGE,
) -> Model:
    """Learn from ``text`` and ``lang`` of the given documents."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return fit([], landmarks, ridge)
    if len(counts) > full_languages:
        landmarks = max(1, landmarks * full_languages // len(counts))
        per_language = max(min(LEAST, per_language), per_language * full_languages // len(counts))
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, per_language / r["count"])) for r in counts], "lang string, share double"
    )
    key = F.xxhash64("text", "doc_id")
    drawn = (F.pmod(key, F.lit(1 << 30)) / float(1 << 30)) < F.col("share")
    marked = labelled.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang")
    sample = marked.where(drawn).select("lang", key.alias("key"), "text")

    def grams(batches):
        for batch in batches:
            found = [presence(t).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("key"), pa.array(found, pa.binary())],
                names=["lang", "key", "grams"],
            )

    ship(docs.sparkSession)
    rows = sample.mapInArrow(grams, "lang string, key long, grams binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["key"]))
    return fit([(r["lang"], np.frombuffer(r["grams"], np.int32)) for r in rows], landmarks, ridge)


def identify(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All rows and columns of ``docs`` and the prediction for ``text``, a struct called ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def predict(column: pa.Array) -> pa.Array:
            grams = [presence(t) for t in texts_of(column)]
            known = np.array([len(g) > 0 for g in grams], bool)
            if not model.languages:
                known[:] = False
                best, top = np.zeros(len(grams), int), np.zeros(len(grams))
            else:
                scores = model.scores(grams)
                best = scores.argmax(1)
                top = np.clip((scores.max(1) + 1) / 2, 0, 1)
            names = [
                model.languages[b] if k else UNKNOWN for b, k in zip(best, known)
            ]
            return pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.where(known, top, 0.0))],
                names=PREDICTION.names,
            )

        return predict

    return annotate(docs, "text", make, PREDICTION, name)
