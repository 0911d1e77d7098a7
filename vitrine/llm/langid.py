"""Language by a string kernel: which n-grams a text has, against landmark texts.

A text is the set of its byte n-grams of one to three bytes, hashed to a fixed
number of presence bits. The kernel of two texts is the share of n-grams they
have in common (the blended spectrum's cosine). Nyström's method stands in for
the full kernel matrix with a few landmark texts, one-versus-rest ridge
regression is solved in that space, and a batch of texts is scored with two
matrix products. Texts are read whole, whatever their length.

The model is fitted on at most ``PER_LANGUAGE`` texts of each language, the ids
with the smallest hashes; only their presence bits reach the driver.

Defined results: a NULL text, or one without a letter, is ``und`` with score 0,
as is every text when there is nothing to learn from; an empty table gives an
empty result; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import bounded_sample, free_name, id_bucket

WIDTH = 4096
PER_LANGUAGE = 300
LANDMARKS = 128
RIDGE = 1.0
SHARPNESS = 6.0
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SLICE = 1 << 20


def presence(text: str) -> np.ndarray:
    """Presence bits of the n-grams of one to three bytes of a text, lower-cased and with single spaces."""
    raw = f" {' '.join(text.lower().split())} ".encode()
    seen = np.zeros(WIDTH, bool)
    for at in range(0, len(raw), _SLICE):
        b = np.frombuffer(raw, np.uint8, min(_SLICE + 2, len(raw) - at), at).astype(np.uint32)
        seen[b] = True
        two = (b[:-1] << np.uint32(8)) + b[1:]
        seen[256 + (two * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(WIDTH // 4)] = True
        three = (two[:-1] << np.uint32(8)) + b[2:]
        seen[256 + WIDTH // 4 + (three * np.uint32(2246822519) >> np.uint32(12)) % np.uint32(WIDTH - WIDTH // 4 - 256)] = True
    return seen


def _unit(rows: np.ndarray) -> np.ndarray:
    """Presence rows of length one, so that a product of two is the kernel."""
    rows = rows.astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # unit presence rows
    weights: np.ndarray  # landmarks x languages, Nyström's map folded in
    offset: np.ndarray

    def score(self, seen: np.ndarray) -> np.ndarray:
        """Shares over the languages, one row per text."""
        margins = SHARPNESS * (_unit(seen) @ self.landmarks.T @ self.weights + self.offset)
        margins = np.exp(margins - margins.max(axis=1, keepdims=True))
        return margins / margins.sum(axis=1, keepdims=True)


def fit(seen: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Landmarks are taken from the languages in turn; rows come in a fixed order."""
    names = sorted(set(langs))
    if not names:
        return None
    codes = np.array([names.index(x) for x in langs])
    rows = _unit(seen)
    turn = sorted(range(len(codes)), key=lambda i: (int((codes[:i] == codes[i]).sum()), codes[i]))
    marks = rows[turn[:max(landmarks, len(names))]]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-8 * values.max(initial=1e-30)
    to_space = vectors[:, kept] / np.sqrt(values[kept])
    space = (rows @ marks.T) @ to_space
    centre = space.mean(axis=0)
    aims = np.where(codes[:, None] == np.arange(len(names)), 1.0, -1.0)
    # Each language counts alike, however many texts it has.
    weight = (1 / np.bincount(codes, minlength=len(names)))[codes][:, None] * len(codes) / len(names)
    middle = (aims * weight).mean(axis=0)
    x = space - centre
    solved = np.linalg.solve(x.T @ (x * weight) + ridge * np.eye(x.shape[1]), x.T @ ((aims - middle) * weight))
    return Model(names, marks, (to_space @ solved).astype(np.float32), (middle - centre @ solved).astype(np.float32))


def _seen(rows: DataFrame) -> DataFrame:
    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            bits = [np.packbits(presence(t.as_py())).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])

    return rows.mapInArrow(batches, "doc_id bigint, lang string, bits binary")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, held_out: tuple[int, int] = (4, 2)) -> Model | None:
    """A model from documents with a language whose crc32(id) modulo ``held_out[0]`` is not ``held_out[1]``."""
    modulus, left_out = held_out
    known = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string"))
    known = known.filter((id_bucket("doc_id", modulus) != left_out) & F.col("lang").isNotNull())
    picked = bounded_sample(known.filter("text is not null").select("doc_id", "lang"), "doc_id", "lang", per_language)
    # The picked ids are per_language times the languages at most. Repeated ids come once.
    rows = known.filter("text is not null").join(F.broadcast(picked.distinct()), ["doc_id", "lang"], "left_semi")
    got = bounded_sample(_seen(rows), "doc_id", "lang", per_language).collect()
    got = sorted((r.lang, r.doc_id is not None, r.doc_id or 0, bytes(r.bits)) for r in got)
    if not got:
        return None
    seen = np.unpackbits(np.frombuffer(b"".join(g[3] for g in got), np.uint8).reshape(len(got), -1), axis=1)
    return fit(seen, [g[0] for g in got])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``_lang`` and ``_score`` added; other columns pass through.

    Where ``docs`` has such columns of its own, the new ones get one more underscore.
    """
    added = [free_name(docs, "_lang"), free_name(docs, "_score")]
    names = [*docs.columns, *added]
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in given:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = [t if t and model and _LETTER.search(t) else None for t in batch.column("text").cast(pa.string()).to_pylist()]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if t is not None]
                if known:
                    shares = model.score(np.stack([presence(texts[i]) for i in known]))
                    best = shares.argmax(axis=1)
                    score[known] = shares[np.arange(len(known)), best]
                    for i, k in zip(known, best):
                        lang[i] = model.languages[k]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang), pa.array(score)], names=names)

    return docs.mapInArrow(batches, schema)


def keep_known(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The documents whose language is found, with at least ``min_score``, in the columns of ``docs``."""
    found = predict(docs, train(docs))
    lang, score = found.columns[-2:]
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
