"""Language ID by a string kernel.

The kernel of two texts is the cosine of their blended spectra: presence of runs of one, two and three bytes (A-Z lower-cased, every
ASCII character that is no letter read as a blank), hashed to 2**BITS flags. Nyström landmarks turn it into features:
K(x, landmarks) K(landmarks, landmarks)^-1/2, on which kernel ridge regression separates each language from the rest.
Scoring is one product of a batch's flags with the landmarks' and one with the weights; a batch has at most ROWS documents, as each takes 2**BITS flags. It
learns from at most ``per_language`` rows of each language and about ``most`` in all, the smallest hashes of doc_id within up to 64 hash chunks; with more than
``most`` languages only those of that many rows are learned.

Nulls and edge cases: a null text, or one without a letter, is ``und`` with score 0; a null lang teaches nothing; rows
with a null doc_id take no part; where there is nothing to learn from, all is ``und``. Of equal scores the first language in
alphabetical order counts. Repeated rows get a row each, with equal predictions. Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import Slice, learns, map_slices
from lodestone.llm.textops import LOWER, mix

BITS, ROWS = 13, 256
_READ = LOWER.copy()
_READ[:128][~np.isin(np.arange(128), [*range(65, 91), *range(97, 123)])] = 32


def presence(part: Slice) -> np.ndarray:
    """(documents, 2**BITS) flags of the runs of bytes that each text has."""
    out = np.zeros((len(part), 1 << BITS), bool)
    flat, read = out.ravel(), _READ[part.buf]
    row = np.repeat(np.arange(len(part)) << BITS, np.diff(part.offsets))
    code = np.zeros(len(read), np.uint64)
    for n in (1, 2, 3):
        if len(read) < n:
            break
        code = (code[: len(read) - n + 1] << np.uint64(8)) | read[n - 1 :]
        same = row[: len(code)] == row[n - 1 :]
        flat[row[: len(code)][same] + (mix(code[same] + np.uint64(n << 40)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return out


def has_letter(part: Slice) -> np.ndarray:
    plain = np.concatenate([[0], np.cumsum((_READ[part.buf] != 32) & (part.buf < 128))])
    high = np.concatenate([[0], np.cumsum(part.buf >= 128)])
    out = plain[part.offsets[1:]] > plain[part.offsets[:-1]]
    for i in np.flatnonzero(~out & (high[part.offsets[1:]] > high[part.offsets[:-1]])):
        out[i] = any(c.isalpha() for c in part.text(i).decode("utf-8", "replace"))
    return out


class Kernel:
    """Landmark flags and the weights of their kernel values, one column for each language."""

    def __init__(self, languages: list[str], marks: np.ndarray, weights: np.ndarray):
        self.languages, self.weights = languages, weights
        self.marks = np.ascontiguousarray((marks / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]).T.astype(np.float32))

    def values(self, flags: np.ndarray) -> np.ndarray:
        return (flags.astype(np.float32) @ self.marks / np.sqrt(np.maximum(flags.sum(1), 1))[:, None]).astype(np.float64)

    def predict(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self.values(flags) @ self.weights
        return out.argmax(1), np.clip((1 + out.max(1)) / 2, 0, 1)


def fit(flags: np.ndarray, langs: list[str], landmarks: int = 96, ridge: float = 1e-3) -> Kernel | None:
    """Landmarks are taken from the languages in turn."""
    languages = sorted(set(langs))
    if not languages:
        return None
    code = np.array([languages.index(x) for x in langs])
    turn = np.empty(len(code), np.int64)
    for k in range(len(languages)):
        turn[code == k] = np.arange((code == k).sum())
    chosen = np.lexsort((code, turn))[:landmarks]
    kernel = Kernel(languages, flags[chosen].astype(np.float32), np.zeros((len(chosen), len(languages))))
    value, vector = np.linalg.eigh(kernel.values(flags[chosen]))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    x = np.concatenate([kernel.values(flags[a : a + 512]) for a in range(0, len(flags), 512)]) @ root
    y = np.where(code[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = (len(code) / len(languages) / np.bincount(code, minlength=len(languages)))[code][:, None]
    kernel.weights = root @ np.linalg.solve((x * balance).T @ x + ridge * len(code) * np.eye(x.shape[1]), (x * balance).T @ y)
    return kernel


def learn(docs: DataFrame, of: int = 4, held_out: int = 2, per_language: int = 1_024, most: int = 16_384, **how) -> Kernel | None:
    """Fits the kernel on the driver to a bounded sample (1 kB of flags for each text), which Spark makes."""
    ids = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).where(learns(of, held_out)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("y"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    per = max(1, min(per_language, most // max(1, ids.agg(F.count_distinct("y")).first()[0])))
    chunks = min(64, per)
    order = Window.partitionBy("y", F.pmod("h", F.lit(chunks))).orderBy("h", "doc_id")
    sample = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per // chunks).orderBy("n", "h", "doc_id").limit(most).select("doc_id", "y")
    # at most ``most`` pairs: small enough to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")

    def make():
        def each(part: Slice) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array([np.packbits(f).tobytes() for f in presence(part)], pa.binary())], ["doc_id", "flags"])

        return each

    rows = map_slices(texts, make, "doc_id long, flags binary", rows=ROWS).join(F.broadcast(sample), "doc_id").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    flags = np.array([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)) for x in rows["flags"]], bool).reshape(-1, 1 << BITS)
    return fit(flags, rows["y"].to_pylist(), **how)


def identify(docs: DataFrame, kernel: Kernel | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(kernel)

    def make():
        kernel = sent.value

        def each(part: Slice) -> pa.RecordBatch:
            known = has_letter(part) if kernel is not None else np.zeros(len(part), bool)
            at, score = kernel.predict(presence(part)) if kernel is not None else (np.zeros(len(part), int), np.zeros(len(part)))
            names = [kernel.languages[k] if ok else "und" for k, ok in zip(at, known, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

        return each

    return map_slices(docs, make, "doc_id long, lang_pred string, score double", rows=ROWS)
