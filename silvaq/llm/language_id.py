"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

Subwords are runs of 1 to 4 UTF-8 bytes of the lower-cased text (letters and word gaps; digits and ASCII signs count as gaps),
hashed into a table of embeddings. A document is the mean of its subwords' embeddings. Since mean and output layer are linear,
scoring uses the product of both tables: a row of class scores per hash bucket. A temperature, fitted on a part of the sample
that training does not see, calibrates the probabilities, and the lowest probability at which accepted predictions are right
often enough becomes the limit of rejection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import leaving_nothing, release, remainder
from .samples import sample

BUCKETS, DIMENSIONS, LONGEST = 1 << 15, 16, 4
#: Documents that training uses: of each language, and in all (see samples.py for more languages than MOST / PER_LANGUAGE).
PER_LANGUAGE, MOST = 1000, 8000
#: Bytes scored at once; a longer text is scored in pieces of this size that overlap by a subword.
PIECE = 1 << 20

UNKNOWN = "und"
_GAP = bytes(i if i >= 0x80 or chr(i).isalpha() else 0x20 for i in range(256))
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def _clean(text: str) -> bytes:
    """Padded bytes: one gap before, LONGEST after, so that no subword of the text reaches the next one."""
    return b" " + text.lower().encode("utf-8", "surrogatepass").translate(_GAP) + b" " * LONGEST


def _buckets(data: np.ndarray) -> np.ndarray:
    """Hash buckets of the subwords that begin at each byte, a row for each length."""
    n = len(data) - LONGEST + 1
    a = data.astype(np.uint32) + np.uint32(1)
    out, key = np.empty((LONGEST, n), dtype=np.int32), np.zeros(n, dtype=np.uint32)
    for k in range(LONGEST):
        key = (key ^ a[k : k + n]) * _MULTIPLIERS[k]
        key ^= key >> np.uint32(15)
        out[k] = (key * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int32)
    return out


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(_clean(text), np.uint8)
    found, counts = np.unique(_buckets(data), return_counts=True)
    return found, (counts / counts.sum()).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        """Class scores of each text; a text's result does not depend on the others."""
        out = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            data, at, total = np.frombuffer(_clean(text), np.uint8), 0, 0
            n = len(data) - LONGEST + 1
            while at < n:
                ids = _buckets(data[at : min(at + PIECE, n) + LONGEST - 1])
                out[i] += np.bincount(ids.ravel(), minlength=BUCKETS).astype(np.float32) @ self.scores if ids.size > BUCKETS else self.scores[ids.ravel()].sum(0)
                total += ids.size
                at += PIECE
            out[i] = out[i] / max(total, 1) + self.bias
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, calibrated probability) of each text; 'und' and 0 without letters."""
        known = [t if has_letter(t) else None for t in texts]
        chances = softmax(self.logits([t or "" for t in known]) / self.temperature)
        best = chances.argmax(1)
        return [UNKNOWN if t is None else self.languages[b] for t, b in zip(known, best, strict=True)], np.where([t is None for t in known], 0.0, chances[np.arange(len(best)), best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[str, str]], *, epochs: int = 6, rate: float = 20.0, right: float = 0.99, seed: int = 1) -> Model:
    """A model of (text, language) rows; each fifth row is kept for calibration. right: share that accepted predictions should reach."""
    languages = sorted({y for _, y in rows})
    if not languages:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    index = {y: i for i, y in enumerate(languages)}
    rows = [(t, index[y]) for t, y in rows if has_letter(t)]
    train, kept = [r for i, r in enumerate(rows) if i % 5 != 4], [r for i, r in enumerate(rows) if i % 5 == 4]
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    bags = [(*_bag(t), y) for t, y in train]
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for i in rng.permutation(len(bags)):
            ids, weights, y = bags[i]
            mean = weights @ e[ids]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= step * 0.05 * np.outer(mean, p)
            b -= step * 0.001 * p
            e[ids] -= step * weights[:, None] * back
    model = Model(languages, e @ w, b.astype(np.float64))
    if kept:
        z, y = model.logits([t for t, _ in kept]), np.array([y for _, y in kept])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        chances = softmax(z / model.temperature)
        top, hit = chances.max(1), chances.argmax(1) == y
        order = np.argsort(-top)
        good = np.cumsum(hit[order]) / np.arange(1, len(y) + 1) >= right
        model.limit = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def identify(docs: DataFrame, *, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted. Learns from rows whose crc32(doc_id) modulo `modulus` is not `held`.

    Null text and texts without a letter: und, score 0, not accepted. Null doc_id: held_out is null and the row is not learned
    from. Null lang: not learned from. If nothing can be learned, all rows are und. Repeated rows are scored each; without rows
    the result is empty; other columns are ignored.
    """
    held_out = (remainder(F.col("doc_id"), modulus) == held).alias("held_out")
    rows = sample(docs.select("doc_id", "text"), docs.where(~held_out).select("doc_id", F.col("lang").alias("label")), PER_LANGUAGE, MOST)
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))
    release()

    def task(batches):
        m = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, chances = m.predict(part.column(2).to_pylist())
                ok = [n != UNKNOWN and c >= m.limit for n, c in zip(names, chances, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(chances, pa.float64()), pa.array(ok)], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text").mapInArrow(leaving_nothing(task), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
