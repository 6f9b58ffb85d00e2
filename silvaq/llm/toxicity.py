"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores and offsets.

Labels are of documents, so tokens are labelled first: a hashed feature of a word (the word, its beginnings, its end) is a
marker if it is far more frequent in toxic documents of the sample than in others, and a token of a toxic document is labelled
1 if it has a marker. The field (two tags; weights of hashed word features, of tag pairs and of the first tag) is trained on pieces of the
sample by its exact likelihood gradient. Forward-backward gives each token's marginal in the whole document; a logistic function
of the marginals, fitted on part of the sample that the field does not see, gives the score.

Both passes go over sequences cut in segments: first what each segment does to the odds that enter it, then the odds at the segments' ends,
one segment after another, then the odds inside all segments side by side. So a long document costs as many steps as it has segments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import leaving_nothing, release, remainder
from .samples import sample
from .shingles import Words, mix, pieces_of

#: Rows that training uses: of each label, and in all.
PER_LABEL, MOST = 2500, 5000
BITS = 18
BUCKETS = 1 << BITS
#: Tokens in a training sequence at most, and in a segment.
SEQUENCE, SEGMENT = 48, 64
#: Tokens that are scored together, at least a text's, and that training looks at at once.
TOGETHER, SHARE = 500_000, 1 << 17
#: Scores of a token, and log odds, beyond which nothing changes.
FAR = 30.0
_EDGE = np.zeros(256, bool)
_EDGE[[*range(0x21, 0x30), *b":;<=>?@[\\]^_`{|}~"]] = True
_WHOLE, _FIRST, _LAST = (np.uint64(k) for k in (0x51ED270B7A1F3C69, 0x2545F4914F6CDD1D, 0x6C62272E07BB0142))


def features(words: Words, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, a feature's hash bucket of each) of the words at start to end: the word without signs around it, its beginnings of 3 to 12 bytes and its last 4 bytes."""
    solid = np.append(np.flatnonzero(~_EDGE[words.data]), len(words.data))
    a = np.minimum(solid[np.searchsorted(solid, start)], end)
    last = np.searchsorted(solid, end) - 1
    b = np.maximum(np.where(last >= 0, solid[last] + 1, 0), a)
    size = b - a
    every = np.arange(len(start))
    bucket = lambda i, j, salt: (mix(words.hashes(i, j) ^ salt) >> np.uint64(64 - BITS)).astype(np.int64)
    out = [(every, bucket(np.minimum(a, len(words.data) - 1), np.where(size > 0, b, np.minimum(a, len(words.data) - 1)), _WHOLE))]
    for k in range(3, 13):
        k_long = every[size >= k]
        out.append((k_long, bucket(a[k_long], a[k_long] + k, _FIRST)))
    k_long = every[size > 4]
    out.append((k_long, bucket(b[k_long] - 4, b[k_long], _LAST)))
    return out


def _read(texts: list[str | None]):
    """(hashes of the distinct words, their features, place of each word among these, text of each word) of the pieces of texts; features: a function of the words wanted."""
    for places, piece in pieces_of(texts):
        words = Words(piece)
        if len(words.start):
            hashes, first, at = np.unique(words.hashes(words.start, words.end), return_index=True, return_inverse=True)
            numbers, begins = np.array(places).T
            yield hashes, lambda k, w=words, f=first: features(w, w.start[f[k]], w.end[f[k]]), at, numbers[np.searchsorted(begins, words.start, side="right") - 1]


def marginal_odds(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float) -> np.ndarray:
    """Log odds of tag 1 at each token of sequences that follow one another.

    emission: a token's score of tag 1 less that of tag 0. trans[i, j]: weight of tag i followed by tag j. start: of the first tag 1.
    """
    return np.log(np.prod(_passes(emission, lengths, trans, start), axis=0))


def _passes(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """The odds of tag 1 at each token by all before it and itself, and by all behind it."""
    x = np.exp(np.clip(emission, -FAR, FAR))
    ahead, behind = np.ones(len(x)), np.ones(len(x))
    lengths = np.asarray(lengths, np.int64)
    if not len(x):
        return ahead, behind
    t = np.exp(trans - trans.max())
    (t00, t01), (t10, t11) = t
    count = -(-lengths // SEGMENT)
    of = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(lengths) - lengths)[of] + place * SEGMENT
    size = np.minimum(lengths[of] - place * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, SEGMENT + 1), side="right")  # segments of at least 1, 2, ... tokens
    begin_in_order = begin[order]
    # What the segments of long sequences do: matrices, from the odds at the end before them to those at their own end.
    enter, leave = np.full(len(of), np.exp(start)), np.ones(len(of))
    many = count[of] > 1
    if many.any():
        m = np.empty((4, len(of)))
        inner = order[many[order]]
        m[:, inner] = t.reshape(4, 1)
        m[0, inner[place[inner] == 0]] = m[3, inner[place[inner] == 0]] = 1
        m[1, inner[place[inner] == 0]] = m[2, inner[place[inner] == 0]] = 0
        left = np.searchsorted(-size[inner], -np.arange(1, SEGMENT + 1), side="right")
        for k in range(SEGMENT):
            i = inner[: left[k]]
            if not len(i):
                break
            a, b, c, d = m[:, i]
            if k:
                a, b, c, d = a * t00 + b * t10, a * t01 + b * t11, c * t00 + d * t10, c * t01 + d * t11
            e = x[begin[i] + k]
            b, d = b * e, d * e
            total = a + b + c + d
            m[:, i] = a / total, b / total, c / total, d / total
        # Along the sequences, the longest first: one step for each segment.
        long = np.flatnonzero(count > 1)
        long = long[np.argsort(-count[long], kind="stable")]
        first = (np.cumsum(count) - count)[long]
        odds = np.full(len(long), np.exp(start))
        for k in range(int(count.max()) - 1):
            n = int(np.searchsorted(-count[long], -(k + 1), side="left"))  # those with a further segment
            a, b, c, d = m[:, first[:n] + k]
            odds = (b + odds[:n] * d) / (a + odds[:n] * c)
            enter[first[:n] + k + 1] = odds
        back = np.ones(len(long))
        for k in range(int(count.max()) - 1, 0, -1):
            n = int(np.searchsorted(-count[long], -k, side="left"))
            a, b, c, d = m[:, first[:n] + k]
            back[:n] = (c + back[:n] * d) / (a + back[:n] * b)
            leave[first[:n] + k - 1] = back[:n]
    head = place[order] == 0
    r = enter[order]
    for k in range(SEGMENT):
        n = live[k]
        if not n:
            break
        at = begin_in_order[:n] + k
        moved = (t01 + r[:n] * t11) / (t00 + r[:n] * t10)
        r = (np.where(head[:n], r[:n], moved) if k == 0 else moved) * x[at]
        ahead[at] = r
    back = leave[order]
    for k in range(SEGMENT - 1, -1, -1):
        n = live[k]
        if not n:
            continue
        at = begin_in_order[:n] + k
        behind[at] = back[:n]
        q = back[:n] * x[at]
        back[:n] = (t10 + q * t11) / (t00 + q * t01)
    return ahead, behind


def likelihood(emission: np.ndarray, lengths: np.ndarray, tags: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The slope of the negative log-likelihood of tags: by each token's score, by trans and by start."""
    ahead, behind = _passes(emission, lengths, trans, start)
    odds = ahead * behind
    p = odds / (1 + odds)
    inner = np.ones(len(tags), bool)
    inner[np.cumsum(lengths)[np.asarray(lengths) > 0] - 1] = False
    i = np.flatnonzero(inner)
    x = np.exp(np.clip(emission, -FAR, FAR))
    (t00, t01), (t10, t11) = np.exp(trans - trans.max())
    r, q = ahead[i], x[i + 1] * behind[i + 1]
    pairs = np.array([t00 + 0 * r, t01 * q, r * t10, r * t11 * q])
    expected = (pairs / pairs.sum(0)).sum(1)
    seen = np.bincount((tags[i] * 2 + tags[i + 1]).astype(int), minlength=4)
    firsts = (np.cumsum(lengths) - lengths)[np.asarray(lengths) > 0]
    return p - tags, (expected - seen).reshape(2, 2), float((p - tags)[firsts].sum())


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    start: float
    head: np.ndarray  # of summary(), last the constant

    def emissions(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all tokens of texts, and the texts' numbers of tokens."""
        out, lengths = [np.zeros(0)], np.zeros(len(texts), np.int64)
        for hashes, found, at, of in _read(texts):
            each = np.zeros(len(hashes))
            for i, bucket in found(slice(None)):
                each[i] += self.weights[bucket]
            out.append(each[at])
            lengths += np.bincount(of, minlength=len(texts))
        return np.concatenate(out), lengths

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of all tokens, and the texts' numbers of tokens."""
        emission, lengths = self.emissions(texts)
        return marginal_odds(emission, lengths, self.trans, self.start), lengths

    def score(self, odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(odds, lengths) @ self.head, -40, 40)))


def summary(odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a document's score is a function of: its strongest tag, its expected toxic tokens and their share."""
    out = np.zeros((len(lengths), 4))
    out[:, 0], out[:, 3] = -8, 1
    full = np.flatnonzero(lengths)
    if len(full):
        at = (np.cumsum(lengths) - lengths)[full]
        p = np.add.reduceat(1 / (1 + np.exp(-np.clip(odds, -FAR, FAR))), at)
        out[full, 0] = np.clip(np.maximum.reduceat(odds, at), -8, 8)
        out[full, 1], out[full, 2] = np.log1p(p), (p / lengths[full]) ** 0.5
    return out


def _markers(rows: list[np.ndarray], y: np.ndarray, odds: float, least: int, cover: int = 4) -> np.ndarray:
    """Features that explain the toxic rows: far more frequent there than in others, chosen by greedy cover.

    A row is explained once `cover` markers are in it, and a marker must be in `least` rows that are not explained yet. So words
    that toxic documents merely share, as copies do, are no markers. rows: each row's distinct features.
    """
    seen = np.zeros((2, BUCKETS))
    for ids, label in zip(rows, y, strict=True):
        seen[label, ids] += 1
    rate = (seen + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1)
    able = (rate[1] > odds * rate[0]) & (seen[1] >= least)
    toxic = [ids[able[ids]] for ids, label in zip(rows, y, strict=True) if label]
    gain = np.bincount(np.concatenate(toxic), minlength=BUCKETS) if toxic else np.zeros(BUCKETS, int)
    missing, chosen = np.full(len(toxic), cover), np.zeros(BUCKETS, bool)
    while True:
        best = int(gain.argmax())
        if gain[best] < least:
            return chosen
        chosen[best] = True
        gain[best] = 0
        for i, ids in enumerate(toxic):
            if missing[i] and best in ids:
                missing[i] -= 1
                if not missing[i]:
                    gain[ids] -= 1


def _shares(lengths: np.ndarray):
    """(first token, last token, lengths) of sequences that follow one another, about SHARE tokens at a time."""
    ends = np.cumsum(lengths)
    cuts = [0, *np.searchsorted(ends, np.arange(SHARE, int(ends[-1]) if len(ends) else 0, SHARE)).tolist(), len(lengths)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield int(ends[i] - lengths[i]), int(ends[j - 1]), lengths[i:j]


def fit(rows: list[tuple[str, int]], *, rounds: int = 25, odds: float = 12.0, least: int = 6) -> Model:
    """A model of (text, 0 or 1) rows, which are used up. Each third row is kept from the field, for the logistic function."""
    y = np.array([int(v) for _, v in rows], dtype=np.int64)
    model = Model(np.zeros(BUCKETS), np.zeros((2, 2)), -4.0, np.array([0.0, 0, 0, -2.0]))
    if not len(rows) or y.min() == y.max():
        if len(rows):
            model.head[3] = 3.0 if y[0] else -3.0
        return model
    number, bucket, tokens, lengths, seen = [], [], [], np.zeros(len(rows), np.int64), np.zeros(0, np.uint64)
    known = seen  # sorted; seen: in the order of the words' numbers
    texts = [t for t, _ in rows]
    rows.clear()
    for hashes, found, at, text in _read(texts):
        new = np.flatnonzero(~np.isin(hashes, known, assume_unique=True))
        for i, k in found(new):
            number.append((i + len(seen)).astype(np.int32))
            bucket.append(k.astype(np.int32))
        seen = np.append(seen, hashes[new])
        known, order = np.sort(seen), np.argsort(seen)
        tokens.append(order[np.searchsorted(known, hashes)].astype(np.int32)[at])
        lengths += np.bincount(text, minlength=len(texts))
    use = np.arange(len(texts)) % 3 != 2
    del texts
    if not tokens:
        return model
    number, bucket, tokens, of = np.concatenate(number), np.concatenate(bucket), np.concatenate(tokens), len(seen)
    order = np.argsort(number, kind="stable")  # features by word
    number, bucket = number[order], bucket[order]
    ends = np.searchsorted(number, np.arange(of + 1))
    starts = np.cumsum(lengths) - lengths

    def distinct(i):
        w = np.unique(tokens[starts[i] : starts[i] + lengths[i]])
        n = ends[w + 1] - ends[w]
        return np.unique(bucket[np.repeat(ends[w] - np.cumsum(n) + n, n) + np.arange(n.sum())])

    marks = _markers([distinct(i) for i in np.flatnonzero(use)], y[use], odds, least)
    marked = np.zeros(of, bool)
    marked[number[marks[bucket]]] = True
    taught = np.repeat(use, lengths)
    gold = (marked[tokens] & np.repeat(y.astype(bool), lengths))[taught].astype(np.float32)
    flat, whole = tokens[taught], lengths[use]
    # Sequences are pieces of at most SEQUENCE tokens of each text.
    cuts = -(-whole // SEQUENCE)
    place = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    pieces = np.minimum(np.repeat(whole, cuts) - place * SEQUENCE, SEQUENCE)
    if not len(flat):
        return model
    # Weights of tag pairs and of the first tag start at observed log rates.
    rate = gold.mean()
    model.start = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    pairs = np.bincount((gold[:-1] * 2 + gold[1:]).astype(int), minlength=4).reshape(2, 2) + 0.5
    model.trans = np.log(pairs / pairs.sum(1, keepdims=True))
    weight, square, pair_square, start_square = model.weights, np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8), 1e-8

    def by_word() -> np.ndarray:
        """Each word's score: its features' weights."""
        return np.bincount(number, weight[bucket], of)

    for _ in range(rounds):
        score, of_word, pair_slope, start_slope = by_word(), np.zeros(of), np.zeros((2, 2)), 0.0
        for a, b, some in _shares(pieces):
            slope, pairs, first = likelihood(score[flat[a:b]], some, gold[a:b], model.trans, model.start)
            of_word += np.bincount(flat[a:b], slope, of)
            pair_slope, start_slope = pair_slope + pairs, start_slope + first
        slope = np.bincount(bucket, of_word[number], BUCKETS) + 0.02 * weight
        square += slope * slope
        weight -= 0.5 * slope / np.sqrt(square)
        pair_square += pair_slope * pair_slope
        model.trans = model.trans - 0.5 * pair_slope / np.sqrt(pair_square)
        start_square += start_slope * start_slope
        model.start -= 0.5 * start_slope / np.sqrt(start_square)
    score, rest, kept = by_word(), lengths[~use], tokens[~taught]
    x, target = np.concatenate([summary(marginal_odds(score[kept[a:b]], some, model.trans, model.start), some) for a, b, some in _shares(rest)]), y[~use]
    head = np.zeros(4)
    for _ in range(30):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(4) * 0.05
        head -= np.linalg.solve(h, x.T @ (p - target) + 0.05 * head)
    model.head = head
    return model


_RUN = re.compile(rb"[^\x20\x09-\x0D]+")


def spans_of(text: str, odds: np.ndarray, limit: float = 0.0) -> list[dict]:
    """Runs of tokens tagged toxic: start and end in code points (end exclusive) and the highest marginal."""
    hot = np.flatnonzero(odds > limit)
    if not len(hot):
        return []
    data, out, wanted, last = text.encode("utf-8", "surrogatepass"), [], set(hot.tolist()), -2
    chars, at = 0, 0
    for k, m in enumerate(_RUN.finditer(data)):
        if k not in wanted:
            continue
        chars += len(data[at : m.start()].decode("utf-8", "replace"))
        size = len(m[0].decode("utf-8", "replace"))
        p = float(1 / (1 + np.exp(-min(odds[k], 30))))
        if last == k - 1:
            out[-1] = {"start": out[-1]["start"], "end": chars + size, "p": max(p, out[-1]["p"])}
        else:
            out.append({"start": chars, "end": chars + size, "p": p})
        chars, at, last = chars + size, m.end(), k
    return out


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held: int = 2) -> Model:
    """A model of the labelled rows whose crc32(doc_id) modulo `modulus` is not `held`."""
    known = labels.where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), modulus) != held)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    model = fit(sample(docs.select("doc_id", "text"), docs.select("doc_id").join(known, "doc_id"), PER_LABEL, MOST))
    release()
    return model


def _tagged(batches, text_at: int, model: Model):
    """(rows, log odds of their tokens, their numbers of tokens); texts of TOGETHER tokens or less at a time, or one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 5 * TOGETHER, side="right")))  # a token and its gap have some 5 bytes
            part = batch.slice(at, n)
            at += n
            yield part, *model.tag(part.column(text_at).to_pylist())


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """All columns of docs (doc_id, text and others) and score, predicted, spans.

    Null and empty texts have no token and get the score of a text without any sign of toxicity; no spans. Repeated rows are
    scored each; without rows the result is empty. A column named score, predicted or spans is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted", "spans")
    text_at = docs.columns.index("text")

    def task(batches):
        m = shared.value
        for part, odds, lengths in _tagged(batches, text_at, m):
            chances = m.score(odds, lengths)
            found = [spans_of(t.as_py() or "", o) for t, o in zip(part.column(text_at), np.split(odds, np.cumsum(lengths)[:-1]), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(chances), pa.array((chances >= threshold).astype(np.int32)), pa.array(found, pa.list_(SPAN))], [*part.schema.names, "score", "predicted", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
    return docs.mapInArrow(leaving_nothing(task), schema)


def reject(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """docs without those that score `threshold` or more; columns stay. Null and empty texts stay unless such a text scores that much."""
    shared, schema, text_at = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index("text")

    def task(batches):
        for part, odds, lengths in _tagged(batches, text_at, shared.value):
            yield part.filter(pa.array(shared.value.score(odds, lengths) < threshold))

    return docs.mapInArrow(leaving_nothing(task), schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, modulus: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans, spans (start:end, comma-joined) of each document.

    Null doc_id: held_out is null. Null and empty texts score as texts without any sign of toxicity and have no spans; repeated rows are scored each.
    Without labels, or with labels of one value, all texts get one score; without rows the result is empty. Other columns are ignored.
    """
    model = train(docs, labels, modulus=modulus, held=held)
    scored = score(docs.select("doc_id", "text"), model, threshold=threshold)
    joined = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), joined.alias("spans"))
