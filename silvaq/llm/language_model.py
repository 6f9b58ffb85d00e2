"""LM scoring: an interpolated modified Kneser-Ney model of words, pairs and triples, counted in Spark, stored as sorted hash arrays.

The vocabulary is the sorted array of the hashes of all training words; a word's number is its place there. Pairs and triples of numbers are hashed
again, and a table of them is a sorted array of 46 bits of each hash: 32 bits, and an index by the 14 above. (A triple that was never seen is taken for
another about once in 20 million times; counting itself is exact.) Workers map these files side by side into memory and look up in all of them at once by
binary search, so that a lookup costs the same whatever the number of files; nothing of the model is sent to the driver but sums.

Counting: tasks count their own words or triples first and deal out sorted, packed runs by part; a part's runs are merged where they meet and
written as one file. Triples are dealt by their middle word v, so that all that is counted of them meets in one part: the triples, what follows (u, v), and
how many words precede (v, w). Triples of a middle word that is seen OFTEN are dealt by all three words, and their partial statistics are added up in
a second step, in fewer parts, since each part sends to each of these. There are as many parts as the texts have PART bytes, so that a part's size does not
follow the corpus; counts are as wide as they need. Numbers have 32 bits: 2^32 - 2 distinct words or more are an error.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Chain, bisect, save_arrays
from .common import filesystem, fresh_dir, leaving_nothing, remainder, stored
from .shingles import mix, word_hashes

#: The hash of the end token; no word has it but by chance.
END = np.uint64(0xD1B54A32D192ED03)
#: Tokens that are counted, and that are scored, together.
COUNTED, SCORED = 1 << 21, 1 << 19
#: Triples whose middle word is seen this often are dealt by all three words.
OFTEN = 1 << 20
#: Bytes of text that a part of the model is made for.
PART = 1 << 23
#: Partitions of a shuffle by parts, at most: beyond that a task takes several parts, one after the other.
PARTITIONS = 1 << 15
#: Parts whose partial statistics are added up together, and words whose statistics are in a file (2 to the power).
ADDED, SPAN = 4, 20
#: Files in a chain if they are mapped and if they are read, and chains that a worker keeps: Linux maps 65530 files for a process.
MAPPED, READ, CHAINS = 1 << 13, 64, 7
#: Bits of a hash by which a table's index goes.
INDEX = 14
#: What a run holds: words, triples of rare and of frequent middle words, contexts and pairs to be added up, statistics of words, a part's sums.
WORDS, RARE, HOT, CONTEXTS, PAIRS, STATISTICS, HEAD = range(7)
RUN = "kind int, part int, n long, widths string, data binary"
_RUN = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("widths", pa.string()), ("data", pa.binary())])


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows of sorted columns begins."""
    turn = np.zeros(len(columns[0]), bool)
    turn[:1] = True
    for c in columns:
        turn[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(turn)


def _sum(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys and the sums of values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys)
    keys = keys[order]
    first = _starts(keys)
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sum_triples(vu: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (vu, w) in their order, and sums."""
    pairs, place = np.unique(vu, return_inverse=True)
    keys, counts = _sum(_joined(place, w), counts)
    place, w = _halves(keys)
    return pairs[place], w, counts


def _stretches(parts: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of one value in sorted parts."""
    cuts = np.flatnonzero(np.diff(parts, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(parts)], strict=True)) if cuts else []


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)


def _pack(columns: list[np.ndarray]) -> tuple[int, str, bytes]:
    """(rows, widths, bytes) of columns; sorted first columns as differences, each column byte by byte of its values."""
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    columns = [c.astype(np.uint64) if c.dtype == np.uint64 else _narrow(c) for c in columns]
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes() for c in columns)
    return len(columns[0]), ",".join(str(c.itemsize) for c in columns), pa.compress(planes, "zstd", asbytes=True)


def _unpack(n: int, widths: str, data: bytes) -> list[np.ndarray]:
    """The columns of _pack: the first as it was, the others as int64."""
    sizes = [int(w) for w in widths.split(",")]
    planes, at, out = np.frombuffer(pa.decompress(data, n * sum(sizes), "zstd", asbytes=True), np.uint8), 0, []
    for w in sizes:
        out.append(np.ascontiguousarray(planes[at : at + n * w].reshape(w, n).T).view(f"<u{w}").reshape(n))
        at += n * w
    return [np.cumsum(out[0], dtype=np.uint64), *(c.astype(np.int64) for c in out[1:])]


def _runs(kind: int, parts: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A record batch of packed runs, a row for each part that rows (sorted by the first column) fall in."""
    order = np.argsort(parts, kind="stable")
    rows = []
    for a, b in _stretches(parts[order]):
        k = order[a:b]
        rows.append((kind, int(parts[k[0]]), *_pack([c[k] for c in columns])))
    return _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_RUN)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _RUN, strict=True)], schema=_RUN)


def _each(table: pa.Table, kind: int):
    """The columns of each run of a kind."""
    for k, n, w, d in zip(*(table[c].to_pylist() for c in ("kind", "n", "widths", "data")), strict=True):
        if k == kind:
            yield _unpack(n, w, d)


def _columns(table: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    """The columns of all runs of a kind, one after the other."""
    found = list(_each(table, kind))
    if not found:
        return [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * (width - 1)]
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _added(table: pa.Table, kind: int, width: int) -> tuple[np.ndarray, ...]:
    """Distinct keys and sums of all runs of a kind, not many more rows than these in memory."""
    held, rows, most = [], 0, COUNTED // 4
    for run in _each(table, kind):
        held.append(run)
        rows += len(run[0])
        if rows > most:
            held = [_sum(*(np.concatenate(c) for c in zip(*held, strict=True)))]
            rows = len(held[0][0])
            most = max(most, 2 * rows)
    return _sum(*(np.concatenate(c) for c in zip(*held, strict=True))) if held else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * (width - 1))


def table_of(name: str, hashes: np.ndarray, **values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a table: hashes in their order, values in bytes; values of 255 or more apart."""
    bits = hashes & np.uint64((1 << (32 + INDEX)) - 1)
    order = np.argsort(bits)
    bits = bits[order]
    out = {f"{name}.index": np.searchsorted(bits, np.arange((1 << INDEX) + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int64), f"{name}.low": (bits & np.uint64(0xFFFFFFFF)).astype(np.uint32)}
    for key, v in values.items():
        v = v[order]
        big = np.flatnonzero(v >= 255)
        out |= {f"{name}.{key}": np.minimum(v, 255).astype(np.uint8), f"{name}.{key}.at": big, f"{name}.{key}.big": v[big]}
    return out


def look_up(files: Chain | dict[str, np.ndarray], name: str, hashes: np.ndarray, *keys: str, place: np.ndarray | None = None) -> list[np.ndarray]:
    """The values of hashes, 0 for those that are not there. place: which of the files each is looked up in, the only one if None."""
    files = files if isinstance(files, Chain) else Chain.of(files)
    place = np.zeros(len(hashes), np.int64) if place is None else place
    here = np.flatnonzero(files.n[f"{name}.low"][place]) if f"{name}.low" in files.n else np.zeros(0, np.int64)
    out = [np.zeros(len(hashes), np.int64) for _ in keys]
    if not len(here):
        return out
    low, starts = files.whole(f"{name}.low")
    want, bucket = (hashes[here] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes[here] >> np.uint64(32) & np.uint64((1 << INDEX) - 1)).astype(np.int64)
    place, start = place[here], starts[place[here]]
    last = files.take(f"{name}.index", place, bucket + 1) + start
    first = bisect(low, want, files.take(f"{name}.index", place, bucket) + start, last)
    hit = np.flatnonzero((first < last) & (low[np.minimum(first, len(low) - 1)] == want))
    place, at, here = place[hit], (first - start)[hit], here[hit]
    for key, found in zip(keys, out, strict=True):
        v = files.take(f"{name}.{key}", place, at).astype(np.int64)
        big = np.flatnonzero(v == 255)
        if len(big):
            places, starts = files.whole(f"{name}.{key}.at")
            first, of = starts[place[big]], place[big]
            v[big] = files.take(f"{name}.{key}.big", of, bisect(places, at[big], first, first + files.n[f"{name}.{key}.at"][of]) - first)
        found[here] = v
    return out


@functools.lru_cache(maxsize=CHAINS)
def _chain(uri: str, kind: str, first: int, end: int, there: frozenset[int]) -> Chain:
    return Chain.load(uri, [f"{kind}-{p}" if p in there else None for p in range(first, end)])


@functools.lru_cache(maxsize=4)
def _most(uri: str) -> int:
    return MAPPED if filesystem(uri)[0].type_name == "local" else READ


def _chained(uri: str, kind: str, there: frozenset[int], files: np.ndarray):
    """(slice, chain, places in it) of sorted numbers of files that are there. One chain has them all up to MAPPED of them, or, on file systems that cannot be mapped, READ."""
    most = _most(uri)
    for a, b in _stretches(files // most):
        first = int(files[a]) // most * most
        yield slice(a, b), _chain(uri, kind, first, min(first + most, max(there) + 1), there), files[a:b] - first


@dataclass(frozen=True)
class Model:
    """What the driver knows of a model: where its files are, and sums."""

    uri: str
    parts: int
    sizes: tuple[int, ...]  # words of each part of the vocabulary
    words: int  # V
    tokens: int  # N
    docs: int
    order: int
    often: int  # triples of middle words that are seen so often are dealt by all three words
    discounts: tuple[tuple[float, float, float], ...]  # of words, pairs, triples
    pairs: int  # distinct
    word_levels: tuple[int, int, int]  # words with 1, 2, 3 or more distinct words before them
    files: frozenset[int]  # parts that have triples
    hot_files: frozenset[int]  # those that have what was added up, of hot_parts
    spans: frozenset[int]  # ranges of numbers that have statistics
    hot_parts: int


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of items seen 1 to 4 times."""
    if not n[0]:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for k in range(3):
        d = k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2
        out.append(min(max(d, 0.0), k + 1.0))
    return tuple(out)


def _levels(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts >= 3).sum())]


class Vocabulary:
    """The mapped vocabulary: numbers of hashes, -1 for unknown ones."""

    def __init__(self, uri: str, parts: int, sizes: tuple[int, ...]):
        self.uri, self.parts, self.sizes = uri, parts, sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.there = frozenset(p for p, n in enumerate(sizes) if n)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each hash."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        part = _part(distinct, self.parts)  # rises with the hash
        known = np.flatnonzero(np.diff(self.starts)[part])
        for k, files, place in _chained(self.uri, "words", self.there, part[known]):
            k = known[k]
            data, starts = files.whole("hashes")
            first, n = starts[place], files.n["hashes"][place]
            at = np.minimum(bisect(data, distinct[k], first, first + n) - first, n - 1)
            hit = data[first + at] == distinct[k]
            number[k] = np.where(hit, at + self.starts[part[k]], -1)
            count[k] = np.where(hit, files.take("counts", place, at).astype(np.int64), 0)
        return number[back], count[back]


@functools.lru_cache(maxsize=1)
def _vocabulary(uri: str, parts: int, sizes: tuple[int, ...]) -> Vocabulary:
    return Vocabulary(uri, parts, sizes)


def _groups(batches, column: int, most: int):
    """(record batch slice, hashes, lengths) of rows with about `most` tokens."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            first, each, n = at, [], 0
            while at < batch.num_rows and (n < most or at == first):
                each.append(np.append(word_hashes(batch.column(column)[at].as_py()), END))
                n += len(each[-1])
                at += 1
            yield batch.slice(first, at - first), np.concatenate(each), np.array([len(e) for e in each], np.int64)


def _before(numbers: np.ndarray, lengths: np.ndarray, *starts: int) -> np.ndarray:
    """What is as many places before each token as there are starts; those stand for what precedes a text, the first for the first token."""
    k = len(starts)
    out = np.empty_like(numbers)
    out[k:] = numbers[: len(numbers) - k]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    for i, start in enumerate(starts):
        out[first[lengths > i] + i] = start
    return out


def _pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(_joined(x, y))


def _triple_hash(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(_pair_hash(u, v) + mix(w.astype(np.uint64) + np.uint64(1)))


def _triple_parts(u, v, w, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part that has a triple: by its middle word, or by all if that is frequent."""
    return _part(np.where(hot, _triple_hash(u, v, w), mix(v.astype(np.uint64))), parts)


def _contexts(vu: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct vu, and of their triples the sum and how many are seen 1, 2, 3 or more times. Sorted by vu."""
    first = _starts(vu)
    if not len(first):
        return vu, *[counts] * 4
    return vu[first], np.add.reduceat(counts, first), *(np.add.reduceat((np.minimum(counts, 3) == k).astype(np.int64), first) for k in (1, 2, 3))


def _word_statistics(vw: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    """Statistics of words as runs, from pairs and their counts: the key is the word and what is counted: pairs that end in it, the sum of those that begin with it, and how
    many of these count 1, 2, 3 or more."""
    v, w = (x.astype(np.uint64) << np.uint64(3) for x in _halves(vw))
    keys, n = _sum(np.concatenate([w, v | np.uint64(1), v | (np.minimum(a, 3) + 1).astype(np.uint64)]), np.concatenate([np.ones(len(a), np.int64), a, np.ones(len(a), np.int64)]))
    return _runs(STATISTICS, (keys >> np.uint64(3 + SPAN)).astype(np.int64), keys, n)


def train(docs: DataFrame, order: int = 3) -> Model:
    """Counts the texts of docs and writes the model to the shared folder. order: 2 (words and pairs) or 3 (triples, too)."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark: SparkSession = docs.sparkSession
    uri = fresh_dir(spark, "lm")
    texts = docs.select("text")
    parts = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART))
    often, hot_parts = OFTEN, -(-parts // ADDED)
    by_part = lambda df: df.repartition(min(parts, PARTITIONS), "part").groupBy("part")  # noqa: E731  # a number of partitions that follows the texts

    def count_words(batches):
        held = []
        for _, hashes, _lengths in _groups(batches, 0, COUNTED):
            held.append(np.unique(hashes, return_counts=True))
            if sum(len(k) for k, _ in held) > COUNTED:
                held = [_sum(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                if len(held[0][0]) > COUNTED // 2:
                    yield _runs(WORDS, _part(held[0][0], parts), *held[0])
                    held = []
        if held:
            keys, counts = _sum(*(np.concatenate(c) for c in zip(*held, strict=True)))
            yield _runs(WORDS, _part(keys, parts), keys, counts)

    def write_words(key, table):
        keys, counts = _sum(*_columns(table, WORDS, 2))
        p, total = key[0].as_py(), int(counts.sum())
        save_arrays(uri, f"words-{p}", {"hashes": keys, "counts": _narrow(counts)})
        end = np.flatnonzero(keys == END)
        return pa.table({"part": pa.array([p], pa.int32()), "words": pa.array([len(keys)], pa.int64()), "tokens": pa.array([total], pa.int64()), "docs": pa.array([int(counts[end].sum())], pa.int64())})

    counted = by_part(texts.mapInArrow(leaving_nothing(count_words), RUN)).applyInArrow(write_words, "part int, words long, tokens long, docs long")
    rows = {r["part"]: r for r in stored(counted, "lm-words").collect()}  # a row for each part
    sizes = tuple(rows[p]["words"] if p in rows else 0 for p in range(parts))
    words, tokens, n_docs = sum(sizes), sum(r["tokens"] for r in rows.values()), sum(r["docs"] for r in rows.values())
    if words >= 2**32 - 2:
        raise ValueError("2^32 - 2 distinct words or more have no numbers")
    start, none = words, words + 1  # the start of a text, and what would be before it

    def count_triples(batches):
        vocabulary = _vocabulary(uri, parts, sizes)
        for _, hashes, lengths in _groups(batches, 0, COUNTED):
            w, count = vocabulary.find(hashes)
            v = _before(w, lengths, start)
            u = _before(w, lengths, none, start) if order == 3 else np.full_like(w, none)
            hot = _before(count, lengths, n_docs) >= often
            for kind, k in ((RARE, ~hot), (HOT, hot)):
                vu, last, counts = _sum_triples(_joined(v[k], u[k]), w[k], np.ones(int(k.sum()), np.int64))
                first, second = _halves(vu)
                yield _runs(kind, _triple_parts(second, first, last, np.full(len(vu), kind == HOT), parts), vu, last, counts)

    def write_triples(key, table):
        """Writes a part; gives what has to be added up, and statistics of words, as runs."""
        p, out, arrays, levels, pair_levels, n_pairs = key[0].as_py(), [], {}, np.zeros(5, np.int64), np.zeros(5, np.int64), 0
        grams = {}
        for kind in (RARE, HOT):
            vu, w, counts = _sum_triples(*_columns(table, kind, 3))
            v, u = _halves(vu)
            whole = u != none
            grams[kind] = _triple_hash(u[whole], v[whole], w[whole]), counts[whole]
            levels += _levels(counts[whole])
            context, *sums = _contexts(vu[whole], counts[whole])
            pair, a = _sum(_joined(v, w), np.where(whole, 1, counts))
            if kind == RARE:
                arrays |= table_of("contexts", _pair_hash(*_halves(context)[::-1]), **dict(zip(("sum", "n1", "n2", "n3"), sums, strict=True))) | table_of("pairs", _pair_hash(*_halves(pair)), count=a)
                pair_levels += _levels(a)
                n_pairs += len(pair)
                out.append(_word_statistics(pair, a))
            else:
                out += [_runs(CONTEXTS, _part(_pair_hash(*_halves(context)[::-1]), hot_parts), context, *sums), _runs(PAIRS, _part(_pair_hash(*_halves(pair)), hot_parts), pair, a)]
        hashes, counts = (np.concatenate(c) for c in zip(*grams.values(), strict=True))
        save_arrays(uri, f"triples-{p}", arrays | table_of("triples", hashes, count=counts))
        return pa.Table.from_batches([*out, _batch([(HEAD, p, n_pairs, json.dumps([levels.tolist(), pair_levels.tolist()]), b"")])])

    def add_up(key, table):
        """Writes a part of what triples of frequent middle words say of contexts and pairs; gives statistics of words as runs."""
        p = key[0].as_py()
        context, *sums = _added(table, CONTEXTS, 5)
        pair, a = _added(table, PAIRS, 2)
        save_arrays(uri, f"hot-{p}", table_of("contexts", _pair_hash(*_halves(context)[::-1]), **dict(zip(("sum", "n1", "n2", "n3"), sums, strict=True))) | table_of("pairs", _pair_hash(*_halves(pair)), count=a))
        return pa.Table.from_batches([_word_statistics(pair, a), _batch([(HEAD, p, len(pair), json.dumps([[0] * 5, _levels(a)]), b"")])])

    def write_statistics(key, table):
        s = key[0].as_py()
        first = s << SPAN
        levels = np.zeros((min(first + (1 << SPAN), words + 1) - first, 5), np.int64)  # distinct words before; of pairs that begin with the word the sum, and how many count 1, 2, 3 or more
        for keys, counts in _each(table, STATISTICS):  # a run has a key once
            levels[(keys >> np.uint64(3)).astype(np.int64) - first, (keys & np.uint64(7)).astype(np.int64)] += counts
        save_arrays(uri, f"levels-{s}", {"levels": _narrow(levels.ravel()).reshape(levels.shape)})
        return pa.table({"part": pa.array([s], pa.int32()), "levels": pa.array([json.dumps(_levels(levels[:, 0]))])})

    triples = stored(by_part(texts.mapInArrow(leaving_nothing(count_triples), RUN)).applyInArrow(write_triples, RUN), "lm-triples")
    hot = stored(by_part(triples.where(F.col("kind").isin(CONTEXTS, PAIRS))).applyInArrow(add_up, RUN), "lm-hot")
    heads = [[(r["part"], r["n"], json.loads(r["widths"])) for r in df.where(F.col("kind") == HEAD).collect()] for df in (triples, hot)]  # a row for each part
    runs = triples.union(hot).where(F.col("kind") == STATISTICS)
    of_spans = [(r["part"], json.loads(r["levels"])) for r in stored(by_part(runs).applyInArrow(write_statistics, "part int, levels string"), "lm-levels").collect()]
    word_levels = np.sum([x for _, x in of_spans] + [[0] * 5], axis=0).tolist()
    triple_levels, pair_levels = np.sum([x for part in heads for _, _, x in part] + [[[0] * 5] * 2], axis=0).tolist()
    return Model(
        uri, parts, sizes, words, tokens, n_docs, order, often, tuple(discounts(x) for x in (word_levels, pair_levels, triple_levels)), sum(n for part in heads for _, n, _ in part),
        (word_levels[0], word_levels[1], word_levels[4]), *(frozenset(p for p, _, _ in part) for part in heads), frozenset(p for p, _ in of_spans), hot_parts,
    )


class Scorer:
    """A model as a worker has it, mapped."""

    def __init__(self, m: Model):
        self.m = m
        self.words = _vocabulary(m.uri, m.parts, m.sizes)

    def _levels(self, numbers: np.ndarray) -> np.ndarray:
        """Of sorted numbers."""
        out = np.zeros((len(numbers), 5), np.int64)
        known = np.flatnonzero((numbers >= 0) & np.isin(numbers >> SPAN, list(self.m.spans)))
        for k, files, place in _chained(self.m.uri, "levels", self.m.spans, numbers[known] >> SPAN):
            k = known[k]
            out[k] = files.take("levels", place[:, None], (numbers[k, None] & (1 << SPAN) - 1) * 5 + np.arange(5))
        return out

    def _values(self, name: str, hashes: np.ndarray, parts: np.ndarray, hot: np.ndarray | None, *keys: str) -> np.ndarray:
        """Values of hashes in a table: in the files of their parts, or, where hot, in those of what was added up."""
        out = np.zeros((len(keys), len(hashes)), np.int64)
        for added, kind, there in ((False, "triples", self.m.files), (True, "hot", self.m.hot_files)):
            at = np.arange(0 if added else len(hashes)) if hot is None else np.flatnonzero(hot == added)
            at = at[np.isin(parts[at], list(there))] if len(there) < (self.m.hot_parts if added else self.m.parts) else at
            # By file, and there about as the table is sorted.
            at = at[np.argsort(_joined(parts[at], hashes[at] >> np.uint64(INDEX) & np.uint64(0xFFFFFFFF)))]
            first = _starts(hashes[at])  # equal ones are side by side
            each, times = hashes[at][first], np.diff(first, append=len(at))
            found = np.zeros((len(keys), len(first)), np.int64)
            for k, files, place in _chained(self.m.uri, kind, there, parts[at][first]):
                found[:, k] = look_up(files, name, each[k], *keys, place=place)
            out[:, at] = np.repeat(found, times, axis=1)
        return out

    def _pairs(self, name: str, x: np.ndarray, y: np.ndarray, v: np.ndarray, hot: np.ndarray, *keys: str) -> np.ndarray:
        """Values of pairs (x, y) of a table that is dealt by v, which is one of the two."""
        hashes = _pair_hash(x, y)
        return self._values(name, hashes, np.where(hot, _part(hashes, self.m.hot_parts), _part(mix(v.astype(np.uint64)), self.m.parts)), hot, *keys)

    def score(self, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, log10 probability) of each text."""
        m = self.m
        w, count = self.words.find(hashes)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        total = lambda x: np.add.reduceat(x, starts)
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        of_words, of_pairs, of_triples = (np.array([0.0, *d]) for d in m.discounts)
        distinct, back = np.unique(w, return_inverse=True)
        levels = self._levels(distinct)
        before = levels[:, 0]
        if m.pairs:
            rest = sum(x * n for x, n in zip(m.discounts[0], m.word_levels, strict=True)) / m.pairs
            p = (np.maximum(before - of_words[np.minimum(before, 3)], 0) / m.pairs + rest / (m.words + 1))[back]
        else:
            p = np.full(len(w), 1 / (m.words + 1))
        v, hot = _before(w, lengths, m.words), _before(count, lengths, m.docs) >= m.often
        context = np.concatenate([[[0] * 5], levels[back][:-1]])
        context[starts] = self._levels(np.array([m.words]))[0]
        k = np.flatnonzero((v >= 0) & (context[:, 1] > 0))  # unknown contexts say nothing
        a = np.zeros(len(k), np.int64)
        known = np.flatnonzero(w[k] >= 0)
        a[known] = self._pairs("pairs", v[k][known], w[k][known], v[k][known], hot[k][known], "count")[0]
        p[k] = (np.maximum(a - of_pairs[np.minimum(a, 3)], 0) + context[k, 2:] @ of_pairs[1:] * p[k]) / context[k, 1]
        if m.order == 3:
            u = _before(w, lengths, m.words + 1, m.words)
            k = np.flatnonzero((u >= 0) & (v >= 0) & (u <= m.words))
            seen, *n = self._pairs("contexts", u[k], v[k], v[k], hot[k], "sum", "n1", "n2", "n3")
            some = seen > 0
            k, seen, n = k[some], seen[some], np.stack([x[some] for x in n], axis=1)
            c = np.zeros(len(k), np.int64)
            known = k[w[k] >= 0]
            triples = _triple_hash(u[known], v[known], w[known])
            c[w[k] >= 0] = self._values("triples", triples, _triple_parts(u[known], v[known], w[known], hot[known], m.parts), None, "count")[0]
            p[k] = (np.maximum(c - of_triples[np.minimum(c, 3)], 0) + n @ of_triples[1:] * p[k]) / seen
        return total((count > 0).astype(np.int64)), total(base), total(np.log10(p))


def score(docs: DataFrame, *, modulus: int = 5, held: int = 1, order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each text, whole; the model learns from rows
    whose crc32(doc_id) modulo `modulus` is not `held`. order: that of the model, 2 or 3.

    Null and empty texts are their end token alone. Null doc_id: held_out is null and the row is not learned from. If nothing is
    learned, every token is unknown. Repeated rows are counted and scored each; without rows the result is empty; other columns
    are ignored.
    """
    held_out = remainder(F.col("doc_id"), modulus) == held
    model = train(docs.where(~held_out), order)

    def task(batches):
        scorer = Scorer(model)
        for rows, hashes, lengths in _groups(batches, 2, SCORED):
            known, base, log10 = scorer.score(hashes, lengths)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(lengths), pa.array(known, pa.int64()), pa.array([model.tokens] * len(lengths), pa.int64()), pa.array(base), pa.array(log10)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(leaving_nothing(task), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
