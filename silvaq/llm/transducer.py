"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file: a normaliser (the dummy prefix and the sign for spaces), the pieces, and byte fallback for characters
that no piece has. Composed with a text, these give a lattice whose states are a place in the text and the last piece, and the
encoding is the shortest path in the tropical semiring (weights add along a path, the least path wins).

For a unigram model an arc's weight is the piece's negative score. For a byte-pair model scores rank merges instead. There an arc from last
piece a to piece b weighs 0 if merging the text of a and b by rank gives a and b again, else infinity: a sequence of pieces is
the byte-pair encoding of its text exactly if all its neighbours pass that test. So each place has one state at most.

Pieces of spaces rank alike and behind all others in such a model. What other merges leave of a run of spaces is a lattice of its own: each piece
weighs 1, and of paths of one weight the one whose first piece is the longest wins. That this is what merging gives is tested for short runs as a model is
compiled; a model that fails, or has other pieces with two spaces side by side, has its runs merged by definition, with a heap.

Texts are cut where no piece has the two characters side by side; no path crosses there. Frequent parts are kept by each worker.
"""

from __future__ import annotations

import array
import functools
import heapq
import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import leaving_nothing

SPACE = "▁"
#: Parts that a worker keeps, and the longest such part in characters; text encoded at once, in bytes.
KEPT, LONGEST, TOGETHER = 400_000, 48, 1 << 20
INFINITE = float("inf")
NONE: dict = {}
#: Weights of neighbours that a worker keeps.
FITS = 1_500_000
#: Weight of a character without a piece in a unigram model: above that of any path of pieces.
BYTES = 1e9
BPE, UNIGRAM = 2, 1
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Transducer:
    """A compiled model. encode() gives ids, decode() text."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        model_type, prefix, normaliser, collapse, escape = UNIGRAM, True, b"", True, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, 1))
            elif number == 2:
                model_type = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                normaliser, prefix, collapse, escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if normaliser or collapse or not escape or model_type not in (BPE, UNIGRAM):
            raise ValueError("only models with identity normalisation, kept white space and escaped spaces are supported")
        self.bpe, self.prefix = model_type == BPE, prefix
        self.bytes_of: list[bytes] = []
        self.fallback = [-1] * 256
        self.number: dict[str, int] = {}
        self.unknown = next((i for i, k in enumerate(kinds) if k == 2), 0)
        for i, (piece, kind) in enumerate(zip(self.pieces, kinds, strict=True)):
            if kind == 6:
                byte = int(_BYTE_PIECE.fullmatch(piece)[1], 16)
                self.fallback[byte] = i
                self.bytes_of.append(bytes([byte]))
            else:
                if kind in (1, 4):
                    self.number[piece] = i
                self.bytes_of.append(b"" if kind in (2, 3) else piece.replace(SPACE, " ").encode())
        self.width = max(map(len, self.number), default=1)
        self.rank = [-s if len(p) > 1 else -INFINITE for p, s in zip(self.pieces, self.scores, strict=True)]  # characters are there from the start
        self.beside = {p[k : k + 2] for p in self.number for k in range(len(p) - 1)}
        apart = [c for c in "\n\r\t" if not any(c in pair for pair in self.beside)]
        gap = "".join(f"\\x{ord(c):02x}" for c in apart)
        open_end = any(pair[1] == SPACE and pair[0] != SPACE for pair in self.beside)
        self.cut = re.compile(f" *[^ {gap}]+| +|[{gap}]" if apart else " *[^ ]+| +") if not open_end else re.compile(r"(?s).+")
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, dict[int, bool]] = {}
        self.fit_count = 0
        self.code = "H" if len(self.pieces) <= 1 << 16 else "I"
        self.known: dict[str, bytes] = {}
        self.tree: dict = {}  # by character; the piece that ends at a node under the empty key
        for p, i in self.number.items():  # in a byte-pair model those that merging makes
            if not self.bpe or len(p) == 1 or self.merged(p) == [p]:
                node = self.tree
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = i
        self.runs = self._space_runs()

    # Byte-pair merging by rank, for the tree of a piece.

    def merged(self, text: str) -> list[str]:
        """The byte-pair encoding of a text, by its definition: again and again the best-ranked pair, the leftmost first."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part) and (both := self.number.get(part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (self.rank[both], i, part[i], part[after[i]]))

        for i in range(len(text)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:  # one of them is another part by now
                continue
            part[i], part[j], after[i] = a + b, "", after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def _space_runs(self) -> list[int] | None:
        """Lengths of the pieces of spaces, the longest first, if their runs can be encoded apart from the rest: see above."""
        runs = {len(p): i for p, i in self.number.items() if p == SPACE * len(p)}
        ranks = {self.rank[i] for k, i in runs.items() if k > 1}
        others = [self.rank[i] for p, i in self.number.items() if len(p) > 1 and p.strip(SPACE)]
        if not self.bpe or 1 not in runs or len(ranks) != 1 or max(others, default=-INFINITE) >= min(ranks) or any(SPACE * 2 in p and p.strip(SPACE) for p in self.number):
            return None
        self.run_ids = runs
        lengths = sorted(runs, reverse=True)
        return lengths if all(self.run(m, lengths) == [runs[len(p)] for p in self.merged(SPACE * m)] for m in range(1, 6 * lengths[0])) else None

    def run(self, m: int, lengths: list[int]) -> list[int]:
        """Ids of the least path over m spaces. All but the last few pieces of a long run are its longest."""
        ahead = max(0, m // lengths[0] - 3)
        rest = m - ahead * lengths[0]
        least, choice = [0] + [rest + 1] * rest, [0] * (rest + 1)
        for k in range(1, rest + 1):
            for n in lengths:
                if n <= k and least[k - n] + 1 < least[k]:
                    least[k], choice[k] = least[k - n] + 1, n
        out = [self.run_ids[lengths[0]]] * ahead
        while rest:
            out.append(self.run_ids[choice[rest]])
            rest -= choice[rest]
        return out

    def split(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes a piece; None for a character, or if the piece is never made."""
        if piece not in self.splits:
            text, found = self.pieces[piece], None
            for k in range(1, len(text)):
                a, b = self.number.get(text[:k]), self.number.get(text[k:])
                if a is not None and b is not None and self.merged(text[:k]) == [text[:k]] and self.merged(text[k:]) == [text[k:]] and max(self.rank[a], self.rank[b]) < self.rank[piece] and self.passes(a, b, self.rank[piece]):
                    found = a, b
                    break
            self.splits[piece] = found
        return self.splits[piece]

    def passes(self, a: int, b: int, until: float = INFINITE) -> bool:
        """Whether a and b, side by side, are not merged across their border by any merge ranked before `until`.

        At each moment one part of a ends at the border and one part of b begins there; both grow. A merge of the two parts that stand there happens
        if it ranks before what makes either grow (at equal ranks the left one comes first).
        """
        left, right = [(a, until)], [(b, until)]  # a part and the rank of the merge that ends it
        while (s := self.split(left[-1][0])) is not None:
            left.append((s[1], self.rank[left[-1][0]]))
        while (s := self.split(right[-1][0])) is not None:
            right.append((s[0], self.rank[right[-1][0]]))
        i, j = len(left) - 1, len(right) - 1
        while True:
            (x, x_end), (y, y_end) = left[i], right[j]
            both = self.number.get(self.pieces[x] + self.pieces[y])
            if both is not None and self.rank[both] < x_end and (self.rank[both] <= y_end if y_end != until else self.rank[both] < until):
                return False
            if i == 0 and j == 0:
                return True
            if j == 0 or (i > 0 and x_end <= y_end):
                i -= 1
            else:
                j -= 1

    def fit(self, last: int, piece: int) -> bool:
        """Whether the arc from piece to piece weighs 0."""
        if self.fit_count > FITS:
            self.fits, self.fit_count = {}, 0
        self.fit_count += 1
        out = self.fits.setdefault(last, {})[piece] = self.passes(last, piece)
        return out

    def shortest(self, text: str) -> list[int]:
        """Ids of the least path over a part of a normalised text. Each place has one best state: its weight, last piece and that piece's start."""
        n, tree, bpe, scores = len(text), self.tree, self.bpe, self.scores
        least, last, start = [INFINITE] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        least[0] = 0.0
        for begin in range(n):
            before, node = last[begin], tree
            fits = self.fits.get(before, NONE) if before >= 0 else None
            for end in range(begin, n):
                node = node.get(text[end])
                if node is None:
                    break
                piece = node.get("")
                if piece is None:
                    continue
                if bpe:
                    if start[end + 1] < 0:  # else the one arc of finite weight that ends here is known
                        if fits is None or (fits[piece] if piece in fits else self.fit(before, piece)):
                            last[end + 1], start[end + 1] = piece, begin
                elif (w := least[begin] - scores[piece]) < least[end + 1]:
                    least[end + 1], last[end + 1], start[end + 1] = w, piece, begin
            if start[begin + 1] < 0:  # a character without a piece, as bytes
                least[begin + 1], start[begin + 1] = least[begin] + BYTES, begin
        out, end = [], n
        while end:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(self.bytes_for(text[start[end] : end])[::-1])
            end = start[end]
        return out[::-1]

    def bytes_for(self, char: str) -> list[int]:
        ids = [self.fallback[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown] if -1 in ids else ids

    def _part(self, part: str) -> bytes:
        """Packed ids of a part of a text, with spaces as they are."""
        text = part.replace(" ", SPACE)
        if self.bpe and SPACE + SPACE in text:
            run = len(text) - len(text.lstrip(SPACE))
            if self.runs is None or SPACE + SPACE in text[run:]:
                return array.array(self.code, [i for p in self.merged(text) for i in ([self.number[p]] if p in self.number else self.bytes_for(p))]).tobytes()
            if run == len(text):
                return array.array(self.code, self.run(run, self.runs)).tobytes()
            tail = array.array(self.code, self.encode_part(" " + part[run:]))
            alone = tail[0] == self.number[SPACE]  # the last space is left to the others
            return array.array(self.code, self.run(run if alone else run - 1, self.runs)).tobytes() + tail[alone:].tobytes()
        if len(text) > 2 and text[-1] in ".," and text[-2:] not in self.beside:
            return self.encode_part(part[:-1]) + self.encode_part(part[-1])
        return array.array(self.code, self.shortest(text)).tobytes()

    def encode_part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = self._part(part)
            if len(part) <= LONGEST:
                if len(self.known) > KEPT:  # what came first is what comes often
                    self.known = dict(itertools.islice(self.known.items(), KEPT // 2))
                self.known[part] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text, as unsigned 16-bit integers, or 32-bit ones for more pieces than these number; none for an empty one."""
        if not text:
            return np.zeros(0, self.code)
        parts = self.cut.findall(" " + text if self.prefix else text)
        known = self.known
        try:
            data = b"".join(map(known.__getitem__, parts))
        except KeyError:
            data = b"".join([known[p] if p in known else self.encode_part(p) for p in parts])
        return np.frombuffer(data, self.code)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement signs."""
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))
        return data[1 if self.prefix and data[:1] == b" " else 0 :].decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def transducer(path: str) -> Transducer:
    """A worker's transducer: one, for all its tasks."""
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids, ids_crc32, round_trip of each text.

    ids_crc32: unsigned crc32 of the ids as little-endian unsigned 32-bit integers. round_trip: whether the decoded ids are the
    text again (all texts but those with the sign for spaces itself).
    Null and empty texts have no ids and come back as the empty text. Repeated rows and null doc_ids are rows like any other;
    without rows the result is empty; other columns are ignored.
    """

    def task(batches):
        t = transducer(model_path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(sizes):
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), TOGETHER, side="right")))
                part = batch.slice(at, n)
                at += n
                texts = part.column(1).to_pylist()
                ids = [t.encode(x) for x in texts]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                sums = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
                back = [t.decode(i) == (x or "") for i, x in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends), pa.int64()), lists, pa.array(sums, pa.int64()), pa.array(back)], ["doc_id", "n_pieces", "ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(leaving_nothing(task), "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, round_trip boolean")
