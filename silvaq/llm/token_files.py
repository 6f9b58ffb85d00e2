"""Token ids in Arrow files: fixed-size-list batches of equal-length sequences and masks, mapped without copies.

A file holds one range of documents, ordered by doc_id. Its ids run on from sequence to sequence; the last sequence is filled
up and its mask says which ids count. A second file beside it has each document's id and number of ids. Files do not depend on
one another: a lost task writes its own again, under the same name, by way of a temporary file. The manifest, a table, has one
row per file, and a document's place in the whole stream is the sum of the files before plus its place in its file.
"""

from __future__ import annotations

import array
import functools
import itertools
import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, fresh_dir, leaving_nothing, stored

LENGTH = 2048
#: Sequences in one batch of a file.
BATCH = 64
#: Words whose ids a worker keeps, and the longest such word in bytes; text encoded at once, in code points.
KEPT, LONGEST, TOGETHER = 700_000, 64, 1 << 20


def _one_run(word: str) -> bool:
    """Whether normalisation leaves a word as it is and the tokenizer's pattern takes it whole: lower-case letters, composed."""
    return word.isalpha() and word.lower() == word and unicodedata.is_normalized("NFC", word)


# The signs by which byte-level models know bytes: printable ones stand for themselves, the others follow from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}


def encodes_words_alone(spec: dict) -> bool:
    """Whether a tokenizer, as its file describes it, composes and lower-cases, takes its pieces at white space, which it drops, and knows bytes by signs."""
    steps = lambda x, key: [] if x is None else x[key] if x.get("type") == "Sequence" else [x]
    normal = [s.get("type") for s in steps(spec.get("normalizer"), "normalizers")]
    cuts = steps(spec.get("pre_tokenizer"), "pretokenizers")
    cut = cuts[0] if cuts else {}
    kinds = [c.get("type") for c in cuts]
    return (
        normal[:1] == ["NFC"] and normal[-1] == "Lowercase" and set(normal) <= {"NFC", "Replace", "Lowercase"}
        and kinds == ["Split", "ByteLevel"] and cut.get("behavior") == "Removed" and cut.get("invert") is True and not cuts[1].get("add_prefix_space", True)
    )


#: Signs that end a word; not the apostrophe, which may begin a piece of letters.
_SIGN = b".,;:!?#$%&*+/=@^_~|-)]}>\""


class WordEncoder:
    """Encodes whole texts with a byte-level tokenizer that drops white space, a word at a time, so that each frequent word is encoded once.

    A new word of letters goes straight to the tokenizer's model; any other goes through its normaliser and pattern first.

    Words end at ASCII white space, which this kind of tokenizer always splits at and never encodes: the ids of a text are the ids of its words.
    Whether a file is of this kind is read from it; another tokenizer encodes whole texts.
    """

    def __init__(self, path: str, dtype=np.uint16):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = encodes_words_alone(json.load(f))
        self.code = {1: "B", 2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.known: dict[bytes, bytes] = {}

    def _new(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        """Encodes words that are not known. Signs that follow a letter or digit are a piece of their own, as the tokenizer has it, so that what is before them may be known."""
        stems = {}
        for w in words:
            if w[-1] in _SIGN and (stem := w.rstrip(_SIGN))[-1:].isalnum():
                stems[w] = stem, w[len(stem) :]
        wanted, rest = {s for pair in stems.values() for s in pair}.union(w for w in words if w not in stems).difference(self.known), []
        tokenize, code = self.tokenizer.model.tokenize, self.code
        for w in wanted:
            if w.isalpha() and w.islower():  # ASCII letters, which stand for themselves
                into[w] = array.array(code, [t.id for t in tokenize(w.decode())]).tobytes()
            elif _one_run(w.decode()):
                into[w] = array.array(code, [t.id for t in tokenize(w.decode("latin-1").translate(_SIGNS))]).tobytes()
            else:
                rest.append(w)
        for w, got in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            into[w] = array.array(code, got.ids).tobytes()
        for w, (stem, sign) in stems.items():
            into[w] = (into[stem] if stem in into else self.known[stem]) + (into[sign] if sign in into else self.known[sign])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [array.array(self.code, got.ids).tobytes() for got in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        known = self.known
        if len(known) > KEPT:  # what came first is what comes often
            self.known = known = dict(itertools.islice(known.items(), KEPT // 2))
        data = [t.encode() if t else b"" for t in texts]
        # The tokenizer lower-cases, but matches its special tokens as they stand.
        split = [(d if b"<|" in d else d.lower()).split() for d in data]
        new, once = set().union(*split).difference(known), {}
        if long := [w for w in new if len(w) > LONGEST]:
            new.difference_update(long)
            self._new(long, once)
        if new:
            self._new(list(new), known)
        if once:
            return [b"".join([once[w] if w in once else known[w] for w in words]) for words in split]
        return [b"".join(map(known.__getitem__, words)) for words in split]


@functools.lru_cache(maxsize=1)
def encoder(path: str, dtype: str) -> WordEncoder:
    """A worker's encoder: one, for all its tasks."""
    return WordEncoder(path, dtype)


def slices(batch: pa.RecordBatch, column: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes of text, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def file_schema(length: int, dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Writes a run of ids as sequences of one length. At most one batch is in memory."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        self.schema = file_schema(length, dtype)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        full = self.length * BATCH * self.dtype.itemsize
        if self.held >= full:
            data = b"".join(self.parts)
            at = 0
            while len(data) - at >= full:
                self._batch(np.frombuffer(data, self.dtype, self.length * BATCH, at))
                at += full
            self.parts, self.held = [data[at:]], len(data) - at

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        room = np.zeros(rows * self.length, self.dtype)
        room[: len(ids)] = ids
        mask = np.arange(len(room)) < len(ids)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (room, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.parts), self.dtype)
        if len(rest):
            self._batch(rest)
        self.writer.close()


class SequenceFile:
    """Random access to a written file; on a local disk the arrays are views of the mapped file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batches = self.file.num_record_batches

    def batch(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of a batch: an array of sequences by length without a copy, and the flat mask."""
        got = self.file.get_batch(i)
        return got.column(0).values.to_numpy(zero_copy_only=True).reshape(-1, self.length), got.column(1).values

    def __len__(self) -> int:
        return 0 if not self.batches else (self.batches - 1) * BATCH + self.file.get_batch(self.batches - 1).num_rows

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.Array]:
        ids, mask = self.batch(i // BATCH)
        return ids[i % BATCH], mask.slice(i % BATCH * self.length, self.length)

    def runs(self) -> Iterator[np.ndarray]:
        """The ids that count, a batch at a time."""
        for i in range(self.batches):
            ids, mask = self.batch(i)
            n = mask.true_count
            yield ids.reshape(-1)[:n]


def write(docs: DataFrame, tokenizer_path: str, out: str, *, end_id: int = 2, length: int = LENGTH, dtype="uint16") -> DataFrame:
    """Encodes docs (doc_id, text) into files below out (a URI); the manifest: file, first, docs, tokens. Runs when the manifest is read."""
    end = np.array([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def task(batches):
        coder = encoder(tokenizer_path, dtype)
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}"
        temp = f"{root}/.{name}-{uuid.uuid4().hex}"
        first, n_docs, n_tokens, started = None, 0, 0, False
        with fs.open_output_stream(f"{temp}.ids") as a, fs.open_output_stream(f"{temp}.docs") as b:
            ids, index = SequenceWriter(a, length, dtype), pa.ipc.new_file(b, DOCS)
            for batch in (part for whole in batches for part in slices(whole, 1)):
                if not started:
                    first, started = batch.column(0)[0].as_py(), True
                coded = coder.encode(batch.column(1).to_pylist())
                counts = [len(x) // width + 1 for x in coded]
                for x in coded:
                    ids.add(x)
                    ids.add(end)
                index.write_batch(pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], schema=DOCS))
                n_docs += batch.num_rows
                n_tokens += sum(counts)
            ids.close()
            index.close()
        if not started:
            fs.delete_file(f"{temp}.ids")
            fs.delete_file(f"{temp}.docs")
            return
        fs.move(f"{temp}.ids", f"{root}/{name}.ids")
        fs.move(f"{temp}.docs", f"{root}/{name}.docs")
        yield pa.RecordBatch.from_pydict({"file": [name], "first": pa.array([first], pa.int64()), "docs": pa.array([n_docs], pa.int64()), "tokens": pa.array([n_tokens], pa.int64())})

    # Rows that share an id, or have none, follow their place in the input: no range is bound to hold them all.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    return ordered.mapInArrow(leaving_nothing(task), "file string, first long, docs long, tokens long")


def read(manifest: DataFrame, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # files are named in the order of their ranges
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))

    def task(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, root = filesystem(out)
                runs, held, at = SequenceFile(f"{out}/{name}.ids").runs(), np.zeros(0, np.uint16), 0
                with fs.open_input_file(f"{root}/{name}.docs") as f:
                    index = pa.ipc.open_file(f)
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        starts, sums = [], []
                        for n in part.column(1).to_pylist():
                            starts.append(base)
                            base += n
                            crc = 0
                            while n:
                                if at == len(held):
                                    held, at = next(runs), 0
                                piece = held[at : at + n]
                                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                                n -= len(piece)
                                at += len(piece)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int64()), part.column(1), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism + 1000))
    dealt = based.select("file", "base").repartition(files, "file")  # a number, so that small rows are not taken for little work
    return dealt.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Writes all documents as token files in the shared folder and returns what read() finds there.

    Null text is empty: only the end id. Documents stand in ascending order of doc_id, nulls first, repeated ids in the order of
    the input. Without rows there are no files and no rows. Other columns are ignored.
    """
    out = fresh_dir(docs.sparkSession, "tokens")
    manifest = stored(write(docs, tokenizer_path, out, end_id=end_id, length=length), "manifest")
    return read(manifest, out)
