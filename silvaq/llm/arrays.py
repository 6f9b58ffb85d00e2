"""Files of arrays in the shared folder, which tasks write once and other tasks map."""

from __future__ import annotations

import ctypes
import json
import mmap
import os
import uuid

import numpy as np

from .common import filesystem

ALIGNED = 64


def packed(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """A file's content, in pieces: its head, then each array."""
    head, at = {}, 0
    for key, a in arrays.items():
        head[key] = (a.dtype.str, a.shape, at)
        at += -(-a.nbytes // ALIGNED) * ALIGNED
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % ALIGNED)
    return [len(text).to_bytes(8, "little") + text, *(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % ALIGNED) for a in arrays.values())]


def save_arrays(uri: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes a file below uri, by way of a temporary one: a task that runs again replaces its file by the same."""
    fs, root = filesystem(uri)
    fs.create_dir(root, recursive=True)
    temp = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        for piece in packed(arrays):
            f.write(piece)
    fs.move(temp, f"{root}/{name}")


def load_arrays(uri: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file: views of the mapped file on a local file system, else of its bytes."""
    fs, root = filesystem(uri)
    if fs.type_name == "local":
        data = np.asarray(np.memmap(f"{root}/{name}", np.uint8, "r"))  # a plain array of the mapping: its views are made quickly
    else:
        with fs.open_input_file(f"{root}/{name}") as f:
            data = np.frombuffer(f.read(), np.uint8)
    size = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for key, (dtype, shape, at) in json.loads(data[8 : 8 + size].tobytes()).items():
        n = int(np.prod(shape)) * np.dtype(dtype).itemsize
        out[key] = data[8 + size + at : 8 + size + at + n].view(dtype).reshape(shape)
    return out


_MAP_FIXED = 0x10


def _side_by_side(paths: list[str | None], starts: np.ndarray) -> np.ndarray:
    """The bytes of files, mapped one after the other into one range of addresses: file i from starts[i] on, which are whole pages."""
    room = mmap.mmap(-1, max(int(starts[-1]), mmap.PAGESIZE), mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS, mmap.PROT_READ)  # goes with the arrays that view it, and the files' mappings with it
    data = np.frombuffer(room, np.uint8)
    put = ctypes.CDLL(None, use_errno=True).mmap
    put.restype, put.argtypes = ctypes.c_void_p, [ctypes.c_void_p, ctypes.c_size_t, ctypes.c_int, ctypes.c_int, ctypes.c_int, ctypes.c_long]
    for path, start, end in zip(paths, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if path and end > start:
            f = os.open(path, os.O_RDONLY)
            try:
                if put(data.ctypes.data + start, end - start, mmap.PROT_READ, mmap.MAP_SHARED | _MAP_FIXED, f, 0) != data.ctypes.data + start:
                    raise OSError(ctypes.get_errno(), f"{path} cannot be mapped")
            finally:
                os.close(f)
    return data


class Chain:
    """Arrays of many files as one range of memory, so that one expression reads from all files, whatever their number: mapped on a local file system, else read.

    A file that is None has no arrays. Of an array `key`, n[key] has the number of elements in each file.
    """

    def __init__(self, data: np.ndarray, starts: list[int | None]):
        self.data, self.n, self._at, self._kinds = data, {}, {}, {}
        for i, start in enumerate(starts):
            if start is None:
                continue
            size = int.from_bytes(data[start : start + 8].tobytes(), "little")
            for key, (dtype, shape, at) in json.loads(data[start + 8 : start + 8 + size].tobytes()).items():
                if key not in self.n:
                    self.n[key], self._at[key], self._kinds[key] = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), {}
                self.n[key][i] = np.prod(shape, dtype=np.int64)
                self._at[key][i] = (start + 8 + size + at) // np.dtype(dtype).itemsize
                self._kinds[key].setdefault(dtype, []).append(i)

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Chain:
        """That of one file with these arrays."""
        return cls(np.frombuffer(b"".join(packed(arrays)), np.uint8), [0])

    @classmethod
    def load(cls, uri: str, names: list[str | None]) -> Chain:
        fs, root = filesystem(uri)
        paths = [name and f"{root}/{name}" for name in names]
        infos = iter(fs.get_file_info([p for p in paths if p]))  # in that order; a store may name paths its own way
        sizes = [next(infos).size if p else 0 for p in paths]
        starts = np.concatenate([[0], np.cumsum([-(-n // mmap.PAGESIZE) * mmap.PAGESIZE for n in sizes], dtype=np.int64)]).astype(np.int64)
        if fs.type_name == "local":
            data = _side_by_side(paths, starts)
        else:
            data = np.zeros(int(starts[-1]), np.uint8)
            for path, start, size in zip(paths, starts[:-1].tolist(), sizes, strict=True):
                if path:
                    with fs.open_input_file(path) as f:
                        data[start : start + size] = np.frombuffer(f.read(), np.uint8)
        return cls(data, [start if path else None for path, start in zip(paths, starts[:-1].tolist(), strict=True)])

    def _view(self, dtype: str) -> np.ndarray:
        return self.data[: len(self.data) // np.dtype(dtype).itemsize * np.dtype(dtype).itemsize].view(dtype)

    def whole(self, key: str) -> tuple[np.ndarray, np.ndarray]:
        """An array that has one type in all files: all memory as that type, and where the array begins there by file."""
        (dtype,) = self._kinds[key]
        return self._view(dtype), self._at[key]

    def take(self, key: str, file: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The elements at an index of each one's file; the files have that array."""
        place, kinds = self._at[key][file] + index, self._kinds[key]
        if len(kinds) == 1:
            return self._view(*kinds)[place]
        out, file = np.zeros(place.shape, np.int64), np.broadcast_to(file, place.shape)
        for dtype, files in kinds.items():
            k = np.isin(file, files)
            out[k] = self._view(dtype)[place[k]]
        return out


def bisect(data: np.ndarray, want: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first place from `first` on, before `end`, where data (sorted between them) is not below what is wanted; else end."""
    for _ in range(int((end - first).max(initial=0)).bit_length()):
        middle = (first + end) >> 1
        less = (data[np.minimum(middle, len(data) - 1)] < want) & (first < end)
        first, end = np.where(less, middle + 1, first), np.where(less, end, middle)
    return first
