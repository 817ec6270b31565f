"""Named arrays in one file of the shared folder, mapped to memory by workers."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs as pafs

_ALIGN = 64
_last: dict[str, dict[str, np.ndarray]] = {}


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes ``arrays`` (one-dimensional) under their names; the file appears whole or not at all."""
    heads, at = [], 0
    for name, a in arrays.items():
        heads.append([name, a.dtype.str, len(a), at])
        at += -(-a.nbytes // _ALIGN) * _ALIGN
    head = json.dumps(heads).encode()
    head += b" " * (-(len(head) + 8) % _ALIGN)
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(f"{path}.part") as out:
        out.write(np.int64(len(head)).tobytes() + head)
        for a in arrays.values():
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % _ALIGN))
    fs.move(f"{path}.part", path)


def _local(uri: str) -> str:
    """Path of a file on a mounted disk; of any other the path of its copy, of which a host has one."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if urlparse(uri).scheme in ("", "file"):
        return path
    copy = os.path.join(tempfile.gettempdir(), "arrays-" + hashlib.sha256(uri.encode()).hexdigest()[:32])
    if not os.path.exists(copy):
        with tempfile.NamedTemporaryFile(dir=os.path.dirname(copy), delete=False) as local, fs.open_input_stream(path) as source:
            while data := source.read(1 << 22):
                local.write(data)
        os.replace(local.name, copy)
    return copy


def open_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; a process keeps the last file open."""
    if uri not in _last:
        raw = np.memmap(_local(uri), np.uint8, "r")
        size = int(raw[:8].view(np.int64)[0])
        heads = json.loads(raw[8 : 8 + size].tobytes())
        _last.clear()
        _last[uri] = {name: np.frombuffer(raw, kind, n, 8 + size + at) for name, kind, n, at in heads}
    return _last[uri]


class Probed:
    """An open-addressing table of 64-bit keys in two arrays, looked up for many keys at once."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self._shift, self._mask = np.uint64(64 - (len(keys).bit_length() - 1)), np.int64(len(keys) - 1)

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> Probed:
        """Of distinct keys; at most half of the slots are taken."""
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        table = cls(np.full(size, cls.EMPTY), np.zeros(size, values.dtype))
        left, at = np.arange(len(keys)), table._home(keys)
        while len(left):
            free = table.keys[at] == cls.EMPTY
            slot, one = np.unique(at[free], return_index=True)
            put = left[free][one]
            table.keys[slot], table.values[slot] = keys[put], values[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            keep = ~done[left]
            left, at = left[keep], (at[keep] + 1) & table._mask
        return table

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.FACTOR) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        at = self._home(keys)
        have = self.keys[at]
        out = np.where(have == keys, self.values[at], missing)
        left = np.flatnonzero((have != keys) & (have != self.EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & self._mask
            have = self.keys[at[left]]
            hit = have == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (have != self.EMPTY)]
        return out
