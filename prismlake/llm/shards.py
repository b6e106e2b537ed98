"""Sorted hash arrays in files of the shared folder, written by tasks and memory-mapped by workers.

A file holds named arrays of fixed width. A task that is repeated writes the same bytes under a name of its own and renames it, so readers see
whole files only. Workers map a file where the shared folder is a local path (a mount); from any other file system they copy it once to a
local file that has no name, and map that.
"""

from __future__ import annotations

import json
import mmap
import tempfile
import uuid

import numpy as np
from pyarrow import fs as arrow_fs

#: Maps that a worker keeps; a process may have 65,530.
KEPT = 8192
_OPEN: dict[str, dict[str, np.ndarray]] = {}
_FOLDER: list[str] = []


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def write_arrays(path: str, **arrays: np.ndarray) -> None:
    """One file with these arrays, each at a multiple of eight bytes."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a)
        head[name] = (raw.dtype.str, len(raw), at)
        pad = -raw.nbytes % 8
        parts.append(raw.tobytes() + b"\0" * pad)
        at += raw.nbytes + pad
    first = json.dumps(head).encode()
    first += b" " * (-(len(first) + 8) % 8)
    system, name = _place(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    own = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(len(first).to_bytes(8, "little") + first)
        for p in parts:
            out.write(p)
    system.move(own, name)


def _buffer(path: str) -> mmap.mmap | None:
    system, name = _place(path)
    if system.get_file_info(name).type == arrow_fs.FileType.NotFound:
        return None
    if isinstance(system, arrow_fs.LocalFileSystem):
        with open(name, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.TemporaryFile() as local:
        with system.open_input_stream(name) as source:
            while part := source.read(8 << 20):
                local.write(part)
        local.flush()
        return mmap.mmap(local.fileno(), 0, access=mmap.ACCESS_READ)


def arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; none where there is no such file. A worker keeps the maps of one folder at a time."""
    if _FOLDER != [folder]:
        _OPEN.clear()
        _FOLDER[:] = [folder]
    if name not in _OPEN:
        if len(_OPEN) >= KEPT:
            _OPEN.pop(next(iter(_OPEN)))
        raw, found = _buffer(f"{folder}/{name}"), {}
        if raw is not None:
            size = int.from_bytes(raw[:8], "little")
            for key, (kind, n, at) in json.loads(raw[8 : 8 + size]).items():
                found[key] = np.frombuffer(raw, kind, n, 8 + size + at)
        _OPEN[name] = found
    return _OPEN[name]


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each wanted key in the sorted keys; wanted keys in order touch the pages in order."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted
