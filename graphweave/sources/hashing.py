"""SHA-256 of files of any size, in parts: a task hashes a bounded part and hands the state of the hash on."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from collections.abc import Iterable
from functools import cache
from threading import Lock

from pyspark import RDD, SparkContext

#: Bytes of a record, and records of a task.
RECORD, RECORDS = 1 << 20, 64
_settings = Lock()
#: OpenSSL's SHA256_CTX: eight words of state, two of the count of bits, sixteen of data, two of lengths.
STATE = 112


@cache
def _openssl() -> ctypes.CDLL:
    """The library that Python's hashlib uses: hashlib itself can't give a state to another process."""
    import _hashlib

    for name in (getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")):
        try:
            lib = name and ctypes.CDLL(name)
            if lib and lib.SHA256_Init and lib.SHA256_Update and lib.SHA256_Final:
                return lib
        except (OSError, AttributeError):
            continue
    raise RuntimeError("SHA-256 in parts needs OpenSSL's libcrypto")


def begun() -> bytes:
    """The state of a hash of nothing."""
    state = ctypes.create_string_buffer(STATE)
    _openssl().SHA256_Init(state)
    return state.raw


def extended(state: bytes, pieces: Iterable[bytes]) -> bytes:
    """The state after further pieces of the stream."""
    now = ctypes.create_string_buffer(state, STATE)
    for piece in pieces:
        _openssl().SHA256_Update(now, piece, ctypes.c_size_t(len(piece)))
    return now.raw


def digest(state: bytes, size: int) -> str:
    """The hash in hex of a stream of size bytes; an error where the state has seen another number of them."""
    bits = int.from_bytes(state[32:36], "little") | int.from_bytes(state[36:40], "little") << 32
    if bits != size * 8:
        raise ValueError(f"{bits // 8} bytes were hashed of {size}")
    out, now = ctypes.create_string_buffer(32), ctypes.create_string_buffer(state, STATE)
    _openssl().SHA256_Final(out, now)
    return out.raw.hex()


def literal(path: str) -> str:
    """The pattern that only this path matches."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def records(sc: SparkContext, path: str, length: int, split: int) -> RDD:
    """A file's records of `length` bytes, `split` bytes to a partition. The last partition has up to a tenth more, and can't be read where
    the file ends inside a record."""
    conf = sc._jsc.hadoopConfiguration()
    names = [f"mapreduce.input.fileinputformat.split.{x}size" for x in ("min", "max")]
    with _settings:  # the RDD keeps a copy of them
        before = [conf.get(name) for name in names]
        try:
            for name in names:
                conf.set(name, str(split))
            return sc.binaryRecords(literal(path).replace(",", r"{\,}"), length)  # a comma alone parts paths
        finally:
            for name, value in zip(names, before, strict=True):
                conf.unset(name) if value is None else conf.set(name, value)


def hashes(sc: SparkContext, files: list[tuple[str, int]]) -> list[str]:
    """The SHA-256 in hex of files (path, size). A round hashes the next part of each file, so files go side by side; what the driver
    holds are states of 112 bytes."""
    parts, todo, at = [], [], 0
    for path, _ in files:
        # all but the last large part, then all but the last record, then the rest byte by byte
        large, small, rest = records(sc, path, RECORD, RECORD * RECORDS), records(sc, path, RECORD, RECORD), records(sc, path, 1, RECORD)
        n, m = large.getNumPartitions(), small.getNumPartitions()
        todo.append([*range(at, at + n - 1), *range(at + n + (n - 1) * RECORDS, at + n + m - 1), at + n + m + m - 1])
        parts += [large, small, rest]
        at += n + m + m
    every, states = sc.union(parts), [begun() for _ in files]
    for turn in range(max(map(len, todo), default=0)):
        now = {nth[turn]: i for i, nth in enumerate(todo) if turn < len(nth)}
        old = {p: states[i] for p, i in now.items()}
        after = every.mapPartitionsWithIndex(lambda p, it, old=old: [(p, extended(old[p], it))])
        for p, state in sc.runJob(after, lambda it: it, list(now)):
            states[now[p]] = state
    return [digest(state, size) for state, (_, size) in zip(states, files, strict=True)]
