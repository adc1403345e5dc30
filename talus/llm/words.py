"""Splitting whole texts into pre-tokens on the JVM, and looking each distinct one up only once in Python."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rows of a batch between JVM and Python where whole texts travel.
BATCH_ROWS = 2_000


def small_batches(spark) -> None:
    """Lowers the session's rows of an Arrow batch, so that a batch of whole texts stays at a few megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def pretokens(text: Column, pattern: str) -> Column:
    """Every match of the pattern, in order; \\s and \\S as Unicode defines white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def release() -> None:
    """Gives memory that is free in this process back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(result):
    release()
    return result


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then `release`."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        release()

    return inner


_active: dict[tuple, Lexicon] = {}


def active(name: tuple, make: Callable[[], Lexicon]) -> Lexicon:
    """The lexicon of that name in this worker.  There is one at a time: another operator's goes first."""
    if name not in _active:
        _active.clear()
        gc.collect()
        release()
        _active[name] = make()
    return _active[name]


class Lexicon:
    """Distinct words seen by this Python worker -> rows of Arrow columns, filled by `encode(list of words)`.

    Holds at most `most` words: beyond that it starts anew, which costs time and changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], list[pa.Array]], most: int = 1_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.parts: list[list[pa.Array]] = []

    def rows(self, words: pa.StringArray) -> tuple[list[pa.Array], pa.Array]:
        """The columns for all words known, and for each word given its row there."""
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        if len(self.at) + len(own) > self.most:
            self.clear()
        if (new := [w for w in own if w not in self.at]) or not self.parts:
            n = len(self.at)
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
            self.parts.append(self.encode(new))
            if len(self.parts) > 8:
                self.parts = [self.columns()]
        at = pa.array([self.at[w] for w in own], pa.int32())
        return self.columns(), (pc.take(at, coded.indices) if len(own) else pa.array([], pa.int32()))

    def columns(self) -> list[pa.Array]:
        joined = [pa.concat_arrays(x) for x in zip(*self.parts, strict=True)]
        self.parts = [joined] if joined else []
        return joined
