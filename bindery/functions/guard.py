"""Limits of time and memory for the work on one document inside a task."""

from __future__ import annotations

import signal
import threading
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from zipfile import ZipFile

from bindery.schema import MAX_INFLATED


@contextmanager
def limited(seconds: float) -> Iterator[None]:
    """Raises TimeoutError in the block once it has taken so long. Elsewhere than in a process's main thread, where Spark's
    Python workers run their tasks, no alarm can be set, and the block has no limit.
    """
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_: object) -> None:
        raise TimeoutError(f"over {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def inflated(data: bytes, most: int = MAX_INFLATED, raw: bool = False) -> bytes:
    """What deflated data hold, raw ones without a header. More than `most` bytes are an error, and aren't made."""
    stream = zlib.decompressobj(-zlib.MAX_WBITS if raw else zlib.MAX_WBITS)
    out = stream.decompress(data, most)
    if stream.unconsumed_tail:
        raise ValueError(f"over {most} bytes when inflated")
    return out


def members(archive: ZipFile, most: int = MAX_INFLATED) -> dict[str, bytes]:
    """The files of an archive by name. More than `most` bytes in all are an error, and aren't made."""
    found, left = {}, most
    for info in archive.infolist():
        if not info.is_dir():
            with archive.open(info) as f:
                data = f.read(left + 1)
            if len(data) > left:
                raise ValueError(f"over {most} bytes when inflated")
            found[info.filename] = data
            left -= len(data)
    return found
