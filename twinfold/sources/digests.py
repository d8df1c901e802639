"""Hashes of files and streams, chunk by chunk."""

from __future__ import annotations

import hashlib
from typing import BinaryIO

import xxhash

CHUNK = 1 << 16


def new_hash(name: str):
    if name == "xxh3_64":
        return xxhash.xxh3_64()
    if name == "xxhash64":
        return xxhash.xxh64(seed=42)  # as Spark's function
    return hashlib.new(name)


def hash_file(path: str, name: str, prefix: int | None = None) -> str | None:
    digest = new_hash(name)
    try:
        with open(path, "rb") as f:
            if prefix is not None:
                digest.update(f.read(prefix))
            else:
                while chunk := f.read(CHUNK):
                    digest.update(chunk)
    except OSError:
        return None
    return digest.hexdigest()


class TooLarge(Exception):
    pass


def hash_stream(stream: BinaryIO, name: str, prefix: int, most: int | None, copy_to: BinaryIO | None = None) -> tuple[int, str, str]:
    """(size, full, quick) in one pass, copying what is read where that is asked for."""
    full, head, size = new_hash(name), b"", 0
    while chunk := stream.read(CHUNK):
        size += len(chunk)
        if most is not None and size > most:
            raise TooLarge(f"more than {most} bytes")
        full.update(chunk)
        if len(head) < prefix:
            head += chunk[: prefix - len(head)]
        if copy_to is not None:
            copy_to.write(chunk)
    quick = new_hash(name)
    quick.update(head)
    return size, full.hexdigest(), quick.hexdigest()
