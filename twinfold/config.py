"""What a scan is told, in parts that each say what is wrong with them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from twinfold.functions.exprs import HASHES


@dataclass(frozen=True)
class Hashing:
    """How content becomes hashes. From ``large`` bytes on a hash of the first ``prefix`` bytes comes first."""

    name: str = "xxh3_64"
    large: int = 1 << 20
    prefix: int = 8 << 10

    def faults(self) -> Iterator[str]:
        if self.name not in HASHES:
            yield f"hash {self.name} is none of {', '.join(HASHES)}"
        if self.large < 0:
            yield "the size from which a file is large is negative"
        if self.prefix < 1:
            yield "the prefix that is hashed has no bytes"


@dataclass(frozen=True)
class Unpacking:
    """How far archives are unpacked. An archive beyond a limit of bytes counts as unread, and is tried again; None is no limit."""

    depth: int = 10
    member_bytes: int | None = None
    archive_bytes: int | None = None

    def faults(self) -> Iterator[str]:
        if self.depth < 0:
            yield "archives cannot be unpacked to a negative depth"
        if any(x is not None and x < 1 for x in (self.member_bytes, self.archive_bytes)):
            yield "a limit of unpacked bytes is below one"


@dataclass(frozen=True)
class Deletion:
    """What becomes of targets that are archived. Nothing is touched unless ``carried_out``."""

    carried_out: bool = False
    way: str = "trash"
    #: Whether a target is chosen where the store has no choice for it.
    unless_stored: bool = True

    def faults(self) -> Iterator[str]:
        if self.way not in ("trash", "permanent"):
            yield f"files are deleted by trash or permanent, not by {self.way}"


@dataclass(frozen=True)
class Scan:
    """Directories, what counts in them, and the policies."""

    archives_in: tuple[str, ...]
    files_in: tuple[str, ...]
    store: str = "twinfold-store"
    #: Whether the store is emptied at the end.
    forget: bool = False
    #: Files and members of fewer bytes are passed over.
    least_bytes: int = 0
    #: Of "archives" and "files", what is read again even if it did not change.
    afresh: frozenset[str] = frozenset()
    #: Whether folders of targets whose time did not change are taken as they were stored, without a look at their files.
    trust_folders: bool = False
    #: Whether members of archives among the files are matched too.
    look_inside: bool = False
    #: Whether archives that are gone still count as sources.
    gone_count: bool = False
    hashing: Hashing = field(default_factory=Hashing)
    unpacking: Unpacking = field(default_factory=Unpacking)
    deletion: Deletion = field(default_factory=Deletion)

    def faults(self) -> list[str]:
        own = [f"no directory with {what} was given" for what, given in (("archives", self.archives_in), ("files", self.files_in)) if not given]
        if self.least_bytes < 0:
            own.append("the least size is negative")
        return [*own, *self.hashing.faults(), *self.unpacking.faults(), *self.deletion.faults()]

    def stamp(self) -> str:
        """Of what decides the stored rows; those made under another one are made again."""
        h = self.hashing
        return f"{h.name}/{h.large}/{h.prefix}/{self.least_bytes}/{self.unpacking.depth}"


def admitted(text: str, taken: list[str]) -> str:
    """The resolved path of a directory that may be added to those taken; else a ValueError that says why not."""
    if not (text := text.strip()):
        raise ValueError("empty path")
    path = os.path.realpath(os.path.expanduser(text))
    if not os.path.isdir(path):
        raise ValueError("not a directory" if os.path.exists(path) else "does not exist")
    if path in taken:
        raise ValueError("already listed")
    return path
