"""Whole files by path or URI, in any file system that Arrow knows; used by tasks and by the driver alike."""

from __future__ import annotations

import re
import shutil
import time
import uuid
from typing import BinaryIO

from pyarrow import fs

TRIES, PAUSE_S = 3, 0.2


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    plain = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), plain) if "://" not in plain else fs.FileSystem.from_uri(plain)


def fetched(path: str, tries: int = TRIES) -> bytes:
    """The bytes of a file.  A file that can't be reached is tried again a few times; one that does not exist is an error."""
    system, name = located(path)
    for attempt in range(1, tries + 1):
        try:
            with system.open_input_file(name) as f:
                return f.read()
        except FileNotFoundError:
            raise
        except OSError:
            if attempt == tries:
                raise
            time.sleep(PAUSE_S * attempt)
    raise AssertionError("unreachable")


def stored(path: str, content: bytes | BinaryIO) -> None:
    """Write a file, from bytes or what is open for reading, under a name of its own and move it in place, so a task that runs
    twice leaves one whole file."""
    system, name = located(path)
    folder, _, base = name.rpartition("/")
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{base}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        if isinstance(content, bytes):
            f.write(content)
        else:
            shutil.copyfileobj(content, f, 1 << 20)
    system.move(draft, name)
