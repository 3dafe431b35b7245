"""Files that are read and written by byte ranges, in any store that pyarrow reaches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and its own path of a URI, or of an absolute local path."""
    return pafs.FileSystem.from_uri(path)


def joined(folder: str, name: str) -> str:
    """name below folder, unless name is a whole path itself."""
    return name if re.match(r"/|[a-z][a-z0-9+.-]*:", name) else f"{folder.rstrip('/')}/{name}"


def parent(path: str) -> str:
    return path.rstrip("/").rpartition("/")[0]


def read_text(path: str) -> str:
    system, own = located(path)
    with system.open_input_stream(own) as file:
        return file.read().decode()


def write_bytes(path: str, content: bytes) -> None:
    """The whole file at once: under another name first, so that no reader sees a part of it."""
    system, own = located(path)
    system.create_dir(own.rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{own}.part") as file:
        file.write(content)
    system.move(f"{own}.part", own)


def exists(path: str) -> bool:
    system, own = located(path)
    return system.get_file_info(own).type != pafs.FileType.NotFound


def remove(path: str) -> None:
    if exists(path):
        system, own = located(path)
        system.delete_file(own)


def filled_lines(path: str, offset: int = 0, chunk: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """(byte offset, text) of the lines from offset on that aren't blank, stripped; a chunk is held at a time."""
    system, own = located(path)
    with system.open_input_file(own) as file:
        file.seek(offset)
        at, rest = offset, b""
        while True:
            read = file.read(chunk)
            *whole, rest = (rest + read).split(b"\n")
            if not read:
                whole, rest = [*whole, rest], b""
            for line in whole:
                if text := line.decode().strip():
                    yield at, text
                at += len(line) + 1
            if not read:
                return


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of this process where all tasks run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
