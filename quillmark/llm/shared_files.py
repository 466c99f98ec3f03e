"""Files of this subpackage's own formats in the folder that driver and executors share."""

from __future__ import annotations

from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from quillmark.llm.common import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, as a URI."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write(uri: str, parts: list[bytes]) -> None:
    """Write a file whole or not at all: a repeated task replaces it by the same bytes."""
    at, path = fs.FileSystem.from_uri(uri)
    at.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid4().hex}.draft"
    with at.open_output_stream(draft) as f:
        for x in parts:
            f.write(x)
    at.move(draft, path)


def read(uri: str, offset: int, size: int) -> bytes:
    at, path = fs.FileSystem.from_uri(uri)
    with at.open_input_file(path) as f:
        f.seek(offset)
        return f.read(size)


def read_all(uri: str) -> pa.Buffer:
    at, path = fs.FileSystem.from_uri(uri)
    with at.open_input_file(path) as f:
        return f.read_buffer()


def remove(folder: str) -> None:
    """Delete a folder of working files, if it is there."""
    at, path = fs.FileSystem.from_uri(folder)
    if at.get_file_info(path).type == fs.FileType.Directory:
        at.delete_dir(path)
