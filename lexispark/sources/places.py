"""Files by URI: opened by executors, renamed and published by the driver."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse


def place(uri: str):
    """(pyarrow file system, path in it) of a URI or of a plain local path."""
    import pyarrow.fs as fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def move_over(system, source: str, target: str) -> None:
    """Rename a file that an executor has written; one that an earlier attempt left at the target goes, as not every file system renames over it."""
    import pyarrow.fs as fs

    if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(target).type != fs.FileType.NotFound:
        system.delete_file(target)
    system.move(source, target)


class Lines:
    """Lines appended by one task to a file of its own in a folder, each there as soon as it is written.

    Where a file system shows a file only when it is closed, a line is a file,
    written beside and renamed.
    """

    def __init__(self, folder: str):
        self.folder, self.file = folder, None

    def add(self, line: bytes) -> None:
        import pyarrow.fs as fs

        if self.file is not None:
            self.file.write(line + b"\n")
            return
        system, path = place(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        if isinstance(system, fs.LocalFileSystem):
            self.file = open(path, "ab", buffering=0)
            self.file.write(line + b"\n")
            return
        with system.open_output_stream(f"{path}.partial") as out:
            out.write(line + b"\n")
        move_over(system, f"{path}.partial", path)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def read_lines(folder: str):
    """Whole lines of the files that ``Lines`` left in a folder; what an interrupted task left of its last line is no line."""
    import pyarrow.fs as fs

    system, path = place(folder)
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.path.endswith(".jsonl"):
            with system.open_input_stream(info.path) as source:
                yield from source.read().split(b"\n")[:-1]


def hadoop(spark, path: str):
    """(Hadoop file system, path) as the driver sees it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def qualified(spark, path: str) -> str:
    """The path with its file system, so that executors find the same place."""
    fs, found = hadoop(spark, path)
    return fs.makeQualified(found).toString()


def exists(spark, path: str) -> bool:
    fs, found = hadoop(spark, path)
    return fs.exists(found)


def read_text(spark, path: str) -> str:
    """A small file, as it is."""
    fs, found = hadoop(spark, path)
    source = fs.open(found)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def sync_folder(spark, path: str) -> None:
    """Make a rename in a folder last, where the file system leaves that to us; others do it as they rename."""
    local = urlparse(qualified(spark, path))
    if local.scheme in ("", "file"):
        handle = os.open(unquote(local.path), os.O_RDONLY)
        try:
            os.fsync(handle)
        finally:
            os.close(handle)


def replace_file(spark, staged: str, target: str) -> None:
    """Rename a file over another one in one step: there is the old one or the new one at any time, and never none."""
    jvm = spark.sparkContext._jvm
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    fs, to = hadoop(spark, target)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(to).toUri(), configuration)
    context.rename(fs.makeQualified(hadoop(spark, staged)[1]), fs.makeQualified(to), options)


def restore_folder(spark, target: str) -> None:
    """What an interrupted ``replace_folder`` left: the old folder goes back if the new one never came."""
    fs, to = hadoop(spark, target)
    old = hadoop(spark, target.rstrip("/") + ".replaced")[1]
    if fs.exists(old):
        if not fs.exists(to):
            fs.rename(old, to)
        else:
            fs.delete(old, True)


def replace_folder(spark, staged: str, target: str) -> None:
    """Publish a folder. No file system renames one folder over another, so the old one steps aside and is kept until the new one is there.

    If the second rename fails the old folder is put back at once; if the
    process ends between the two, the next ``replace_folder`` or
    ``restore_folder`` puts it back.
    """
    restore_folder(spark, target)
    fs, to = hadoop(spark, target)
    old, new = hadoop(spark, target.rstrip("/") + ".replaced")[1], hadoop(spark, staged)[1]
    had = fs.exists(to)
    if had and not fs.rename(to, old):
        raise OSError(f"cannot put {target} aside")
    try:
        if not fs.rename(new, to):
            raise OSError(f"cannot publish {target}")
    except Exception:
        if had and not fs.exists(to):
            fs.rename(old, to)
        raise
    if had:
        fs.delete(old, True)


def write_file(spark, path: str, data: bytes, durable: bool = True) -> None:
    """A small file, written beside, synced, and renamed over the old one; ``durable`` also syncs the folder."""
    staged = f"{path}.{uuid.uuid4().hex}.partial"
    fs, beside = hadoop(spark, staged)
    out = fs.create(beside, True)
    try:
        out.write(bytearray(data))
        out.hsync()
    finally:
        out.close()
    try:
        replace_file(spark, staged, path)
    except Exception:
        fs.delete(beside, False)
        raise
    if durable:
        sync_folder(spark, path.rstrip("/").rsplit("/", 1)[0] or "/")
