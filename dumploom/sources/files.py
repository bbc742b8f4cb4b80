"""Files by path or URI, on the driver and on executors."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import uuid
from collections.abc import Callable, Mapping
from urllib.parse import urlparse
from urllib.request import url2pathname

from pyarrow import fs

from dumploom.errors import IoFailure, UnsupportedCompression

#: Schemes of object stores and the web.
REMOTE = frozenset("abfs abfss az adl azure gs s3 s3a http https".split())
GZIP, ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"


def is_remote(uri: str) -> bool:
    """By scheme, from a closed list, so that a drive letter is local."""
    return "://" in uri and urlparse(uri).scheme.lower() in REMOTE


def local_path(uri: str) -> str:
    return url2pathname(urlparse(uri).path) if uri.startswith("file:") else uri


#: Names of storage options, and what the file systems call them.
S3_OPTIONS = {
    "aws_access_key_id": "access_key", "aws_secret_access_key": "secret_key", "aws_session_token": "session_token", "aws_region": "region", "aws_endpoint": "endpoint_override",
}
AZURE_OPTIONS = {"azure_storage_account_name": "account_name", "azure_storage_account_key": "account_key", "azure_storage_sas_token": "sas_token"}
HADOOP_OPTIONS = {
    "aws_access_key_id": "fs.s3a.access.key", "aws_secret_access_key": "fs.s3a.secret.key", "aws_session_token": "fs.s3a.session.token", "aws_region": "fs.s3a.endpoint.region", "aws_endpoint": "fs.s3a.endpoint",
}


def file_system(uri: str, options: Mapping[str, str] | None = None) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` and the path on it. ``options`` are storage options, never told in a message."""
    scheme = urlparse(uri).scheme.lower() if "://" in uri else ""
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), local_path(uri)
    given, parts = dict(options or {}), urlparse(uri)
    if scheme in ("s3", "s3a"):
        return fs.S3FileSystem(**{ours: given[k] for k, ours in S3_OPTIONS.items() if k in given}), parts.netloc + parts.path
    if scheme in ("abfs", "abfss", "az", "adl", "azure"):
        container, _, account = parts.netloc.rpartition("@")
        known = {ours: given[k] for k, ours in AZURE_OPTIONS.items() if k in given}
        if container:
            known.setdefault("account_name", account.split(".")[0])
        return fs.AzureFileSystem(**known), (container or parts.netloc) + parts.path
    if scheme == "gs":
        return fs.GcsFileSystem(), parts.netloc + parts.path
    if scheme in ("http", "https"):
        raise IoFailure(message=f"reading over {scheme} needs a copy of the file in a file system")
    return fs.FileSystem.from_uri(uri)


def data_uri(uri: str) -> str:
    """``uri`` as Spark's own readers and writers want it."""
    return "s3a://" + uri[5:] if uri.startswith("s3://") else uri


def give_options(spark, options: Mapping[str, str] | None) -> None:
    """The same options for Spark's own readers and writers; keys that begin with ``fs.`` go as they are."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in (options or {}).items():
        name = HADOOP_OPTIONS.get(key, key if key.startswith("fs.") else None)
        if name:
            conf.set(name, value)


class Resumed(io.RawIOBase):
    """A stream that survives dropped connections: after an error it opens the file anew and goes on where it stopped, ``most`` times.

    An end before ``size`` bytes is a failure; an error after the last of them is not.
    """

    def __init__(self, open_at: Callable[[int], object], size: int, most: int = 8):
        self.open_at, self.size, self.left, self.at, self.stream = open_at, size, most, 0, open_at(0)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.at < self.size:
            try:
                got = self.stream.read(min(len(into), self.size - self.at))
                if not got:
                    raise OSError("the stream ended early")
                into[: len(got)] = got
                self.at += len(got)
                return len(got)
            except OSError as error:
                if not self.left:
                    raise IoFailure(message=f"reading stopped at byte {self.at} of {self.size}") from error
                self.left -= 1
                self.stream = self.open_at(self.at)
        return 0


def compression(head: bytes) -> str:
    """By the first bytes, never by a name's ending."""
    return "gzip" if head.startswith(GZIP) else "zstd" if head.startswith(ZSTD) else "none"


def opened(uri: str, options: Mapping[str, str] | None = None):
    """(stream, size in bytes); a missing file fails here, before any work."""
    store, path = file_system(uri, options)
    info = store.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(uri)

    def open_at(place: int):
        stream = store.open_input_file(path)
        stream.seek(place)
        return stream

    return io.BufferedReader(Resumed(open_at, info.size), 1 << 20), info.size


def plain_copy(uri: str, folder: str, options: Mapping[str, str] | None = None) -> tuple[str, str, int]:
    """(uri of the plain text, compression, bytes as stored). Gzip, several members too, is spooled once to ``folder``."""
    stream, size = opened(uri, options)
    with stream:
        kind = compression(stream.read(4))
    if kind == "zstd":
        raise UnsupportedCompression(format="zstd")
    if kind == "none":
        return uri, kind, size
    store, path = file_system(folder, options)
    store.create_dir(path, recursive=True)
    name = f"{path}/{uuid.uuid4().hex}.sql"
    raw, _ = opened(uri, options)
    with raw, gzip.GzipFile(fileobj=raw) as text, store.open_output_stream(name) as out:
        shutil.copyfileobj(text, out, 8 << 20)
    return (name if isinstance(store, fs.LocalFileSystem) else f"{folder.rstrip('/')}/{os.path.basename(name)}"), kind, size
