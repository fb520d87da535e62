"""The binary files of an existing store: state log, key/value index, posting lists, ranks, page blobs; readers and writers.

Files are opened on the executors by pyarrow's file systems (a URI such as hdfs:// or s3://, or a path on a folder that all executors share), and
read and written as streams. A writer writes under a name of its attempt and renames at the end, so that a repeated task leaves one whole file.
"""

from __future__ import annotations

import hashlib
import io
import itertools
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Streams are read in chunks of so many bytes, and rows leave Python in frames of so many.
CHUNK, FRAME = 1 << 22, 50_000


def state_record(key: bytes, kind: int, time: int = 0, digest: bytes = b"", position: int = 0, length: int = 0) -> bytes:
    """33 bytes for nothing and know, 40 for errors, 72 for redirects and files. Time takes 7 bytes; a file keeps the digest's last 20."""
    head = key + bytes([kind])
    if kind < 2:
        return head
    head += time.to_bytes(7, "big")
    if kind >= 128:
        return head
    return head + (digest if kind == 2 else struct.pack(">QI", position, length) + digest[12:])


def _record(data: bytes, at: int, seq: int) -> tuple[dict, int] | None:
    """The record at a place and where the next one begins; None if the data end before it does."""
    if at + 33 > len(data):
        return None
    kind = data[at + 32]
    end = at + (33 if kind < 2 else 40 if kind >= 128 else 72)
    if end > len(data):
        return None
    row = {"seq": seq, "url_key": data[at : at + 32].hex(), "state_type": kind, "time": 0, "digest": None, "blob_position": None, "blob_length": None}
    if end - at > 33:
        row["time"] = int.from_bytes(data[at + 33 : at + 40], "big")
    if kind == 2:
        row["digest"] = data[at + 40 : end].hex()
    elif end - at == 72:
        row["blob_position"], row["blob_length"] = struct.unpack(">QI", data[at + 40 : at + 52])
        row["digest"] = data[at + 52 : end].hex()
    return row, end


def state_records(chunks: bytes | Iterable[bytes]) -> Iterator[dict]:
    """Records in file order, of a whole file or of its chunks; a cut tail ends the reading."""
    rest, seq = b"", 0
    for chunk in [chunks] if isinstance(chunks, bytes) else chunks:
        rest, at = rest + chunk, 0
        while (got := _record(rest, at, seq)) is not None:
            row, at = got
            seq += 1
            yield row
        rest = rest[at:]


def key_values(pairs: Iterable[tuple[bytes, bytes]]) -> bytes:
    return b"".join(k + struct.pack(">I", len(v)) + v for k, v in pairs)


def read_key_values(data: bytes | BinaryIO, size: int | None = None) -> Iterator[tuple[bytes, bytes]]:
    """Records key, length, value, of bytes or of a stream of so many bytes. ValueError for a value that runs over the end; an empty value at the very end is dropped."""
    source, size = (io.BytesIO(data), len(data)) if isinstance(data, bytes) else (data, size)
    at = 0
    while at + 36 < size:
        head = source.read(36)
        (n,) = struct.unpack(">I", head[32:])
        if at + 36 + n > size:
            raise ValueError("a value runs over the end of the file")
        yield head[:32], source.read(n) if n else b""
        at += 36 + n


def posting_bytes(items: Iterable[tuple[bytes, float]]) -> bytes:
    return b"".join(k + struct.pack(">f", v) for k, v in items)


def read_postings(value: bytes) -> list[tuple[bytes, float]]:
    if len(value) % 36:
        raise ValueError("the length is no multiple of 36")
    return [(value[i : i + 32], struct.unpack(">f", value[i + 32 : i + 36])[0]) for i in range(0, len(value), 36)]


def blob(content: bytes) -> tuple[bytes, bytes]:
    """(what is stored, digest of the content): each value is a zlib stream of its own."""
    return zlib.compress(content), hashlib.sha256(content).digest()


def unblob(stored: bytes, digest_tail: bytes) -> bytes:
    content = zlib.decompress(stored)
    if hashlib.sha256(content).digest()[12:] != digest_tail:
        raise ValueError("the content does not match its digest")
    return content


def _file_system(path: str):  # noqa: ANN202
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(local)


def _frames(rows: Iterable[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    rows = iter(rows)
    while part := list(itertools.islice(rows, FRAME)):
        yield pd.DataFrame(part, columns=names)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, number: the files under a path in the order of their names; contents are not read. One row a file."""
    paths = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    return paths.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("number"))


def _read_files(spark: SparkSession, path: str, rows: Callable[[str, int], Iterator[tuple]], schema: str) -> DataFrame:
    """Each file of a path by one task, as a stream."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, number in zip(b.file, b.number, strict=True):
                yield from _frames(rows(file, number), names)

    return _files(spark, path).repartition(spark.sparkContext.defaultParallelism, "file").mapInPandas(run, schema)


def load_state_log(spark: SparkSession, path: str) -> DataFrame:
    """The state log files under path; a file is read by one task, as its records have no fixed size.

    seq rises over the files in the order of their names and within a file: a record of a later file is the newer one.
    """

    def rows(file: str, number: int) -> Iterator[tuple]:
        system, at = _file_system(file)
        with system.open_input_stream(at) as f:
            for r in state_records(iter(lambda: f.read(CHUNK), b"")):
                yield (number << 40 | r["seq"], *list(r.values())[1:])

    raw = _read_files(spark, path, rows, "seq long, url_key string, state_type short, time long, digest string, blob_position long, blob_length int")
    return raw.select("seq", "url_key", "state_type", F.timestamp_seconds("time").alias("state_time"), F.when(F.col("state_type") == 2, F.col("digest")).alias("dest_key"), "blob_position", "blob_length", "digest")


def _key_value_file(file: str) -> Iterator[tuple[bytes, bytes]]:
    system, at = _file_system(file)
    with system.open_input_stream(at) as f:
        yield from read_key_values(f, system.get_file_info(at).size)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Posting lists of a key/value index: word_key, page_key, tf."""

    def rows(file: str, number: int) -> Iterator[tuple]:
        for k, v in _key_value_file(file):
            word = k.hex()
            yield from ((word, p.hex(), tf) for p, tf in read_postings(v))

    return _read_files(spark, path, rows, "word_key string, page_key string, tf float")


def load_rank(spark: SparkSession, path: str) -> DataFrame:
    """Ranks of a key/value index: page_key, rank."""
    return _read_files(spark, path, lambda file, number: ((k.hex(), struct.unpack(">f", v)[0]) for k, v in _key_value_file(file)), "page_key string, rank float")


def _write_files(ordered: DataFrame, folder: str, name: str, pieces: Callable[[Iterator[tuple]], Iterator[bytes]]) -> None:
    """Each partition of a table as one file of folder, in partition order; partitions without rows leave none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        rows = (r for b in batches for r in b.itertuples(index=False, name=None))
        if (first := next(rows, None)) is None:
            return
        system, root = _file_system(folder)
        system.create_dir(root, recursive=True)
        final = f"{root.rstrip('/')}/{name.format(context.partitionId())}"
        attempt = f"{root.rstrip('/')}/_attempt-{context.taskAttemptId()}"
        with system.open_output_stream(attempt) as f:
            for piece in pieces(itertools.chain([first], rows)):
                f.write(piece)
        system.move(attempt, final)
        yield pd.DataFrame({"file": [final]})

    ordered.mapInPandas(run, "file string").write.format("noop").mode("overwrite").save()


def _lists(rows: Iterator[tuple]) -> Iterator[bytes]:
    for word, items in itertools.groupby(rows, key=lambda r: r[0]):
        value = b"".join(bytes.fromhex(p) + struct.pack(">f", tf) for _, p, tf in items)
        if len(value) >= 1 << 32:
            raise ValueError(f"the list of word {word} is longer than the format's length field can say")
        yield key_values([(bytes.fromhex(word), value)])


def write_index(posts: DataFrame, folder: str) -> None:
    """posts: word_key, page_key (hex), tf. Writes the posting lists as key/value files, one a task, each list sorted by page.

    The format holds a list as one value with a 4-byte length, so the rows of a word come to one task; they arrive sorted, only the open
    list is held, at most 4 GB by the format, and a longer one raises a ValueError. Parquet (postings.write_index) has no such limit.
    """
    ordered = posts.select("word_key", "page_key", "tf").repartitionByRange("word_key").sortWithinPartitions("word_key", "page_key")
    _write_files(ordered, folder, "words-{:05}.db", _lists)


def write_rank(ranks: DataFrame, folder: str) -> None:
    """ranks: page_key (hex), rank. Writes key/value files of 4-byte values, one a task."""
    _write_files(ranks.select("page_key", "rank"), folder, "pagerank-{:05}.db", lambda rows: (key_values([(bytes.fromhex(k), struct.pack(">f", r))]) for k, r in rows))


def write_state_log(log: DataFrame, folder: str) -> None:
    """log: the columns that load_state_log gives. Writes files that follow each other in seq order, by name and within a file.

    seq is range-partitioned, so a file holds a range of it and no task or driver the whole log.
    """

    def records(rows: Iterator[tuple]) -> Iterator[bytes]:
        for key, kind, time, digest, position, length in rows:
            target = bytes.fromhex(digest or "00" * 32)
            yield state_record(bytes.fromhex(key), kind, 0 if pd.isna(time) else int(time), target if kind == 2 else bytes(12) + target[-20:], 0 if pd.isna(position) else int(position), 0 if pd.isna(length) else int(length))

    ordered = log.select("seq", "url_key", "state_type", F.unix_timestamp("state_time").alias("time"), "digest", "blob_position", "blob_length").repartitionByRange("seq").sortWithinPartitions("seq").drop("seq")
    _write_files(ordered, folder, "urls-{:05}.meta", records)
