"""A Spark data source for lines in .xz files, dealt by file and block.

An .xz file ends with an index of its blocks, each of which inflates by itself. The driver reads the indexes alone; a partition is a run of blocks,
and gives the lines that start in them: it skips what is left of the line before, and goes on into the next block for the rest of its last line.
Blocks are inflated as a stream, a chunk at a time, so that neither a file nor a block is held whole. The writer makes blocks of a stated size.

    spark.dataSource.register(XzLines)
    spark.read.format("xz_lines").load("s3://bucket/raw/*.jsonl.xz")
"""

from __future__ import annotations

import fnmatch
import lzma
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER_MAGIC, FOOTER_MAGIC, EDGE = b"\xfd7zXZ\0", b"YZ", 12
#: Bytes asked from the store, and inflated at once.
CHUNK = 1 << 20
SCHEMA = "file_name string, offset long, value string"


class XzError(ValueError):
    """A file is not a whole .xz file."""


@dataclass
class Block:
    """A block: where it lies in the file, and which bytes of the inflated whole it gives."""

    at: int
    size: int
    start: int
    length: int
    flags: bytes


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The .xz files of a file, a folder (below it too; names with a leading _ or . do not count) or a glob in the last part of a path."""
    folder, _, last = path.rstrip("/").rpartition("/")
    wild = any(c in last for c in "*?[")
    store, at = store_of(folder if wild else path)
    prefix = "" if path.startswith("file:") else (folder if wild else path).removesuffix(at)
    if wild:
        paths = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, last)]
    elif (info := store.get_file_info(at)).type == fs.FileType.Directory:
        paths = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.base_name[:1] not in "_." and f.path.endswith(".xz")]
    elif info.type == fs.FileType.File:
        paths = [at]
    else:
        raise FileNotFoundError(path)
    return [prefix + p for p in sorted(paths)]


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and where the next begins."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 56:
            raise XzError("broken index")
        value, shift, at = value | (data[at] & 0x7F) << shift, shift + 7, at + 1
        if not data[at - 1] & 0x80:
            return value, at


def _packed(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def index_of(read, size: int) -> list[tuple[int, list[tuple[int, int]], bytes]]:
    """Streams of a file, read from its end: where the blocks start, their sizes (in the file without padding, inflated), and the stream's flags."""
    streams, end = [], size
    while end:
        if end < 2 * EDGE:
            raise XzError("too short")
        footer = read(end - EDGE, EDGE)
        if footer[-4:] == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        crc, back, flags = struct.unpack("<II2s", footer[:10])
        if footer[10:] != FOOTER_MAGIC or zlib.crc32(footer[4:10]) != crc:
            raise XzError("no .xz footer")
        back = (back + 1) * 4
        if end < EDGE + back + EDGE:
            raise XzError("broken footer")
        data = read(end - EDGE - back, back)
        if data[:1] != b"\0" or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise XzError("broken index")
        n, at = _number(data, 1)
        sizes = []
        for _ in range(n):
            packed, at = _number(data, at)
            length, at = _number(data, at)
            sizes.append((packed, length))
        start = end - EDGE - back - sum(p + -p % 4 for p, _ in sizes)
        if start < EDGE or read(start - EDGE, EDGE)[: len(HEADER_MAGIC)] != HEADER_MAGIC:
            raise XzError("broken index")
        streams.append((start, sizes, flags))
        end = start - EDGE
    return streams[::-1]


def blocks_of(path: str) -> list[Block]:
    """The blocks of a file that hold anything, in order; only footers and indexes are read."""
    store, at = store_of(path)
    with store.open_input_file(at) as file:
        try:
            streams = index_of(lambda offset, n: file.read_at(n, offset), file.size())
        except XzError as e:
            raise XzError(f"{path}: {e}") from None
    out, start = [], 0
    for place, sizes, flags in streams:
        for packed, length in sizes:
            if length:
                out.append(Block(place, packed + -packed % 4, start, length, flags))
            place, start = place + packed + -packed % 4, start + length
    return out


def inflated(path: str, blocks: list[Block]) -> Iterator[bytes]:
    """What blocks of a file give, a chunk at a time."""
    store, at = store_of(path)
    with store.open_input_file(at) as file:
        for block in blocks:
            head = HEADER_MAGIC + block.flags + struct.pack("<I", zlib.crc32(block.flags))
            unpack, place, left, given = lzma.LZMADecompressor(lzma.FORMAT_XZ), block.at, block.size, 0
            unpack.decompress(head)
            while given < block.length:
                data = b""
                if unpack.needs_input:
                    data = file.read_at(min(CHUNK, left), place)
                    if not data:
                        raise XzError(f"{path}: a block ends early")
                    place, left = place + len(data), left - len(data)
                if out := unpack.decompress(data, CHUNK):
                    given += len(out)
                    yield out


def lines_of(path: str, blocks: list[Block], first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that start in blocks first to last - 1: beyond them, blocks are read up to the next line feed only.

    A line that starts where the first block does belongs to the partition before, which cannot know that it ends there.
    """
    stop = blocks[last - 1].start + blocks[last - 1].length
    at, held, skip = blocks[first].start, [], first > 0
    for chunk in inflated(path, blocks[first:]):
        begin = 0
        while (cut := chunk.find(b"\n", begin)) >= 0:
            held.append(chunk[begin:cut])
            line = b"".join(held)
            if not skip:
                yield at, line
            at, held, begin, skip = at + len(line) + 1, [], cut + 1, False
            if at > stop:
                return
        held.append(chunk[begin:])
    if not skip and any(held):
        yield at, b"".join(held)


@dataclass
class Run(InputPartition):
    """Blocks first to last - 1 of a file."""

    path: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[Run]:
        """Neighbouring blocks of a file share a partition up to splitBytes of inflated data; larger blocks stand alone."""
        runs = []
        for path in files_of(self.path):
            first, size, blocks = 0, 0, blocks_of(path)
            for i, block in enumerate(blocks):
                if size and size + block.length > self.split:
                    runs.append(Run(path, first, i))
                    first, size = i, 0
                size += block.length
            if blocks:
                runs.append(Run(path, first, len(blocks)))
        return runs or [Run("", 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.last:
            return
        name, rows, size = posixpath.basename(run.path), [], 0
        for row in lines_of(run.path, blocks_of(run.path), run.first, run.last):
            rows.append(row)
            size += len(row[1])
            if size > 4 * CHUNK or len(rows) == 10_000:
                yield _batch(name, rows)
                rows, size = [], 0
        if rows:
            yield _batch(name, rows)


def _batch(name: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    values = pa.array([line for _, line in rows], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([at for at, _ in rows], pa.int64()), values], ["file_name", "offset", "value"])


@dataclass
class Written(WriterCommitMessage):
    path: str | None


def packed_blocks(chunks: Iterator[bytes], write) -> None:
    """Writes one .xz stream with a block for each chunk that is not empty."""
    records, flags = [], None
    for chunk in filter(None, chunks):
        alone = lzma.compress(chunk, lzma.FORMAT_XZ)
        ((start, [(packed, length)], flags),) = index_of(lambda at, n: alone[at : at + n], len(alone))
        if not records:
            write(alone[:start])
        write(alone[start : start + packed + -packed % 4])
        records.append((packed, length))
    if flags is None:
        write(lzma.compress(b"", lzma.FORMAT_XZ))
        return
    index = b"\0" + _packed(len(records)) + b"".join(_packed(x) for r in records for x in r)
    index += b"\0" * (-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + flags
    write(index + struct.pack("<I", zlib.crc32(tail)) + tail + FOOTER_MAGIC)


class Writer(DataSourceWriter):
    """Rows of one string column, or of a column called value, as lines. Files count once the job commits: until then their names have a leading underscore."""

    def __init__(self, options: dict, column: str):
        self.path, self.size, self.column = options["path"].rstrip("/"), int(options.get("blockBytes", 8 << 20)), column

    def _chunks(self, rows) -> Iterator[bytes]:
        held, size = [], 0
        for row in rows:
            line = (row[self.column] or "").encode() + b"\n"
            if b"\n" in line[:-1]:
                raise ValueError("a line holds a line feed")
            held.append(line)
            size += len(line)
            if size >= self.size:
                yield b"".join(held)
                held, size = [], 0
        if held:
            yield b"".join(held)

    def write(self, rows) -> Written:
        (store, at), name = store_of(self.path), f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.xz"
        chunks = self._chunks(rows)
        first = next(chunks, None)
        if first is None:
            return Written(None)
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/_{name}") as out:
            packed_blocks((c for part in ([first], chunks) for c in part), out.write)
        return Written(name)

    def commit(self, messages) -> None:
        store, at = store_of(self.path)
        store.create_dir(at, recursive=True)
        for m in messages:
            if m is not None and m.path:
                store.move(f"{at}/_{m.path}", f"{at}/{m.path}")

    def abort(self, messages) -> None:
        store, at = store_of(self.path)
        for m in messages:
            if m is not None and m.path:
                store.delete_file(f"{at}/_{m.path}")


class XzLines(DataSource):
    """Format xz_lines: file_name, offset (of the line in the inflated file, in bytes) and value of each line. Options: splitBytes to read, blockBytes to write."""

    @classmethod
    def name(cls) -> str:
        return "xz_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("xz_lines appends: use mode('append') and a new folder")
        names = [f.name for f in schema.fields]
        return Writer(self.options, "value" if "value" in names else names[0])
