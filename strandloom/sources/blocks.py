"""Alignments from block-compressed binary files (BAM), as a data source of Spark's with partitions inside of files.

Such a file is a row of gzip blocks of at most 64 KB, and records run over their ends. A partition is a range of bytes:
it looks for the first block that starts in it, told by the block's magic and by the block that follows, and in what
that holds for the first record, told by fields that fit together in a row of records. It reads on over its end to
finish the last record that starts in one of its blocks. So nobody reads a file from its start, and the driver reads the header only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar array<struct<op:int,len:int>>, seq string, tags map<string,string>"
SPLIT = 64 << 20
#: What a block begins with, its size apart; letters of packed bases; formats of tag values.
MAGIC, EXTRA = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
BASES = "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
#: Records that have to fit together to be believed, and the most bytes of one.
CHAIN, LARGEST = 8, 64 << 20


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def block_size(head: bytes) -> int | None:
    """The bytes of the block that begins here, None if none does."""
    if len(head) < 18 or head[:4] != MAGIC or head[12:16] != EXTRA:
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


class Blocks:
    """What the blocks of a file hold from a place on, as bytes in one row."""

    def __init__(self, file, at: int):
        self.file, self.at, self.size = file, at, file.size()
        self.data = bytearray()
        #: (place in the file, place in the data) of each block read.
        self.starts: list[tuple[int, int]] = []

    def more(self) -> bool:
        """Read one block more."""
        if self.at >= self.size:
            return False
        self.file.seek(self.at)
        raw = self.file.read(1 << 16)
        n = block_size(raw)
        if n is None:
            raise ValueError(f"no block at byte {self.at}")
        self.starts.append((self.at, len(self.data)))
        self.data += zlib.decompress(raw[18 : n - 8], -15)
        self.at += n
        return True

    def has(self, end: int) -> bool:
        while len(self.data) < end:
            if not self.more():
                return False
        return True


def first_block(file, at: int, end: int) -> int | None:
    """The first block that begins in at .. end - 1: one that another follows, or the file's end."""
    file.seek(at)
    window = file.read(min(end - at, 1 << 17) + 18)
    found = window.find(MAGIC)
    while 0 <= found < end - at:
        n = block_size(window[found : found + 18])
        if n is not None:
            after = at + found + n
            file.seek(after)
            if after == file.size() or block_size(file.read(18)) is not None:
                return at + found
        found = window.find(MAGIC, found + 1)
    return None


def read_header(blocks: Blocks) -> tuple[list[tuple[str, int]], int]:
    """References (name, length), and where the records begin in the data."""
    if not blocks.has(8) or blocks.data[:4] != b"BAM\x01":
        raise ValueError("no binary alignments")
    at = 8 + struct.unpack_from("<i", blocks.data, 4)[0]
    blocks.has(at + 4)
    (n,), at = struct.unpack_from("<i", blocks.data, at), at + 4
    out = []
    for _ in range(n):
        blocks.has(at + 4)
        (size,) = struct.unpack_from("<i", blocks.data, at)
        blocks.has(at + 8 + size)
        out.append((bytes(blocks.data[at + 4 : at + 3 + size]).decode(), struct.unpack_from("<i", blocks.data, at + 4 + size)[0]))
        at += 8 + size
    return out, at


def _fits(data: bytearray, at: int, references: int) -> int | None:
    """The end of a record that may begin here; None if its fields don't fit."""
    size, ref, pos, name, _, _, ops, _, bases, other, _, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (32 < size <= LARGEST and -1 <= ref < references and pos >= -1 and name > 1 and bases >= 0 and -1 <= other < references):
        return None
    if 32 + name + 4 * ops + (bases + 1) // 2 + bases > size:
        return None
    said = data[at + 36 : at + 36 + name]
    if len(said) == name and (said[-1] or any(not 33 <= c <= 126 for c in said[:-1])):
        return None
    return at + 4 + size


def first_record(blocks: Blocks, references: int) -> int | None:
    """Where in the data of some blocks the first record begins; None if none begins in the first block."""
    blocks.has(1)
    first = len(blocks.data)
    for start in range(first):
        at, seen = start, 0
        while seen < CHAIN:
            if not blocks.has(at + 36):
                seen = CHAIN if at == len(blocks.data) and seen else -1  # records end with the file
                break
            end = _fits(blocks.data, at, references)
            if end is None:
                seen = -1
                break
            at, seen = end, seen + 1
        if seen >= CHAIN:
            return start
    return None


def _tags(raw: bytes) -> dict[str, str]:
    out, at = {}, 0
    while at < len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in NUMBERS:
            form = "<" + NUMBERS[kind]
            value, at = f"{struct.unpack_from(form, raw, at)[0]:g}" if kind == "f" else str(struct.unpack_from(form, raw, at)[0]), at + struct.calcsize(form)
        elif kind == "A":
            value, at = chr(raw[at]), at + 1
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            value, at = raw[at:end].decode(), end + 1
        else:
            item, (n,) = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)
            form = f"<{n}{NUMBERS[item]}"
            values = struct.unpack_from(form, raw, at + 5)
            value, at = ",".join([item, *(f"{v:g}" if item == "f" else str(v) for v in values)]), at + 5 + struct.calcsize(form)
        out[name] = value
    return out


def record(raw: bytes, names: list[str]) -> tuple:
    """A row of ``SCHEMA`` from the bytes of a record, its size apart."""
    ref, pos, name, mapq, _, ops, flag, bases = struct.unpack_from("<iiBBHHHi", raw, 0)
    at = 32 + name
    cigar = [{"op": x & 15, "len": x >> 4} for x in struct.unpack_from(f"<{ops}I", raw, at)]
    at += 4 * ops
    packed = raw[at : at + (bases + 1) // 2]
    seq = "".join(BASES[x >> 4] + BASES[x & 15] for x in packed)[:bases] or "*"
    return raw[32 : 31 + name].decode(), flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, seq, _tags(raw[at + len(packed) + bases :])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class BlockReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split
        with _open(path) as file:
            self.size = file.size()
            self.references, _ = read_header(Blocks(file, 0))

    def partitions(self) -> list[InputPartition]:
        return [Range(self.path, at, min(at + self.split, self.size)) for at in range(0, self.size, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = [n for n, _ in self.references]
        with _open(partition.path) as file:
            begin = first_block(file, partition.start, partition.end)
            while begin is not None and begin < partition.end:
                blocks = Blocks(file, begin)
                at = read_header(blocks)[1] if begin == 0 else first_record(blocks, len(names))
                if at is not None:
                    break
                begin = blocks.starts[1][0] if len(blocks.starts) > 1 else None  # a block within a long record, or an empty one
            else:
                return
            while blocks.has(at + 4):
                while len(blocks.starts) > 1 and blocks.starts[1][1] <= at:
                    blocks.starts.pop(0)
                if blocks.starts[0][0] >= partition.end:
                    return
                (size,) = struct.unpack_from("<i", blocks.data, at)
                if not blocks.has(at + 4 + size):
                    raise ValueError("a record ends early")
                yield record(bytes(blocks.data[at + 4 : at + 4 + size]), names)
                at += 4 + size
                if at > 1 << 22:
                    del blocks.data[:at]
                    blocks.starts = [(f, d - at) for f, d in blocks.starts]
                    at = 0


class BlockAlignments(DataSource):
    """Option path: the file; option split: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "block_alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_blocks(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Alignments and references (rname, length), as ``readers.read_sam`` gives them for the text form."""
    spark.dataSource.register(BlockAlignments)
    align = spark.read.format("block_alignments").option("path", path).option("split", split).load()
    with _open(path) as file:
        references, _ = read_header(Blocks(file, 0))
    return align, spark.createDataFrame(references, "rname string, length long")
