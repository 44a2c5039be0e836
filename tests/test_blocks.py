"""Block-compressed alignments against their text form, in partitions of all sizes."""

import random
import struct
import zlib

import pytest

from strandloom.sources import blocks
from strandloom.sources.readers import read_sam

OPS = "MIDNSHP=X"


def block(data):
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def binary(rows, references):
    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references).encode()
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    for n, size in references:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    places = [n for n, _ in references]
    for name, flag, ref, pos, mapq, cigar, seq, tags in rows:
        bases = "" if seq == "*" else seq
        codes = [blocks.BASES.index(c) for c in bases + "=" * (len(bases) % 2)]
        body = struct.pack("<iiBBHHHiiii", places.index(ref) if ref != "*" else -1, pos - 1, len(name) + 1, mapq, 0, len(cigar), flag, len(bases), -1, -1, 0)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in cigar)
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + b"\xff" * len(bases)
        for tag, kind, value in tags:
            body += tag.encode() + kind.encode() + (value.encode() + b"\0" if kind == "Z" else value.encode() if kind == "A" else struct.pack("<i", int(value)))
        out += struct.pack("<i", len(body)) + body
    return out


def sample(seed, n):
    rng = random.Random(seed)
    references = [(f"gene{i}", rng.randint(50, 900)) for i in range(12)]
    rows = []
    for i in range(n):
        cigar = [(rng.randint(1, 30), rng.choice("SH")), *((rng.randint(1, 40), o) for o in rng.choices("=XID", k=rng.randint(1, 5)))]
        seq = "*" if rng.random() < 0.2 else "".join(rng.choice("ACGT") for _ in range(rng.choice((5, 90, 3000))))
        ref = "*" if rng.random() < 0.05 else rng.choice(references)[0]
        rows.append((f"read{i}", rng.choice((0, 4, 16, 256)), ref, rng.randint(1, 40), rng.randint(0, 60), cigar, seq, [("NM", "i", str(rng.randint(0, 9))), ("MD", "Z", f"{i}A3"), ("tp", "A", "P")]))
    return rows, references


def sam(rows, references):
    lines = [f"@SQ\tSN:{n}\tLN:{size}" for n, size in references]
    for name, flag, ref, pos, mapq, cigar, seq, tags in rows:
        lines.append("\t".join([name, str(flag), ref, str(pos), str(mapq), "".join(f"{n}{o}" for n, o in cigar), "*", "0", "0", seq, "*", *(":".join(t) for t in tags)]))
    return "\n".join(lines) + "\n"


def plain(row):
    return (row["qname"], row["flag"], row["rname"], row["pos"], row["mapq"], tuple((c["op"], c["len"]) for c in row["cigar"]), row["seq"], tuple(sorted(row["tags"].items())))


@pytest.mark.parametrize("seed,size,split", [(1, 60_000, 1 << 26), (2, 700, 3000), (3, 61, 500)])
def test_as_the_text_form(spark, tmp_path, seed, size, split):
    rows, references = sample(seed, 400)
    data = binary(rows, references)
    (tmp_path / "a.bam").write_bytes(b"".join(block(data[i : i + size]) for i in range(0, len(data), size)) + block(b""))
    (tmp_path / "a.sam").write_text(sam(rows, references))
    text, lengths = read_sam(spark, str(tmp_path / "a.sam"))
    align, told = blocks.read_blocks(spark, str(tmp_path / "a.bam"), split)
    assert sorted(map(plain, align.collect())) == sorted(map(plain, text.collect()))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, lengths.collect()))
    assert (align.rdd.getNumPartitions() > 10) == (split < 1 << 20)


def test_no_records_and_no_such_file(spark, tmp_path):
    (tmp_path / "none.bam").write_bytes(block(binary([], [("g", 5)])) + block(b""))
    assert blocks.read_blocks(spark, str(tmp_path / "none.bam"))[0].count() == 0
    (tmp_path / "bad.bam").write_bytes(block(b"something else"))
    with pytest.raises(ValueError, match="no binary alignments"):
        blocks.read_blocks(spark, str(tmp_path / "bad.bam"))[0].count()
