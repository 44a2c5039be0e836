"""Scalar functions on signed symbols, strands, cigars and DNA. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JOIN = "~~~"
_BAD_CALL = "a call needs a strand, + or -, and a name"


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def split_call(call: Column) -> Column:
    """struct<name, strand> of a call such as ``+geneA``; spaces in names become underscores."""
    sign, name = F.substring(call, 1, 1), F.substring(call, 2, 1 << 30)
    good = sign.isin("+", "-") & (F.length(name) > 0)
    clean = _checked(good, F.replace(name, F.lit(" "), F.lit("_")), _BAD_CALL)
    return F.when(call.isNotNull(), F.struct(clean.alias("name"), F.when(sign == "-", -1).otherwise(1).cast("tinyint").alias("strand")))


def call_name(call: Column) -> Column:
    return F.replace(F.substring(call, 2, 1 << 30), F.lit(" "), F.lit("_"))


def call_strand(call: Column) -> Column:
    return strand_to_int(F.substring(call, 1, 1))


def make_call(name: Column, strand: Column) -> Column:
    return F.concat(strand_to_text(strand), name)


def strand_to_int(sign: Column) -> Column:
    known = F.when(sign == "+", "1").when(sign == "-", "-1")
    return F.when(sign.isNotNull(), _checked(known.isNotNull(), known, "a strand is + or -").cast("int"))


def strand_to_text(strand: Column) -> Column:
    known = F.when(strand == 1, "+").when(strand == -1, "-")
    return F.when(strand.isNotNull(), _checked(known.isNotNull(), known, "a strand is 1 or -1"))


def reverse_strand(strand: Column) -> Column:
    return strand_to_int(strand_to_text(-strand))


def flip(call: Column) -> Column:
    """The call on the other strand; a gap stays a gap and anything else has no other strand."""
    rest = F.substring(call, 2, 1 << 30)
    return F.when(call == "*", call).when(call.startswith("+"), F.concat(F.lit("-"), rest)).when(call.startswith("-"), F.concat(F.lit("+"), rest))


def name_digest(name: Column) -> Column:
    """SHA-256 of a name as it is framed by protocol 4 of Python's pickle, in hex; for names of 1 to 251 bytes."""
    n = F.octet_length(name)
    frame = F.concat(F.unhex(F.lit("800495")), F.unhex(F.lpad(F.hex(n + 4), 2, "0")), F.unhex(F.lit("00" * 7 + "8c")), F.unhex(F.lpad(F.hex(n), 2, "0")), F.encode(name, "UTF-8"), F.unhex(F.lit("942e")))
    return F.sha2(frame, 256)


def order_key(call: Column) -> Column:
    """A text that sorts calls as signed 256-bit numbers sort: negative ones first and mirrored."""
    digest = name_digest(call_name(call))
    return F.when(call.startswith("+"), F.concat(F.lit("1"), digest)).otherwise(F.concat(F.lit("0"), F.translate(digest, "0123456789abcdef", "fedcba9876543210")))


def clean_name(name: Column) -> Column:
    return F.translate(name, "|()-*+#:=/,'", "")


def label(genes: Column) -> Column:
    return F.array_join(genes, JOIN)


def same(a: Column, b: Column) -> Column:
    """1 if equal, else 0: the score of an aligned pair."""
    return (a == b).cast("int")


def reverse_complement(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ACGTacgt", "TGCAtgca"))


# Cigars are arrays of struct<op: int, len: int>, ops numbered as in the BAM format.
HARD_CLIP, SOFT_CLIP, EQUAL, DIFF, MATCH, INSERT, DELETE = 5, 4, 7, 8, 0, 1, 2
_OPS = "MIDNSHP=X"


def parse_cigar(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct((F.instr(F.lit(_OPS), F.substring(p, -1, 1)) - 1).cast("int").alias("op"), F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("len")))


def _total(cigar: Column, keep) -> Column:
    return F.aggregate(F.filter(cigar, keep), F.lit(0), lambda acc, c: acc + c["len"])


def region_start(cigar: Column) -> Column:
    """The last base of a leading hard clip, counted from 0, or 0."""
    first = F.get(cigar, F.lit(0))
    return F.when(first["op"] == HARD_CLIP, first["len"] - 1).otherwise(0)


def region_length(cigar: Column) -> Column:
    return _total(cigar, lambda c: c["op"] != HARD_CLIP)


def region_end(cigar: Column, start: Column) -> Column:
    return start + region_length(cigar) - 1


def cigar_sum(cigar: Column, *ops: int) -> Column:
    return _total(cigar, lambda c: c["op"].isin(*ops))


def mapped_call(reference: Column, flag: Column) -> Column:
    """The call that an alignment makes: the reference's name, by the strand of the flag."""
    name = F.replace(reference, F.lit(JOIN), F.lit(";"))
    for end in (".aln.fas", ".fasta", ".fa"):
        name = F.replace(name, F.lit(end), F.lit(""))
    return F.concat(F.when(flag.bitwiseAND(F.lit(16)) != 0, "-").otherwise("+"), name)
