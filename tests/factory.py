"""Small byte files for the readers."""

from __future__ import annotations

import struct

from strandcheck.plans.derived_files import BamFile, bgzf_block, encode_header, encode_record
from strandcheck.sources.bgzf import EOF_BLOCK

HEADER = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:248956422\n@RG\tID:rg1\tSM:S1\n@PG\tID:cellranger\tPN:cellranger\n"
REFS = [("chr1", 248956422)]


def record(**changes) -> dict:
    base = {
        "ref_id": 0, "pos": 100, "read_name": "r", "mapq": 255, "flag": 0, "l_seq": 50, "spliced": False,
        "cb": "AAACCCAAGGAGAGTA-1", "ub": "ACGTACGTACGT", "gx": "ENSG000001", "gn": "GENE1", "re": "E",
    }
    return base | changes


def write_bam(path: str, records: list[dict], text: str = HEADER, refs=REFS, index: bool = True, eof: bool = True):
    """A BAM written as the table jobs write theirs, with its index."""
    with open(path, "wb") as sink:
        bam = BamFile(sink, encode_header(text, refs), len(refs))
        for r in records:
            bam.add(r)
        size = bam.close()
    if not eof:
        with open(path, "r+b") as f:
            f.truncate(size - len(EOF_BLOCK))
    if index:
        with open(path + ".bai", "wb") as f:
            f.write(bam.index())


def one_member_bam(records: list[dict], text: str = HEADER, refs=REFS) -> tuple[bytes, int]:
    """Header and records in one block; also the in-block offset of the first record."""
    header = encode_header(text, refs)
    return bgzf_block(header + b"".join(encode_record(r) for r in records)) + EOF_BLOCK, len(header)


def bai(refs: list[dict], trailer: int | None = None, junk: bytes = b"") -> bytes:
    """Index bytes from ``{bins: [(bin, [(beg, end)])], linear: [..]}`` per reference."""
    out = b"BAI\x01" + struct.pack("<I", len(refs))
    for ref in refs:
        out += struct.pack("<I", len(ref.get("bins", [])))
        for number, chunks in ref.get("bins", []):
            out += struct.pack("<II", number, len(chunks))
            for beg, end in chunks:
                out += struct.pack("<QQ", beg, end)
        linear = ref.get("linear", [])
        out += struct.pack("<I", len(linear)) + struct.pack(f"<{len(linear)}Q", *linear)
    if trailer is not None:
        out += struct.pack("<Q", trailer)
    return out + junk


def at(block: int, within: int = 0) -> int:
    return block << 16 | within
