"""Small invented inputs, written by tests where they need them, and plain per-base values to compare with."""

import math

CONTIGS = [("alpha~one", 900), ("alpha~two", 700), ("beta~one", 1200), ("gamma~x", 120)]
#: (name, flag, contig, position from 1, mapping quality, CIGAR, mate's contig, edit distance)
RECORDS = [
    ("p1", 99, "alpha~one", 101, 60, "4M1D145M", "=", 3), ("p1", 147, "alpha~one", 301, 60, "150M", "=", 0),
    ("p2", 99, "alpha~one", 180, 20, "150M", "=", 1), ("p2", 147, "alpha~one", 420, 58, "20S130M", "=", 0),
    ("p3", 97, "alpha~two", 31, 50, "100M", "beta~one", 0), ("p3", 145, "beta~one", 201, 51, "50M10I90M", "alpha~two", 12),
    ("p4", 2113, "beta~one", 220, 50, "60M", "=", 0), ("p5", 257, "beta~one", 240, 50, "150M", "=", 2),
    ("p6", 77, "*", 0, 0, "*", "*", None), ("p6", 141, "*", 0, 0, "*", "*", None), ("p7", 0, "beta~one", 1151, 60, "100M", "*", 0),
]


def sam(path):
    lines = ["@HD\tVN:1.6\tSO:unsorted", *(f"@SQ\tSN:{n}\tLN:{x}" for n, x in CONTIGS)]
    for name, flag, contig, pos, mapq, cigar, mate, nm in RECORDS:
        lines.append("\t".join([name, str(flag), contig, str(pos), str(mapq), cigar, mate, "0", "0", "A" * 150, "*", *([f"NM:i:{nm}", f"AS:i:{150 - nm}"] if nm is not None else [])]))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def parsed(cigar):
    out, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        elif c != "*":
            out.append((int(n), c))
            n = ""
    return out


def used(mapq=0, proper=False, secondary=False):
    """The mapped records that count, by default."""
    return [r for r in RECORDS if not r[1] & 4 and (secondary or not r[1] & 256) and r[4] >= mapq and (not proper or r[1] & 2)]


def depths(contig, records):
    """The depth of each base of a contig."""
    out = [0] * dict(CONTIGS)[contig]
    for r in records:
        if r[2] == contig:
            at = r[3] - 1
            for n, op in parsed(r[5]):
                if op in "M=X":
                    for p in range(at, min(at + n, len(out))):
                        out[p] += 1
                at += n if op in "M=XDN" else 0
    return out


def inner(contig, records, ends=75):
    """Depths without the ends; a contig without records counts whole if its ends would overlap."""
    all_ = depths(contig, records)
    seen = any(r[2] == contig for r in records)
    if len(all_) < 2 * ends:
        return [] if seen else all_
    return all_[ends : len(all_) - ends]


def identity(r):
    n = sum(k for k, op in parsed(r[5]) if op in "MID=X")
    return (n - r[7]) / n


def trimmed(values, low=0.05, high=0.95):
    """The sum of the sorted depths from place ``lo`` to ``hi`` (from 1) over their distance. As in published results, the place after
    ``hi`` counts as well where its depth, or that of ``hi``, is not the one that ``lo`` has."""
    lo, hi = math.floor(low * len(values)), math.ceil(high * len(values))
    values = sorted(values)
    same = values.count(values[max(lo - 1, 0)]) + values.index(values[max(lo - 1, 0)])
    return sum(values[max(lo - 1, 0) : hi if hi < same else hi + 1]) / (hi - lo)


def variance(values):
    mean = sum(values) / len(values)
    return sum((x - mean) ** 2 for x in values) / (len(values) - 1)


def gff(path):
    rows = [
        "##gff-version 3", "# a comment", "alpha~one\ttool\tCDS\t101\t500\t.\t+\t0\tID=first;Name=other", "alpha~two\ttool\tgene\t1\t700\t.\t-\t.\tlocus_tag=second",
        "beta~one\ttool\tCDS\t1000\t5000\t.\t+\t0\t", "beta~one\ttool\tCDS\t0\t50\t.\t+\t0\tID=no_place", "beta~one\ttool\tCDS", "elsewhere\ttool\tCDS\t1\t50\t.\t+\t0\tgene_id \"third\"; x \"y\"",
    ]
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def fasta(path, sequences, width=60):
    path.write_text("".join(f">{n} some text\n" + "".join(s[i : i + width] + "\n" for i in range(0, len(s), width)) for n, s in sequences))
    return str(path)


def fastq(path, reads):
    path.write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in reads))
    return str(path)
