"""Schemas of the tables that sources produce and operators take."""

ALIGNMENTS = (
    "sample STRING, sample_idx INT, qname STRING, flag INT, tid INT, pos BIGINT, mapq INT, cigar STRING, mtid INT, mpos BIGINT, "
    "tlen BIGINT, seq_len INT, nm BIGINT, align_score BIGINT, shard INT"
)
CONTIGS = "tid INT, contig STRING, length BIGINT"
GENOMES = "genome_idx INT, genome STRING, contig STRING"
GENES = "gene_id STRING, contig STRING, feature STRING, start BIGINT, end BIGINT, line_no BIGINT"
QUALITY = "genome STRING, completeness DOUBLE, contamination DOUBLE"
READS = "read_set STRING, mate INT, name STRING, seq STRING, qual STRING"

#: Flag bits of the SAM format.
PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, SUPPLEMENTARY = 0x1, 0x2, 0x4, 0x10, 0x40, 0x80, 0x100, 0x800
