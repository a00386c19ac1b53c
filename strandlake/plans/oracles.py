"""The registered queries in SQL that DuckDB runs. They use the arithmetic of the test bed, not its CIGAR strings."""

from __future__ import annotations

_ALNS = """
c AS (SELECT p_partkey AS tid, concat(p_brand, '~', cast(p_partkey AS varchar)) AS contig, p_brand AS genome, cast(500 + p_size * 20 AS bigint) AS len, p_size AS size FROM part),
a0 AS (SELECT l_returnflag AS sample, l_partkey AS tid, l_orderkey, l_linenumber, l_suppkey, l_linestatus, cast(l_quantity AS bigint) AS n1, cast(l_quantity AS bigint) + 10 AS n2,
              cast(round(l_discount * 100) AS bigint) % 3 AS nd, cast(round(l_tax * 100) AS bigint) AS mm FROM lineitem),
a AS (SELECT sample, tid, contig, genome, len, n1, n2, nd, mm + nd AS nm, l_suppkey, (l_orderkey * 7919 + l_linenumber * 104729 + l_suppkey * 31) % (len - (n1 + n2 + nd)) AS pos,
             l_linenumber = 7 AS sup, l_linenumber = 6 AS sec, l_linestatus = 'F' AS proper, l_suppkey % 37 = 0 AS unm,
             CASE WHEN l_suppkey % 61 = 60 THEN 255 ELSE l_suppkey % 61 END AS mapq, n1 + n2 + l_linenumber AS seq_len, n1 + n2 - mm - nd AS score,
             row_number() OVER (PARTITION BY sample, tid ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM a0 JOIN c USING (tid)),
s AS (SELECT sample, count(*) FILTER (NOT sup AND NOT sec) AS num_reads FROM a GROUP BY sample)"""


def _depth(where: str, e: int) -> str:
    """Used records, runs of depth, and depths of each contig."""
    return f"""
u AS (SELECT * FROM a WHERE NOT unm AND ({where})),
bl AS (SELECT sample, tid, len, pos AS s, pos + n1 AS e FROM u UNION ALL SELECT sample, tid, len, pos + n1 + nd, pos + n1 + nd + n2 FROM u),
de AS (SELECT sample, tid, len, s AS p, 1 AS d FROM bl UNION ALL SELECT sample, tid, len, e, -1 FROM bl WHERE e < len),
pts AS (SELECT sample, tid, len, p, sum(d) AS d FROM de GROUP BY ALL),
runs AS (SELECT sample, tid, len, p AS s, lead(p, 1, len) OVER (PARTITION BY sample, tid ORDER BY p) AS e,
                cast(sum(d) OVER (PARTITION BY sample, tid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS depth FROM pts),
ct AS (SELECT sample, tid, count(*) AS n_all, count(*) FILTER (NOT sup) AS n_no_sup, count(*) FILTER (NOT sup AND NOT sec) AS n_primary,
              sum((n1 + n2 + nd - nm) / (n1 + n2 + nd)::double) FILTER (NOT sup AND NOT sec) AS same_primary, sum((n1 + n2 + nd - nm) / (n1 + n2 + nd)::double) FILTER (NOT sup) AS same_no_sup FROM u GROUP BY ALL),
cf AS (SELECT s.sample, c.*, n_all IS NOT NULL AS seen, coalesce(n_all, 0) AS n_all, coalesce(n_no_sup, 0) AS n_no_sup, coalesce(n_primary, 0) AS n_primary,
              coalesce(same_primary, 0) AS same_primary, coalesce(same_no_sup, 0) AS same_no_sup,
              CASE WHEN n_all IS NULL AND len < {2 * e} THEN len ELSE greatest(len - {2 * e}, 0) END AS windowed FROM s CROSS JOIN c LEFT JOIN ct USING (sample, tid)),
cd AS (SELECT sample, tid, depth, sum(e - s) AS n_full, sum(greatest(0, least(e, len - {e}) - greatest(s, {e}))) AS n_win FROM runs WHERE depth > 0 AND e > s GROUP BY ALL)"""


def _stats(key: str, reads: str, same: str, m: float, where: str = "true", source: str = "") -> str:
    """Statistics of entries: ``f`` has facts and ``dc`` depths by (sample, k)."""
    made = source or f"""
f AS (SELECT sample, {key} AS k, windowed, len, {reads} AS reads, {same} AS same, seen FROM cf WHERE {where}),
dc AS (SELECT sample, {key} AS k, depth, n_full, n_win FROM cd JOIN c USING (tid) WHERE {where})"""
    return (
        made
        + f""",
st AS (SELECT sample, k, sum(windowed) AS B, sum(len) AS L, sum(reads) AS R, sum(same) AS I, bool_or(seen) AS seen FROM f GROUP BY ALL),
mo AS (SELECT sample, k, sum(depth * n_win) AS s1, sum(depth * depth * n_win) AS s2, sum(n_win) AS C, sum(n_full) AS CF, min(CASE WHEN n_win > 0 THEN depth END) AS lo FROM dc GROUP BY ALL),
x0 AS (SELECT sample, k, B::bigint AS B, L::bigint AS L, R::bigint AS R, I, seen, coalesce(s1, 0)::bigint AS s1, coalesce(s2, 0)::bigint AS s2, coalesce(C, 0)::bigint AS C, coalesce(CF, 0)::bigint AS CF,
              CASE WHEN coalesce(C, 0) < B THEN 0 ELSE coalesce(lo, 0) END AS v FROM st LEFT JOIN mo USING (sample, k)),
h AS (SELECT sample, k, depth, sum(n_win)::bigint AS n FROM dc GROUP BY ALL HAVING sum(n_win) > 0 UNION ALL SELECT sample, k, 0, B - C FROM x0),
h1 AS (SELECT h.*, sum(n) OVER (PARTITION BY sample, k ORDER BY depth) AS upto, floor(0.05::double * B)::bigint AS lo, ceil(0.95::double * B)::bigint AS hi FROM h JOIN x0 USING (sample, k)),
h2 AS (SELECT *, upto - n AS before, min(CASE WHEN upto >= lo THEN depth END) OVER (PARTITION BY sample, k) AS first FROM h1),
tr AS (SELECT sample, k, sum(depth * CASE WHEN depth = first THEN least(upto, hi) - lo + 1 WHEN depth > first AND upto <= hi THEN n WHEN depth > first AND before <= hi THEN hi - before + 1 ELSE 0 END)::double
              / nullif(max(hi - lo), 0) AS trimmed FROM h2 GROUP BY ALL),
x AS (SELECT x0.*, B > 0 AND C / nullif(B, 0)::double >= {m}::double AS ok, L > 0 AND CF / nullif(L, 0)::double >= {m}::double AS okf, trimmed FROM x0 LEFT JOIN tr USING (sample, k)),
m AS (SELECT sample, k AS entry, seen, R, L, CASE WHEN ok THEN s1 / B::double ELSE 0.0 END::double AS mean, CASE WHEN ok AND C > 0 THEN coalesce(trimmed, 0.0) ELSE 0.0 END::double AS trimmed_mean,
             CASE WHEN okf THEN CF / L::double ELSE 0.0 END::double AS covered_fraction, CASE WHEN okf THEN CF ELSE 0 END::double AS covered_bases,
             CASE WHEN ok AND B >= 3 THEN ((s2 - 2 * v * s1 + v * v * B) - ((s1 - v * B)::double * (s1 - v * B)::double) / B::double) / (B - 1)::double ELSE 0.0 END::double AS variance,
             L::double AS length, R::double AS count, CASE WHEN L > 0 THEN R / L::double ELSE 0.0 END::double AS reads_per_base, CASE WHEN R > 0 THEN I / R::double ELSE 0.0 END::double AS anir,
             CASE WHEN okf THEN R * 1000000000 / L::double ELSE 0.0 END::double AS rpkm, CASE WHEN okf THEN R / L::double ELSE 0.0 END::double AS tpm FROM x)"""
    )


def _rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns)


_USED = "NOT sec"


def _contig(columns: list[str], e: int = 75, m: float = 0.0, where: str = _USED, extra: str = "") -> str:
    return f"WITH {_ALNS},{_depth(where, e)},{_stats('contig', 'n_primary', 'same_primary', m)} SELECT sample, entry, {_rounded(columns)} FROM m {extra}"


_KEYS = {"map": ("genome", "n_all", "same_no_sup", "tid % 10 <> 9"), "separator": ("genome", "n_no_sup", "same_primary", "true"), "single": ("'genome1'", "n_no_sup", "same_primary", "true")}


def _with_genome(mode: str, m: float = 0.0) -> str:
    key, reads, same, where = _KEYS[mode]
    return f"WITH {_ALNS},{_depth(_USED, 75)},{_stats(key, reads, same, m, where)}"


def _genome(columns: list[str], mode: str, m: float = 0.0) -> str:
    return f"{_with_genome(mode, m)} SELECT sample, entry, {_rounded(columns)} FROM m"


def _final(start: str, shown: str, positive: str) -> str:
    """Second stage over ``m``: ``t`` has the totals of samples."""
    return f"""{start},
t AS (SELECT sample, num_reads, coalesce(n, 0) AS num_mapped FROM s LEFT JOIN (SELECT sample, sum(R)::bigint AS n FROM m WHERE seen AND ({positive}) > 0 GROUP BY sample) USING (sample)),
z AS (SELECT m.*, num_reads, num_mapped, sum(tpm) OVER w AS st, sum(mean) OVER w AS sm FROM m JOIN t USING (sample) WINDOW w AS (PARTITION BY sample))
SELECT sample, entry, {shown} FROM z"""


def _contig_start() -> str:
    return f"WITH {_ALNS},{_depth(_USED, 75)},{_stats('contig', 'n_primary', 'same_primary', 0.0)}"


_RPKM, _TPM = "round(CASE WHEN num_mapped > 0 THEN rpkm / num_mapped::double ELSE 0.0 END, 6) AS rpkm", "round(CASE WHEN st > 0 THEN tpm / st * 1000000 ELSE 0.0 END, 6) AS tpm"


def _genes(columns: list[str], where: str = "true") -> str:
    source = f"""
g AS (SELECT concat('g', cast(tid AS varchar), 'a') AS k, tid, 10 + size AS s, 210 + size AS e FROM c WHERE {where}
      UNION ALL SELECT concat('g', cast(tid AS varchar), 'b'), tid, 150 + 3 * size, least(5000 + size, len) FROM c WHERE {where}),
gr AS (SELECT sample, k, count(*) AS n, sum((n1 + n2 + nd - nm) / (n1 + n2 + nd)::double) AS same FROM u JOIN g ON u.tid = g.tid AND pos >= g.s AND pos < g.e WHERE NOT sup AND NOT sec GROUP BY ALL),
f AS (SELECT s.sample, g.k, greatest(e - g.s - 150, 0) AS windowed, e - g.s AS len, coalesce(n, 0) AS reads, coalesce(same, 0) AS same, true AS seen FROM s CROSS JOIN g LEFT JOIN gr ON gr.sample = s.sample AND gr.k = g.k),
dc AS (SELECT sample, k, depth, sum(least(r.e, g.e) - greatest(r.s, g.s)) AS n_full, sum(greatest(0, least(r.e, g.e - 75) - greatest(r.s, g.s + 75))) AS n_win
       FROM runs r JOIN g ON r.tid = g.tid AND r.s < g.e AND g.s < r.e WHERE depth > 0 AND r.e > r.s GROUP BY ALL)"""
    return f"WITH {_ALNS},{_depth(_USED, 75)},{_stats('', '', '', 0.0, source=source)} SELECT sample, entry, {_rounded(columns)} FROM m"


def _counted(where: str, source: str = "a") -> str:
    return f"WITH {_ALNS} SELECT sample, cast(tid AS int) AS tid, count(*) AS n, sum(pos)::bigint AS sum_pos, sum(nm)::bigint AS sum_nm, count(*) FILTER (unm) AS n_unmapped FROM {source} WHERE {where} GROUP BY sample, tid"


_MATES = """(SELECT p.*, q.ok AS pair_ok FROM (SELECT *, (rn - 1) // 2 AS pair FROM a) p JOIN (
    SELECT sample, tid, (rn - 1) // 2 AS pair, sum(n1 + n2) >= 90 AND 1 - sum(nm) / sum(n1 + n2)::double >= 0.93::double AND bool_and(1 - nm / (n1 + n2 + nd)::double >= 0.9::double) AS ok3,
           sum(n1 + n2) >= 90 AND 1 - sum(nm) / sum(n1 + n2)::double >= 0.93::double AS ok FROM a WHERE proper AND NOT sup AND NOT sec AND NOT unm GROUP BY ALL HAVING count(*) = 2) q
    ON p.sample = q.sample AND p.tid = q.tid AND p.pair = q.pair WHERE p.proper AND NOT p.sup AND NOT p.sec AND NOT p.unm)"""
_IDENT, _ALL = "1 - nm / (n1 + n2 + nd)::double >= 0.95::double", ["mean", "trimmed_mean", "covered_fraction", "covered_bases", "variance", "length", "count", "reads_per_base", "anir"]

SQL: dict[str, str] = {
    "genome_relative_abundance": _final(
        _with_genome("separator", 0.1),
        "round(mean * 100 * (num_mapped / num_reads::double) / sm, 6) AS relative_abundance, round(mean, 9) AS mean, round(covered_fraction, 9) AS covered_fraction", "greatest(mean, covered_fraction)",
    ),
    "contig_mean": _contig(["mean"]),
    "contig_mean_no_exclusion": _contig(["mean"], e=0),
    "contig_trimmed_mean": _contig(["trimmed_mean"]),
    "contig_histogram": f"{_contig_start()}, top AS (SELECT sample, k, max(depth) AS top FROM h JOIN (SELECT sample, k FROM x0 WHERE seen AND B > 0) USING (sample, k) GROUP BY ALL) "
    "SELECT sample, k AS entry, d::bigint AS depth, coalesce(n, 0)::bigint AS n_bases FROM (SELECT sample, k, unnest(range(0, top + 1)) AS d FROM top) LEFT JOIN h USING (sample, k) WHERE h.depth = d "
    "UNION ALL SELECT sample, k, d::bigint, 0::bigint FROM (SELECT sample, k, unnest(range(0, top + 1)) AS d FROM top) q WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sample = q.sample AND h.k = q.k AND h.depth = q.d)",
    "contig_covered_fraction": _contig(["covered_fraction"]),
    "contig_covered_bases": _contig(["covered_bases"]),
    "contig_variance": _contig(["variance"]),
    "contig_length": _contig(["length"]),
    "contig_count": _contig(["count"]),
    "contig_reads_per_base": _contig(["reads_per_base"]),
    "contig_anir": _contig(["anir"]),
    "contig_rpkm": _final(_contig_start(), _RPKM, "rpkm"),
    "contig_tpm": _final(_contig_start(), _TPM, "tpm"),
    "contig_metabat": f"WITH {_ALNS},{_depth('1 - nm / (n1 + n2 + nd)::double >= 0.97001::double', 75)},{_stats('contig', 'n_primary', 'same_primary', 0.0)} "
    "SELECT entry AS contigName, max(L) AS contigLen, round(sum(mean) / 3, 4) AS totalAvgDepth, "
    + ", ".join(f"round(max(mean) FILTER (sample = '{n}'), 4) AS {n}_bam, round(max(variance) FILTER (sample = '{n}'), 4) AS {n}_bam_var" for n in "ANR")
    + " FROM m GROUP BY entry",
    "contig_all_methods": _contig(_ALL),
    "contig_no_zeros": _contig(["mean", "covered_bases"], extra="WHERE seen AND greatest(mean, covered_bases) > 0"),
    "contig_min_covered_fraction": _contig(["mean", "covered_fraction", "variance"], m=0.5),
    "contig_thresholds": _contig(["mean", "count"], where=f"NOT sec AND {_IDENT} AND mapq >= 20 AND mapq <> 255"),
    "contig_proper_pairs": _contig(["mean", "count"], where="NOT sec AND NOT sup AND proper"),
    "genome_mean_map": _genome(["mean"], "map"),
    "genome_mean_separator": _genome(["mean"], "separator"),
    "genome_single": _genome(_ALL, "single"),
    "genome_unmapped": f"{_with_genome('separator')}, t AS (SELECT sample, num_reads, sum(R)::bigint AS num_mapped FROM m JOIN s USING (sample) WHERE seen AND mean > 0 GROUP BY ALL) "
    "SELECT sample, 'unmapped' AS entry, round(100.0::double * (1.0::double - num_mapped / num_reads::double), 6) AS relative_abundance FROM t",
    "genome_trimmed_mean": _genome(["trimmed_mean"], "map"),
    "genome_variance": _genome(["variance"], "map"),
    "genome_rpkm": _final(_with_genome("separator"), _RPKM, "rpkm"),
    "genome_tpm": _final(_with_genome("separator"), _TPM, "tpm"),
    "genome_count_map_mode": _genome(["count", "anir"], "map"),
    "gene_mean": _genes(["mean", "covered_fraction", "covered_bases"]),
    "gene_count": _genes(["count", "reads_per_base", "anir", "length"]),
    "gene_genome_mean": _genes(["mean", "variance"], "tid % 10 <> 9"),
    "filter_flags": _counted("proper AND NOT sup AND NOT sec"),
    "filter_single_identity": _counted(f"NOT sec AND NOT unm AND {_IDENT}"),
    "filter_single_length": _counted("NOT sec AND NOT unm AND n1 + n2 + nd >= 60"),
    "filter_aligned_percent": _counted("NOT sec AND NOT unm AND (n1 + n2 + nd) / seq_len::double >= 0.96::double"),
    "filter_mapq": _counted("NOT sec AND NOT unm AND mapq >= 30 AND mapq <> 255"),
    "filter_pairs": _counted("pair_ok", _MATES.replace("q.ok AS", "q.ok3 AS")),
    "filter_pairs_inverse": _counted("keep", f"(SELECT sample, tid, pos, nm, unm, true AS keep FROM {_MATES} WHERE NOT pair_ok UNION ALL SELECT sample, tid, pos, nm, unm, true FROM a WHERE NOT sup AND NOT sec AND (unm OR NOT proper))"),
    "filter_inverse": _counted(f"NOT sec AND (unm OR NOT ({_IDENT}))"),
    "filter_proper_pairs": _counted("true", _MATES),
    "shard_best_hit": f"WITH {_ALNS} SELECT sample, contig, count(*) AS n, sum(score)::bigint AS score FROM a WHERE NOT unm AND NOT sup AND NOT sec GROUP BY ALL",
    "shard_excluded": f"WITH {_ALNS} SELECT sample, contig, count(*) AS n, sum(score)::bigint AS score FROM a WHERE NOT unm AND NOT sup AND NOT sec AND genome <> 'Brand#11' GROUP BY ALL",
    "sample_totals": f"{_contig_start()} SELECT sample, num_reads, sum(R)::bigint AS num_mapped FROM m JOIN s USING (sample) WHERE seen AND mean > 0 GROUP BY ALL",
    "dense_matrix": f"{_contig_start()} SELECT entry AS contig, " + ", ".join(f"round(max({c}) FILTER (sample = '{n}'), 6) AS {n}_{c}" for n in "ANR" for c in ("mean", "covered_bases")) + " FROM m GROUP BY entry",
    "depth_segments": f"WITH {_ALNS},{_depth(_USED, 75)}, r1 AS (SELECT *, coalesce(lag(e) OVER w = s AND lag(depth) OVER w = depth, false) AS same FROM runs WHERE depth > 0 AND e > s WINDOW w AS (PARTITION BY sample, tid ORDER BY s)), "
    "r2 AS (SELECT *, count(*) FILTER (NOT same) OVER (PARTITION BY sample, tid ORDER BY s) AS run FROM r1) "
    'SELECT sample, cast(tid AS int) AS tid, min(s)::bigint AS start, max(e)::bigint AS "end", depth FROM r2 GROUP BY sample, tid, run, depth',
    "cigar_blocks": f"WITH {_ALNS}, b AS (SELECT sample, tid, pos AS s, pos + n1 AS e, nd FROM a UNION ALL SELECT sample, tid, pos + n1 + nd, pos + n1 + nd + n2, nd FROM a) "
    "SELECT sample, cast(tid AS int) AS tid, count(*) AS n_blocks, sum(s)::bigint AS sum_s, sum(e)::bigint AS sum_e FROM (SELECT * FROM b WHERE nd > 0 UNION ALL "
    "SELECT * FROM b WHERE nd = 0) GROUP BY sample, tid",
    "definition_join": "SELECT CASE WHEN p_partkey % 10 <> 9 THEN p_brand END AS genome, count(*) AS n, sum(500 + p_size * 20)::bigint AS bases FROM part GROUP BY 1",
    "unassigned_contigs": "SELECT concat(p_brand, '~', cast(p_partkey AS varchar)) AS contig, cast(500 + p_size * 20 AS bigint) AS length FROM part WHERE p_partkey % 10 = 9",
}

# The same results by way of files.
SQL |= {"source_sam_contig_mean": SQL["contig_mean"], "source_gff_gene_mean": SQL["gene_mean"], "source_definition_join": SQL["definition_join"]}
SQL |= {
    "source_bam_contig_mean": SQL["contig_mean"],
    "source_fasta_contigs": f"WITH {_ALNS} SELECT contig, len AS length FROM c",
    "source_quality_genomes": "WITH g AS (SELECT DISTINCT p_brand AS genome, cast(regexp_extract(p_brand, '(\\d+)$', 1) AS int) AS i FROM part WHERE p_partkey % 10 <> 9) SELECT genome FROM g WHERE i % 5 <> 0 AND i + 40 >= 60 AND i % 7 <= 4",
    "stream_incremental_counts": f"WITH {_ALNS},{_depth(_USED, 75)} SELECT sample, cast(tid AS int) AS tid, n_all, n_no_sup, n_primary FROM ct",
}

SQL |= {
    "stream_incremental_depth": SQL["depth_segments"],
    "stream_event_windows": "SELECT cast(floor(epoch(ts) / 3600) AS bigint) * 3600 AS start_s, event_type, count(*) AS n, cast(sum(cast(value AS decimal(28, 6))) AS double) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}

# Headers that differ: a sample has the contigs whose number, divided by 3, does not leave its own.
_OWN = "cast(regexp_extract(entry, '(\\d+)$', 1) AS int) % 3 <> CASE sample WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_OWN_TID = "tid % 3 <> CASE sample WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
SQL |= {
    "headers_sam_contig_mean": _contig(["mean", "covered_bases", "length"], extra=f"WHERE {_OWN}"),
    "headers_bam_contig_mean": _contig(["mean", "covered_bases", "length"], extra=f"WHERE {_OWN}"),
    "headers_dense_matrix": f"{_contig_start()} SELECT entry AS contig, " + ", ".join(f"coalesce(round(max(mean) FILTER (sample = '{n}' AND {_OWN}), 6), 0.0) AS {n}_mean" for n in "ANR") + " FROM m GROUP BY entry",
    "headers_genome_mean": f"WITH {_ALNS},{_depth(_USED, 75)},{_stats('genome', 'n_no_sup', 'same_primary', 0.0, _OWN_TID)} SELECT sample, entry, {_rounded(['mean', 'length'])} FROM m",
}

_SETS = """
w AS (SELECT doc_id, n_chars, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT doc_id, n_chars, list_sort(list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)])) AS s FROM w WHERE len(w) >= 3),
sets AS (SELECT s, min(doc_id) AS id, max(n_chars) AS size FROM sh GROUP BY s),
it AS (SELECT id, len(s) AS n, unnest(s) AS item FROM sets),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS common, x.n AS n_a, y.n AS n_b FROM it x JOIN it y USING (item) WHERE x.id < y.id GROUP BY ALL HAVING 2 * count(*) >= x.n + y.n - count(*))"""

SQL |= {
    "cluster_candidates": f"WITH {_SETS} SELECT a, b, common, n_a::bigint AS n_a, n_b::bigint AS n_b FROM pairs",
    "cluster_representatives": f"""WITH RECURSIVE {_SETS},
rk AS (SELECT id, row_number() OVER (ORDER BY size DESC, id) AS k FROM sets WHERE id IN (SELECT a FROM pairs UNION SELECT b FROM pairs)),
near AS (SELECT greatest(x.k, y.k) AS k, least(x.k, y.k) AS better, common / (n_a + n_b - common)::double AS j FROM pairs JOIN rk x ON x.id = a JOIN rk y ON y.id = b),
steps AS (SELECT rk.k, coalesce(list(better) FILTER (better IS NOT NULL), []) AS better FROM rk LEFT JOIN near USING (k) GROUP BY rk.k),
pass(k, chosen) AS (SELECT 0::bigint, []::bigint[] UNION ALL SELECT s.k, CASE WHEN list_has_any(s.better, p.chosen) THEN p.chosen ELSE list_append(p.chosen, s.k) END FROM pass p JOIN steps s ON s.k = p.k + 1),
chosen AS (SELECT unnest(arg_max(chosen, k)) AS k FROM pass),
goes AS (SELECT near.k, arg_min(better, (-j, better)) AS target FROM near JOIN chosen c ON c.k = near.better WHERE near.k NOT IN (SELECT k FROM chosen) GROUP BY near.k)
SELECT coalesce(r.id, sets.id) AS representative, sets.id AS member FROM sets LEFT JOIN rk ON rk.id = sets.id LEFT JOIN goes ON goes.k = rk.k LEFT JOIN rk r ON r.k = goes.target""",
}

_TAGS = f"WITH {_ALNS} SELECT concat('group', mapq % 5) AS read_group, count(*) AS n, sum(n1 + n2 + ln)::bigint AS sum_xs, sum(nm)::bigint AS sum_nm FROM (SELECT *, seq_len - n1 - n2 AS ln FROM a) WHERE NOT sec AND NOT unm AND {_IDENT} GROUP BY 1"
SQL |= {"source_sam_tags": _TAGS, "source_bam_tags": _TAGS}

SQL |= {
    "contig_added_methods": f"{_contig_start()}, q AS (SELECT h1.sample, h1.k, min(depth) FILTER (upto >= 0.5::double * B) AS q5, min(depth) FILTER (upto >= 0.9::double * B) AS q9 FROM h1 JOIN x0 ON x0.sample = h1.sample AND x0.k = h1.k GROUP BY ALL) "
    "SELECT m.sample, entry, round(mean, 9) AS mean, coalesce(q5, 0)::double AS median_depth, coalesce(q9, 0)::double AS depth_of_ninety FROM m JOIN q ON q.sample = m.sample AND q.k = m.entry",
}
