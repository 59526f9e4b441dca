"""DuckDB twins of the registered queries. Those of iterative plans state what their
invariants must come to, those of round trips the input."""

from __future__ import annotations

from helixmill.params import ReadParams
from helixmill.sources.derived import BASES, LENGTH, LETTERS, MATE_GAP, SPREAD, STEP

L, P = LENGTH, ReadParams(LENGTH)
OFF, BLOCK = 25, 10_000
RC = "translate(reverse({}), 'ACGTN', 'TGCAN')"


def _bits(s: str, width: int) -> str:
    for base, two in zip("ACGTN", ("00", "01", "10", "11", "00")):
        s = f"replace({s}, '{base}', '{two}')"
    return f"CAST(CAST(lpad(rpad({s}, {width}, '0'), 64, '0') AS BIT) AS BIGINT)"


REFS = f"refs AS (SELECT doc_id AS ref_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') AS dna FROM documents)"
READS = f"""{REFS},
reads AS (SELECT ref_id * {SPREAD} + off // {STEP} AS read_id, substr(dna, CAST(off + 1 AS INTEGER), {L}) AS seq
          FROM (SELECT ref_id, dna, unnest(range(0, length(dna) - {L} + 1, {STEP})) AS off FROM refs WHERE length(dna) >= {L}))"""
CLEAN = f"{READS}, clean AS (SELECT * FROM reads WHERE NOT contains(seq, 'N'))"

_steps = [f"al0 AS (SELECT ref_id * {SPREAD} + pos // {STEP} AS read_id, ref_id, pos, substr(dna, CAST(pos + 1 AS INTEGER), {L}) AS win, substr(dna, CAST(pos + 1 AS INTEGER), {L}) AS s FROM (SELECT ref_id, dna, unnest(range(0, length(dna) - {L} + 1, {STEP})) AS pos FROM refs WHERE length(dna) >= {L}))"]
for _k in range(1, 7):
    _at = f"CAST((read_id * {5 + 2 * _k} + {17 * _k}) % {L} AS INTEGER)"
    _steps.append(f"al{_k} AS (SELECT read_id, ref_id, pos, win, CASE WHEN read_id % 7 >= {_k} THEN substr(s, 1, {_at}) || translate(substr(win, {_at} + 1, 1), 'ACGTN', 'CGTAN') || substr(s, {_at} + 2) ELSE s END AS s FROM al{_k - 1})")
ALIGN = ",\n".join([REFS, *_steps, f"al AS (SELECT read_id, ref_id, pos, CASE WHEN read_id % 3 = 0 THEN 1 ELSE 0 END AS strand, win, s AS oriented, CASE WHEN read_id % 3 = 0 THEN {RC.format('s')} ELSE s END AS seq FROM al6)"])
MM = f"""{ALIGN}, mm AS (SELECT read_id, CAST(row_number() OVER (PARTITION BY read_id ORDER BY off) - 1 AS INTEGER) AS ord, CAST(off AS INTEGER) AS off, ref_base, read_base FROM
  (SELECT read_id, off, substr(win, CAST(off + 1 AS INTEGER), 1) AS ref_base, substr(oriented, CAST(off + 1 AS INTEGER), 1) AS read_base FROM (SELECT *, unnest(range(0, {L})) AS off FROM al WHERE win <> oriented)) WHERE ref_base <> read_base)"""
RANKS = f"""{MM}, every AS (SELECT a AS ref_base, b AS read_base FROM (SELECT unnest(['A','C','G','T']) AS a), (SELECT unnest(['A','C','G','N','T']) AS b) WHERE a <> b),
ranks AS (SELECT every.ref_base AS ref_base, every.read_base AS read_base, CAST(row_number() OVER (PARTITION BY every.ref_base ORDER BY coalesce(n, 0) DESC, every.read_base) - 1 AS INTEGER) AS rank
  FROM every LEFT JOIN (SELECT ref_base, read_base, count(*) AS n FROM mm GROUP BY ALL) c ON every.ref_base = c.ref_base AND every.read_base = c.read_base)"""
_placed = f"WITH {ALIGN} "

COPIES = "copies AS (SELECT s, p, 0 AS off FROM (SELECT read_id AS s, lead(read_id) OVER (PARTITION BY seq ORDER BY read_id) AS p FROM {}) WHERE p IS NOT NULL)"
LINKS = f"""{CLEAN}, {COPIES.format('clean')},
suf AS (SELECT read_id, substr(seq, {OFF + 1}) AS key, row_number() OVER (PARTITION BY substr(seq, {OFF + 1}) ORDER BY read_id) AS rn FROM clean ANTI JOIN (SELECT s AS read_id FROM copies) USING (read_id)),
pre AS (SELECT read_id, substr(seq, 1, {L - OFF}) AS key, row_number() OVER (PARTITION BY substr(seq, 1, {L - OFF}) ORDER BY read_id) AS rn FROM clean ANTI JOIN (SELECT p AS read_id FROM copies) USING (read_id)),
links AS (SELECT * FROM copies UNION ALL SELECT suf.read_id, pre.read_id, {OFF} FROM suf JOIN pre ON suf.key = pre.key AND suf.rn = pre.rn WHERE suf.read_id <> pre.read_id),
flags AS (SELECT clean.read_id AS read_id, n.off AS off_next, v.off AS off_prev FROM clean LEFT JOIN links n ON n.s = clean.read_id LEFT JOIN links v ON v.p = clean.read_id),
strong AS (SELECT read_id, coalesce((off_next IS NOT NULL AND off_prev IS NOT NULL) OR (off_next = 0) OR (off_prev = 0), false) AS is_reference FROM flags)"""
REPS = f"{CLEAN}, reps AS (SELECT min(read_id) AS read_id, seq FROM clean GROUP BY seq)"
PAIRS = f"""{REFS}, w AS (SELECT ref_id * {SPREAD} + off // {STEP} AS pair_id, off, dna FROM (SELECT ref_id, dna, unnest(range(0, length(dna) - {L + MATE_GAP} + 1, {STEP})) AS off FROM refs WHERE length(dna) >= {L + MATE_GAP})),
prs AS (SELECT pair_id * 2 AS read_id, pair_id, 0 AS mate, substr(dna, CAST(off + 1 AS INTEGER), {L}) AS seq FROM w
  UNION ALL SELECT pair_id * 2 + 1, pair_id, 1, {RC.format(f'substr(dna, CAST(off + {MATE_GAP + 1} AS INTEGER), {L})')} FROM w)"""
ITEMS = f"""{PAIRS}, it0 AS (SELECT pair_id, pair_id // {SPREAD} AS block_id, pair_id % {SPREAD} AS n FROM prs WHERE mate = 0),
items AS (SELECT pair_id, block_id, n AS ord, abs(CASE WHEN n % 4 = 0 THEN 200 WHEN n % 4 = 1 THEN 70000 + (n * 37) % 500 WHEN n % 4 = 2 THEN 140000 + n ELSE 70000 - (n * 11) % 90000 END) AS dist FROM it0)"""
INDEX = f"""idx AS (SELECT kmer, ref_id, "at" FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY ref_id, "at") AS rn FROM
  (SELECT ref_id, CAST("at" AS INTEGER) AS "at", substr(dna, CAST("at" + 1 AS INTEGER), {P.map_k}) AS kmer FROM (SELECT ref_id, dna, unnest(range(0, length(dna) - {P.map_k} + 1, {P.map_ref_step})) AS "at" FROM refs WHERE length(dna) >= {P.map_k})) WHERE NOT contains(kmer, 'N')) WHERE rn <= {P.bucket})"""
HITS = f"""{ALIGN}, q AS (SELECT min(read_id) AS read_id, seq FROM al GROUP BY seq), {INDEX},
both_ AS (SELECT read_id, 0 AS strand, seq AS o FROM q UNION ALL SELECT read_id, 1, {RC.format('seq')} FROM q),
probe AS (SELECT read_id, strand, "at", substr(o, CAST("at" + 1 AS INTEGER), {P.map_k}) AS kmer FROM (SELECT *, unnest(range(0, {L - P.map_k + 1}, {P.map_read_step})) AS "at" FROM both_)),
hits AS (SELECT DISTINCT read_id, strand, idx.ref_id AS ref_id, idx."at" - probe."at" AS pos FROM probe JOIN idx ON probe.kmer = idx.kmer JOIN refs ON refs.ref_id = idx.ref_id WHERE idx."at" - probe."at" >= 0 AND idx."at" - probe."at" + {L} <= length(refs.dna))"""
BEST = f"""{HITS}, scored AS (SELECT hits.read_id AS read_id, hits.strand AS strand, hits.ref_id AS ref_id, pos, hamming(o, substr(dna, CAST(pos + 1 AS INTEGER), {L})) AS mm FROM hits JOIN both_ ON both_.read_id = hits.read_id AND both_.strand = hits.strand JOIN refs ON refs.ref_id = hits.ref_id),
best AS (SELECT read_id, CAST(strand AS INTEGER) AS strand, ref_id, CAST(pos AS BIGINT) AS pos, CAST(mm AS INTEGER) AS mm FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY mm, strand, ref_id, pos) AS rn FROM scored WHERE mm <= {P.max_mismatches}) WHERE rn = 1)"""
COMPONENTS = f"{ALIGN}, comp AS (SELECT read_id, CASE WHEN contains(win, 'N') THEN 'n' WHEN ref_id % 2 = 0 THEN 'hq' ELSE 'lq' END AS component, pos FROM al)"
PALINDROMES = f"{REFS}, pal AS (SELECT ref_id, substr(dna, 1, 300) || 'ACCA' || {RC.format('substr(dna, 31, 120)')} || 'GTTG' || substr(dna, 301) AS dna FROM refs WHERE length(dna) >= 200)"
STRANDED = f"{READS}, ch AS (SELECT read_id, CASE WHEN read_id % 11 = 0 THEN substr(seq, 1, CAST((read_id * 7) % {L} AS INTEGER)) || translate(substr(seq, CAST((read_id * 7) % {L} + 1 AS INTEGER), 1), 'ACGTN', 'CGTAN') || substr(seq, CAST((read_id * 7) % {L} + 2 AS INTEGER)) ELSE seq END AS seq FROM reads), strd AS (SELECT read_id, CASE WHEN read_id % 3 = 0 THEN {RC.format('seq')} ELSE seq END AS seq FROM ch)"


def _seeds(src: str, dest: str, each: bool) -> str:
    """CTEs idx, dst and seeds: seeds of the strings ``dest`` (ref_id, rc) in the strings ``src`` (ref_id, dna)."""
    per, same = ("ref_id, kmer ORDER BY \"at\"", "AND dst.ref_id = idx.ref_id") if each else ("kmer ORDER BY ref_id, \"at\"", "")
    return f"""idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {per}) AS rn FROM (SELECT ref_id, CAST("at" AS INTEGER) AS "at", substr(dna, CAST("at" + 1 AS INTEGER), {P.match_k}) AS kmer FROM (SELECT ref_id, dna, unnest(range(0, length(dna) - {P.match_k} + 1, {P.match_src_step})) AS "at" FROM {src})) WHERE NOT contains(kmer, 'N')) WHERE rn <= {P.bucket}),
dst AS (SELECT ref_id, CAST("at" AS INTEGER) AS "at", substr(rc, CAST("at" + 1 AS INTEGER), {P.match_k}) AS kmer FROM (SELECT ref_id, rc, unnest(range(0, length(rc) - {P.match_k} + 1, {P.match_dest_step})) AS "at" FROM {dest})),
seeds AS (SELECT dst.ref_id AS dest_id, dst."at" AS at_dest, idx.ref_id AS src_id, idx."at" AS at_src FROM dst JOIN idx ON dst.kmer = idx.kmer {same})"""


def _maximal(src: str, dest: str) -> str:
    """CTE maximal: the first of the seeds that overlap on a diagonal, as far as bases agree, by halving
    steps to the right and to the left."""
    first = f"one AS MATERIALIZED (SELECT dest_id, src_id, at_dest, at_src FROM (SELECT *, lag(at_dest) OVER (PARTITION BY dest_id, src_id, at_src - at_dest ORDER BY at_dest) AS before FROM seeds) WHERE before IS NULL OR at_dest - before > {P.match_k})"
    step = "e0 AS (SELECT dest_id, src_id, at_dest, at_src, s.dna AS a, d.rc AS b, least(length(s.dna) - at_src, length(d.rc) - at_dest) - {k} AS room_r, least(at_src, at_dest) AS room_l, 0 AS r, 0 AS l FROM one JOIN {src} s ON s.ref_id = src_id JOIN {dest} d ON d.ref_id = dest_id)".format(k=P.match_k, src=src, dest=dest)
    out = [first, step]
    steps = range(17, -1, -1)
    for i, k in enumerate(steps):
        n = 1 << k
        right = f"CASE WHEN room_r - r >= {n} AND substr(a, CAST(at_src + {P.match_k + 1} + r AS INTEGER), {n}) = substr(b, CAST(at_dest + {P.match_k + 1} + r AS INTEGER), {n}) THEN {n} ELSE 0 END"
        left = f"CASE WHEN room_l - l >= {n} AND substr(a, CAST(at_src + 1 - l - {n} AS INTEGER), {n}) = substr(b, CAST(at_dest + 1 - l - {n} AS INTEGER), {n}) THEN {n} ELSE 0 END"
        out.append(f"e{i + 1} AS (SELECT dest_id, src_id, at_dest, at_src, a, b, room_r, room_l, r + {right} AS r, l + {left} AS l FROM e{i})")
    last = len(steps)
    out.append(f"maximal AS (SELECT DISTINCT dest_id, src_id, CAST(at_dest - l AS INTEGER) AS pos_dest, CAST(at_src - l AS INTEGER) AS pos_src, CAST({P.match_k} + l + r AS INTEGER) AS len FROM e{last} WHERE {P.match_k} + l + r >= {P.match_min})")
    return ", ".join(out)


SELF = f"{PALINDROMES}, rcs AS (SELECT ref_id, {RC.format('dna')} AS rc FROM pal), {_seeds('pal', 'rcs', True)}"
CROSS = f"""{REFS}, even AS (SELECT * FROM refs WHERE ref_id % 2 = 0),
odd AS (SELECT ref_id, CASE WHEN ref_id % 4 = 1 THEN dna ELSE {RC.format('dna')} END AS rc FROM refs WHERE ref_id % 2 = 1), {_seeds('even', 'odd', False)}, {_maximal('even', 'odd')}"""
CANONICAL = f"""{SELF}, {_maximal('pal', 'rcs')}, own AS (SELECT dest_id AS ref_id, least(pos_src, length(dna) - pos_dest - len) AS ps, greatest(pos_src, length(dna) - pos_dest - len) AS pd, len FROM maximal JOIN pal ON pal.ref_id = dest_id),
trimmed AS (SELECT ref_id, ps, pd, len, greatest(0, ps + len - pd + 1) // 2 AS margin FROM own),
canon AS (SELECT DISTINCT ref_id, CAST(ps AS INTEGER) AS pos_src, CAST(pd + margin AS INTEGER) AS pos_dest, CAST(len - margin AS INTEGER) AS len FROM trimmed WHERE len - margin >= {P.match_min})"""
COVER = f"""{CANONICAL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY pos_dest, pos_src, len) AS i FROM canon),
fold AS (SELECT DISTINCT ref_id, 0::BIGINT AS i, 0 AS reach, 0 AS pos_src, 0 AS pos_dest, 0 AS len FROM ranked UNION ALL
  SELECT fold.ref_id, ranked.i, CASE WHEN ranked.len - greatest(0, reach - ranked.pos_dest) >= {P.match_min} THEN ranked.pos_dest + ranked.len ELSE reach END, ranked.pos_src, ranked.pos_dest + greatest(0, reach - ranked.pos_dest), ranked.len - greatest(0, reach - ranked.pos_dest)
  FROM fold JOIN ranked ON ranked.ref_id = fold.ref_id AND ranked.i = fold.i + 1),
cover AS (SELECT ref_id, CAST(pos_src AS INTEGER) AS pos_src, CAST(pos_dest AS INTEGER) AS pos_dest, CAST(len AS INTEGER) AS len FROM fold WHERE len >= {P.match_min})"""


def _rotated(off: int) -> str:
    """CTE z{off}: links of one offset among the N-free reads, groups shifted in which a read meets itself."""
    return f"""s{off} AS (SELECT read_id AS s, substr(seq, {off + 1}) AS key, row_number() OVER (PARTITION BY substr(seq, {off + 1}) ORDER BY read_id) AS rn FROM clean),
        p{off} AS (SELECT read_id AS p, substr(seq, 1, {L - off}) AS key, row_number() OVER (PARTITION BY substr(seq, 1, {L - off}) ORDER BY read_id) AS rn, count(*) OVER (PARTITION BY substr(seq, 1, {L - off})) AS n FROM clean),
        c{off} AS (SELECT DISTINCT s{off}.key AS key FROM s{off} JOIN p{off} ON s{off}.key = p{off}.key AND s{off}.rn = p{off}.rn WHERE s = p),
        r{off} AS (SELECT p, p{off}.key AS key, CASE WHEN c{off}.key IS NULL THEN rn ELSE rn % n + 1 END AS rn FROM p{off} LEFT JOIN c{off} ON c{off}.key = p{off}.key),
        z{off} AS (SELECT s, p, {off} AS off FROM s{off} JOIN r{off} ON s{off}.key = r{off}.key AND s{off}.rn = r{off}.rn WHERE s <> p)"""


def _zero(*names: str) -> str:
    return "SELECT " + ", ".join(f"CAST(0 AS BIGINT) AS {n}" for n in names)


_k = f"substr(seq, {P.overlap_at + 1}, {P.overlap_k})"
_kn = f"replace(substr(seq, 1, {P.overlap_k}), 'N', 'A')"

SQL = {
    "reads_scan": f"WITH {READS} SELECT read_id, 0 AS mate, seq, contains(seq, 'N') AS has_n FROM reads",
    "reads_paired": f"WITH {PAIRS} SELECT read_id, pair_id, mate, seq FROM prs",
    "fastq_scan": f"WITH {READS} SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, seq, contains(seq, 'N') AS has_n FROM reads",
    "fastq_paired": f"WITH {PAIRS}, d AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS number FROM prs WHERE mate = 0) SELECT 2 * number + mate AS read_id, number AS pair_id, mate, seq FROM prs JOIN d ON d.pair_id = prs.pair_id",
    "block_partition": f"WITH {READS}, n AS (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS number FROM reads) SELECT number // {BLOCK} AS block_id, count(*) AS n, min(read_id) AS first_read, max(read_id) AS last_read FROM n GROUP BY number // {BLOCK}",
    "length_assert": f"WITH {READS} SELECT count(*) AS n, count(*) FILTER (length(seq) <> {L} OR translate(seq, 'ACGTN', '') <> '') AS bad, count(*) FILTER (contains(seq, 'N')) AS with_n FROM reads",
    "base_encode": f"WITH {READS} SELECT read_id, translate(seq, 'ACGTN', '01230') AS codes, translate(seq, 'ACGTN', 'TGCAN') AS complement FROM reads",
    "packed_words": f"WITH {READS} SELECT read_id, " + ", ".join(f"{_bits(f'substr(seq, {32 * i + 1}, 32)', 64)} AS w{i}" for i in range(P.words)) + " FROM reads",
    "kmer_extract": f"WITH {CLEAN} SELECT read_id, {_k} AS kmer, {_bits(_k, 2 * P.overlap_k)} AS code FROM clean",
    "kmer_extract_n": f"WITH {READS} SELECT read_id, {_kn} AS kmer, {_bits(_kn, 2 * P.overlap_k)} AS code FROM reads WHERE contains(seq, 'N')",
    "revcomp": f"WITH {READS} SELECT read_id, {RC.format('seq')} AS rc FROM reads",
    "canonical_count": f"WITH {READS} SELECT least(seq, {RC.format('seq')}) AS canonical, count(*) AS n, min(read_id) AS first_read FROM reads GROUP BY 1",
    "hamming_packed": f"WITH {ALIGN} SELECT read_id, CAST(hamming(replace(oriented, 'N', 'A'), replace(win, 'N', 'A')) AS INTEGER) AS mm FROM al",
    "hamming_forward": f"WITH {ALIGN} SELECT read_id, CAST(hamming(seq, win) AS INTEGER) AS mm FROM al WHERE strand = 0 AND NOT contains(win, 'N')",
    "hamming_revcomp": f"WITH {ALIGN} SELECT read_id, CAST(hamming({RC.format('seq')}, win) AS INTEGER) AS mm FROM al WHERE strand = 1",
    "hamming_n": f"WITH {ALIGN} SELECT read_id, CAST(hamming(oriented, win) AS INTEGER) AS mm FROM al WHERE contains(win, 'N')",
    "class_split": f"WITH {READS} SELECT contains(seq, 'N') AS has_n, count(*) AS n, CAST(sum(read_id) AS BIGINT) AS id_sum FROM reads GROUP BY 1",
    "dup_links": f"WITH {CLEAN}, {COPIES.format('clean')} SELECT s, p, off FROM copies",
    "dup_links_n": f"WITH {READS}, {COPIES.format("(SELECT * FROM reads WHERE contains(seq, 'N'))")} SELECT s, p, off FROM copies",
    "dup_counts": f"WITH {READS} SELECT min(read_id) AS read_id, seq, count(*) AS n FROM reads GROUP BY seq",
    "prefix_index": f"WITH {CLEAN} SELECT {_k} AS kmer, count(*) AS n, least(count(*), {P.bucket}) AS capped, min(read_id) AS first_read FROM clean GROUP BY 1",
    "overlap_candidates": f"""WITH {REPS}, pre AS (SELECT read_id, seq, {_k} AS kmer FROM reps),
        suf AS (SELECT read_id, seq, off, substr(seq, CAST(off + {P.overlap_at + 1} AS INTEGER), {P.overlap_k}) AS kmer FROM (SELECT *, unnest(range(1, {P.max_offset})) AS off FROM reps))
        SELECT suf.read_id AS s, pre.read_id AS p, CAST(off AS INTEGER) AS off FROM suf JOIN pre ON suf.kmer = pre.kmer
        WHERE suf.read_id <> pre.read_id AND substr(suf.seq, CAST(off + 1 AS INTEGER)) = substr(pre.seq, 1, CAST({L} - off AS INTEGER))""",
    "overlap_rankzip": f"""WITH {CLEAN}, suf AS (SELECT read_id, substr(seq, {OFF + 1}) AS key, row_number() OVER (PARTITION BY substr(seq, {OFF + 1}) ORDER BY read_id) AS rn FROM clean),
        pre AS (SELECT read_id, substr(seq, 1, {L - OFF}) AS key, row_number() OVER (PARTITION BY substr(seq, 1, {L - OFF}) ORDER BY read_id) AS rn FROM clean)
        SELECT suf.read_id AS s, pre.read_id AS p, {OFF} AS off FROM suf JOIN pre ON suf.key = pre.key AND suf.rn = pre.rn WHERE suf.read_id <> pre.read_id""",
    "overlap_rotation": f"WITH {CLEAN}, " + ", ".join(_rotated(off) for off in (70, 85, L - 1)) + " SELECT * FROM z70 UNION ALL SELECT * FROM z85 UNION ALL SELECT * FROM " + f"z{L - 1}",
    "available_prefix": f"WITH {LINKS} SELECT read_id FROM clean ANTI JOIN (SELECT p AS read_id FROM links) USING (read_id)",
    "available_suffix": f"WITH {LINKS} SELECT read_id FROM clean ANTI JOIN (SELECT s AS read_id FROM links) USING (read_id)",
    "link_counts": f"WITH {LINKS} SELECT count(*) AS n, count(off_next) AS linked, count(*) - count(off_next) AS open_suffixes, count(*) - count(off_prev) AS open_prefixes FROM flags",
    "weak_reads": f"WITH {LINKS} SELECT read_id, is_reference FROM strong",
    "ref_reads": f"WITH {LINKS}, kept AS (SELECT read_id FROM strong WHERE is_reference) SELECT s, p, off FROM links SEMI JOIN kept a ON s = a.read_id SEMI JOIN kept b ON p = b.read_id",
    "overlap_greedy": _zero("false_links", "self_links", "repeated_next", "repeated_prev", "edges_left"),
    "contigs": _zero("misread", "unplaced", "bases_off", "still_open"),
    "lq_contigs": f"WITH {CLEAN} {_zero('misread', 'unplaced', 'bases_off', 'still_open')}, count(*) AS reads FROM clean",
    "n_contigs": f"WITH {READS} {_zero('misread', 'unplaced', 'bases_off', 'still_open')}, count(*) AS reads FROM reads WHERE contains(seq, 'N')",
    "cycle_cut": f"""WITH RECURSIVE {LINKS}, linked AS MATERIALIZED (SELECT * FROM links),
        reached AS (SELECT read_id FROM clean ANTI JOIN (SELECT p AS read_id FROM linked) USING (read_id) UNION ALL SELECT linked.p FROM reached JOIN linked ON linked.s = reached.read_id),
        ring AS MATERIALIZED (SELECT s, p, off FROM linked ANTI JOIN reached ON reached.read_id = linked.s),
        walk AS (SELECT s AS start, s, p, off FROM ring UNION ALL SELECT walk.start, ring.s, ring.p, ring.off FROM walk JOIN ring ON ring.s = walk.p WHERE walk.p <> walk.start),
        member AS (SELECT start, min(s) AS label FROM walk GROUP BY start),
        cuts AS (SELECT label, arg_min(s, (-off, s)) AS s FROM ring JOIN member ON member.start = ring.s GROUP BY label)
        SELECT (SELECT count(DISTINCT label) FROM member) AS cycles, (SELECT count(*) FROM ring) AS reads, (SELECT count(*) FROM cuts) AS cuts, CAST(coalesce((SELECT sum(s) FROM cuts), 0) AS BIGINT) AS cut_after, 0::BIGINT AS on_cycles, 0::BIGINT AS unplaced""",
    "contig_placement": f"WITH {REPS} SELECT read_id AS contig_id, CAST({L} AS BIGINT) AS length, {L} * (row_number() OVER (ORDER BY read_id) - 1) AS base FROM reps",
    "seed_index_capped": f'WITH {REFS}, {INDEX} SELECT kmer, ref_id, "at" FROM idx',
    "seed_hits": f"WITH {HITS} SELECT read_id, CAST(strand AS INTEGER) AS strand, count(*) AS hits, CAST(min(pos) AS BIGINT) AS least_pos FROM hits GROUP BY read_id, strand",
    "map_best": f"WITH {BEST} SELECT read_id, strand, ref_id, pos, mm FROM best",
    "map_unmapped": f"WITH {BEST} SELECT read_id FROM q ANTI JOIN best USING (read_id)",
    "mm_hist": f"WITH {BEST} SELECT mm, strand, count(*) AS n FROM best GROUP BY mm, strand",
    "mm_extract": f"WITH {MM} SELECT read_id, ord, off, ref_base, read_base FROM mm",
    "mm_context_counts": f"WITH {MM} SELECT ref_base, read_base, count(*) AS n FROM mm GROUP BY ref_base, read_base",
    "mm_rank_table": f"WITH {RANKS} SELECT ref_base, read_base, rank FROM ranks",
    "mm_base_code": f"WITH {RANKS} SELECT read_id, ord, off, rank FROM mm JOIN ranks ON mm.ref_base = ranks.ref_base AND mm.read_base = ranks.read_base",
    "mm_base_decode": f"WITH {MM} SELECT read_id, ord, off, ref_base, read_base FROM mm WHERE ref_base <> 'N'",
    "mm_offset_code": f"""WITH {MM}, o AS (SELECT read_id, list(off ORDER BY off) AS offs FROM mm GROUP BY read_id),
        g AS (SELECT read_id, offs, len(offs) AS n, offs[1] >= {L - 1} - offs[-1] AS r, list_transform(range(1, len(offs)), lambda i: offs[i + 1] - offs[i]) AS gaps FROM o),
        h AS (SELECT read_id, n, CASE WHEN r THEN [1, {L - 1} - offs[-1]] ELSE [0, offs[1]] END AS head, CASE WHEN r THEN list_reverse(gaps) ELSE gaps END AS walked, list_min(gaps) AS least FROM g)
        SELECT read_id, CAST(n AS INTEGER) AS mm, array_to_string(CASE WHEN n = 1 THEN head WHEN n = 2 THEN list_concat(head, [least - 1]) ELSE list_concat(list_concat(head, [least - 1]), list_transform(walked, lambda x: x - least)) END, ',') AS code FROM h""",
    "mm_offset_decode": f"WITH {MM}, o AS (SELECT read_id, string_agg(CAST(off AS VARCHAR), ',' ORDER BY off) AS offs FROM mm GROUP BY read_id) SELECT al.read_id AS read_id, coalesce(offs, '') AS offs FROM al LEFT JOIN o ON al.read_id = o.read_id",
    "mm_group_ordinal": f"WITH {MM}, c AS (SELECT read_id, count(*) AS m FROM mm GROUP BY read_id) SELECT read_id, CAST(m AS INTEGER) AS mm, CAST((row_number() OVER (PARTITION BY m ORDER BY read_id) - 1) * (CASE WHEN m = 1 THEN 2 WHEN m = 2 THEN 3 ELSE m + 2 END) AS BIGINT) AS slot FROM c",
    "mm_restore": _placed + "SELECT read_id, seq FROM al",
    "read_off_delta": _placed + "SELECT read_id, coalesce(pos - lag(pos) OVER (PARTITION BY ref_id ORDER BY pos, read_id), 0) AS delta FROM al",
    "read_off_overlap": _placed + f"SELECT read_id, {L} - (pos - coalesce(lag(pos) OVER (PARTITION BY ref_id ORDER BY pos, read_id), 0)) AS overlap FROM al",
    "read_off_inverse": _placed + "SELECT read_id, pos FROM al",
    "pos_order": _placed + "SELECT read_id, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY pos, read_id) - 1 AS INTEGER) AS rank FROM al",
    "hq_ordinal": f"WITH {READS} SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS ordinal FROM reads WHERE NOT contains(seq, 'N')",
    "id_to_pos": _placed + "SELECT read_id, pos FROM al",
    "joined_coordinate": f"WITH {COMPONENTS}, sz AS (SELECT component, max(pos) + {L} AS size FROM comp GROUP BY component) SELECT read_id, pos + CASE component WHEN 'hq' THEN 0 WHEN 'lq' THEN coalesce((SELECT size FROM sz WHERE component = 'hq'), 0) ELSE coalesce((SELECT sum(size) FROM sz WHERE component <> 'n'), 0) END::BIGINT AS joined FROM comp",
    "component_split": f"WITH {COMPONENTS} SELECT read_id, component, pos FROM comp",
    "pe_mate_distance": f"WITH {PAIRS} SELECT pair_id, CAST({MATE_GAP} AS BIGINT) AS distance, true AS base_first FROM prs WHERE mate = 0",
    "pe_pos_class": f"""WITH RECURSIVE {ITEMS}, far AS (SELECT block_id, dist, row_number() OVER (PARTITION BY block_id ORDER BY ord) AS i FROM items WHERE dist > 65535),
        st AS (SELECT block_id, 0::BIGINT AS i, 0::BIGINT AS ref, 0::BIGINT AS prev, false AS hit UNION ALL
               SELECT st.block_id, far.i, CASE WHEN (far.dist - st.ref BETWEEN -32768 AND 32767) OR NOT st.hit OR st.ref <> st.prev THEN far.dist ELSE st.ref END, far.dist, far.dist - st.ref BETWEEN -32768 AND 32767
               FROM st JOIN far ON far.block_id = st.block_id AND far.i = st.i + 1)
        SELECT kind, n FROM (SELECT 'near' AS kind, count(*) AS n FROM items WHERE dist <= 65535 UNION ALL SELECT CASE WHEN hit THEN 'delta' ELSE 'far' END, count(*) FROM st WHERE i > 0 GROUP BY hit)""".replace("st AS (SELECT block_id, 0::BIGINT", "st AS (SELECT DISTINCT block_id, 0::BIGINT").replace("false AS hit UNION ALL", "false AS hit FROM far UNION ALL"),
    "pe_pos_roundtrip": f"WITH {ITEMS} SELECT pair_id, dist FROM items",
    "pe_order_roundtrip": f"WITH {ITEMS} SELECT pair_id, dist FROM items",
    "selfmatch_seeds": f"WITH {SELF} SELECT dest_id, at_dest, src_id, at_src FROM seeds",
    "selfmatch_maximal": f"WITH {SELF}, {_maximal('pal', 'rcs')} SELECT dest_id, src_id, pos_dest, pos_src, len FROM maximal",
    "crossmatch_maximal": f"WITH {CROSS} SELECT dest_id, src_id, pos_dest, pos_src, len FROM maximal",
    "selfmatch_canonical": f"WITH {CANONICAL} SELECT ref_id, pos_src, pos_dest, len FROM canon",
    "interval_cover": f"WITH RECURSIVE {COVER} SELECT ref_id, pos_src, pos_dest, len FROM cover",
    "hole_text": f"WITH RECURSIVE {COVER}, h AS (SELECT ref_id, count(*) AS holes, sum(len) AS gone FROM cover GROUP BY ref_id) SELECT pal.ref_id AS ref_id, CAST(length(dna) AS INTEGER) AS size, CAST(coalesce(holes, 0) AS INTEGER) AS holes, CAST(length(dna) - coalesce(gone, 0) + coalesce(holes, 0) AS INTEGER) AS left_over FROM pal LEFT JOIN h ON h.ref_id = pal.ref_id",
    "ref_recover": f"WITH {PALINDROMES} SELECT ref_id, dna FROM pal",
    "roundtrip_default": f"WITH {STRANDED} SELECT seq, count(*) AS n FROM strd GROUP BY seq",
    "roundtrip_preserve": f"WITH {STRANDED} SELECT read_id, seq FROM strd",
    "roundtrip_paired": f"WITH {PAIRS} SELECT pair_id, mate, seq FROM prs",
}
