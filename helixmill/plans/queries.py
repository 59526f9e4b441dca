"""Registered queries of the read store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.operators import assemble as A
from helixmill.operators import candidates as K
from helixmill.operators import chains as C
from helixmill.operators import mapping as M
from helixmill.operators import overlap as O
from helixmill.operators import rankzip as Z
from helixmill.operators import selfmatch as X
from helixmill.operators import streams as T
from helixmill.operators.ordering import dense_number, running_sum
from helixmill.params import ReadParams
from helixmill.plans.storage import Store
from helixmill.sources import derived

P = ReadParams(derived.LENGTH)
OFF = 25
BLOCK = 10_000  # reads per block in the block queries
WIDTH = derived.SPREAD  # read ids per bucket of a global order: one document


def _reads(spark, sf_dir):
    return derived.reads(spark, sf_dir)


def _clean(spark, sf_dir):
    return _reads(spark, sf_dir).where(~F.contains("seq", F.lit("N")))


# 2.1 and 2.2 scans, functions ------------------------------------------------


def reads_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("read_id", F.lit(0).alias("mate"), "seq", F.contains("seq", F.lit("N")).alias("has_n"))


def reads_paired(spark, sf_dir):
    return derived.pairs(spark, sf_dir)


def fastq_scan(spark, sf_dir):
    """Reads written as FASTQ, read back, numbered in file order."""
    from helixmill.sources.fastq import check_reads, infer_params, read_single, write_fastq

    path = f"{Store(spark, 'fastq').base}/reads.fastq"
    write_fastq(_reads(spark, sf_dir), path)
    back = read_single(spark, path)
    return check_reads(back, infer_params(back)).select("read_id", "seq", "has_n")


def fastq_paired(spark, sf_dir):
    """Mates written as two FASTQ files, read back in lock step."""
    from helixmill.sources.fastq import read_paired, write_fastq

    base = Store(spark, "fastq").base
    for mate in (0, 1):
        write_fastq(derived.pairs(spark, sf_dir).where(F.col("mate") == mate), f"{base}/reads_{mate + 1}.fastq")
    return read_paired(spark, f"{base}/reads_1.fastq", f"{base}/reads_2.fastq").select("read_id", "pair_id", "mate", "seq")


def block_partition(spark, sf_dir):
    numbered = dense_number(_reads(spark, sf_dir), ["read_id"], WIDTH)
    return numbered.groupBy(F.floor(F.col("number") / BLOCK).cast("long").alias("block_id")).agg(F.count("*").alias("n"), F.min("read_id").alias("first_read"), F.max("read_id").alias("last_read"))


def length_assert(spark, sf_dir):
    return _reads(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(~S.valid("seq", P.length)).alias("bad"), F.count_if(F.contains("seq", F.lit("N"))).alias("with_n"))


def base_encode(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", S.base_codes("seq").alias("codes"), S.complement("seq").alias("complement"))


def packed_words(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", *[S.packed_word("seq", i).alias(f"w{i}") for i in range(P.words)])


def kmer_extract(spark, sf_dir):
    k = S.kmer("seq", P.overlap_at, P.overlap_k)
    return _clean(spark, sf_dir).select("read_id", k.alias("kmer"), S.kmer_code(k, P.overlap_k).alias("code"))


def kmer_extract_n(spark, sf_dir):
    k = F.replace(S.kmer("seq", 0, P.overlap_k), F.lit("N"), F.lit("A"))
    return _reads(spark, sf_dir).where(F.contains("seq", F.lit("N"))).select("read_id", k.alias("kmer"), S.kmer_code(k, P.overlap_k).alias("code"))


def revcomp(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", S.reverse_complement("seq").alias("rc"))


def canonical_count(spark, sf_dir):
    """Flagship: how often each sequence occurs on either strand."""
    return _reads(spark, sf_dir).groupBy(S.canonical("seq").alias("canonical")).agg(F.count("*").alias("n"), F.min("read_id").alias("first_read"))


def _aligned(spark, sf_dir):
    a = derived.alignments(spark, sf_dir)
    return a.withColumn("oriented", F.when(F.col("strand") == 1, S.reverse_complement("seq")).otherwise(F.col("seq")))


def hamming_packed(spark, sf_dir):
    a = _aligned(spark, sf_dir)
    return a.select("read_id", S.packed_distance(S.packed("oriented", P.length), S.packed("window", P.length), P.words).cast("int").alias("mm"))


def hamming_forward(spark, sf_dir):
    return derived.alignments(spark, sf_dir).where("strand = 0 AND NOT contains(window, 'N')").select("read_id", S.distance("seq", "window", P.length).cast("int").alias("mm"))


def hamming_revcomp(spark, sf_dir):
    return derived.alignments(spark, sf_dir).where("strand = 1").select("read_id", S.distance(S.reverse_complement("seq"), "window", P.length).cast("int").alias("mm"))


def hamming_n(spark, sf_dir):
    return _aligned(spark, sf_dir).where("contains(window, 'N')").select("read_id", S.distance("oriented", "window", P.length).cast("int").alias("mm"))


# 2.3 classes, 2.4 links --------------------------------------------------------


def class_split(spark, sf_dir):
    return _reads(spark, sf_dir).groupBy(F.contains("seq", F.lit("N")).alias("has_n")).agg(F.count("*").alias("n"), F.sum("read_id").alias("id_sum"))


def _copies_and_zip(spark, sf_dir):
    """Ends with links of copies and, between ends still open, of one fixed offset."""
    return O.linked_ends(_clean(spark, sf_dir), OFF, P, WIDTH)


def dup_links(spark, sf_dir):
    return O.duplicate_links(_clean(spark, sf_dir), WIDTH)


def dup_links_n(spark, sf_dir):
    return O.duplicate_links(_reads(spark, sf_dir).where(F.contains("seq", F.lit("N"))), WIDTH)


def dup_counts(spark, sf_dir):
    return O.distinct_reads(_reads(spark, sf_dir))


def prefix_index(spark, sf_dir):
    return O.prefix_index(_clean(spark, sf_dir), P).groupBy("kmer").agg(F.count("*").alias("n"), F.least(F.count("*"), F.lit(P.bucket)).cast("long").alias("capped"), F.min("read_id").alias("first_read"))


def overlap_candidates(spark, sf_dir):
    return K.all_candidates(Store(spark, "candidates"), _clean(spark, sf_dir), P)


def overlap_rankzip(spark, sf_dir):
    r = _clean(spark, sf_dir)
    return O.plain_rank_zip(r, r, OFF, P)


def overlap_rotation(spark, sf_dir):
    """Rank-zip where a group in which a read would meet itself is shifted by one: long, short and
    single-base overlaps."""
    return Z.zip_all(Store(spark, "rotation"), _clean(spark, sf_dir), [70, 85, P.length - 1], P, WIDTH)


def available_prefix(spark, sf_dir):
    return _copies_and_zip(spark, sf_dir).where("side = 1 AND other IS NULL").select("read_id")


def available_suffix(spark, sf_dir):
    return _copies_and_zip(spark, sf_dir).where("side = 0 AND other IS NULL").select("read_id")


def link_counts(spark, sf_dir):
    ends = _copies_and_zip(spark, sf_dir)
    n = lambda what, name: F.count_if(F.expr(what)).alias(name)
    return ends.agg(n("side = 0", "n"), n("side = 0 AND other IS NOT NULL", "linked"), n("side = 0 AND other IS NULL", "open_suffixes"), n("side = 1 AND other IS NULL", "open_prefixes"))


def weak_reads(spark, sf_dir):
    return O.strong_reads(_clean(spark, sf_dir), _copies_and_zip(spark, sf_dir))


def ref_reads(spark, sf_dir):
    """Links left when weak reads are cut off."""
    return O.links_of_strong(_copies_and_zip(spark, sf_dir))


def overlap_greedy(spark, sf_dir):
    """Invariants of the greedy matching: each end once, every link a true overlap, no edge left
    that could still be taken."""
    store = Store(spark, "greedy")
    r = store.save(O.distinct_reads(_clean(spark, sf_dir)).select("read_id", "seq"))
    edges = store.save(O.overlap_candidates(r, r, P))
    links = O.greedy_matching(store, edges)
    return _link_checks(r, links, edges)


def _link_checks(r, links, edges=None):
    text = links.join(r.select(F.col("read_id").alias("s"), F.col("seq").alias("a")), "s").join(r.select(F.col("read_id").alias("p"), F.col("seq").alias("b")), "p")
    false = text.agg(F.count_if(F.substring("a", F.col("off") + 1, F.lit(P.length)) != F.substring(F.col("b"), F.lit(1), P.length - F.col("off"))).alias("false_links"), F.count_if(F.col("s") == F.col("p")).alias("self_links"))
    twice = lambda c, name: links.groupBy(c).count().agg(F.count_if(F.col("count") > 1).alias(name))
    out = false.crossJoin(twice("s", "repeated_next")).crossJoin(twice("p", "repeated_prev"))  # one row each
    if edges is not None:
        left = edges.join(links.select("s"), "s", "left_anti").join(links.select("p"), "p", "left_anti")
        out = out.crossJoin(left.agg(F.count("*").alias("edges_left")))
    return out


# 2.5 graph -------------------------------------------------------------------


def _least_read_set(spark, sf_dir, has_n):
    r = _reads(spark, sf_dir).where(F.contains("seq", F.lit("N")) if has_n else ~F.contains("seq", F.lit("N")))
    return r.select("read_id", "seq")


def _assembled(spark, sf_dir, has_n=False, weak_cut=True, least=1):
    store = Store(spark, "assembly")
    r = store.save(_least_read_set(spark, sf_dir, has_n))
    links, kept = O.overlap_reads(store, r, P, weak_cut, least)
    before = links
    links, placed, cut = A.cut_cycles(store, kept, links)
    text = store.save(A.contigs(kept, links, placed, P))
    return r, kept, before, links, placed, cut, text


def _still_open(kept, links):
    """Bases that some open suffix ends with and another read's open prefix begins with."""
    one = lambda reads, base, n: reads.groupBy(base.alias("base")).agg(F.count("*").alias(f"n_{n}"), F.min("read_id").alias(n))
    s = one(O.open_suffixes(kept, links), F.substring("seq", P.length, 1), "s")
    p = one(O.open_prefixes(kept, links), F.substring("seq", 1, 1), "p")
    return s.join(p, "base").agg(F.count_if((F.col("n_s") > 1) | (F.col("n_p") > 1) | (F.col("s") != F.col("p"))).alias("still_open"))


def _assembly_checks(parts):
    r, kept, before, links, placed, cut, text = parts
    windows = A.read_windows(text, placed, P).join(kept, "read_id")
    wrong = windows.agg((F.count_if(F.col("window") == F.col("seq")) - F.count("*")).alias("misread"), F.count("*").alias("found"))
    sizes = placed.groupBy("head").agg(F.max("dist").alias("d")).agg(F.sum(F.col("d") + P.length).alias("want"))
    have = text.agg(F.sum(F.length("text")).alias("have"))
    n = kept.agg(F.count("*").alias("n"))
    rows = wrong.crossJoin(sizes).crossJoin(have).crossJoin(n).crossJoin(_still_open(kept, before))  # one row each
    return rows.select(
        F.col("misread").cast("long").alias("misread"), (F.col("found") - F.col("n")).cast("long").alias("unplaced"),
        (F.coalesce("want", F.lit(0)) - F.coalesce("have", F.lit(0))).cast("long").alias("bases_off"), "still_open", F.col("n").alias("reads"),
    )


def contigs(spark, sf_dir):
    """Contigs of the N-free reads: every kept read stands in its contig, text is as long as the
    chains, no two ends that overlap by a base are open. Which reads are kept is weak_reads' matter."""
    return _assembly_checks(_assembled(spark, sf_dir)).drop("reads")


def lq_contigs(spark, sf_dir):
    """N-free reads without the weak-read cut, as for those that did not map: all of them are placed."""
    return _assembly_checks(_assembled(spark, sf_dir, weak_cut=False))


def n_contigs(spark, sf_dir):
    return _assembly_checks(_assembled(spark, sf_dir, has_n=True, weak_cut=False))


def cycle_cut(spark, sf_dir):
    """Links of one fixed offset close cycles; one link of each is cut, the one of its cycle with the
    largest offset, and no cycle is left."""
    store, n = Store(spark, "cycles"), _clean(spark, sf_dir).count()
    parts = max(1, -(-n // C.PART_READS))
    ends = O.linked_ends(_clean(spark, sf_dir), OFF, P, WIDTH, lambda read_id: C.home_of(read_id, WIDTH, parts))
    nodes = ends.where("side = 0").select("read_id", F.col("other").alias("next"), "off", "home")
    placed, cyclic, cut, left = C.cut(store, nodes, parts, WIDTH)
    of_cycles = cyclic.agg(F.countDistinct("label").alias("cycles"), F.count("*").alias("reads"))
    cuts = cut.agg(F.count("*").alias("cuts"), F.coalesce(F.sum("s"), F.lit(0)).alias("cut_after"))
    rows = of_cycles.crossJoin(cuts).crossJoin(left.agg(F.count("*").alias("left"))).crossJoin(placed.agg(F.count("*").alias("placed")))  # one row each
    return rows.select("cycles", "reads", "cuts", "cut_after", F.col("left").alias("on_cycles"), (F.lit(n) - F.col("placed")).cast("long").alias("unplaced"))


def contig_placement(spark, sf_dir):
    """Chains of copies laid end to end in order of their head."""
    return A.placed_sizes(A.copy_contigs(_clean(spark, sf_dir), P))


# 2.4 mapping -----------------------------------------------------------------


def _refs(spark, sf_dir):
    return derived.references(spark, sf_dir)


def _to_map(spark, sf_dir):
    """Distinct changed reads."""
    return O.distinct_reads(derived.alignments(spark, sf_dir)).select("read_id", "seq")


def seed_index_capped(spark, sf_dir):
    return M.seed_index(_refs(spark, sf_dir), P.map_k, P.map_ref_step, P.bucket)


def seed_hits(spark, sf_dir):
    return M.seed_hits(_to_map(spark, sf_dir), _refs(spark, sf_dir), P).groupBy("read_id", "strand").agg(F.count("*").alias("hits"), F.min("pos").alias("least_pos"))


def map_best(spark, sf_dir):
    return M.best_mapping(_to_map(spark, sf_dir), _refs(spark, sf_dir), P)


def map_unmapped(spark, sf_dir):
    r = _to_map(spark, sf_dir)
    return M.unmapped(r, M.best_mapping(r, _refs(spark, sf_dir), P)).select("read_id")


def mm_hist(spark, sf_dir):
    return M.best_mapping(_to_map(spark, sf_dir), _refs(spark, sf_dir), P).groupBy("mm", "strand").agg(F.count("*").alias("n"))


# 2.10 and 2.11 streams ---------------------------------------------------------


def _extracted(spark, sf_dir):
    return T.extract_mismatches(derived.alignments(spark, sf_dir).select("read_id", "strand", "window", "seq"), P.length)


def mm_extract(spark, sf_dir):
    return derived.alignments(spark, sf_dir, then=T.mismatch_batches(P.length))


def mm_context_counts(spark, sf_dir):
    return T.context_counts(T.mismatch_rows(_extracted(spark, sf_dir)))


def mm_rank_table(spark, sf_dir):
    counts = derived.alignments(spark, sf_dir, then=T.count_batches(P.length))
    return T.ranked(counts.groupBy("ref_base", "read_base").agg(F.sum("n").alias("n")))


def mm_base_code(spark, sf_dir):
    rows = T.mismatch_rows(_extracted(spark, sf_dir)).where("ref_base <> 'N'")
    return T.code_bases(rows, T.rank_table(rows)).select("read_id", "ord", "off", "rank")


def mm_base_decode(spark, sf_dir):
    rows = T.mismatch_rows(_extracted(spark, sf_dir)).where("ref_base <> 'N'")
    table = T.rank_table(rows)
    return T.decode_bases(T.code_bases(rows, table), table).select("read_id", "ord", "off", "ref_base", "read_base")


def _offs(spark, sf_dir):
    return _extracted(spark, sf_dir).select("read_id", F.col("ms.off").alias("offs"))


def mm_offset_code(spark, sf_dir):
    coded = derived.alignments(spark, sf_dir, then=T.code_batches(P.length))
    return coded.select("read_id", "mm", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


def mm_offset_decode(spark, sf_dir):
    coded = _offs(spark, sf_dir).select("read_id", F.size("offs").alias("mm"), T.offset_code(F.col("offs"), P.length).alias("code"))
    return coded.select("read_id", F.array_join(T.offset_decode(F.col("code"), F.col("mm"), P.length).cast("array<string>"), ",").alias("offs"))


def mm_group_ordinal(spark, sf_dir):
    a = _extracted(spark, sf_dir).select("read_id", F.size("ms").alias("mm"))
    return T.group_ordinal(a, WIDTH)


def mm_restore(spark, sf_dir):
    """Reads rebuilt from window, mismatches and strand."""
    x = _extracted(spark, sf_dir)
    patched = S.apply_mismatches(F.col("window"), F.col("ms"))
    return x.select("read_id", F.when(F.col("strand") == 1, S.reverse_complement(patched)).otherwise(patched).alias("seq"))


def _placed(spark, sf_dir):
    return derived.alignments(spark, sf_dir).select("read_id", "ref_id", "pos")


def read_off_delta(spark, sf_dir):
    return T.position_delta(_placed(spark, sf_dir), "ref_id").select("read_id", "delta")


def read_off_overlap(spark, sf_dir):
    return T.position_overlap(_placed(spark, sf_dir), "ref_id", P.length).select("read_id", "overlap")


def read_off_inverse(spark, sf_dir):
    o = T.position_overlap(_placed(spark, sf_dir), "ref_id", P.length)
    o = dense_number(o, ["pos", "read_id"], T.STRETCH, ["ref_id"], "ord").drop("pos")
    return T.positions_from_overlap(o, "ref_id", P.length).select("read_id", F.col("restored").alias("pos"))


def pos_order(spark, sf_dir):
    """Alignments in stored order: by position, ties by id."""
    return dense_number(_placed(spark, sf_dir), ["pos", "read_id"], T.STRETCH, ["ref_id"], "rank").select("read_id", F.col("rank").cast("int").alias("rank"))


def hq_ordinal(spark, sf_dir):
    """Number of N-free reads before each N-free read, in order of id."""
    r = _reads(spark, sf_dir).withColumn("hq", F.when(F.contains("seq", F.lit("N")), 0).otherwise(1))
    return running_sum(r, F.col("hq"), ["read_id"], WIDTH, out="ordinal", exclusive=True).where("hq = 1").select("read_id", "ordinal")


def _components(spark, sf_dir):
    """Three components by language of the reads' class: N-free windows by third, reads with N."""
    r = derived.alignments(spark, sf_dir)
    c = F.when(F.contains("window", F.lit("N")), "n").when(F.pmod("ref_id", F.lit(2)) == 0, "hq").otherwise("lq")
    parts = r.select("read_id", c.alias("component"), "pos")
    sizes = parts.groupBy("component").agg((F.max("pos") + P.length).alias("size"))
    order = F.when(F.col("component") == "hq", 0).when(F.col("component") == "lq", 1).otherwise(2)
    return parts, sizes.withColumn("ord", order)


def id_to_pos(spark, sf_dir):
    return _placed(spark, sf_dir).select("read_id", "pos")


def joined_coordinate(spark, sf_dir):
    parts, sizes = _components(spark, sf_dir)
    return T.joined_coordinate(parts, sizes).select("read_id", "joined")


def component_split(spark, sf_dir):
    parts, sizes = _components(spark, sf_dir)
    return T.split_coordinate(T.joined_coordinate(parts, sizes).select("read_id", "joined"), sizes).select("read_id", F.col("component2").alias("component"), F.col("pos2").alias("pos"))


# pairs -----------------------------------------------------------------------


def _pair_items(spark, sf_dir):
    """Per pair: the mates' positions and their distance; distances vary from near to far."""
    p = derived.pairs(spark, sf_dir).where("mate = 0")
    block = F.floor(F.col("pair_id") / derived.SPREAD).cast("long")
    n = F.pmod("pair_id", F.lit(derived.SPREAD))
    far = F.when(F.pmod(n, F.lit(4)) == 0, F.lit(200)).when(F.pmod(n, F.lit(4)) == 1, 70_000 + F.pmod(n * 37, F.lit(500))).when(F.pmod(n, F.lit(4)) == 2, 140_000 + n).otherwise(70_000 - F.pmod(n * 11, F.lit(90_000)))
    dist = F.abs(far).cast("long")
    return p.select("pair_id", block.alias("block_id"), n.cast("long").alias("ord"), dist.alias("dist"))


def pe_mate_distance(spark, sf_dir):
    placed = derived.pairs(spark, sf_dir).select("read_id", "pair_id", "mate", (F.pmod("pair_id", F.lit(derived.SPREAD)) * derived.STEP + F.col("mate") * derived.MATE_GAP).alias("pos"))
    return T.mate_positions(placed).select("pair_id", (F.col("other") - F.col("base")).cast("long").alias("distance"), (F.col("base") < F.col("other")).alias("base_first"))


def pe_pos_class(spark, sf_dir):
    """Classes of the position coder: unsigned 16-bit distance, signed 16-bit delta, raw."""
    items = _pair_items(spark, sf_dir)
    return T.predict(items, "block_id", 65_535, -32_768, 32_767).groupBy("kind").agg(F.count("*").alias("n"))


def pe_pos_roundtrip(spark, sf_dir):
    coded = T.predict(_pair_items(spark, sf_dir), "block_id", 65_535, -32_768, 32_767).select("pair_id", "block_id", "ord", "kind", "value")
    return T.unpredict(coded, "block_id").select("pair_id", F.col("restored").alias("dist"))


def pe_order_roundtrip(spark, sf_dir):
    """Classes of the order coder: unsigned 8-bit distance, signed 8-bit delta, raw."""
    coded = T.predict(_pair_items(spark, sf_dir), "block_id", 255, -128, 127).select("pair_id", "block_id", "ord", "kind", "value")
    return T.unpredict(coded, "block_id").select("pair_id", F.col("restored").alias("dist"))


# 2.4 self-match ----------------------------------------------------------------


def _palindromic(spark, sf_dir):
    """References followed by the reverse complement of their inner part, and a marker of their own."""
    r = _refs(spark, sf_dir).where(F.length("dna") >= 200)
    tail = S.reverse_complement(F.substring("dna", 31, 120))
    return r.select("ref_id", F.concat(F.substring("dna", 1, 300), F.lit("ACCA"), tail, F.lit("GTTG"), F.substring("dna", 301, 1 << 30)).alias("dna"))


def selfmatch_seeds(spark, sf_dir):
    return X.seed_pairs(_palindromic(spark, sf_dir), P)


def _match_rows(found):
    return found.select("dest_id", "src_id", *[F.col(c).cast("int").alias(c) for c in ("pos_dest", "pos_src", "len")])


def selfmatch_maximal(spark, sf_dir):
    """Maximal inverted repeats of each reference in itself."""
    return _match_rows(X.maximal_matches(_palindromic(spark, sf_dir), P))


def crossmatch_maximal(spark, sf_dir):
    """Maximal inverted repeats between references: sources with an even id, destinations with an
    odd one, of which every second is turned round."""
    refs = _refs(spark, sf_dir)
    turned = F.when(F.pmod("ref_id", F.lit(4)) == 1, S.reverse_complement("dna")).otherwise(F.col("dna"))
    return _match_rows(X.maximal_matches(refs.where("ref_id % 2 = 0"), P, refs.where("ref_id % 2 = 1").select("ref_id", turned.alias("dna"))))


def _place_rows(found):
    return found.select("ref_id", *[F.col(c).cast("int").alias(c) for c in ("pos_src", "pos_dest", "len")])


def selfmatch_canonical(spark, sf_dir):
    """Source before destination, no overlap, mirrored halves once."""
    return _place_rows(X.own_canonical(_palindromic(spark, sf_dir), P))


def interval_cover(spark, sf_dir):
    """Disjoint destinations, left to right."""
    return _place_rows(X.own_cover(_palindromic(spark, sf_dir), P))


def hole_text(spark, sf_dir):
    """Per reference: size of text left and holes' bases, number of holes, size of the text left."""
    h = X.own_holes(_palindromic(spark, sf_dir), P)
    gone = F.aggregate("map", F.lit(0), lambda a, x: a + x["len"])
    return h.select("ref_id", (F.length("holed") - F.size("map") + gone).cast("int").alias("size"), F.size("map").alias("holes"), F.length("holed").alias("left_over"))


def ref_recover(spark, sf_dir):
    return X.own_filled(X.own_holes(_palindromic(spark, sf_dir), P))


# whole pipeline ----------------------------------------------------------------


def _stranded(spark, sf_dir):
    """Reads of which every third is reverse complemented and every eleventh has one base changed."""
    r = _reads(spark, sf_dir)
    at = F.pmod(F.col("read_id") * 7, F.lit(P.length)).cast("int") + 1
    changed = F.when(F.pmod("read_id", F.lit(11)) == 0, F.overlay("seq", F.translate(F.substring(F.col("seq"), at, F.lit(1)), "ACGTN", "CGTAN"), at)).otherwise(F.col("seq"))
    return r.select("read_id", changed.alias("seq")).select("read_id", F.when(F.pmod("read_id", F.lit(3)) == 0, S.reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"))


def _round_trip(spark, reads, mode):
    from helixmill.plans.archive import decode, encode

    path = f"{Store(spark, 'archive').base}/{mode}"
    encode(reads, path, P, mode, reads_per_block=50_000)
    return decode(spark, path)


def roundtrip_default(spark, sf_dir):
    return _round_trip(spark, _stranded(spark, sf_dir), "default").groupBy("seq").agg(F.count("*").alias("n"))


def roundtrip_preserve(spark, sf_dir):
    return _round_trip(spark, _stranded(spark, sf_dir), "preserve")


def roundtrip_paired(spark, sf_dir):
    return _round_trip(spark, derived.pairs(spark, sf_dir), "paired")


def queries():
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"}
