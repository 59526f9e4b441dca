"""Queries that failed by time or disk on larger tables: results against plain Python, and work that
follows the rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions.arrays import cuts
from helixmill.operators import assemble as A
from helixmill.operators import blocks
from helixmill.operators import candidates as K
from helixmill.operators import chains as C
from helixmill.operators import overlap as O
from helixmill.operators import rankzip as Z
from helixmill.operators import selfmatch as X
from helixmill.operators import streams as T
from helixmill.params import ReadParams
from helixmill.plans import queries as Q
from helixmill.plans.storage import Store
from helixmill.sources import derived

RC = str.maketrans("ACGTN", "TGCAN")


def rc(s):
    return s[::-1].translate(RC)


def genome(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def documents(spark, tmp_path, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_windows_of_a_long_document_take_linear_time(spark, tmp_path):
    r = random.Random(21)
    text = "".join(r.choice("abcdeghijklmnoprstuvwxyzABC é,") for _ in range(1_000_000))
    d = documents(spark, tmp_path, {3: text, 5: None, 6: "", 7: "é1"})
    dna = "".join(dict(zip(derived.LETTERS, derived.BASES))[c.lower()] for c in text if c.isascii() and c.isalpha())
    assert {x.ref_id: x.dna for x in derived.references(spark, d).collect()} == {3: dna, 5: None, 6: "", 7: ""}
    start = time.time()
    n, last = derived.alignments(spark, d).agg(F.count("*"), F.max("read_id")).first()
    assert time.time() - start < 12  # some 60 s by substrings, which walk from the start
    assert n == (len(dna) - 100) // 25 + 1 and last == 3_000_000 + n - 1
    got = {x.read_id: x.seq for x in derived.reads(spark, d).where("read_id % 9973 = 0").collect()}
    assert got and all(s == dna[25 * (i - 3_000_000) :][:100] for i, s in got.items())


@pytest.mark.parametrize("strand", [0, 1])
def test_mismatches_without_a_struct_for_every_base(spark, strand):
    r = random.Random(22)
    rows, want = [], {}
    for i in range(50):
        w = "".join(r.choice("ACGTN") for _ in range(100))
        s = "".join(r.choice("ACGTN") if r.random() < 0.05 * (i % 3) else c for c in w)
        rows.append((i, strand, w, rc(s) if strand else s))
        want[i] = [(j, a, b) for j, (a, b) in enumerate(zip(w, s)) if a != b]
    x = T.extract_mismatches(spark.createDataFrame(rows, "read_id long, strand int, window string, seq string"), 100)
    assert "filter(transform(" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert {y.read_id: [tuple(m) for m in y.ms] for y in x.collect()} == want
    assert sorted((y.read_id, y.ord, y.off, y.ref_base, y.read_base) for y in T.mismatch_rows(x).collect()) == [(i, k, *m) for i, ms in want.items() for k, m in enumerate(ms)]


def seeds_by_hand(text, p):
    d, k, places, out = rc(text), p.match_k, {}, set()
    for i in range(0, len(text) - k + 1, p.match_src_step):
        if "N" not in text[i : i + k]:
            places.setdefault(text[i : i + k], []).append(i)
    for j in range(0, len(d) - k + 1, p.match_dest_step):
        out |= {(j, i) for i in places.get(d[j : j + k], [])[: p.bucket]}
    return out


def test_matches_within_a_string_need_no_shuffle(spark):
    r, p = random.Random(23), ReadParams(100)
    a = genome(r, 500)
    texts = ["", "A" * 35, a + "N" * 3 + rc(a), rc(a[:90]) + genome(r, 33) + a, "ACGT" * 90, a[:70] + "N" + a[71:200] + "GG" + rc(a[:200]), genome(r, 20) + (a[:60] + "T") * 15 + rc(a[:60])]
    refs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "ref_id long, dna string").coalesce(1)
    seeds, found = X.seed_pairs(refs, p), X.maximal_matches(refs, p)
    for df in (seeds, found):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, seeds.select("dest_id", "at_dest", "src_id", "at_src").collect()))
    assert got == sorted((n, j, n, i) for n, t in enumerate(texts) for j, i in seeds_by_hand(t, p)) and len(got) > 100
    want = set()
    for n, t in enumerate(texts):
        d = rc(t)
        for j, i in seeds_by_hand(t, p):
            lo, hi = 0, p.match_k
            while i - lo > 0 and j - lo > 0 and t[i - lo - 1] == d[j - lo - 1]:
                lo += 1
            while i + hi < len(t) and j + hi < len(t) and t[i + hi] == d[j + hi]:
                hi += 1
            if lo + hi >= p.match_min:
                want.add((n, n, j - lo, i - lo, lo + hi))
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)


@pytest.mark.parametrize("common", [10_000, 2])
def test_linked_ends_equal_links_and_shuffle_hashes_only(spark, monkeypatch, common):
    monkeypatch.setattr(O, "COMMON", common)
    r, p = random.Random(24), ReadParams(100)
    g, tip = genome(r, 900), "ACGTA" * 5
    seqs = [g[i : i + 100] for i in range(0, 800, 25)] * 2 + ["A" * 100] * 3 + [tip * 4, genome(r, 100), "A" * 99 + "C", tip * 3 + "G" * 25] + [g[100:200]] * 5
    df = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    copies = O.duplicate_links(df, 7)
    links = copies.union(O.plain_rank_zip(O.open_suffixes(df, copies), O.open_prefixes(df, copies), 25, p))
    ends = O.linked_ends(df, 25, p, 7)
    want = {(x.s, 0): (x.p, x.off) for x in links.collect()} | {(x.p, 1): (x.s, x.off) for x in links.collect()}
    assert {(x.read_id, x.side): (x.other, x.off) for x in ends.collect()} == {(i, side): want.get((i, side), (None, None)) for i in range(len(seqs)) for side in (0, 1)}
    flags = O.split_weak(df, links)
    assert sorted(map(tuple, O.strong_reads(df, ends).collect())) == sorted(map(tuple, flags.collect()))
    kept = O.cut_links(links, flags.where("NOT is_reference"))
    assert sorted(map(tuple, O.links_of_strong(ends).select("s", "p", "off").collect())) == sorted(map(tuple, kept.collect()))
    assert flags.where("NOT is_reference").count() and kept.count()
    if common > 2:
        assert ends.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_placement_of_copies_stores_and_shuffles_no_bases(spark, tmp_path, monkeypatch):
    r, p = random.Random(25), ReadParams(100)
    letters = dict(zip("ACGT", "abcd"))
    texts = ["".join(letters[c] for c in genome(r, n)) for n in (600, 90, 350, 1000)]
    d = documents(spark, tmp_path, dict(zip([5, 2, 9, 7, 4, 11], [*texts, texts[0], texts[3][:425]])))
    reads, store = Q._clean(spark, d), Store(spark, "test")
    copies = store.save(O.duplicate_links(reads, Q.WIDTH))
    want = A.placement(A.contigs(reads, copies, A.chain_heads(store, reads, copies)[0], p), p).collect()
    monkeypatch.setattr(Store, "save", lambda *_: pytest.fail("a table is stored"))
    got = Q.contig_placement(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 50
    assert "Exchange hashpartitioning(seq" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size, common, rows", [(90, 10_000, 1 << 19), (400, 10_000, 64), (200, 9, 64), (0, 9, 64)])
def test_rank_zip_by_blocks_of_hashes(spark, monkeypatch, size, common, rows):
    monkeypatch.setattr(blocks, "PART_ROWS", rows)
    monkeypatch.setattr(Z, "SAMPLE", 5)
    r, p = random.Random(26), ReadParams(16)
    seqs = ["".join(r.choice("AC") for _ in range(16)) for _ in range(size)] + ["ACGT" * 4] * (size // 9) + ["A" * 16] * (size // 20)
    ids = r.sample(range(-(10**11), 10**12), len(seqs))
    ids[: len(seqs) // 2] = range(len(seqs) // 2)
    df = spark.createDataFrame(list(zip(ids, seqs)), "read_id long, seq string")
    want = set()
    for off in (8, 12, 15):
        keys = {s[off:] for s in seqs} & {s[: 16 - off] for s in seqs}
        for k in keys:
            left, right = (sorted(i for i, s in zip(ids, seqs) if cut(s) == k) for cut in (lambda s: s[off:], lambda s: s[: 16 - off]))
            if any(a == b for a, b in zip(left, right)):
                right = right[-1:] + right[:-1]
            want |= {(a, b, off) for a, b in zip(left, right) if a != b}
    got = Z.zip_all(Store(spark, "test"), df, [8, 12, 15], p, 7, common)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString() or common == 9


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _documents_in(spark, path):
    r = random.Random(9)
    rows = [(k, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.choice([0, 90, 130, 700])))) for k in range(60)] + [(60, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_mismatch_rows_are_made_where_the_reads_are(spark, tmp_path):
    d = _documents_in(spark, tmp_path)
    got = Q.mm_extract(spark, d)
    assert _plan(got).count("MapInArrow") == 1 and "Generate" not in _plan(got)
    want = T.mismatch_rows(Q._extracted(spark, d))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())
    assert got.count() > 500


def test_mismatches_are_counted_where_the_reads_are(spark, tmp_path):
    d = _documents_in(spark, tmp_path)
    got = Q.mm_rank_table(spark, d)
    assert _plan(got).count("MapInArrow") == 1 and "Generate" not in _plan(got)
    assert sorted(got.collect()) == sorted(T.rank_table(T.mismatch_rows(Q._extracted(spark, d))).collect())
    none = str(tmp_path / "none")
    spark.createDataFrame([(1, None), (2, "abc")], "doc_id long, text string").write.parquet(f"{none}/documents.parquet")
    assert Q.mm_rank_table(spark, none).count() == 16


def test_offset_codes_are_made_where_the_reads_are(spark, tmp_path):
    d = _documents_in(spark, tmp_path)
    got = Q.mm_offset_code(spark, d)
    assert _plan(got).count("MapInArrow") == 1
    offs = Q._offs(spark, d).where(F.size("offs") > 0)
    want = offs.select("read_id", F.size("offs").alias("mm"), F.array_join(T.offset_code(F.col("offs"), 100).cast("array<string>"), ",").alias("code"))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


def test_offset_codes_of_any_offsets(spark):
    r = random.Random(4)
    rows = [sorted(r.sample(range(100), r.choice([1, 2, 3, 5, 40, 100]))) for _ in range(300)]
    want = [x[0] for x in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k long, offs array<int>").orderBy("k").select(T.offset_code(F.col("offs"), 100)).collect()]
    code, ends = T.offset_codes(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])]), 100)
    assert [code[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])] == want
    code, ends = T.offset_codes(np.zeros(0, np.int64), np.zeros(1, np.int64), 100)
    assert not len(code) and ends.tolist() == [0]


def _repeats(r):
    """Strings with inverted repeats, next to each other, overlapping themselves, with N, and short ones."""
    out = ["", "ACGT", "AT" * 90, "N" * 120, genome(r, 35), "ACGTTGCA" * 40]
    for _ in range(30):
        a = genome(r, r.choice([60, 200, 400]))
        i = r.randrange(len(a) - 55)
        cut = rc(a[i : i + r.choice([50, 80, 300])])
        out.append(a + r.choice(["", "N", genome(r, 30)]) + cut + genome(r, r.choice([0, 40])) + cut[:60])
    return out


def test_kmers_that_meet_nothing_are_not_sorted():
    r, p = random.Random(12), ReadParams(100)
    texts = _repeats(r)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    s = X._Strings(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    got = [set() for _ in texts]
    for row, at, src in zip(*s.seeds(p)):
        got[row].add((at, src))
    assert got == [seeds_by_hand(t, p) for t in texts]
    src, dest = s._kmers(s.a, p.match_k, p.match_src_step), s._kmers(s.b, p.match_k, p.match_dest_step)
    met_s, met_d = X._meeting(src[0], src[2:], dest[0], dest[2:])
    equal = {tuple(x) for x in zip(src[0], *src[2:])} & {tuple(x) for x in zip(dest[0], *dest[2:])}
    assert {i for i, x in enumerate(zip(src[0], *src[2:])) if tuple(x) in equal} <= set(met_s.tolist())
    assert {i for i, x in enumerate(zip(dest[0], *dest[2:])) if tuple(x) in equal} <= set(met_d.tolist())
    one = genome(r, 3000)
    alone = X._Strings(np.frombuffer(one.encode(), np.uint8), np.array([0, 3000]))
    src, dest = alone._kmers(alone.a, 36, 5), alone._kmers(alone.b, 36, 3)
    assert len(X._meeting(src[0], src[2:], dest[0], dest[2:])[1]) < len(dest[0]) / 4


def test_canonical_matches_without_a_join(spark):
    p = ReadParams(100)
    refs = spark.createDataFrame(list(enumerate(_repeats(random.Random(13)))) + [(99, None)], "ref_id long, dna string").repartition(3)
    got = X.own_canonical(refs, p)
    assert "Exchange" not in _plan(got).replace("RoundRobinPartitioning", "").split("MapInArrow")[0]
    want = X.canonical_matches(X.maximal_matches(refs, p), refs.select("ref_id", F.length("dna").alias("size")), p)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert got.count() > 30


def test_cover_and_holes_without_a_shuffle(spark, monkeypatch):
    r, p = random.Random(14), ReadParams(100)
    unit = genome(r, 70)
    texts = [*_repeats(r), (unit + rc(unit)) * 20, unit * 9 + rc(unit) * 9]
    refs = spark.createDataFrame([*enumerate(texts), (None, unit + rc(unit))], "ref_id long, dna string").coalesce(2).localCheckpoint()
    want = X.interval_cover(X.own_canonical(refs, p), p)
    holed = X.punch_holes(refs, want)
    monkeypatch.setattr(X, "cuts", lambda at, most=300: cuts(at, most))
    got, holes = X.own_cover(refs, p), X.own_holes(refs, p)
    back = X.own_filled(holes)
    for df in (got, holes, back):
        assert "Exchange" not in _plan(df) and "Window" not in _plan(df)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 60
    rows = lambda df: sorted(map(repr, df.select("ref_id", "holed", "map").collect()))
    assert holes.dtypes == holed.dtypes and rows(holes) == rows(holed)
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(map(tuple, refs.collect()), key=key)


def test_cover_and_hole_queries_move_no_strings(spark, tmp_path):
    d = _documents_in(spark, tmp_path)
    for name in ("interval_cover", "hole_text", "ref_recover"):
        got = getattr(Q, name)(spark, d)
        assert "Exchange" not in _plan(got), name
    assert sorted(map(tuple, Q.ref_recover(spark, d).collect())) == sorted(map(tuple, Q._palindromic(spark, d).collect()))


def test_many_holes_are_filled_in_linear_time(spark):
    r = random.Random(15)
    a = genome(r, 400_000)
    holes = [(400_000 + k * 60, k * 11, 50) for k in range(20_000)]
    row = [(7, a + "%ACGTACGTAC" * 20_000, holes), (8, "", []), (None, "AC", [])]
    df = spark.createDataFrame(row, "ref_id long, holed string, map array<struct<pos_dest:int,pos_src:int,len:int>>").coalesce(1).localCheckpoint()
    start = time.time()
    got = {x.ref_id: x.dna for x in X.own_filled(df).collect()}
    assert time.time() - start < 12
    assert got == {7: a + "".join(rc(a[s : s + n]) + "ACGTACGTAC" for _, s, n in holes), 8: "", None: "AC"}


@pytest.mark.parametrize("length, rows", [(100, 1 << 19), (100, 64), (37, 64), (1, 64)])
def test_seeded_overlaps_by_blocks_of_hashes(spark, monkeypatch, length, rows):
    monkeypatch.setattr(blocks, "PART_ROWS", rows)
    monkeypatch.setattr(K, "CHUNK", 50)
    monkeypatch.setattr(K, "PAIRS", 7)
    r, p = random.Random(27), ReadParams(length)
    g, line = genome(r, 900), genome(r, 140)
    texts = [g, g[:400] + "T" + g[400:], *(genome(r, 90) + line + genome(r, 90) for _ in range(12)), "A" * 200, "ACGTA" * 50]
    seqs = [t[i : i + length] for t in texts for i in range(0, len(t) - length + 1, 7)]
    seqs += seqs[::5]
    ids = r.sample(range(-(10**11), 10**12), len(seqs))
    ids[: len(seqs) // 2] = range(len(seqs) // 2)
    df = spark.createDataFrame(list(zip(ids, seqs)), "read_id long, seq string")
    got = K.all_candidates(Store(spark, "test"), df, p)
    distinct = O.distinct_reads(df)
    want = O.overlap_candidates(distinct, distinct, p)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in _plan(got) and "Generate" not in _plan(got)
    assert length < 100 or got.count() > 500
    none = df.where("read_id IS NULL")
    assert K.all_candidates(Store(spark, "test"), none, p).count() == 0


@pytest.mark.parametrize("limit", [1 << 21, 0])
@pytest.mark.parametrize("parts", [1, 5])
def test_chains_are_contracted_where_reads_lie_together(spark, monkeypatch, parts, limit):
    monkeypatch.setattr(A, "READS", limit)
    r, store, width = random.Random(41), Store(spark, "test"), 50
    ids, nxt, off, home = r.sample(range(2000), 600), {}, {}, {}
    order = sorted(ids[:300]) + ids[300:]
    at = 0
    while at < len(order) - 1:  # chains and rings, along ids and across them; some links lead to copies
        n = min(r.choice([1, 2, 3, 9, 40]), len(order) - at)
        run, at = order[at : at + n], at + n
        for a, b in zip(run, run[1:] + (run[:1] if n > 1 and r.random() < 0.5 else [])):
            nxt[a], off[a] = b, 25
    heads = sorted(set(ids) - set(nxt.values()))
    parted = lambda: spark.createDataFrame([(i,) for i in ids], "read_id long").select("read_id", C.home_of(F.col("read_id"), width, parts).alias("h"))
    home = {x.read_id: x.h for x in parted().collect()}
    for a in [a for a in nxt if nxt[a] in heads or r.random() < 0.3]:
        if home[a] == home[nxt[a]]:
            off[a] = 0
    nodes = store.save(spark.createDataFrame([(i, nxt.get(i), off.get(i), home[i]) for i in ids], "read_id long, next long, off int, home int"))
    links = store.save(nodes.where("next IS NOT NULL").select(F.col("read_id").alias("s"), F.col("next").alias("p"), "off"))
    rows = lambda df, *columns: sorted(tuple(x) for x in df.select(*columns).collect())
    placed, cyclic = C.heads(store, nodes, parts, width)
    want = A.chain_heads(store, nodes, links)
    assert rows(placed, "read_id", "head", "dist") == rows(want[0], "read_id", "head", "dist")
    assert rows(cyclic, "read_id", "label") == rows(want[1], "read_id", "label") and cyclic.count() > 50
    assert {x.read_id: (x.next, x.off) for x in cyclic.collect()} == {x.read_id: (nxt[x.read_id], off[x.read_id]) for x in cyclic.collect()}
    _, all_placed, gone = A.cut_cycles(store, nodes, links)
    placed, _, cut, left = C.cut(store, nodes, parts, width)
    assert rows(placed, "read_id", "head", "dist") == rows(all_placed, "read_id", "head", "dist")
    assert rows(cut, "s", "p", "off") == rows(gone, "s", "p", "off") and left.isEmpty()


def test_cycle_cut_doubles_only_links_that_leave_a_part(spark, tmp_path, monkeypatch):
    r, letters = random.Random(42), dict(zip("ACGT", "abcd"))
    texts = ["".join(letters[c] for c in genome(r, n)) for n in (2000, 90, 1500, 3000)]
    ring = "".join(letters[c] for c in genome(r, 100))
    d = documents(spark, tmp_path, dict(enumerate([*texts, texts[0], texts[3][:425], ring * 3])))
    seen, doubled = [], A.doubled_heads

    def counted(store, first):
        seen.append(first.count())
        return doubled(store, first)

    for module in (A, C):
        monkeypatch.setattr(module, "doubled_heads", counted)
    got = Q.cycle_cut(spark, d).collect()
    n = Q._clean(spark, d).count()
    assert [(x.cycles, x.on_cycles, x.unplaced) for x in got] == [(1, 0, 0)] and n > 250
    assert sum(seen) <= got[0].reads + n // 10


def test_cross_matches_deal_only_kmers_that_meet(spark):
    r, p = random.Random(43), ReadParams(100)
    part, far = genome(r, 400), genome(r, 900)
    src = [genome(r, 300) + part[: 60 + 20 * i] + genome(r, 50) for i in range(16)] + [part[:150] + "N" + part[151:], far[:100] + "NN" + far[102:145] + "N" + far[146:], "", "ACGT" * 30]
    dest = [rc(genome(r, 40) + part + "N" + genome(r, 80)), rc(part[:150] + "N" + part[151:] + part[:90]), rc(far[:100] + "NN" + far[102:145] + "N" + far[146:]), genome(r, 500), "ACGT" * 20]
    frame = lambda texts, key: spark.createDataFrame([(key(i), t) for i, t in enumerate(texts)], ["ref_id", "dna"])
    both = []
    for key in (int, lambda i: f"{i:04d}"):  # by blocks, and by a join
        a, b = frame(src, key), frame(dest, key)
        seeds, found = X.seed_pairs(a, p, b), X.maximal_matches(a, p, b)
        both.append([sorted((int(x.dest_id), x[1], int(x[2]), x[3]) for x in seeds.collect())] + [sorted((int(x.dest_id), int(x.src_id), x.pos_dest, x.pos_src, x.len) for x in found.collect())])
        plan = seeds._jdf.queryExecution().executedPlan().toString()
        assert ("Window" in plan, "SortMergeJoin" in plan) == ((False, False) if key is int else (True, True))
    assert both[0] == both[1] and len(both[0][0]) > 300
    rows = both[0][1]
    assert {x[4] for x in rows if x[:2] == (2, 17)} == {900} and any(x[:2] == (1, 16) and x[4] == 400 for x in rows)
