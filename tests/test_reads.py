import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import assemble as A
from helixmill.operators import overlap as O
from helixmill.operators import selfmatch as X
from helixmill.operators.mapping import best_mapping
from helixmill.operators.ordering import dense_number, next_in_group, running_sum
from helixmill.params import ReadParams
from helixmill.plans.archive import decode, encode
from helixmill.plans.storage import Store

RC = str.maketrans("ACGTN", "TGCAN")


def rc(s):
    return s[::-1].translate(RC)


def frame(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def genome(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def test_ordering(spark):
    r = random.Random(1)
    rows = [(i * r.randint(1, 3) + i, r.choice("aab"), r.randint(0, 9)) for i in range(200)]
    rows = list({x[0]: x for x in rows}.values())
    df = spark.createDataFrame(rows, "id long, k string, v int")
    ids = sorted(x[0] for x in rows)
    assert {x.id: x.number for x in dense_number(df, ["id"], 16).collect()} == {i: n for n, i in enumerate(ids)}
    total, want = 0, {}
    for i, _, v in sorted(rows):
        total += v
        want[i] = total
    assert {x.id: x.running for x in running_sum(df, F.col("v"), ["id"], 16).collect()} == want
    nxt = {x.id: x.next for x in next_in_group(df, "k", "id", 16).collect()}
    for i, k, _ in rows:
        assert nxt[i] == min((j for j, q, _ in rows if q == k and j > i), default=None)


def test_ordering_in_two_levels(spark, monkeypatch):
    from helixmill.operators import ordering

    monkeypatch.setattr(ordering, "FAN", 3)
    test_ordering(spark)


def test_scratch_folder_needs_sharing(monkeypatch):
    from types import SimpleNamespace

    from helixmill.plans.storage import shared_folder

    session = lambda master, given: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: given), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_folder(session("spark://x:1", "hdfs:///c/")) == "hdfs:///c"
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://x:1", None))


@pytest.fixture(params=["one task", "rounds"])
def ways(request, monkeypatch):
    """Both the bounded ways in one task and those for any size."""
    if request.param == "rounds":
        monkeypatch.setattr(O, "EDGES", 0)
        monkeypatch.setattr(O, "ENDS", 0)
        monkeypatch.setattr(A, "READS", 0)


def test_greedy_equals_sequential(spark, ways):
    r = random.Random(2)
    edges = list({(r.randint(0, 30), r.randint(0, 30), r.randint(1, 9)) for _ in range(200)})
    edges = [e for e in edges if e[0] != e[1]]
    want, s_used, p_used = set(), set(), set()
    for s, p, off in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if s not in s_used and p not in p_used:
            want.add((s, p, off))
            s_used.add(s)
            p_used.add(p)
    got = O.greedy_matching(Store(spark, "t"), spark.createDataFrame(edges, "s long, p long, off int"))
    assert {tuple(x) for x in got.collect()} == want


CASES = {
    "copies": lambda r: [genome(r, 64)] * 7,
    "circle": lambda r: (lambda g: [(g + g)[i : i + 64] for i in range(0, 200, 10)])(genome(r, 200)),
    "homopolymer": lambda r: ["A" * 64] * 3 + ["A" * 63 + "C", "C" + "A" * 63],
    "repeat": lambda r: [("ACG" * 40)[i : i + 64] for i in range(6)],
    "tiles": lambda r: (lambda g: [g[i : i + 64] for i in range(0, 400, 7)])(genome(r, 470)),
    "strangers": lambda r: [genome(r, 64) for _ in range(5)],
    "one": lambda r: [genome(r, 64)],
}


@pytest.mark.parametrize("case", CASES)
def test_assembly_places_every_read(spark, case, ways):
    seqs = CASES[case](random.Random(3))
    p, store = ReadParams(64), Store(spark, "t")
    reads = store.save(frame(spark, seqs))
    links, kept = O.overlap_reads(store, reads, p, weak_cut=False, least=40)
    for x in links.collect():
        assert seqs[x.s][x.off :] == seqs[x.p][: 64 - x.off]
    assert links.select("s").distinct().count() == links.select("p").distinct().count() == links.count()
    links, placed, _ = A.cut_cycles(store, kept, links)
    text = A.contigs(kept, links, placed, p, segment=100)
    back = {x.read_id: x.window for x in A.read_windows(text, placed, p, segment=100).collect()}
    assert back == dict(enumerate(seqs))


def test_rank_zip_shift(spark):
    p = ReadParams(8)
    seqs = ["ACACACAC", "ACACACAC", "CACACACA", "ACACACAC"]
    df = frame(spark, seqs)
    out = O.rank_zip(df, df, 2, p).collect()
    assert len({x.s for x in out}) == len({x.p for x in out}) == len(out) and all(x.s != x.p and seqs[x.s][2:] == seqs[x.p][:6] for x in out)
    assert len(out) == 3  # the three equal reads in a circle; the other meets itself only


def sequential_zip(seqs, off):
    """Pairs of the i-th suffix and prefix of each key, prefixes shifted by one where a read meets itself."""
    keys = {s[off:] for s in seqs} & {s[: len(s) - off] for s in seqs}
    out = set()
    for k in keys:
        left = [i for i, s in enumerate(seqs) if s[off:] == k]
        right = [i for i, s in enumerate(seqs) if s[: len(s) - off] == k]
        if any(a == b for a, b in zip(left, right)):
            right = right[-1:] + right[:-1]
        out |= {(a, b, off) for a, b in zip(left, right) if a != b}
    return out


def test_chains_and_cycles_both_ways(spark, monkeypatch):
    r, store = random.Random(14), Store(spark, "t")
    ids = r.sample(range(10**6), 60)
    nxt = dict(zip(ids[:20], ids[1:21])) | dict(zip(ids[30:40], ids[31:40] + ids[30:31])) | {ids[45]: ids[45]} | dict(zip(ids[50:59], ids[51:60]))
    links = store.save(spark.createDataFrame([(a, b, 1 + a % 9) for a, b in nxt.items()], "s long, p long, off int"))
    reads = store.save(spark.createDataFrame([(i, "A") for i in ids], "read_id long, seq string"))
    got = []
    for limit in (1 << 21, 0):
        monkeypatch.setattr(A, "READS", limit)
        placed, cyclic = A.chain_heads(store, reads, links)
        got.append((sorted(map(tuple, placed.collect())), sorted(map(tuple, cyclic.collect()))))
    assert got[0] == got[1] and len(got[0][1]) == 11 and (ids[30], min(ids[30:40])) in got[0][1]


@pytest.mark.parametrize("off", [1, 4, 7])
def test_rank_zip_both_ways(spark, off):
    r, p = random.Random(off), ReadParams(8)
    seqs = ["".join(r.choice("AC") for _ in range(8)) for _ in range(120)]
    df = frame(spark, seqs)
    want = sequential_zip(seqs, off)
    assert {tuple(x) for x in O.rank_zip(df, df, off, p, width=7).collect()} == want
    ends = O.zip_ends(O.open_ends(df, df, off), p)
    assert {(x.id, x.other, x.off) for x in ends.where("side = 0 AND other IS NOT NULL").collect()} == want
    assert {(x.other, x.id, x.off) for x in ends.where("side = 1 AND other IS NOT NULL").collect()} == want


def test_short_overlaps_down_to_one_base(spark, ways):
    r, p, store = random.Random(12), ReadParams(64), Store(spark, "t")
    seqs = [genome(r, 64) for _ in range(40)] + [(lambda g: g)(genome(r, 64))] * 2
    links = O.short_overlap_links(store, frame(spark, seqs), O.duplicate_links(frame(spark, seqs)), p).collect()
    assert all(seqs[x.s][x.off :] == seqs[x.p][: 64 - x.off] for x in links)
    open_s, open_p = set(range(len(seqs))) - {x.s for x in links}, set(range(len(seqs))) - {x.p for x in links}
    assert not any(seqs[s][-1] == seqs[p_][0] for s in open_s for p_ in open_p if s != p_)
    assert max(x.off for x in links) == 63


def test_holes_filled_from_other_strings(spark):
    r, p = random.Random(9), ReadParams(100)
    hq = [genome(r, 900) for _ in range(3)]
    others = [genome(r, 70) + rc(hq[0][100:260]) + genome(r, 30) + rc(hq[2][500:900]), rc(hq[1]), genome(r, 300), "N" * 40 + rc(hq[1][0:120]) + rc(hq[0][60:170]), ""]
    src = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(hq)], "ref_id string, dna string")
    dest = spark.createDataFrame([(f"o{i}", t) for i, t in enumerate(others)], "ref_id string, dna string")
    found = X.cross_matches(X.maximal_matches(src, p, dest), dest.select("ref_id", F.length("dna").alias("size")))
    holed = X.punch_holes(dest, X.interval_cover(found, p))
    sizes = {x.ref_id: (len(x.holed), len(x.map)) for x in holed.collect()}
    assert sizes["o1"] == (1, 1) and sizes["o0"][1] == 2 and sizes["o0"][0] <= 104 and sizes["o2"] == (300, 0) and sizes["o3"][1] == 2
    assert {x.ref_id: x.dna for x in X.fill_from(holed, src).collect()} == {f"o{i}": t for i, t in enumerate(others)}


def test_long_runs_are_extended_beyond_reach(spark, monkeypatch):
    monkeypatch.setattr(X, "REACH", 20)
    r, p = random.Random(10), ReadParams(100)
    a = genome(r, 700)
    refs = spark.createDataFrame([(1, a + genome(r, 40) + rc(a))], "ref_id long, dna string")
    assert {(x.pos_src, x.pos_dest, x.len) for x in X.maximal_matches(refs, p).collect()} >= {(0, 0, 700)}


def test_mapping_bound_and_strand(spark):
    r, p = random.Random(4), ReadParams(100)
    g = genome(r, 600)

    def change(s, n):
        # the first 40 bases stay, so a seed survives
        at = r.sample(range(40, 100), n)
        return "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i in at else c for i, c in enumerate(s))

    seqs = [g[50:150], change(g[101:201], 20), change(g[101:201], 21), rc(change(g[333:433], 5)), genome(r, 100), g[:99] + "N"]
    got = {x.read_id: (x.strand, x.pos, x.mm) for x in best_mapping(frame(spark, seqs), spark.createDataFrame([("r", g)], "ref_id string, dna string"), p).collect()}
    assert got == {0: (0, 50, 0), 1: (0, 101, 20), 3: (1, 333, 5), 5: (0, 0, 1)}


def test_inverted_repeats(spark):
    r, p = random.Random(5), ReadParams(100)
    rows = []
    for i, n in enumerate([0, 30, 49, 50, 80, 300]):
        a = genome(r, 400)
        rows.append((i, a + genome(r, 37) + rc(a[:n]) + genome(r, 25)))
    rows += [(10, "A" * 35), (11, ""), (12, "ACGT" * 60), (13, genome(r, 80) + "N" * 70 + genome(r, 50))]
    refs = spark.createDataFrame(rows, "ref_id long, dna string")
    found = X.maximal_matches(refs, p)
    texts = dict(rows)
    for x in found.collect():
        d = rc(texts[x.dest_id])
        s = texts[x.src_id]
        assert s[x.pos_src : x.pos_src + x.len] == d[x.pos_dest : x.pos_dest + x.len] and x.len >= 50
        assert x.pos_src == 0 or x.pos_dest == 0 or s[x.pos_src - 1] != d[x.pos_dest - 1]
    sizes = refs.select("ref_id", F.length("dna").alias("size"))
    m = X.canonical_matches(found, sizes, p)
    cover = X.interval_cover(m, p)
    assert {4, 5} <= {x.ref_id for x in cover.collect()} and not {0, 1} & {x.ref_id for x in cover.collect()}
    holed = X.punch_holes(refs, cover)
    assert holed.where("contains(holed, '%')").count() >= 2
    assert {x.ref_id: x.dna for x in X.fill_holes(holed).collect()} == texts


@pytest.mark.parametrize("mode", ["default", "preserve", "paired"])
def test_round_trip(spark, tmp_path, mode):
    r, p = random.Random(6), ReadParams(64)
    g = genome(r, 500)
    seqs = []
    for _ in range(90):
        i = r.randint(0, 436)
        s = g[i : i + 64]
        if r.random() < 0.3:
            j = r.randrange(64)
            s = s[:j] + r.choice("ACGTN") + s[j + 1 :]
        seqs.append(rc(s) if r.random() < 0.4 else s)
    seqs += ["N" * 64, "A" * 64, "A" * 64, genome(r, 64)]
    df = frame(spark, seqs).withColumn("pair_id", F.floor(F.col("read_id") / 2)).withColumn("mate", (F.col("read_id") % 2).cast("int"))
    encode(df, f"file://{tmp_path}/a", p, mode, reads_per_block=40, least=40)
    out = decode(spark, f"file://{tmp_path}/a").collect()
    if mode == "default":
        assert sorted(x.seq for x in out) == sorted(seqs)
    elif mode == "preserve":
        assert {x.read_id: x.seq for x in out} == dict(enumerate(seqs))
    else:
        assert {x.pair_id * 2 + x.mate: x.seq for x in out} == dict(enumerate(seqs))
    assert len(out) == len(seqs) and spark.read.parquet(f"file://{tmp_path}/a/reads").select("block_id").distinct().count() == 3


def test_compress_and_decompress(spark, tmp_path):
    from helixmill.plans.archive import compress, decompress
    from helixmill.sources.fastq import write_fastq

    r = random.Random(11)
    g = genome(r, 700)
    seqs = [rc(s) if i % 5 == 0 else s for i, s in enumerate(g[j : j + 100] for j in (r.randint(0, 600) for _ in range(120)))] + [genome(r, 100), "N" + genome(r, 99), rc(g[300:400])]
    for i, part in enumerate((seqs, seqs[::-1])):
        write_fastq(frame(spark, part), f"{tmp_path}/{i}.fastq")
    one, two, out = f"{tmp_path}/one.reads", f"{tmp_path}/two.reads", f"{tmp_path}/out"
    counters = compress(spark, [f"{tmp_path}/0.fastq"], one, reads_per_block=50)
    assert counters["reads"] == len(seqs) and counters["blocks"] == 3
    blocks = spark.read.parquet(f"{one}/reads").groupBy("block_id").count().collect()
    assert {x.block_id: x["count"] for x in blocks} == {0: 50, 1: 50, 2: len(seqs) - 100}
    folder, = decompress(spark, one, out, rows_per_file=30)
    lines = [x.value for x in spark.read.text(folder).collect()]
    assert sorted(lines) == sorted(seqs)
    # default order: by block, then hq, lq, n by position
    from helixmill.plans.archive import ORDER, decode

    assert [x.seq for x in decode(spark, one, places=True).orderBy(*ORDER["default"]).collect()] == [x.value for x in spark.read.text(folder).withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).collect()]
    compress(spark, [f"{tmp_path}/0.fastq", f"{tmp_path}/1.fastq"], two)
    first, second = decompress(spark, two, out)
    pairs = list(zip(*([x.value for x in spark.read.text(f).withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).collect()] for f in (first, second))))
    assert pairs == list(zip(seqs, seqs[::-1]))
    for bad in (lambda: compress(spark, ["x.txt"], one), lambda: compress(spark, [f"{tmp_path}/0.fastq"], "x"), lambda: compress(spark, [f"{tmp_path}/0.fastq"] * 2, two, reads_per_block=3)):
        with pytest.raises(ValueError):
            bad()


def test_empty_archive(spark, tmp_path):
    encode(frame(spark, ["A"]).limit(0), f"file://{tmp_path}/a", ReadParams(64), "preserve", least=60)
    assert decode(spark, f"file://{tmp_path}/a").count() == 0


def test_fastq(spark, tmp_path):
    from helixmill.sources.fastq import check_reads, infer_params, read_paired, read_single, write_fastq, write_sequences

    r = random.Random(7)
    seqs = [genome(r, 50) for _ in range(300)]
    quals = ["@" + "I" * 49 if i % 3 == 0 else "+" * 50 if i % 5 == 0 else "I" * 50 for i in range(300)]
    f = tmp_path / "x.fastq"
    f.write_text("".join(f"@r{i} @x\n{s}\n+{'r' if i % 2 else ''}\n{q}\n" for i, (s, q) in enumerate(zip(seqs, quals))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert [x.seq for x in read_single(spark, str(f)).orderBy("read_id").collect()] == seqs
        two = read_paired(spark, str(f), str(f))
        assert two.count() == 600 and two.where("read_id <> 2 * pair_id + mate").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    write_fastq(frame(spark, seqs), f"{tmp_path}/y.fq")
    back = read_single(spark, f"{tmp_path}/y.fq")
    assert sorted(x.seq for x in check_reads(back, infer_params(back)).collect()) == sorted(seqs)
    with pytest.raises(Exception):
        check_reads(frame(spark, ["ACGT", "ACG"]), ReadParams(4)).collect()
    with pytest.raises(Exception):
        check_reads(frame(spark, ["ACGR"]), ReadParams(4)).collect()
    with pytest.raises(ValueError):
        read_single(spark, "x.txt")
    paths = write_sequences(frame(spark, seqs).withColumn("mate", (F.col("read_id") % 2).cast("int")), f"{tmp_path}/out", ["read_id"], paired=True)
    assert [x.value for x in spark.read.text(paths[1]).collect()] and spark.read.text(paths[0]).count() == 150


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).columns == ["canonical", "n", "first_read"]
    assert set(E.oracle_sql()) <= set(E.queries())
