import random

import pytest
from pyspark.sql import functions as F

from helixmill.functions import sequence as S
from helixmill.operators import streams as T
from helixmill.params import ReadParams


def some(r, n, letters="ACGT"):
    return "".join(r.choice(letters) for _ in range(n))


@pytest.mark.parametrize("n", [1, 31, 32, 33, 64, 88, 89, 100, 512])
def test_params_and_packing(spark, n):
    p = ReadParams(n)
    assert p.words == -(-n // 32) and p.max_offset == n * 65 // 100 and p.max_mismatches == n // 5
    assert p.overlap_at + p.overlap_k + p.max_offset == n or n < 3
    r = random.Random(n)
    rows = [(some(r, n, "ACGTN"), some(r, n, "ACGTN")) for _ in range(20)] + [("T" * n, "A" * n)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", S.packed("a", n).alias("w"), S.distance("a", "b", n).alias("d"), S.packed_distance(S.packed("a", n), S.packed("b", n), p.words).alias("pd"), S.reverse_complement("a").alias("rc")).collect()
    code = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 0}
    for x in got:
        want = []
        for i in range(0, n, 32):
            v = 0
            for c in x.a[i : i + 32].ljust(32, "A"):
                v = v * 4 + code[c]
            want.append(v - (1 << 64) if v >> 63 else v)
        assert x.w == want
        assert x.d == sum(c != d for c, d in zip(x.a, x.b))
        assert x.pd == sum(code[c] != code[d] for c, d in zip(x.a, x.b))
        assert x.rc == x.a[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


@pytest.mark.parametrize("n", [0, 513])
def test_length_limits(n):
    with pytest.raises(ValueError):
        ReadParams(n)


def test_known_parameters():
    a, b = ReadParams(100), ReadParams(64)
    assert (a.words, a.max_offset, a.overlap_k, a.overlap_at, a.max_mismatches) == (4, 65, 32, 3, 20)
    assert (b.words, b.max_offset, b.overlap_k, b.overlap_at, b.max_mismatches) == (2, 41, 23, 0, 12)


def test_mismatches_and_offset_code(spark):
    r, n = random.Random(1), 100
    rows = []
    for i in range(300):
        w = some(r, n, "ACGTN")
        s = list(w)
        for at in r.sample(range(n), r.choice([0, 1, 2, 3, 4, 9, 20])):
            s[at] = r.choice("ACGTN")
        rows.append((i, w, "".join(s)))
    edge = "A" * n
    for at in ([0], [99], [49], [50], [0, 99], [10, 89], [0, 1, 2], [97, 98, 99], [40, 50, 60], [5, 50, 94]):
        rows.append((len(rows), edge, "".join("C" if i in at else "A" for i in range(n))))
    df = spark.createDataFrame(rows, "id int, w string, s string").withColumn("ms", S.mismatches(F.col("w"), F.col("s"), n))
    code = T.offset_code(F.col("ms.off"), n)
    back = df.select("*", code.alias("code"), S.apply_mismatches(F.col("w"), F.col("ms")).alias("s2")).withColumn("offs", T.offset_decode(F.col("code"), F.size("ms"), n))
    for x in back.collect():
        offs = [i for i in range(n) if x.w[i] != x.s[i]]
        assert x.s2 == x.s and [m.off for m in x.ms] == offs == list(x.offs)
        if offs:
            assert x.code[0] == int(offs[0] >= n - 1 - offs[-1]) and len(x.code) == {1: 2, 2: 3}.get(len(offs), len(offs) + 2)


@pytest.mark.parametrize("small, lo, hi", [(255, -128, 127), (65535, -32768, 32767)])
def test_predictor(spark, small, lo, hi):
    r = random.Random(small)
    rows = [(b, i, r.choice([r.randint(0, small), small + r.randint(1, hi), small + r.randint(1, 9 * hi), small, small + 1])) for b in range(3) for i in range(60)]
    # around the limits of a delta
    rows += [(9, i, d) for i, d in enumerate([small + 1, small + 1 + hi, small + 2 + 2 * hi, small + 1 + hi, small + hi + lo, 10 * hi + small, small + 5])]
    df = spark.createDataFrame(rows, "block int, ord long, dist long")
    coded = T.predict(df, "block", small, lo, hi)
    want = {}
    for b in {x[0] for x in rows}:
        ref = prev = 0
        match = False
        for _, i, d in sorted(x for x in rows if x[0] == b):
            if d <= small:
                want[b, i] = ("near", d)
                continue
            hit = lo <= d - ref <= hi
            want[b, i] = ("delta", d - ref) if hit else ("far", d)
            if hit or not match or ref != prev:
                ref = d
            match, prev = hit, d
    assert {(x.block, x.ord): (x.kind, x.value) for x in coded.collect()} == want
    out = T.unpredict(coded.select("block", "ord", "kind", "value"), "block")
    assert sorted((x.block, x.ord, x.restored) for x in out.collect()) == sorted(rows)
