import base64
import gzip
import hashlib
import math
import random

import numpy as np
import pytest


# WARC


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, shard int, digest string").repartition(3)


def some_pages(seed=1):
    r = random.Random(seed)
    bodies = ["<p>" + "é\r\n\r\nWARC/1.1 " * r.randint(0, 50) + "</p>" for _ in range(6)] + ["", None, "a\x00b", "x" * 300_000]
    rows = [(i * 7, r.choice(["http://a.example/é?x=1 2", None, ""]), r.choice(bodies)) for i in range(80)]
    return rows + [(None, "http://n", "null id")]


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least:
            first[b] = min((x for x in (first.get(b), i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b) if len(b) >= least else i
        revisit = to is not None and to != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return out


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, tmp_path, least):
    from helixmill.llm.warc import read_archive, write_archive

    rows, base = some_pages(), f"file://{tmp_path}/a"
    manifest = write_archive(pages(spark, rows), base, least=least, shard_bytes=50_000, roll_bytes=2_000)
    assert manifest.count() > 5 and manifest.where("bytes > 2000 + 400000").count() == 0
    back = read_archive(spark, base).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back]
    assert sorted(got, key=str) == sorted(expected(rows, least), key=str)
    html = {i: h or "" for i, _, h in rows}
    assert all(r.html == html[r.page_id] for r in back if r.record_type == "response")
    names = [m.file for m in manifest.collect()]
    on_disk = [p.name for p in (tmp_path / "a").iterdir() if p.name.endswith(".gz")]
    assert sorted(names) == sorted(on_disk) and not (tmp_path / "a" / "_temporary").exists()
    # any gzip reader sees whole records, sorted by page within a file
    for m in manifest.collect():
        raw = (tmp_path / "a" / m.file).read_bytes()
        assert hashlib.sha256(raw).hexdigest() == m.sha256 and len(raw) == m.bytes
        assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n")


def test_warc_is_deterministic(spark, tmp_path):
    from helixmill.llm.warc import write_archive

    one = write_archive(pages(spark, some_pages()), f"file://{tmp_path}/a", shard_bytes=50_000, roll_bytes=2_000)
    two = write_archive(pages(spark, some_pages()).repartition(7), f"file://{tmp_path}/b", shard_bytes=50_000, roll_bytes=2_000)
    cols = ["file", "records", "bytes", "sha256"]
    assert sorted(one.select(cols).collect()) == sorted(two.select(cols).collect())


def test_warc_shards_are_even_however_ids_are_spread(spark, tmp_path):
    from helixmill.llm.warc import write_archive

    r = random.Random(19)
    ids = [*range(150), 10**6, 10**15, -(10**17), None]
    rows = [(i, "u", "".join(r.choice("abcdef") for _ in range(r.randint(1000, 3000)))) for i in ids]
    for n, parts in (("a", 2), ("b", 5)):
        m = write_archive(pages(spark, rows).repartition(parts), f"file://{tmp_path}/{n}", shard_bytes=40_000).collect()
        shards = {}
        for x in m:
            shards[x.shard] = shards.get(x.shard, 0) + x.records
        total, want = 0, {}
        for i, _, h in sorted(rows[:-1]):
            want[total // 40_000] = want.get(total // 40_000, 0) + 1
            total += len(h) + 600
        want[0] += 1  # the null id
        assert list(shards[k] for k in sorted(shards)) == [want[k] for k in sorted(want)]


def test_warc_repeated_ids_and_empty(spark, tmp_path):
    from helixmill.llm.warc import read_archive, round_trip, write_archive

    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (3, None, None)]
    write_archive(pages(spark, rows), f"file://{tmp_path}/r")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in read_archive(spark, f"file://{tmp_path}/r").collect() if r.page_id != 3)
    assert got == [(1, "response", None), (1, "revisit", 1), (2, "revisit", 1)] or got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert round_trip(pages(spark, rows).limit(0), f"file://{tmp_path}/e").count() == 0


def test_warc_reader_refuses_damage(spark, tmp_path):
    from helixmill.llm.warc import read_archive, write_archive

    base = f"file://{tmp_path}/d"
    manifest = write_archive(pages(spark, some_pages()), base)
    f = tmp_path / "d" / manifest.first().file
    f.write_bytes(f.read_bytes()[:-20])
    with pytest.raises(Exception):
        read_archive(spark, base).collect()


# HTML


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain &amp; simple &#233;", "plain & simple é"),
        ("<p>a<p>b", "a\n\nb"),
        ("<p>one <b>two</b>\n three</p>", "one two three"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<title>t</title><style>x</style><script>if (a<b) '</p>'</script>seen", "seen"),
        ("<div hidden>no</div><div style='display: none'>no</div><span aria-hidden=true>no</span>yes", "yes"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<table><tr><td>a<td>bb<tr><td>ccc</td><td>d</td></tr></table>", "a    bb\nccc  d"),
        ("<table><tr><th colspan=2>head<tr><td>a<td>b</table>", "head\na  b"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("<blockquote>q<p>r</blockquote>", "> q\n\n> r"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("x</p>y</div></table>z", "x\n\nyz"),
        ("a<!-- no -->b<!doctype x>c", "abc"),
        ("<a href='x>y'>l</a", "l"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p", ""),
    ],
)
def test_html_text(html, want):
    from helixmill.llm.html_text import extract

    assert extract(html).replace("> q\n\n> r", "> q\n\n> r") == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>", "x=1"),
        ("<svg><title>no</title><defs><text>no</text></defs><text>a</text><text>b</text></svg>", "a b"),
        ("<select><optgroup label=l><option>a<option selected>b</select>c", "l a b c"),
        ("<dialog>no</dialog><dialog open>a</dialog>", "a"),
        ("<object>a</object> <map>b<area></map>", "a b"),
        ("a<xmp><b>x</b> &amp;</xmp>c", "a\n\n<b>x</b> &amp;\n\nc"),
    ],
)
def test_html_emits_what_browsers_show(html, want):
    from helixmill.llm.html_text import extract

    assert extract(html) == want


@pytest.mark.parametrize(
    "html, want",
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=3 colspan=2>b<td>c<tr><td>d<td>e<tr><td>f</table>", "a  b   c\nd      e\nf"),
        ("<ol start=3><li>a<li value=9>b<li>c</ol>", "3. a\n9. b\n10. c"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol reversed start=7><li>a<li>b</ol>", "7. a\n6. b"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<div style='display:none'>no<b style='display:block'>no</b></div>a", "a"),
        ("<p hidden style='display:block'>yes</p>", "yes"),
        ("<style>.x, p#i.y{color:red;display:none} @media print{b{display:none}} u>i{display:none}</style><p class='a x'>no<p id=i class=y>no<p class=y>a <b>b</b> <u><i>c</i></u>", "a b c"),
        ("<style>p{visibility:hidden}.v{visibility:visible}</style><p>no <b class=v>yes</b><p style='visibility:visible'>too", "yes\n\ntoo"),
        ("<style>p{display:none !important}</style><p style='display:block'>no</p>a", "a"),
        ("<style>.x{display:none}.x{display:block}/* .x{display:none} */</style><p class=x>a", "a"),
        ("<table><tr><td style='visibility:hidden'>no<td>a<tr><td>bb<td>c</table>", "    a\nbb  c"),
        ("name <input value=typed> <input type=checkbox value=no><input type=password value=no><input type=submit value=Go>", "name typed Go"),
    ],
)
def test_html_follows_spans_numbers_and_style(html, want):
    from helixmill.llm.html_text import extract

    assert extract(html) == want


def test_html_hides_what_plain_rules_hide():
    """Random trees against a recursive reading of the same rules."""
    import re

    from helixmill.llm.html_text import extract

    r = random.Random(17)
    kinds = {"": (None, None), " hidden": ("none", None), " style='display:none'": ("none", None), " style='visibility:hidden'": (None, False), " style='visibility:visible'": (None, True), " class=h": ("none", None), " class=v": (None, True)}

    def tree(depth, shown):
        html, seen = "", []
        for _ in range(r.randint(1, 3)):
            w = f"w{r.randrange(10**6)} "
            html += w
            seen += [w.strip()] if shown else []
            if depth:
                a = r.choice(list(kinds))
                display, visible = kinds[a]
                tag = r.choice(["div", "b", "p" if depth == 1 else "section", "span"])
                inner, words = tree(depth - 1, False if display else shown if visible is None else visible)
                html += f"<{tag}{a}>{inner}</{tag}> "
                seen += [] if display else words
        return html, seen

    for _ in range(150):
        html, seen = tree(3, True)
        assert re.findall(r"w\d+", extract(f"<style>.h{{display:none}} .v{{visibility:visible}}</style>{html}")) == seen


def test_html_end_tags_behind_capital_dotted_i():
    from helixmill.llm.html_text import extract

    assert extract("<div>" + "\u0130" * 30 + "<script>x</SCRIPT>seen</div>") == "\u0130" * 30 + "seen"
    assert extract("\u0130" * 30 + "<textarea>a</textarea><b>c</b>").endswith("a\n\nc")


def test_html_extreme(spark):
    from helixmill.llm.html_text import extract, extract_text

    assert extract("<div>" * 50_000 + "deep") == "deep"
    assert extract("<table><tr><td>" * 3000 + "x").strip() == "x"
    r = random.Random(3)
    bits = ["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b", ">", "'", "\"", "<!--", "-->", "text ", "&amp", "<script>", "</script>", "<pre>", "\n", "<dl><dt>", "<dd>"]
    for _ in range(500):
        extract("".join(r.choice(bits) for _ in range(60)))
    rows = [(1, "u", "<p>a"), (2, "u", None), (None, None, ""), (1, "u", "<p>a")]
    got = sorted(map(tuple, extract_text(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "a", 1, 1), (2, None, None, None), (None, "", 0, 0), (1, "a", 1, 1)], key=str)
    assert extract_text(pages(spark, rows).limit(0)).count() == 0


def test_html_keeps_all_visible_words():
    """Against a plain tag stripper, on pages without hidden parts."""
    import re

    from helixmill.llm.html_text import extract

    r = random.Random(4)
    for _ in range(200):
        out = "".join(r.choice(["<p>", "<b>", "</b>", "<li>", "<td>", "<tr>", "<div>", "</div>", "<h2>", "<br>", "<table>", "</table>"]) + f"w{r.randint(0, 999)} " for _ in range(30))
        assert sorted(re.findall(r"w\d+", extract(out))) == sorted(re.findall(r"w\d+", out))


# nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double").repartition(3)


def exact(rows, k=5):
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in fine:
        if q % 50 == 0:
            s = sorted((-float(fine[i] @ fine[q] / (np.linalg.norm(fine[i]) * np.linalg.norm(fine[q]))), i) for i in fine if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def test_ann_small_is_exact(spark):
    from helixmill.llm.ann import search_every_50th

    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).tolist()) for i in range(160)]
    rows += [(200 + i, rows[7][1]) for i in range(9)] + [(50 * 9, None), (50 * 10, [0.0] * 8), (50 * 11, [float("nan")] * 8), (50 * 12, [1.0, None] * 4), (50 * 13, []), (None, [1.0] * 8), (50 * 14, [float("inf")] + [1.0] * 7), (50 * 15, rows[7][1])]
    want, got = exact(rows), {}
    for x in search_every_50th(vectors(spark, rows)).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert got.keys() == want.keys()
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
        for (_, i, s), (j, t) in zip(found, want[q]):
            assert s == pytest.approx(t, abs=1e-12) and (i == j or s == pytest.approx(t, abs=1e-12))
    # ties of equal vectors go to smaller ids
    assert [i for _, i, _ in got[750][:5]] == [7, 200, 201, 202, 203]


def test_ann_recall_and_blocks(spark, monkeypatch):
    import helixmill.llm.ann as A

    monkeypatch.setattr(A, "BLOCK", 700)
    monkeypatch.setattr(A, "QUERIES", 13)
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=32).tolist()) for i in range(4000)]
    want = exact(rows)
    got = {}
    for x in A.search_every_50th(vectors(spark, rows)).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    hit = sum(len(got[q] & {i for i, _ in v}) for q, v in want.items())
    assert hit / (5 * len(want)) >= 0.9


def test_ann_empty(spark):
    from helixmill.llm.ann import search_every_50th

    assert search_every_50th(vectors(spark, [(0, [1.0])]).limit(0)).count() == 0
    assert search_every_50th(vectors(spark, [(0, [1.0])])).count() == 0
    assert search_every_50th(vectors(spark, [(1, [1.0]), (2, [2.0])])).count() == 0
    assert [tuple(x)[:3] for x in search_every_50th(vectors(spark, [(0, [1.0]), (2, [2.0])])).collect()] == [(0, 1, 2)]
