"""Language identification with bit-sliced Bloom filters over byte n-grams.

One Bloom filter per language, stored slot by slot: a slot holds one bit per
language, so the AND of an n-gram's slots is the set of all languages whose
filter contains it. A text's n-grams are looked up, bits are counted per
language, counts are corrected by each filter's false-positive rate, and the
largest share wins.

An n-gram is ``N`` bytes of the lower-cased UTF-8 text around a position inside
or at the border of a word. Each language's filter holds all n-grams of its
training rows. The number of slots follows from the language with most distinct
n-grams, so that at most ``FILL`` of a filter's bits are set, up to 2 ** ``MOST_BITS``
slots; what filters fuller than that let through by mistake is part of the
correction. N-grams of all training rows are gathered in the cluster; what comes to
the driver, and goes out to all tasks, is the slots: 2 ** MOST_BITS bytes for up to
eight languages, eight times that for each 64 languages otherwise.

Cases: a text that is null or has no letter is ``und`` with score 0; a text of
letters whose n-grams no filter holds gets the learned language with most
training rows, score 0, as long as anything was learned; with nothing learned
every text is ``und``; ties go to the first language by name; rows with null
lang or null text teach nothing; repeated rows teach no more than one; null ids hash
as the empty text; extra columns are not read, and come through the stage whatever
their names; a very long text is one slice of its own; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Scratch, bounded_batches, sheltered, slices, utf8
from helixmill.llm.grams import U, mix

N = 5
HASHES = 2
FILL, LEAST_BITS, MOST_BITS = 0.25, 16, 27
#: The stage keeps texts of whose n-grams the language's filter holds this share.
LEAST_SCORE = 0.5
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")

# ASCII letters, other ASCII bytes become a blank; bytes of other characters stay
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _ngrams(raw: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document of each) of the byte n-grams whose middle byte is in a word."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64)
    pad = n // 2
    # a blank run of n between documents keeps n-grams inside them
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    spread = np.full(len(raw) + n * len(at), 32, np.uint8)
    spread[np.arange(len(raw)) + n * (doc + 1)] = _FOLD[raw]
    m = len(spread) - n + 1
    h = np.zeros(m, U)
    for j in range(n):
        h = (h << U(8)) | spread[j : j + m].astype(U)
    middle = spread[pad : pad + m] != 32
    where = np.flatnonzero(middle)
    ends = at[1:] + n * np.arange(1, len(at))
    return mix(h[where]), np.searchsorted(ends, where + pad, "right")


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(col, ""))


def distinct_ngrams(docs: DataFrame, n: int = N) -> DataFrame:
    """(gram, lang) of all rows with text and lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            nonlocal size
            for lang, parts in held.items():
                grams = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array([lang] * len(grams)).cast(pa.string())], ["gram", "lang"])
            held.clear()
            size = 0

        for b in slices(batches, "text"):
            langs = np.array(b.column(1).to_pylist(), object)
            text = _lower(b.column(0))
            for lang in dict.fromkeys(langs):
                h, _ = _ngrams(*utf8(text.filter(pa.array(langs == lang))), n)
                g = np.unique(h)
                held.setdefault(lang, []).append(g)
                size += len(g)
            if size > 1_500_000:
                yield from flush()
        yield from flush()

    rows = docs.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return rows.mapInArrow(run, "gram long, lang string").distinct()


class Filters:
    """Slots of bit-sliced filters; languages in blocks of 64."""

    def __init__(self, langs: list[str], rows: list[int], slots: np.ndarray, masks: list[np.ndarray], bits: int):
        self.langs, self.bits, self.most = langs, bits, (langs[int(np.argmax(rows))] if langs else UND)
        self.blocks = []
        for mask in masks:
            full = np.zeros(1 << bits, U)
            full[slots] = mask
            self.blocks.append(full)
        self.false = np.array([(np.count_nonzero(self.blocks[i // 64] >> U(i % 64) & U(1)) / (1 << bits)) ** HASHES for i in range(len(langs))])
        if len(langs) <= 8:
            self.blocks = [b.astype(np.uint8) for b in self.blocks]

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        return [(h >> U(64 - self.bits)).astype(np.int64), (h & U((1 << self.bits) - 1)).astype(np.int64)]

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(text)
        raw, at = utf8(_lower(text))
        h, doc = _ngrams(raw, at)
        first, total = np.searchsorted(doc, np.arange(n + 1)), np.bincount(doc, minlength=n)
        a, b = self.slots(h)
        hits = np.zeros((len(self.langs), n))
        for k, block in enumerate(self.blocks):
            both = block[a] & block[b]
            for i in range(64 * k, min(64 * k + 64, len(self.langs))):
                bit = np.concatenate(([0], np.cumsum(both >> both.dtype.type(i - 64 * k) & both.dtype.type(1), dtype=np.int64)))
                hits[i] = bit[first[1:]] - bit[first[:-1]]
        share = np.clip((hits / np.maximum(total, 1) - self.false[:, None]) / (1 - self.false[:, None] + 1e-12), 0, 1)
        langs, scores = [], np.zeros(n)
        best = share.argmax(axis=0) if len(self.langs) else np.zeros(n, int)
        for d, t in enumerate(text.to_pylist()):
            if not self.langs or t is None or not _LETTER.search(t):
                langs.append(UND)
            elif not share[:, d].any():
                langs.append(self.most)
            else:
                langs.append(self.langs[best[d]])
                scores[d] = share[best[d], d]
        return langs, scores


def slot_bits(distinct: int) -> int:
    """Bits of the slot number for filters of up to so many n-grams."""
    return min(max(LEAST_BITS, int(np.ceil(np.log2(max(1, HASHES * distinct / FILL))))), MOST_BITS)


def learn(docs: DataFrame, bits: int | None = None) -> Filters:
    """Filters from all rows of ``docs`` (text, lang)."""
    scratch = Scratch(docs.sparkSession, "language-id")
    grams = scratch.save(distinct_ngrams(docs), "grams")
    learned = {r["lang"]: r["rows"] for r in docs.where("text IS NOT NULL AND lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("rows")).collect()}
    langs = sorted(learned)
    bits = bits or slot_bits(max([r["count"] for r in grams.groupBy("lang").count().collect()], default=0))
    if not langs:
        return Filters([], [], np.zeros(0, np.int64), [], bits)
    code = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])[F.col("lang")]
    n_blocks = -(-len(langs) // 64)
    in_block = lambda k: F.col("code").between(64 * k, 64 * k + 63)
    slot = F.explode(F.array(F.shiftrightunsigned("gram", 64 - bits), F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))))
    bit = lambda k: F.bit_or(F.when(in_block(k), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("code") - 64 * k)).otherwise(F.lit(0).cast("long"))).alias(f"m{k}")
    rows = grams.select(code.alias("code"), slot.alias("slot")).groupBy("slot").agg(*[bit(k) for k in range(n_blocks)]).toPandas()
    scratch.drop(grams)
    return Filters(langs, [learned[x] for x in langs], rows["slot"].to_numpy(np.int64), [rows[f"m{k}"].to_numpy(np.int64).view(U) for k in range(n_blocks)], bits)


def tag(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows of ``docs`` with ``__lang`` and ``__score``."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    arrow, sent = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filters = sent.value
        for b in slices(batches, "text"):
            langs, scores = f.predict(b.column(b.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], schema=arrow)

    return docs.mapInArrow(run, schema)


def held_out(mod: int) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == 2


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the rows not held out."""
    filters = learn(docs.where(~held_out(4)).select("text", "lang"))
    return tag(docs.select("doc_id", "text"), filters).select("doc_id", held_out(4).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(docs: DataFrame, langs: Collection[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose text is, by prediction, in one of ``langs`` (any learned language
    if None) with a score of ``least`` or more; the others go, and so do texts without a letter."""
    docs, named = sheltered(docs, ("__lang", "__score"))
    filters = learn(docs.where(~held_out(4)).select("text", "lang"))
    wanted = F.col("__lang").isin(*(filters.langs if langs is None else langs)) & (F.col("__score") >= least)
    return named(tag(docs, filters).where(wanted).drop("__lang", "__score"))
