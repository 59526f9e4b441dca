"""Encode reads to a folder of Parquet tables and decode them again.

Tables: ``meta`` (one row, with counters), ``contigs`` (component, contig_id, seg, start,
text, tail, map: in components lq and n each stretch that is the reverse complement of hq
text is a hole, listed in map), ``ranks`` (the code of a differing base by how often it
stands for the contig's base) and ``reads`` (by block: place, strand, and the mismatches as
a code of their offsets and ranks; with ids only where the mode keeps them).

Components: hq, of the N-free reads that overlap others on both sides; lq and n, of the
N-free and other reads that do not map to hq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.sequence import apply_mismatches, reverse_complement
from helixmill.operators import selfmatch as X
from helixmill.operators import streams as T
from helixmill.operators.assemble import SEGMENT, contigs, cut_cycles
from helixmill.operators.mapping import best_mapping, unmapped
from helixmill.operators.ordering import dense_number, union_all, unsized
from helixmill.operators.overlap import overlap_reads
from helixmill.params import MAX_BLOCKS, ReadParams
from helixmill.plans.storage import Store
from helixmill.sources.fastq import check_paths, check_reads, infer_params, read_paired, read_single, write_sequences

SUFFIX = ".reads"
COMPONENTS = ("hq", "lq", "n")
MAP = "array<struct<pos_dest:int,src_id:string,pos_src:int,len:int>>"
TEXT = f"component string, contig_id long, seg long, start long, text string, tail string, map {MAP}"
READS = "component string, contig_id long, dist long, strand int, mm int, offs array<int>, ranks array<int>, block_id int"
IDS = {"default": [], "preserve": ["read_id"], "paired": ["pair_id", "mate"]}
BUCKETS = 1 << 16  # of read ids, for their numbering


def assemble(store: Store, reads: DataFrame, p: ReadParams, weak_cut: bool, least: int) -> tuple[DataFrame, DataFrame]:
    """(contigs, placed): text segments, and (read_id, contig_id, dist) of the reads in them."""
    links, kept = overlap_reads(store, reads, p, weak_cut, least)
    links, placed, _ = cut_cycles(store, kept, links)
    text = store.save(contigs(kept, links, placed, p, SEGMENT))
    return text, placed.select("read_id", F.col("head").alias("contig_id"), "dist")


def segments(text: DataFrame) -> DataFrame:
    """Contig segments as mapping references, tails included."""
    return text.select(F.concat_ws(":", "contig_id", "seg").alias("ref_id"), "contig_id", "start", F.concat("text", "tail").alias("dna"))


def _holed(store: Store, hq: DataFrame, others: dict[str, DataFrame], p: ReadParams) -> DataFrame:
    """Segments of the other components with what they repeat of hq, turned round, taken out."""
    rows = store.save(union_all([t.select(F.lit(c).alias("component"), "*") for c, t in others.items()]))
    ref_id = F.concat_ws(":", "component", "contig_id", "seg")
    refs = rows.select(ref_id.alias("ref_id"), F.col("text").alias("dna"))
    found = X.maximal_matches(segments(hq).select("ref_id", "dna"), p, refs)
    cover = X.interval_cover(X.cross_matches(found, refs.select("ref_id", F.length("dna").alias("size"))), p)
    holed = X.punch_holes(refs, cover)
    rows = unsized(rows.withColumn("ref_id", ref_id).drop("text")).join(holed, "ref_id")
    return rows.select("component", "contig_id", "seg", "start", F.col("holed").alias("text"), "tail", F.col("map").cast(MAP).alias("map"))


def _pairs(table: list, key: str, value: str) -> F.Column:
    """A map from ref_base and ``key`` to ``value`` of the few rows of a rank table."""
    return F.create_map(*[F.lit(x) for r in table for x in (f"{r['ref_base']}{r[key]}", r[value])])


def encode(reads: DataFrame, path: str, p: ReadParams, mode: str = "default", reads_per_block: int = 0, least: int = 1) -> None:
    """Write (read_id, seq [, pair_id, mate]) to ``path``.

    ``reads_per_block``: reads of a block in order of read_id, 0 for one block; ``least``:
    smallest overlap in bases that still joins two reads."""
    if mode not in IDS:
        raise ValueError(f"mode {mode}: one of {', '.join(IDS)}")
    spark = reads.sparkSession
    store = Store(spark, "encode")
    pair = ["pair_id", "mate"] if mode == "paired" else []
    reads = store.save(reads.select("read_id", *pair, "seq", F.contains("seq", F.lit("N")).alias("has_n")))
    n, low, high = reads.agg(F.count("*"), F.min("read_id"), F.max("read_id")).first()
    size = reads_per_block or max(1, n)
    blocks = -(-n // size)
    if blocks > MAX_BLOCKS:
        raise ValueError(f"{blocks} blocks; at most {MAX_BLOCKS}")

    hq, hq_placed = assemble(store, reads.where("NOT has_n").select("read_id", "seq"), p, True, least)
    rest = store.save(unsized(reads.select("read_id", "seq", "has_n")).join(unsized(hq_placed.select("read_id")), "read_id", "left_anti"))
    refs = segments(hq)
    mapped = store.save(best_mapping(rest.select("read_id", "seq"), refs.select("ref_id", "dna"), p))
    left = store.save(unmapped(rest, mapped))
    lq, lq_placed = assemble(store, left.where("NOT has_n").select("read_id", "seq"), p, False, least)
    ns, ns_placed = assemble(store, left.where("has_n").select("read_id", "seq"), p, False, least)

    plain = hq.select(F.lit("hq").alias("component"), "contig_id", "seg", "start", "text", "tail", F.array().cast(MAP).alias("map"))
    plain.unionByName(_holed(store, hq, {"lq": lq, "n": ns}, p)).write.mode("overwrite").parquet(f"{path}/contigs")

    none = F.array().cast("array<int>")
    exact = union_all([x.select("read_id", F.lit(c).alias("component"), "contig_id", "dist", F.lit(0).alias("strand"), F.lit(0).alias("mm"), none.alias("offs"), none.alias("ranks")) for c, x in zip(COMPONENTS, (hq_placed, lq_placed, ns_placed))])
    at = unsized(unsized(mapped).join(refs, "ref_id")).join(rest.select("read_id", "seq"), "read_id")
    at = at.select("read_id", "contig_id", (F.col("start") + F.col("pos")).alias("dist"), "strand", "seq", F.substring("dna", (F.col("pos") + 1).cast("int"), F.lit(p.length)).alias("window"))
    differ = store.save(T.extract_mismatches(at, p.length).select("read_id", "contig_id", "dist", "strand", "ms"))
    table = T.rank_table(T.mismatch_rows(differ)).collect()
    spark.createDataFrame(table, "ref_base string, read_base string, rank int").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    code = _pairs(table, "read_base", "rank")
    approximate = differ.select(
        "read_id", F.lit("hq").alias("component"), "contig_id", "dist", "strand", F.size("ms").alias("mm"),
        T.offset_code(F.col("ms.off"), p.length).alias("offs"), F.transform("ms", lambda m: code[F.concat(m["ref_base"], m["read_base"])]).alias("ranks"),
    )
    rows = exact.unionByName(approximate)
    if pair:
        rows = unsized(rows).join(unsized(reads.select("read_id", *pair)), "read_id")
    width = max(1, -(-((high or 0) - (low or 0) + 1) // BUCKETS))
    rows = dense_number(rows, ["read_id"], width).withColumn("block_id", F.floor(F.col("number") / size).cast("int")).drop("number")
    if mode != "preserve":
        rows = rows.drop("read_id")
    place = ["block_id", "component", "contig_id", "dist"]
    rows.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite").partitionBy("block_id").parquet(f"{path}/reads")
    stored = spark.read.schema(TEXT).parquet(f"{path}/contigs").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("bases"), F.coalesce(F.sum(F.size("map")), F.lit(0)).alias("holes")).first()
    spark.createDataFrame([(p.length, mode, n, blocks, stored["bases"], stored["holes"])], "length int, mode string, reads long, blocks int, bases long, holes long").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(component, contig_id, seg, start, dna): segments with their holes filled and tails on."""
    text = spark.read.schema(TEXT).parquet(f"{path}/contigs")
    whole = text.where(F.size("map") == 0)
    holed = text.where(F.size("map") > 0).withColumn("ref_id", F.concat_ws(":", "component", "contig_id", "seg"))
    src = text.where("component = 'hq'").select(F.concat_ws(":", "contig_id", "seg").alias("ref_id"), F.concat("text", "tail").alias("dna"))
    filled = X.fill_from(holed.select("ref_id", F.col("text").alias("holed"), "map"), src)
    filled = holed.drop("text").join(filled.withColumnRenamed("dna", "text"), "ref_id")
    out = ["component", "contig_id", "seg", "start", F.concat("text", "tail").alias("dna")]
    return whole.select(*out).union(filled.select(*out))


def decode(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """The reads under ``path``: seq, with read_id (preserve), or pair_id and mate (paired);
    with ``places`` also block_id, component, contig_id and dist."""
    meta = spark.read.parquet(f"{path}/meta").first()
    length, ids = meta["length"], IDS[meta["mode"]]
    base = _pairs(spark.read.parquet(f"{path}/ranks").collect(), "rank", "read_base")
    text = _texts(spark, path)
    schema = ", ".join(f"{c} {'int' if c == 'mate' else 'long'}" for c in ids) + ", " * bool(ids) + READS
    rows = spark.read.schema(schema).parquet(f"{path}/reads").withColumn("seg", F.floor(F.col("dist") / SEGMENT))
    # a mapped read may begin in the tail of its segment, before the next one's first piece
    near = unsized(rows).join(text, ["component", "contig_id", "seg"], "left").withColumn("here", F.coalesce(F.col("dist") >= F.col("start"), F.lit(False)))
    early = unsized(near.where("NOT here").drop("start", "dna", "here").withColumn("seg", F.col("seg") - 1)).join(text, ["component", "contig_id", "seg"])
    found = near.where("here").drop("here").unionByName(early)
    found = found.withColumn("window", F.substring("dna", (F.col("dist") - F.col("start") + 1).cast("int"), F.lit(length))).drop("dna")
    offs = T.offset_decode(F.col("offs"), F.col("mm"), length)
    ms = F.zip_with(offs, "ranks", lambda o, r: F.struct(o.alias("off"), base[F.concat(F.substring(F.col("window"), o + 1, F.lit(1)), r.cast("string"))].alias("read_base")))
    patched = apply_mismatches(F.col("window"), ms)
    seq = F.when(F.col("strand") == 1, reverse_complement(patched)).otherwise(patched)
    return found.select(*ids, seq.alias("seq"), *(["block_id", "component", "contig_id", "dist"] if places else []))


#: Order of the decoded sequences: as the mode keeps it, or as they stand in hq, then lq, then n.
ORDER = {"default": ["block_id", "component", "contig_id", "dist", "seq"], "preserve": ["read_id"], "paired": ["pair_id"]}


def write_output(spark: SparkSession, archive: str, path: str, rows_per_file: int = 0) -> list[str]:
    """Decoded sequences as text, in the order that the archive keeps."""
    mode = spark.read.parquet(f"{archive}/meta").first()["mode"]
    return write_sequences(decode(spark, archive, places=True), path, ORDER[mode], mode == "paired", rows_per_file)


def check_archive(path: str) -> str:
    if not path.rstrip("/").endswith(SUFFIX):
        raise ValueError(f"{path}: an archive path ends in {SUFFIX}")
    return path.rstrip("/")


def compress(spark: SparkSession, inputs: list[str], archive: str, preserve: bool = False, reads_per_block: int = 0, least: int = 1) -> dict:
    """One FASTQ file, or two of pairs, to an archive; returns its counters. Pairs keep their order."""
    check_paths(inputs)
    path = check_archive(archive)
    if len(inputs) == 2 and reads_per_block % 2:
        raise ValueError("a block of paired reads holds an even number of them")
    reads = read_paired(spark, *inputs) if len(inputs) == 2 else read_single(spark, inputs[0])
    p = infer_params(reads)
    encode(check_reads(reads, p), path, p, "paired" if len(inputs) == 2 else "preserve" if preserve else "default", reads_per_block, least)
    return spark.read.parquet(f"{path}/meta").first().asDict()


def decompress(spark: SparkSession, archive: str, path: str, rows_per_file: int = 0) -> list[str]:
    """An archive to sequence files, one a line; returns their folders."""
    return write_output(spark, check_archive(archive), path, rows_per_file)
