"""python -m helixmill compress IN [IN2] ARCHIVE | decompress ARCHIVE OUT"""

import argparse

from pyspark.sql import SparkSession

from helixmill.plans.archive import compress, decompress


def main() -> None:
    parser = argparse.ArgumentParser(prog="helixmill")
    verbs = parser.add_subparsers(dest="verb", required=True)
    c = verbs.add_parser("compress", help="one FASTQ file, or two of pairs, to an archive")
    c.add_argument("paths", nargs="+", metavar="PATH", help="inputs, then the archive")
    c.add_argument("--preserve", action="store_true", help="keep the order of reads")
    c.add_argument("--reads-per-block", type=int, default=0)
    c.add_argument("--least", type=int, default=1, help="smallest overlap in bases")
    d = verbs.add_parser("decompress", help="an archive to sequence files")
    d.add_argument("archive")
    d.add_argument("out")
    d.add_argument("--rows-per-file", type=int, default=0)
    a = parser.parse_args()
    spark = SparkSession.builder.appName("helixmill").getOrCreate()
    if a.verb == "compress":
        *inputs, archive = a.paths
        print(compress(spark, inputs, archive, a.preserve, a.reads_per_block, a.least))
    else:
        print("\n".join(decompress(spark, a.archive, a.out, a.rows_per_file)))


if __name__ == "__main__":
    main()
