"""The pipeline from a command line: python -m mapweave.plans.cli --corpus_path C --output_folder O."""

import argparse

from pyspark.sql import SparkSession

from mapweave.plans import mapping_pipeline as P


def parser() -> argparse.ArgumentParser:
    d, p = P.Config(), argparse.ArgumentParser(description=__doc__)
    p.add_argument("--corpus_path", help="JSON lines, or a folder of CSV files")
    p.add_argument("--output_folder", required=True, help="a folder that all executors can write to")
    p.add_argument("--threshold", type=float, default=d.coherence, help="columns below this coherence go")
    p.add_argument("--theta", type=float, default=d.theta, help="share of rows that a dependency must cover")
    p.add_argument("--min_rows", type=int, default=d.min_rows, help="rows with both values that a dependency needs")
    p.add_argument("--index_path", help="where the co-occurrence index is kept")
    p.add_argument("--rebuild_index", action="store_true", help="count anew even if an index is kept")
    p.add_argument("--no_save_index", action="store_true", help="don't keep the index")
    p.add_argument("--table_types", default=",".join(d.table_types), help="table types to read, with commas")
    p.add_argument("--tau", type=float, default=d.tau, help="conflict from which two candidates aren't merged")
    p.add_argument("--no_approx", action="store_true", help="compare values exactly")
    p.add_argument("--string_matcher", choices=["edit", "jaccard", "jw"], default="edit", help="how values are compared otherwise")
    p.add_argument("--theta_overlap", type=int, default=d.theta_overlap, help="pairs or lefts that must be shared, and one more")
    p.add_argument("--theta_edge", type=float, default=d.theta_edge, help="least weight of a positive edge")
    p.add_argument("--parallel_workers", type=int, default=1, help="partitions of shuffles; 1 leaves them to the session")
    p.add_argument("--max_bucket_size", type=int, default=d.max_bucket, help="values that more candidates share are passed over; 0: none")
    p.add_argument("--no_skip_noise_values", action="store_true", help="count numbers, hex codes and placeholders, too")
    p.add_argument("--pair_cap", type=int, default=d.pair_cap, help="pairs of a candidate that are compared; 0: all")
    p.add_argument("--no_noise_filter", action="store_true", help="keep candidates that the noise rules drop")
    p.add_argument("--only", choices=["resolve", "vote", "score", "baselines", "synonyms"], help="work on what an earlier run saved")
    return p


def config(args: argparse.Namespace) -> P.Config:
    return P.Config(
        args.threshold, args.theta, args.min_rows, not args.no_skip_noise_values, args.theta_overlap, args.theta_edge, args.tau, args.max_bucket_size, args.pair_cap,
        "exact" if args.no_approx else args.string_matcher, not args.no_noise_filter, tuple(args.table_types.split(",")), args.index_path, args.rebuild_index, not args.no_save_index,
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("mapweave").getOrCreate()
    if args.parallel_workers > 1:
        spark.conf.set("spark.sql.shuffle.partitions", str(args.parallel_workers))
    if args.only in ("resolve", "vote", "score", "synonyms"):
        out = {"resolve": P.resolve_saved, "vote": P.vote_saved, "score": P.score_saved, "synonyms": P.save_synonyms}[args.only](spark, args.output_folder)
    elif not args.corpus_path:
        parser().error("--corpus_path is missing")
    elif args.only == "baselines":
        out = P.save_baselines(spark, args.corpus_path, args.output_folder)
    else:
        out = P.run(spark, args.corpus_path, args.output_folder, config(args))
    print(f"{out.count()} rows in {args.output_folder}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
