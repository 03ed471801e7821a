"""Sinks and reloads, the command line, loaders of raw lines and cell stores, and operators on empty and odd tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mapweave.operators import baselines, coherence, evaluation, explore, graph, resolution, synthesis, views
from mapweave.operators import candidates as C
from mapweave.plans import cli, mapping_pipeline
from mapweave.sources import artefacts, corpus
from mapweave.streaming import increments


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """The folder of a run from the command line over four like tables and one that conflicts."""
    out = tmp_path_factory.mktemp("run")
    names, codes = [f"land {c}" for c in "abcdefgh"], [c * 3 for c in "abcdefgh"]
    lines = [json.dumps({"relation": [names, codes], "tableType": "RELATION", "pgId": i % 2}) for i in range(4)]
    lines += [json.dumps({"relation": [names, [*codes[:7], "zzz"]], "tableType": "OTHER"})]
    (out / "c.jsonl").write_text("\n".join(lines))
    args = ["--corpus_path", str(out / "c.jsonl"), "--output_folder", str(out / "o"), "--table_types", "RELATION,OTHER", "--no_approx"]
    assert cli.main(args, spark) == 0
    return str(out / "o"), str(out / "c.jsonl")


def test_run_leaves_its_artefacts(spark, saved):
    out, _ = saved
    kept = artefacts.load(spark, out, "filtered_corpus").orderBy("table_idx").collect()
    assert len(kept) == 5 and len(kept[0].relation) == 2 and kept[0].relation[0][0] == "land a" and kept[0].rejected_column_indices == [] and "relation" in json.loads(kept[0].meta)
    cands = artefacts.load(spark, out, "candidates")
    assert sorted(r.cand for r in cands.select("cand").collect()) == list(range(10))
    assert artefacts.load(spark, out, "edges").where("w_pos IS NULL OR w_neg IS NULL").count() == 0
    maps = artefacts.load(spark, out, "synthesized_mappings").collect()
    assert sum(m.num_source_tables for m in maps) == 10 and all(m.size == len(m.pairs) for m in maps)
    assert sum(m.num_conflicts_removed for m in artefacts.load(spark, out, "resolved_mappings").collect()) == sum(m.size for m in maps) - sum(m.size for m in artefacts.load(spark, out, "resolved_mappings").collect())


def test_work_on_saved_artefacts(spark, saved):
    out, path = saved
    again = mapping_pipeline.resolve_saved(spark, out, "resolved_mappings")
    assert again.count() == artefacts.load(spark, out, "synthesized_mappings").count()
    for what in ("vote", "score", "synonyms", "baselines"):
        assert cli.main(["--output_folder", out, "--corpus_path", path, "--only", what], spark) == 0
    scored = artefacts.load(spark, out, "scored_mappings").collect()
    for m in scored:
        c = [p.confidence for p in m.scored_pairs]
        assert c == sorted(c, reverse=True) and (m.size, m.max_confidence) == (len(c), c[0])
        assert [(p.l, p.r) for p in m.scored_pairs] == [(p.l, p.r) for p in sorted(m.scored_pairs, key=lambda p: (-p.confidence, p.l, p.r))]
    rows = {(r.method, r.group_id): r.num_source_tables for r in artefacts.load(spark, out, "baselines").collect()}
    assert rows["UnionDomain", "0_ncols_2"] == 2 and rows["UnionDomain", "unknown_ncols_2"] == 1 and rows["UnionWeb", "ncols_2"] == 5
    assert artefacts.load(spark, out, "majority_mappings").count() == len(scored)


def test_index_is_kept_or_not(spark, saved, tmp_path):
    out, path = saved
    values, _ = corpus.read_index(spark, f"{out}/cooccurrence_index")
    assert values.count() > 0
    config = mapping_pipeline.Config(save_index=False, table_types=("RELATION", "OTHER"))
    again = mapping_pipeline.run(spark, path, str(tmp_path / "o"), config)
    assert not (tmp_path / "o" / "cooccurrence_index").exists()
    pairs = lambda df: sorted(map(str, (r.pairs for r in df.collect())))
    assert pairs(again) == pairs(artefacts.load(spark, out, "resolved_mappings"))


def test_cli_flags():
    args = cli.parser().parse_args(["--corpus_path", "c", "--output_folder", "o", "--tau", "-0.5", "--max_bucket_size", "9", "--no_skip_noise_values", "--string_matcher", "jw", "--no_save_index"])
    c = cli.config(args)
    assert (c.tau, c.max_bucket, c.skip_noise, c.matcher, c.save_index, c.theta, c.table_types) == (-0.5, 9, False, "jw", False, 0.95, ("RELATION",))
    with pytest.raises(SystemExit):
        cli.main(["--output_folder", "o"], spark=object())


def test_raw_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"relation": [["A ", null], ["1"]], "pgId": 7}\n\n{"pgId": null}\n')
    rows = [(r.domain, r["columns"]) for r in corpus.load_raw_jsonl(spark, str(tmp_path / "r.jsonl")).orderBy("table_idx").collect()]
    assert rows == [("7", [["A ", None], ["1"]]), (None, [])]


def test_candidates_far_apart_have_numbers_of_their_own(spark):
    far = 5000 << 33  # as of partition 5,000
    rows = [(t, c, i, f"{v}{i}") for t, c0, c1 in ((far, 0, 1001), (far, 2, 1), (far + 1, 0, 5000)) for c, v in ((c0, "x"), (c1, "y")) for i in range(4)]
    found = C.candidates(spark.createDataFrame(rows, "table_idx long, col_idx int, row_idx long, value string")).collect()
    keys = [(r.table_idx, r.left_col, r.right_col) for r in sorted(found, key=lambda r: r.cand)]
    assert sorted(r.cand for r in found) == list(range(len(found))) and keys == sorted(keys) and len(keys) == 14


def test_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(7)
    assert all(r.k == r.no for r in graph.numbered(df, ["k"], "no").collect())
    assert graph.numbered(df.limit(0), ["k"], "no").count() == 0


def naive_merge(edges, members, tau):
    """The heaviest edge by a full scan each time; of equals the one offered first."""
    group = {m: [m] for m in sorted(members)}
    pos = {(a, b): p for a, b, p, _ in edges if p > 0}
    neg = {(a, b): n for a, b, _, n in edges if n < 0}
    turn = {e: k for k, e in enumerate(sorted(pos))}
    fresh, clock = max(members) + 1, len(turn)
    get = lambda d, a, b: d.get((a, b), d.get((b, a), 0.0))
    while True:
        best = min(((-w, turn[e], e) for e, w in pos.items() if get(neg, *e) >= tau), default=None)
        if best is None:
            return sorted(sorted(g) for g in group.values())
        a, b = best[2]
        new, fresh = fresh, fresh + 1
        group[new] = group.pop(a) + group.pop(b)
        for k in list(group):
            if k == new:
                continue
            w, c = get(pos, a, k) + get(pos, b, k), min(get(neg, a, k), get(neg, b, k))
            if w > 0:
                pos[k, new], turn[k, new] = w, clock
                clock += 1
            if c < 0:
                neg[k, new] = c
        for d in (pos, neg):
            for e in [e for e in d if a in e or b in e]:
                del d[e]


@pytest.mark.parametrize("seed", range(8))
def test_merging_equals_a_full_scan(seed):
    rng = random.Random(seed)
    n = rng.randrange(3, 14)
    edges = [(a, b, rng.choice([0.0, 0.25, 0.5, 0.75, 1.0]), rng.choice([0.0, 0.0, -0.125, -0.5])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6]
    got = synthesis.merge_component(edges, list(range(n)), -0.25)
    assert sorted(map(sorted, got)) == naive_merge(edges, list(range(n)), -0.25)


def test_cells_come_back(spark):
    df = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 0, "b"), (0, 0, 2, None), (1, 3, 4, "x")], "table_idx long, col_idx int, row_idx int, value string")
    assert {r.table_idx: r["columns"] for r in corpus.to_tables(df).collect()} == {0: [["b", "", ""]], 1: [["", "", "", "", "x"]]}
    t = spark.createDataFrame([(0, [["a", None], None, []])], "table_idx long, columns array<array<string>>")
    assert [tuple(r) for r in corpus.to_cells(t).collect()] == [(0, 0, 0, "a"), (0, 0, 1, None)]


def test_digests_of_tables_tell_cells_apart(spark):
    t = spark.createDataFrame([(0, [["a\tb"]]), (1, [["a", "b"]]), (2, [["a"], ["b"]]), (3, [["a\nb"]]), (4, [["a", None]]), (5, [["a"]])], "table_idx long, columns array<array<string>>")
    assert evaluation.table_keys(t).select("key").distinct().count() == 6


def test_cell_store_over_jdbc(spark, tmp_path):
    df = spark.createDataFrame([(t, c, r, f"{t}{c}{r}", f"v{r}") for t in range(9) for c in range(2) for r in range(3)], "tableid long, colid int, rowid int, term string, tokenized string")
    options = {"url": f"jdbc:derby:{tmp_path}/store;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver", "dbtable": "cells"}
    try:
        df.write.format("jdbc").options(**options).mode("append").save()
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no embedded store: {str(e)[:80]}")
    one, many = corpus.read_cells_jdbc(spark, options), corpus.read_cells_jdbc(spark, options, 4)
    assert many.rdd.getNumPartitions() == 4 and sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) == sorted(map(tuple, df.collect()))


def test_views(spark):
    scored = spark.createDataFrame([(0, 0, 0.9), (0, 1, 0.1), (1, 0, 0.5)], "table_idx long, col_idx int, score double")
    cells = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate("cba")] + [(0, 1, 0, "q"), (1, 0, 0, "z")], "table_idx long, col_idx int, row_idx int, value string")
    assert {(r.kind, r.table_idx, r.col_idx): r.examples for r in views.kept_examples(scored, cells).collect()} == {("kept", 0, 0): ["c", "b", "a"], ("kept", 1, 0): ["z"], ("removed", 0, 1): ["q"]}
    store = cells.select(F.col("table_idx").alias("tableid"), F.col("col_idx").alias("colid"), F.col("row_idx").alias("rowid"), F.col("value").alias("term"), F.col("value").alias("tokenized"))
    assert [r.term for r in explore.listing(store, 0, 3).collect()] == ["c", "q", "b"]


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "table_idx long, col_idx int, row_idx long, value string")
    assert coherence.coherence(cells).count() == 0 and coherence.corpus_summary(cells).first().tables == 0 and C.candidates(cells).count() == 0
    rows = spark.createDataFrame([], "partition long, l string, r string")
    assert resolution.resolve(rows).count() == 0 and resolution.report(resolution.nested(rows, rows)).first().removed == 0
    pairs = spark.createDataFrame([], "cand long, pos int, l string, r string")
    edges = synthesis.overlap_edges(pairs, 1)
    assert synthesis.edge_scores(pairs, edges).count() == 0 and synthesis.edge_report(synthesis.edge_scores(pairs, edges)).first().edges == 0
    assert baselines.union_domain(baselines.first_columns(spark.createDataFrame([], "table_idx long, domain string, columns array<array<string>>"))).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0 and corpus.to_tables(cells).count() == 0


def test_streams(spark, tmp_path):
    cols = spark.createDataFrame([(i, 0, v) for i, v in enumerate([["b", "a", "c"], ["a", "b", "a"], ["x", "1", ""], ["c", "b", "17"]])], "table_idx long, col_idx int, vals array<string>")
    cols.repartition(2).write.parquet(str(tmp_path / "in"))
    q = increments.stream_pairs(spark.readStream.schema(cols.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("pairs").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 2)}
    events = spark.createDataFrame([(f"2024-01-01 {h:02}:{m:02}:00", k, 1.5) for h, m, k in ((0, 1, "a"), (0, 59, "a"), (1, 0, "b"), (9, 0, "a"))], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "ev"))
    q = increments.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.window.start.hour, r.event_type, r.n, r.total) for r in spark.table("windows").collect()} >= {(0, "a", 2, 3.0), (1, "b", 1, 1.5)}


@pytest.mark.parametrize("seed", range(40))
def test_merging_in_tables_equals_a_full_scan(seed):
    import numpy as np

    rng = random.Random(seed)
    n = rng.randrange(3, 16)
    edges = [(3 * a, 3 * b, rng.choice([0.0, 0.25, 0.5, 0.75, 1.0]), rng.choice([0.0, 0.0, -0.125, -0.5])) for a in range(n) for b in range(a + 1, n) if rng.random() < rng.choice([0.5, 0.9, 1.0])]
    rng.shuffle(edges)
    members = sorted({m for e in edges for m in e[:2]})
    if edges:
        got = synthesis.merge_dense(*map(np.array, zip(*edges)), -0.25)
        assert sorted(map(sorted, got)) == naive_merge(edges, members, -0.25)


def test_a_component_with_all_edges(spark):
    scores = spark.range(90).selectExpr("id AS ci").crossJoin(spark.range(90).selectExpr("id AS cj")).where("ci < cj").selectExpr("ci", "cj", "IF((cj - ci) % 3 = 0, 1.0D, 0.6D) AS w_pos", "IF((cj - ci) % 3 = 0, 0.0D, -0.4D) AS w_neg")
    parts = {r.cand: r.partition for r in synthesis.greedy_partition(scores, spark.range(90).toDF("cand"), -0.2, 0.5).collect()}
    assert parts == {k: k % 3 for k in range(90)}
