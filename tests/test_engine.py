"""The mapping engine on small corpora with known results."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from mapweave.functions import jaro as J
from mapweave.functions import text as T
from mapweave.operators import baselines, coherence, evaluation, explore, graph, resolution, synonyms, synthesis
from mapweave.operators import candidates as C
from mapweave.plans import mapping_pipeline
from mapweave.sources import corpus
from mapweave.streaming import increments

TABLES = [
    [["Copper", "Cobalt", "Nickel"], ["CU", "CO", "NI"]],
    [["Copper", "Cobalt", "Zinc"], ["CU", "CO", "ZN"]],
    [["Nickel", "Zinc", "Tin"], ["NI", "ZN", "SN"]],
    [["1987-03-09", "green tea", "41.2%", "silent film", "teal"]],
    [["1987-03-09", "1990-11-30"]],
    [["green tea", "plum"]],
    [["x", "x"], ["1", "2"]],
]


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "t.jsonl"
    lines = [json.dumps({"relation": t, "tableType": "RELATION", "hasHeader": False, "headerRowIndex": -1}) for t in TABLES]
    lines += ["", "{broken", json.dumps({"relation": TABLES[0], "tableType": "ENTITY"}), json.dumps({"relation": [["Head", "A ", " b  c"], ["h", None, 1.0]], "tableType": "RELATION", "hasHeader": True, "headerRowIndex": 0})]
    path.write_text("\n".join(lines))
    return graph.checkpointed(corpus.to_cells(corpus.load_corpus(spark, str(path))))


def test_loader(cells):
    rows = {(r.col_idx, r.row_idx): r.value for r in cells.join(cells.agg(F.max("table_idx").alias("table_idx")), "table_idx").collect()}
    assert rows == {(0, 0): "a", (0, 1): "b c"}  # the header is gone, and so is a column with one value
    assert cells.where("value = 'x'").count() == 0


def test_missing_path(spark):
    with pytest.raises(FileNotFoundError):
        corpus.load_corpus(spark, "/nowhere/at/all")


def test_csv_folder(spark, tmp_path):
    (tmp_path / "b.csv").write_text('Name,Code\n"New, York",ny\nBoston\n')
    (tmp_path / "a.CSV").write_text("k,v\nk,w\n")
    (tmp_path / "c.txt").write_text("no,table\n")
    rows = [(r.table_idx, json.loads(r.meta)["source"], r["columns"]) for r in corpus.load_corpus(spark, str(tmp_path)).orderBy("table_idx").collect()]
    assert rows == [(0, "a.CSV", [["v", "w"]]), (1, "b.csv", [["name", "new, york", "boston"], ["code", "ny", ""]])]


def test_wikipedia(spark, tmp_path):
    data = [[str(i + 1), v, n, "same"] for i, (v, n) in enumerate([("Rome", "?"), ("Paris", "-"), ("Oslo", "x"), ("Bern", "b")])]
    (tmp_path / "w.jsonl").write_text(json.dumps({"tableData": [[{"text": c} for c in row] for row in data]}) + "\n{bad\n")
    assert [r["columns"] for r in corpus.load_wikipedia(spark, str(tmp_path / "w.jsonl")).collect()] == [[["Rome", "Paris", "Oslo", "Bern"]]]


def test_archive(spark, tmp_path):
    import io
    import tarfile

    def packed(files):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for name, body in files:
                info = tarfile.TarInfo(name)
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
        return out.getvalue()

    inner = packed([("a.json", b'{"relation": []}'), ("b.json", b"broken"), ("c.txt", b"x")])
    (tmp_path / "all.tar.gz").write_bytes(packed([("one.tar.gz", inner), ("d.json", b'{"k": 1}')]))
    assert sorted(r.value for r in corpus.load_archives(spark, str(tmp_path)).collect()) == ['{"k": 1}', '{"relation": []}']


def test_nested_again(spark):
    df = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 2, "c"), (0, 1, 1, "x")], "table_idx long, col_idx int, row_idx int, value string")
    assert corpus.to_tables(df).first()["columns"] == [["a", "", "c"], ["", "x"]]


def test_npmi_and_coherence(cells):
    cols = coherence.column_values(cells)
    pairs = {(r.u, r.v): r.npmi for r in coherence.npmi(cols).collect()}
    assert pairs["cobalt", "copper"] == 1.0 and ("cobalt", "teal") not in pairs
    assert all(-1 <= v <= 1 for v in pairs.values())
    n = coherence.total_columns(cols).first()[0]
    want = math.log((1 / n) / ((2 / n) * (2 / n))) / -math.log(1 / n)
    assert pairs["cobalt", "nickel"] == pytest.approx(want)
    assert coherence.coherence(cells.where("value = 'teal'")).first().score == -1.0


def test_approximate_fd(spark):
    rows = [(0, c, i, v) for c, vals in enumerate([["a", "a", "b", "b", "", "c"], ["2", "1", "3", "3", "4", ""], ["k"] * 6]) for i, v in enumerate(vals)]
    out = {(r.left_col, r.right_col): r for r in C.approximate_fds(spark.createDataFrame(rows, "table_idx long, col_idx int, row_idx long, value string")).collect()}
    assert out[0, 1].theta == 0.75 and [tuple(p) for p in out[0, 1].pairs] == [("a", "2"), ("b", "3")]  # the first seen of equals
    assert (0, 2) not in out and (out[1, 0].row_count, out[1, 0].covered_rows) == (4, 4)


NOISE = [
    ("identity", [("a", "a"), ("b", "b")]), ("int->int", [("1", "2.5"), ("3", "-4")]), ("hex_pair", [("#ff", "0x1"), ("#1", "#2")]), ("placeholder_dominated", [("a", "n/a"), ("-", "b")]),
    ("numeric_string", [("a", "1,000,000"), ("b", "+3")]), (None, [("a", "1999"), ("b", "2001")]), (None, [("a", "04.10"), ("b", "1999-07-05")]), ("currency_value", [("a", "$5 x"), ("b", "7€ y")]),
    ("number_dominated", [("a", "14b3z9"), ("b", "a123")]), ("boolean_pair", [("a", "yes"), ("b", "f")]), ("uuid_pair", [("a", "abcdef" * 5 + "12"), ("b", "abcdef12-aaaa-bbbb-cccc-abcdef1234ab")]),
    ("url_or_path", [("a", "https://b c"), ("b", "/usr/lib")]), ("repeated_char", [("a", "----"), ("b", "???")]), ("constant_pair", [("a", "k"), ("b", "k")]), (None, [("a", "x"), ("b", "y")]),
]


def test_noise_rules(spark):
    df = spark.createDataFrame([(i, l, r) for i, (_, ps) in enumerate(NOISE) for l, r in ps], "cand long, l string, r string")
    assert {r.cand: r.reason for r in C.noise_reasons(df).collect()} == {i: k for i, (k, _) in enumerate(NOISE)}


def cand_pairs(spark, cands):
    return spark.createDataFrame([(i, k, l, r) for i, ps in enumerate(cands) for k, (l, r) in enumerate(ps)], "cand long, pos int, l string, r string")


def test_scores_and_components(spark):
    a = [(x, x.upper()) for x in ("aa", "bb", "cc", "dd")]
    p = cand_pairs(spark, [a, a[:3], [("aa", "AA"), ("bb", "no"), ("cc", "no"), ("dd", "DD")], [("zz", "ZZ")]])
    edges = synthesis.overlap_edges(p, 1)
    got = {(r.ci, r.cj): (r.w_pos, r.w_neg) for r in synthesis.edge_scores(p, edges).collect()}
    assert got == {(0, 1): (1.0, 0.0), (0, 2): (0.5, -0.5), (1, 2): (1 / 3, -2 / 3)}
    assert {(r.ci, r.cj) for r in synthesis.overlap_edges(p, 3).collect()} == {(0, 2)}  # strictly more than the bound
    scores = synthesis.edge_scores(p, edges)
    roots = {r.v: r.root for r in synthesis.candidate_components(scores, p, 0.85).collect()}
    assert roots == {0: 0, 1: 0, 2: 2, 3: 3}
    parts = {r.cand: r.partition for r in synthesis.greedy_partition(scores, p, -0.2, 0.3).collect()}
    assert parts == {0: 0, 1: 0, 2: 2, 3: 3}


def test_near_values_can_weigh_more_than_one(spark):
    p = cand_pairs(spark, [[(f"united stat{i}s", "k") for i in "aeiou"], [("united states", "k")]])
    e = spark.createDataFrame([(0, 1)], "ci long, cj long")
    assert synthesis.edge_scores(p, e, synthesis.edit_matcher).first().w_pos == 5.0


def test_merge_order():
    assert synthesis.merge_component([(0, 1, 0.9, 0.0), (1, 2, 0.8, 0.0), (0, 2, 0.0, -0.5)], [0, 1, 2], -0.2) == [[2], [0, 1]]
    assert synthesis.merge_component([(0, 1, 0.9, 0.0), (1, 2, 0.8, 0.0), (0, 2, 0.0, -0.1)], [0, 1, 2], -0.2) == [[0, 1, 2]]
    # sums let the union of two beat a heavier single edge
    assert synthesis.merge_component([(0, 1, 1.0, 0.0), (0, 2, 0.6, 0.0), (1, 2, 0.6, 0.0), (2, 3, 0.9, 0.0), (0, 3, 0.0, -1.0)], [0, 1, 2, 3], -0.2) == [[3], [0, 1, 2]]


def test_resolution(spark):
    rows = spark.createDataFrame([(1, "a", r) for r in "uvz"] + [(1, "b", "q"), (2, "a", "k")], "partition long, l string, r string")
    assert {tuple(r) for r in resolution.resolve(rows).collect()} == {(1, "a", "z"), (1, "b", "q"), (2, "a", "k")}
    support = spark.createDataFrame([(1, "a", "v", 3), (1, "a", "u", 3), (1, "a", "z", 1)], "partition long, l string, r string, support long")
    assert {(r.partition, r.l, r.r) for r in resolution.majority(rows, support).collect()} == {(1, "a", "u"), (1, "b", "q"), (2, "a", "k")}
    assert resolution.report(resolution.nested(resolution.resolve(rows), rows)).first().removed == 2


def test_confidence(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (0, "a", "y"), (0, "b", "z")], "partition long, l string, r string")
    pairs = cand_pairs(spark, [[("a", "x"), ("b", "z")], [("a", "x")], [("a", "y")]])
    cands = spark.createDataFrame([(0, 1.0), (1, 0.98), (2, 0.95)], "cand long, theta double")
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "cand long, partition long")
    out = {(r.l, r.r): r for r in resolution.confidence(rows, parts, cands, pairs, rows.where("r <> 'y'")).collect()}
    assert out["a", "x"].confidence == pytest.approx(0.5 + 0.3 * 0.8 + 0.2) and out["a", "y"].confidence == pytest.approx(0.25 + 0.06) and not out["a", "y"].survived
    with pytest.raises(ValueError):
        resolution.confidence(rows, parts, cands, pairs, weights=(1, 1, 1))


@pytest.mark.parametrize("a,b,want", [("U.S.A.", "usa", "exact"), ("", "x", "empty"), ("American Samoa (US)", "american samoa", "exact"), ("Republic of Korea", "Korea Republic", "token_set"), ("NYC", "New York City", "abbreviation"), ("united states", "united statez", "edit_distance"), ("abc", "xyz", "no_match")])
def test_match_strategy(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(T.match_strategy(F.col("a"), F.col("b"))).first()[0] == want


def test_jaro_winkler(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("dixon", "dicksonx"), ("", "a"), ("a", "a")], "a string, b string")
    rows = [tuple(r) for r in df.select(J.jaro(F.col("a"), F.col("b")), J.jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert rows[0] == pytest.approx((0.944444, 0.961111), abs=1e-5) and rows[1] == pytest.approx((0.766667, 0.813333), abs=1e-5) and rows[2] == (0.0, 0.0) and rows[3] == (1.0, 1.0)


def test_unicode(spark):
    df = spark.createDataFrame([(" Köln-süd  (x) ",)], "t string")
    assert tuple(df.select(T.clean_value(F.col("t")), T.normalize(F.col("t"))).first()) == ("köln-süd (x)", "köln süd")


def test_synonyms(spark, tmp_path):
    table = synonyms.synonyms(synonyms.pairs(spark, spark.createDataFrame([("U.K. ", "uk")], "a string, b string")))
    assert {r.value for r in synonyms.synonyms_of(table, " UK").collect()} == {"uk", "u.k.", "united kingdom", "great britain"}
    synonyms.save_csv(table, str(tmp_path / "s"))
    assert synonyms.synonyms(synonyms.load_csv(spark, str(tmp_path / "s"))).count() == table.count()
    p = cand_pairs(spark, [[("uk", "x"), ("fr", "y")], [("great britain", "x"), ("fr", "y")]])
    assert synonyms.boost(p, spark.createDataFrame([(0, 1)], "ci long, cj long"), table).first().boost == 1


def test_evaluation(spark):
    gold = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f"), ("b", "a"), ("g", "g"), ("", "x")], "l string, r string")
    predicted = spark.createDataFrame([("b", "a"), ("a", "c"), ("q", "a")], "l string, r string")
    cells_ = spark.createDataFrame([(0, 0, 0, "a"), (0, 1, 0, "b"), (0, 0, 1, "c"), (1, 0, 0, "d")], "table_idx long, col_idx int, row_idx long, value string")
    r = evaluation.evaluate(gold, predicted, cells_).first()
    assert (r.n_g, r.n_p, r.n_p_g, r.n_ach, r.n_p_ach, r.n_sc) == (3, 3, 1, 2, 1, 2) and r.precision == pytest.approx(1 / 3)
    assert {(x.a, x.b): x.status for x in evaluation.coverage(gold, cells_).collect()} == {("a", "b"): "covered", ("c", "d"): "split", ("e", "f"): "absent"}
    assert {tuple(x) for x in evaluation.cover_tables(gold, cells_).collect()} == {(0, 1)}


def test_covered_sample(spark):
    tables = evaluation.table_keys(spark.createDataFrame([(i, [[str(i // 2)]]) for i in range(10)], "table_idx long, columns array<array<string>>"))
    out = evaluation.covered_sample(tables.where("table_idx < 3"), tables, 5).collect()
    assert len(out) == 5 and not [r for r in out if r.source == "filler" and r.table_idx < 4]


def test_baselines(spark):
    df = spark.createDataFrame([(0, "p", [["A ", "b"], ["1", "2"]]), (1, "p", [["a", ""], ["1", "9"]]), (2, None, [["c"], ["3"], ["x"]]), (3, "p", [["z"]])], "table_idx long, domain string, columns array<array<string>>")
    rows = baselines.first_columns(df)
    assert {(r.group_id, r.num_source_tables, r.size) for r in baselines.union_domain(rows).collect()} == {("p_ncols_2", 2, 2), ("unknown_ncols_3", 1, 1)}
    assert {(r.group_id, r.size) for r in baselines.schema_cc(rows, 0.5).collect()} == {("0", 2), ("2", 1)}


def test_explore(spark):
    df = spark.createDataFrame([(1, 0, 0, "Name"), (1, 1, 0, None), (1, 0, 1, "12"), (1, 1, 1, "n/a"), (1, 2, 1, " ")], "tableid long, colid int, rowid long, tokenized string")
    assert tuple(explore.token_classes(df).first()) == (1, 5, 2, 1, 2)
    assert {tuple(r) for r in explore.pivot_all(df).collect()} == {(1, 0, "Name", None, None), (1, 1, "12", "n/a", " ")}
    assert explore.header_rows(df, ["nam"]).first().header_row == 0 and explore.last_full_row(df).first().header_row == 1
    assert explore.without_nulls(df).count() == 2


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (7, 7)], "a long, b long")
    out = {r.v: r.root for r in graph.components(edges, spark.range(102).toDF("v")).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[100] == 50 and out[101] == 101 and len(out) == 102


def test_pipeline(spark, tmp_path):
    lines = [json.dumps({"relation": [[f"land {c}" for c in "abcdefgh"], [c * 3 for c in "abcdefgh"]], "tableType": "RELATION"}) for _ in range(4)]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    out = mapping_pipeline.run(spark, str(tmp_path / "c.jsonl"), str(tmp_path / "out")).collect()
    assert {(r.size, r.num_conflicts_removed) for r in out} == {(8, 0)} and len(out) == 2  # one for each direction


def test_index_round_trip(spark, cells, tmp_path):
    cols = coherence.column_values(cells)
    corpus.write_index(coherence.value_counts(cols), coherence.cooccurrence(cols), str(tmp_path))
    values, pairs = corpus.read_index(spark, str(tmp_path))
    assert values.count() == coherence.value_counts(cols).count() and pairs.count() == coherence.cooccurrence(cols).count()


def test_stream_equals_batch(spark, cells, tmp_path):
    cols = cells.groupBy("table_idx", "col_idx").agg(F.collect_list("value").alias("vals"))
    cols.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cols.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = increments.stream_value_counts(stream).writeStream.outputMode("complete").format("memory").queryName("value_counts").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in coherence.value_counts(coherence.column_values(cells)).collect()}
    assert {tuple(r) for r in spark.table("value_counts").collect()} == want


def test_stored_frames_are_small(spark):
    """Serialised rows of a checkpoint took over 40 bytes each."""
    from mapweave.operators import graph

    rows = spark.range(0, 200_000, 1, 2).selectExpr("id div 1000 AS table_idx", "CAST(id % 7 AS INT) AS col_idx", "id % 1000 AS row_idx", "concat('value number ', id % 25) AS value")
    out = graph.checkpointed(rows)
    sizes = [spark._jvm.java.io.File(f.replace("file:", "")).length() for f in out.inputFiles()]
    assert 0 < sum(sizes) < 200_000 * 10
    assert out.schema.simpleString() == rows.schema.simpleString() and out.exceptAll(rows).count() == 0 == rows.exceptAll(out).count()


def test_witnesses_in_both_directions_with_one_shuffle(spark):
    from mapweave.operators import candidates

    cells = spark.createDataFrame([(0, c, r, v) for r, (a, b, d) in enumerate([("x", "1", "p"), ("x", "2", "p"), ("y", "2", ""), ("x", "1", None)]) for c, v in enumerate((a, b, d))], "table_idx long, col_idx int, row_idx long, value string")
    out = candidates.witnesses(cells)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.left_col, r.right_col, r.x): (r.y, r.cnt, r.rows_x, r.first_row, r.low_y, r.high_y) for r in out.collect()}
    assert got == {
        (0, 1, "x"): ("1", 2, 3, 0, "1", "2"), (0, 1, "y"): ("2", 1, 1, 2, "2", "2"), (1, 0, "1"): ("x", 2, 2, 0, "x", "x"), (1, 0, "2"): ("x", 1, 2, 1, "x", "y"),
        (0, 2, "x"): ("p", 2, 2, 0, "p", "p"), (2, 0, "p"): ("x", 2, 2, 0, "x", "x"), (1, 2, "1"): ("p", 1, 1, 0, "p", "p"), (1, 2, "2"): ("p", 1, 1, 1, "p", "p"), (2, 1, "p"): ("1", 1, 2, 0, "1", "2"),
    }


def test_coherence_by_broadcast_and_by_shuffle(spark, monkeypatch):
    from mapweave.operators import coherence

    cells = spark.createDataFrame([(t, 0, r, f"v{(t * r) % 5}") for t in range(1, 9) for r in range(4)], "table_idx long, col_idx int, row_idx long, value string")
    few = coherence.coherence(cells)
    assert "BroadcastHashJoin [u#" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(coherence, "BROADCAST_PAIRS", 0)
    rounded = lambda df: {(r.table_idx, r.col_idx, round(r.score, 12)) for r in df.collect()}
    assert rounded(few) == rounded(coherence.coherence(cells)) and len(rounded(few)) == 8


def test_candidates_with_the_same_pairs_are_compared_once(spark, monkeypatch):
    """All of them met at each value, so that rows grew with the square of the candidates."""
    import random
    from collections import Counter
    from itertools import combinations

    rng, seen, shared = random.Random(3), [], synthesis._shared
    monkeypatch.setattr(synthesis, "_shared", lambda rows, keys, name: seen.append((rows.count(), keys)) or shared(rows, keys, name))
    sets = [[("a", "x"), ("b", "y"), ("c", "z")], [("a", "x"), ("b", "z")], [("a", "x"), ("a", "x"), ("d", "y")], [("e", "w")]]
    held = [rng.choice(sets) for _ in range(24)] + [[("e", "w")], [("q", "w")]]
    rows = [(c, i, *p) for c, ps in enumerate(held) for i, p in enumerate(ps)]
    rng.shuffle(rows)
    p = spark.createDataFrame(rows, "cand long, pos int, l string, r string")
    want, scores = {}, {}
    for i, j in combinations(range(len(held)), 2):
        x, y = Counter(held[i]), Counter(held[j])
        lefts = {a for a, _ in x} & {a for a, _ in y}
        if lefts:
            want[i, j] = (sum(x[k] * y[k] for k in x), len(lefts))
            clashes = {a for a, b in x if any(a == c and b != d for c, d in y)}
            small = min(len(held[i]), len(held[j]))
            scores[i, j] = (len(x.keys() & y.keys()) / small, -len(clashes) / small)
    edges = graph.checkpointed(synthesis.overlap_edges(p, 0))
    assert {(r.ci, r.cj): (r.shared_pairs, r.shared_lefts) for r in edges.collect()} == want and edges.count() == len(want)
    assert [n for n, keys in seen if keys == ["l", "r"]] == [10]  # of the sets' pairs, not of 26 candidates'
    for matcher in (None, synthesis.edit_matcher):
        assert {(r.ci, r.cj): (r.w_pos, r.w_neg) for r in synthesis.edge_scores(p, edges, matcher).collect()} == scores
    capped = {(r.ci, r.cj) for r in synthesis.overlap_edges(p, 0, 3).collect()}  # buckets count all candidates
    n = Counter(a for ps in held for a in {a for a, _ in ps})
    m = Counter(q for ps in held for q in ps)
    assert capped == {(i, j) for i, j in want if any(n[a] <= 3 for a in {a for a, _ in held[i]} & {a for a, _ in held[j]}) or any(m[q] <= 3 for q in set(held[i]) & set(held[j]))}
    monkeypatch.setattr(synthesis, "BROADCAST_ROWS", 0)
    assert {(r.ci, r.cj): (r.w_pos, r.w_neg) for r in synthesis.edge_scores(p, synthesis.overlap_edges(p, 0)).collect()} == scores


def test_partition_pairs_is_the_greedy_one_without_edges(spark, monkeypatch):
    """Twins in families with and without conflicts, small ones whose copies don't meet, against the merge of all edges."""
    rng, rows = random.Random(11), []
    for cand in range(60):
        family = rng.randrange(5)
        size = 2 if family == 4 else 8
        for k in range(size):
            right = rng.choice("ab") if family == 1 and k < 3 else "c" if family == 2 and k == 0 and rng.random() < 0.5 else "r"
            rows.append((cand, f"f{family}k{k}", right))
    pairs, cands = graph.checkpointed(spark.createDataFrame(rows, "cand long, l string, r string")), spark.range(61).toDF("cand")
    for theta in (0.5, 0.85):
        scores = synthesis.edge_scores(pairs, synthesis.overlap_edges(pairs, 3))
        want = {r.cand: r.partition for r in synthesis.greedy_partition(scores, cands, -0.2, theta).collect()}
        assert {r.cand: r.partition for r in synthesis.partition_pairs(pairs, cands, 3, theta_edge=theta).collect()} == want
    assert len(set(want.values())) > 10

    def never(*_):
        raise AssertionError("edges of candidates")

    monkeypatch.setattr(synthesis, "greedy_partition", never)
    easy = pairs.where("l NOT LIKE 'f1%'")
    assert synthesis.partition_pairs(easy, cands, 3).count() == 61
