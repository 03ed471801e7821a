"""Compatibility graph of candidates and its greedy partition.

Candidates meet where they share a left value or a whole pair; the shuffle key is that value. One join gives shared pairs, shared lefts and
conflicts of each edge at once. Edges are (ci, cj) with ci < cj, and the lower candidate is B in asymmetric scores.

Candidates that hold the same pairs are twins: their smallest one is compared for all of them, with itself too, and the results go to
each edge. So the joins on values grow with the different sets of pairs, and only the list of edges with the number of candidates' pairs.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions import text as T
from mapweave.operators.graph import checkpointed, components

EDGE = ["ci", "cj"]
#: Rows of two or four numbers that are sent to all executors at most; beyond, the join is left to a shuffle.
BROADCAST_ROWS = 200_000


def _small(stored: DataFrame) -> DataFrame:
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def twins(pairs: DataFrame) -> DataFrame:
    """(cand, twin): each candidate with the smallest one that holds the same pairs, each as often."""
    held = pairs.groupBy("cand").agg(F.array_sort(F.collect_list(F.struct("l", "r"))).alias("held"))
    return held.join(held.groupBy("held").agg(F.min("cand").alias("twin")), "held").select("cand", "twin")


def inverted_index(pairs: DataFrame) -> DataFrame:
    """(l, r, cands): for each pair the candidates that hold it, in order."""
    return pairs.groupBy("l", "r").agg(F.array_sort(F.collect_set("cand")).alias("cands"))


def _capped(pairs: DataFrame, keys: list[str], most: int) -> DataFrame:
    if most <= 0:
        return pairs
    return pairs.withColumn("bucket", F.count("*").over(Window.partitionBy(*keys))).where(F.col("bucket") <= most).drop("bucket")


def _shared(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    a, b = rows.select(F.col("cand").alias("ci"), *keys), rows.select(F.col("cand").alias("cj"), *keys)
    return a.join(b, keys).where("ci <= cj").groupBy(*EDGE).agg(F.count("*").alias(name))


def overlap_edges(pairs: DataFrame, theta_overlap: int = 1, max_bucket: int = 0) -> DataFrame:
    """(ci, cj, shared_pairs, shared_lefts) where more than theta_overlap pairs or lefts are shared. Buckets of more than max_bucket
    candidates (0: none) are passed over, as stop words are."""
    same = _small(checkpointed(twins(pairs)))
    # each candidate meets the larger ones that its twin has an edge with; the candidates are dealt out, for few twins may have most of them
    both = _twin_overlaps(pairs, same, theta_overlap, max_bucket)
    spark = pairs.sparkSession
    each = same.toDF("ci", "x").join(both, "x").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ci")
    return each.join(same.toDF("cj", "y"), "y").where("ci < cj").select(*EDGE, "shared_pairs", "shared_lefts")


def _twin_overlaps(pairs: DataFrame, same: DataFrame, theta_overlap: int, max_bucket: int) -> DataFrame:
    """(x, y, shared_pairs, shared_lefts) of twins in both directions, each with itself too."""
    first = same.where("cand = twin").select("cand")
    # buckets are counted over all candidates
    whole = _shared(_capped(pairs.select("cand", "l", "r"), ["l", "r"], max_bucket).join(first, "cand", "left_semi"), ["l", "r"], "shared_pairs")
    left = _shared(_capped(pairs.select("cand", "l").distinct(), ["l"], max_bucket).join(first, "cand", "left_semi"), ["l"], "shared_lefts")
    out = left.join(whole, EDGE, "full_outer").na.fill(0, ["shared_pairs", "shared_lefts"])
    out = checkpointed(out.where((F.col("shared_pairs") > theta_overlap) | (F.col("shared_lefts") > theta_overlap)))
    both = out.select(F.col("ci").alias("x"), F.col("cj").alias("y"), "shared_pairs", "shared_lefts")
    return both.union(both.where("x < y").select("y", "x", "shared_pairs", "shared_lefts"))


def sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cand").agg(F.count("*").alias("n"))


def edge_scores(pairs: DataFrame, edges: DataFrame, matcher=None, pair_cap: int = 0) -> DataFrame:
    """(ci, cj, w_pos, w_neg) of each edge. matcher(a, b): whether two values agree, as a Column; None compares exactly. pair_cap: only
    the first pairs of a candidate are compared (0: all). w_pos counts the rows of B that have a partner, over the smaller size; w_neg the lefts of B with a
    matching left of another right."""
    if pair_cap:
        pairs = pairs.where(F.col("pos") < pair_cap)
    same = _small(checkpointed(twins(pairs)))
    known = edges.select(*EDGE).join(same.toDF("ci", "xi"), "ci").join(same.toDF("cj", "xj"), "cj")
    e = checkpointed(known.select(F.col("xi").alias("ci"), F.col("xj").alias("cj")).distinct())  # in both directions, where edges are
    scored = _twin_scores(pairs, same, e, matcher)
    return known.join(_small(checkpointed(scored)), ["xi", "xj"]).select(*EDGE, "w_pos", "w_neg")


def _twin_scores(pairs: DataFrame, same: DataFrame, e: DataFrame, matcher=None) -> DataFrame:
    """(xi, xj, w_pos, w_neg) for the stored edges (ci, cj) of twins."""
    p = pairs.select("cand", "l", "r").join(same.where("cand = twin").select("cand"), "cand", "left_semi")
    a, b = p.toDF("ci", "l1", "r1"), p.toDF("cj", "l2", "r2")
    if matcher is None:
        # the edges come first: only pairs of candidates with an edge meet
        met = e.join(a, "ci").join(p.toDF("cj", "l1", "r2"), ["cj", "l1"]).select(*EDGE, "l1", "r1", (F.col("r1") == F.col("r2")).alias("same"))
    else:
        # each pair of values that meets in some edge is compared once
        lefts = e.join(a.select("ci", "l1").distinct(), "ci").join(b.select("cj", "l2").distinct(), "cj")
        near = checkpointed(lefts.select("l1", "l2").distinct()).where(matcher(F.col("l1"), F.col("l2")))  # else the matcher is pushed below distinct
        met = lefts.join(near, ["l1", "l2"]).join(a, ["ci", "l1"]).join(b, ["cj", "l2"])
        agree = checkpointed(met.select("r1", "r2").distinct()).select(F.col("r1").alias("x"), F.col("r2").alias("y"), matcher(F.col("r1"), F.col("r2")).alias("same"))
        met = met.join(agree, (F.col("r1") == F.col("x")) & (F.col("r2") == F.col("y"))).select(*EDGE, "l1", "r1", "same")
    rows = met.groupBy(*EDGE, "l1", "r1").agg(F.bool_or("same").alias("hit"), F.bool_or(~F.col("same")).alias("clash"))
    sums = rows.groupBy(*EDGE).agg(F.count_if("hit").alias("inter"), F.count_distinct(F.when(F.col("clash"), F.col("l1"))).alias("conflicts"))
    n = sizes(p)
    out = e.join(sums, EDGE, "left").na.fill(0, ["inter", "conflicts"]).join(n.toDF("ci", "ni"), "ci").join(n.toDF("cj", "nj"), "cj")
    small = F.least("ni", "nj")
    return out.select(F.col("ci").alias("xi"), F.col("cj").alias("xj"), (F.col("inter") / small).alias("w_pos"), (-F.col("conflicts") / small).alias("w_neg"))


def edit_matcher(a: Column, b: Column) -> Column:
    return T.approx_match(a, b)


def jaccard_matcher(a: Column, b: Column) -> Column:
    """Character bigrams with a similarity of one half; two texts without any agree."""
    return T.char_jaccard(a, b) >= 0.5


def negative_edges(scores: DataFrame) -> DataFrame:
    """All edges with a conflict, whatever their positive weight."""
    return scores.where("w_neg < 0")


def edge_report(scores: DataFrame, theta_edge: float = 0.85, blocking: float = -0.2) -> DataFrame:
    """How many edges there are, are kept as positive or negative ones, and conflict beyond a fixed bound."""
    return scores.agg(F.count("*").alias("edges"), F.count_if((F.col("w_pos") >= theta_edge) & (F.col("w_pos") > 0)).alias("positive"), F.count_if(F.col("w_neg") < 0).alias("negative"), F.count_if(F.col("w_neg") < blocking).alias("blocking"))


def positive_edges(scores: DataFrame, theta_edge: float = 0.85) -> DataFrame:
    return scores.where((F.col("w_pos") >= theta_edge) & (F.col("w_pos") > 0))


def candidate_components(scores: DataFrame, cands: DataFrame, theta_edge: float = 0.85) -> DataFrame:
    """(v, root) over positive edges; candidates without any are alone."""
    edges = positive_edges(scores, theta_edge).select(F.col("ci").alias("a"), F.col("cj").alias("b"))
    return components(edges, cands.select(F.col("cand").alias("v")).distinct())


def merge_component(edges: list[tuple[int, int, float, float]], members: list[int], tau: float) -> list[list[int]]:
    """Greedy merging of one component: the heaviest edge without a conflict beyond tau first, then the earlier; weights to the union are
    sums, conflicts minima. edges: (a, b, w_pos or 0, w_neg)."""
    pos: dict[int, dict[int, float]] = {m: {} for m in members}
    neg: dict[int, dict[int, float]] = {m: {} for m in members}
    heap: list[tuple[float, int, int, int]] = []
    group, turn, fresh = {m: [m] for m in sorted(members)}, 0, max(members) + 1

    def offer(a: int, b: int) -> None:
        nonlocal turn
        w = pos[a].get(b, 0.0)
        if w > 0 and neg[a].get(b, 0.0) >= tau:
            heapq.heappush(heap, (-w, turn, a, b))
        turn += 1

    for a, b, p, n in sorted(edges):
        if p > 0:
            pos[a][b] = pos[b][a] = p
        if n < 0:
            neg[a][b] = neg[b][a] = n
    for a, b, p, _ in sorted(edges):
        if p > 0:
            offer(a, b)
    while heap:
        _, _, a, b = heapq.heappop(heap)
        if a not in group or b not in group:
            continue
        new, fresh = fresh, fresh + 1
        pos[new], neg[new] = {}, {}
        near = sorted((pos[a].keys() | pos[b].keys() | neg[a].keys() | neg[b].keys()) - {a, b})  # older groups have smaller numbers
        for k in near:
            w, c = pos[a].get(k, 0.0) + pos[b].get(k, 0.0), min(neg[a].get(k, 0.0), neg[b].get(k, 0.0))
            for side, value, live in ((pos, w, w > 0), (neg, c, c < 0)):
                side[k].pop(a, None)
                side[k].pop(b, None)
                if live:
                    side[new][k] = side[k][new] = value
        group[new] = group.pop(a) + group.pop(b)
        for k in near:
            if k in pos[new]:
                offer(k, new)
        for gone in (a, b):
            pos.pop(gone)
            neg.pop(gone)
    return [sorted(g) for g in group.values()]


def merge_dense(a: np.ndarray, b: np.ndarray, p: np.ndarray, c: np.ndarray, tau: float) -> list[list[int]]:
    """The same for a component with many of its possible edges, given as columns, in tables of all pairs of members: 20 bytes a pair, where
    dictionaries take hundreds for an edge."""
    ids = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    n = len(ids)
    place = np.searchsorted(ids, a) * n
    place += np.searchsorted(ids, b)
    if (place[1:] <= place[:-1]).any():
        order = np.argsort(place)
        place, p, c = place[order], p[order], c[order]
    pos, neg, turn = np.zeros((n, n)), np.zeros((n, n)), np.zeros((n, n), dtype=np.uint32)
    pos.reshape(-1)[place], neg.reshape(-1)[place] = np.maximum(p, 0), np.minimum(c, 0)
    place = place[p > 0]
    turn.reshape(-1)[place] = np.arange(len(place))
    clock, fresh = len(place), n
    for table in (pos, neg, turn):
        table += table.T  # only the part above the diagonal was filled
    del place
    group, number, live = {k: [int(x)] for k, x in enumerate(ids)}, np.arange(n), np.ones(n, dtype=bool)
    best, mate = np.zeros(n), np.full(n, -1)

    def look(rows: np.ndarray) -> None:
        """Each row's heaviest edge without a conflict, the earliest of equals."""
        for at in range(0, len(rows), 256):
            r = rows[at : at + 256]
            w = np.where(neg[r] >= tau, pos[r], 0)
            best[r] = w.max(axis=1)
            mate[r] = np.where(w == best[r][:, None], turn[r], np.iinfo(np.uint32).max).argmin(axis=1)
            mate[r[best[r] == 0]] = -1

    look(np.arange(n))
    while (w := best.max()) > 0:
        heavy = np.flatnonzero(best == w)
        x = int(heavy[turn[heavy, mate[heavy]].argmin()])
        gone = int(mate[x])
        group[x] += group.pop(gone)
        live[gone] = False
        w, c = pos[x] + pos[gone], np.minimum(neg[x], neg[gone])
        w[[x, gone]] = c[[x, gone]] = 0
        for table, row in ((pos, w), (neg, c)):
            table[x], table[:, x] = row, row
            table[gone], table[:, gone] = 0, 0
        number[x], fresh = fresh, fresh + 1
        near = np.flatnonzero(w > 0)
        near = near[np.argsort(number[near])]
        turn[x, near] = turn[near, x] = clock + np.arange(len(near))
        clock += len(near)
        now = np.where(c >= tau, w, 0)
        lost = live & ((mate == x) | (mate == gone)) & (now <= best)
        more = live & (now > best)
        best[more], mate[more] = now[more], x
        best[gone], mate[gone] = 0, -1
        lost[x] = True
        look(np.flatnonzero(lost))
    return [sorted(g) for g in group.values()]


def greedy_partition(scores: DataFrame, cands: DataFrame, tau: float = -0.2, theta_edge: float = 0.85) -> DataFrame:
    """(cand, partition): candidates by partition, named by its smallest candidate. Each component is merged in a task; a component's edges must
    fit there, so cap buckets for corpora whose graph has a giant one."""
    roots = candidate_components(scores, cands, theta_edge)
    x, y = roots.toDF("ci", "root"), roots.toDF("cj", "root_j")
    kept = scores.join(x, "ci").join(y, "cj").where("root = root_j").select("root", *EDGE, F.when((F.col("w_pos") >= theta_edge) & (F.col("w_pos") > 0), F.col("w_pos")).otherwise(0.0).alias("p"), "w_neg")

    def merged_parts(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate([piece.pop(0) for piece in held]) for _ in range(4)]  # a column at a time is there twice
        members = np.union1d(np.unique(columns[0]), np.unique(columns[1]))
        if 12 * len(columns[0]) > len(members) ** 2:
            parts = merge_dense(*columns, tau)
        else:
            parts = merge_component(list(zip(*(x.tolist() for x in columns))), members.tolist(), tau)
        cand = [m for part in parts for m in part]
        return pa.RecordBatch.from_arrays([pa.array(cand, pa.int64()), pa.array([part[0] for part in parts for _ in part], pa.int64())], ["cand", "partition"])

    def merge(batches):
        root, held = None, []
        for batch in batches:
            roots = batch.column(0).to_numpy()
            cuts = np.flatnonzero(roots[1:] != roots[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(roots)]):
                if lo == hi:
                    continue
                if held and roots[lo] != root:
                    yield merged_parts(held)
                    held = []
                root = roots[lo]
                held.append([batch.column(k).to_numpy()[lo:hi].copy() for k in range(1, 5)])
        if held:
            yield merged_parts(held)

    # a component's rows come in batches, so that a task holds them once
    merged = kept.repartition("root").sortWithinPartitions("root", *EDGE).mapInArrow(merge, "cand long, partition long")
    alone = cands.select("cand").distinct().join(merged, "cand", "left_anti").select("cand", F.col("cand").alias("partition"))
    return merged.union(alone)


def partition_pairs(pairs: DataFrame, cands: DataFrame, theta_overlap: int = 1, max_bucket: int = 0, matcher=None, tau: float = -0.2, theta_edge: float = 0.85) -> DataFrame:
    """(cand, partition) as greedy_partition has them for the scored overlap edges of `pairs`. Where no conflict inside a component is beyond tau, all of
    its positive edges are merged in the end, in whatever order, and the component is one part: that is told from twins, without the candidates'
    edges. Other components, and those where the direction decides whether two twins' candidates have a positive edge, are merged edge by edge."""
    same = _small(checkpointed(twins(pairs)))
    last = same.groupBy("twin").agg(F.max("cand").alias("last")).toDF("y", "last")
    # a direction is there if some candidate of x comes before one of y; x is its smallest
    ways = _twin_overlaps(pairs, same, theta_overlap, max_bucket).join(last, "y").where("x < last")
    scored = checkpointed(_twin_scores(pairs, same, checkpointed(ways.select(F.col("x").alias("ci"), F.col("y").alias("cj"))), matcher))
    positive = positive_edges(scored, theta_edge)
    tied = checkpointed(positive.select(F.explode(F.array("xi", "xj")).alias("twin")).distinct())
    roots = checkpointed(components(positive.select(F.col("xi").alias("a"), F.col("xj").alias("b")), tied.toDF("v")))
    kept = scored.join(roots.toDF("xi", "root"), "xi").join(roots.toDF("xj", "root_j"), "xj").where("root = root_j").select("root", "xi", "xj", "w_pos", "w_neg")
    is_pos = (F.col("w_pos") >= theta_edge) & (F.col("w_pos") > 0)
    both = kept.groupBy("root", F.least("xi", "xj").alias("x"), F.greatest("xi", "xj").alias("y")).agg(F.min("w_neg").alias("low"), F.bool_or(is_pos).alias("some"), F.bool_and(is_pos).alias("every"))
    hard = checkpointed(both.where((F.col("low") < tau) | (F.col("some") & ~F.col("every"))).select("root").distinct())
    # the candidates of a twin that has no positive edge, not even with itself, stay alone
    placed = checkpointed(same.join(roots.toDF("twin", "root"), "twin").select("cand", "twin", "root"))
    parts = placed.join(hard, "root", "left_anti").select("cand", F.col("root").alias("partition"))
    if hard.limit(1).count():
        rest = placed.join(hard, "root", "left_semi").select("cand", "twin")
        edges = rest.toDF("ci", "xi").join(kept.join(hard, "root", "left_semi").drop("root"), "xi").join(rest.toDF("cj", "xj"), "xj").where("ci < cj")
        parts = parts.union(greedy_partition(checkpointed(edges.select(*EDGE, "w_pos", "w_neg")), rest, tau, theta_edge))
    parts = checkpointed(parts)
    alone = cands.select("cand").distinct().join(parts, "cand", "left_anti").select("cand", F.col("cand").alias("partition"))
    return parts.union(alone)


def mappings(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(partition, candidates, pairs, size, num_source_tables) with sorted distinct pairs."""
    p = parts.join(pairs, "cand").groupBy("partition").agg(F.array_sort(F.collect_set(F.struct("l", "r"))).alias("pairs"))
    c = parts.groupBy("partition").agg(F.array_sort(F.collect_set("cand")).alias("candidates"))
    return c.join(p, "partition").select("partition", "candidates", "pairs", F.size("pairs").alias("size"), F.size("candidates").alias("num_source_tables"))


def top(maps: DataFrame, k: int = 5, sample: int = 3) -> DataFrame:
    """(rank, partition, size, num_source_tables, sample): the k largest mappings with their first pairs."""
    first = maps.orderBy(F.desc("size"), "partition").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("size"), "partition"))  # over k rows
    return first.select(rank.alias("rank"), "partition", "size", "num_source_tables", F.slice("pairs", 1, sample).alias("sample"))


def report(maps: DataFrame) -> DataFrame:
    return maps.agg(F.count("*").alias("mappings"), F.count_if(F.col("num_source_tables") == 1).alias("singletons"), F.min("size").alias("min_size"), F.avg("size").alias("mean_size"), F.max("size").alias("max_size"))
