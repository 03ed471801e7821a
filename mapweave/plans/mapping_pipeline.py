"""From a corpus of tables to resolved mappings."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from mapweave.functions.jaro import jaro_winkler_match
from mapweave.operators import baselines as B
from mapweave.operators import candidates as C
from mapweave.operators import coherence as H
from mapweave.operators import resolution as R
from mapweave.operators import synonyms as Y
from mapweave.operators import synthesis as S
from mapweave.operators.graph import checkpointed
from mapweave.sources import artefacts as A
from mapweave.sources import corpus as L


@dataclass(frozen=True)
class Config:
    coherence: float = 0.3
    theta: float = 0.95
    min_rows: int = 3
    skip_noise: bool = True
    theta_overlap: int = 3
    theta_edge: float = 0.85
    tau: float = -0.2
    max_bucket: int = 0
    pair_cap: int = 0
    matcher: str = "exact"  # exact, edit, jaccard, jw
    noise_filter: bool = True
    table_types: tuple[str, ...] = ("RELATION",)
    index_path: str | None = None  # where the co-occurrence index is kept; below the output by default
    rebuild_index: bool = False
    save_index: bool = True


MATCHERS = {"exact": None, "edit": S.edit_matcher, "jaccard": S.jaccard_matcher, "jw": jaro_winkler_match}


def kept_cells(cells: DataFrame, config: Config = Config()) -> DataFrame:
    kept = H.keep_columns(H.coherence(cells, config.skip_noise), config.coherence)
    return cells.join(kept.select("table_idx", "col_idx"), ["table_idx", "col_idx"], "left_semi")


def find_candidates(cells: DataFrame, config: Config = Config()) -> DataFrame:
    return _candidates(kept_cells(cells, config), config)


def _candidates(kept: DataFrame, config: Config) -> DataFrame:
    found = C.candidates(kept, config.theta, config.min_rows)
    return C.drop_noise(found) if config.noise_filter else found


def synthesise(cands: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(partitions, mappings)."""
    pairs = C.explode_pairs(cands)
    parts = S.greedy_partition(scores(pairs, config), cands, config.tau, config.theta_edge)
    return parts, S.mappings(parts, pairs)


def scores(pairs: DataFrame, config: Config = Config()) -> DataFrame:
    edges = S.overlap_edges(pairs, config.theta_overlap, config.max_bucket)
    return S.edge_scores(pairs, edges, MATCHERS[config.matcher], config.pair_cap)


def index(spark: SparkSession, cells: DataFrame, out: str, config: Config) -> tuple[DataFrame, DataFrame]:
    """Value and pair counts, read from where they are kept, or counted (and kept there, if wanted)."""
    path = config.index_path or f"{out}/cooccurrence_index"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{'skipnoise' if config.skip_noise else 'full'}/pairs/_SUCCESS")
    if not config.rebuild_index and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return L.read_index(spark, path, config.skip_noise)
    columns = H.column_values(cells, config.skip_noise)
    counts, pairs = H.value_counts(columns), H.cooccurrence(columns)
    if not config.save_index:
        return checkpointed(counts), checkpointed(pairs)
    L.write_index(counts, pairs, path, config.skip_noise)
    return L.read_index(spark, path, config.skip_noise)


def resolve_saved(spark: SparkSession, out: str, name: str = "resolved_mappings") -> DataFrame:
    """Resolve the conflicts of mappings that an earlier run saved, save the result and return it; nothing else is computed again."""
    before = R.exploded(A.load(spark, out, "synthesized_mappings"))
    A.save(R.nested(R.resolve(before), before), out, name)
    return A.load(spark, out, name)


def vote_saved(spark: SparkSession, out: str) -> DataFrame:
    """The same by majority vote, with the saved partitions and candidates."""
    before, pairs = R.exploded(A.load(spark, out, "synthesized_mappings")), C.explode_pairs(A.load(spark, out, "candidates"))
    voted = R.majority(before, R.pair_support(A.load(spark, out, "partitions"), pairs))
    A.save(R.nested(voted.drop("support"), before), out, "majority_mappings")
    return A.load(spark, out, "majority_mappings")


def score_saved(spark: SparkSession, out: str) -> DataFrame:
    """The confidence of each pair of the saved mappings."""
    maps, cands = A.load(spark, out, "synthesized_mappings"), A.load(spark, out, "candidates")
    scored = R.confidence(R.exploded(maps), A.load(spark, out, "partitions"), cands, C.explode_pairs(cands), R.exploded(A.load(spark, out, "resolved_mappings")))
    A.save(R.scored_mappings(checkpointed(scored)), out, "scored_mappings")
    return A.load(spark, out, "scored_mappings")


def save_baselines(spark: SparkSession, path: str, out: str, threshold: float = 0.3) -> DataFrame:
    """The three baselines over a corpus of JSON lines as it is."""
    rows = checkpointed(B.first_columns(L.load_raw_jsonl(spark, path)))
    A.save(B.union_domain(rows).unionByName(B.union_web(rows)).unionByName(B.schema_cc(rows, threshold)), out, "baselines")
    return A.load(spark, out, "baselines")


def save_synonyms(spark: SparkSession, out: str, extra: DataFrame | None = None) -> DataFrame:
    A.save(Y.synonyms(Y.pairs(spark, extra)), out, "synonyms")
    return A.load(spark, out, "synonyms")


def run(spark: SparkSession, path: str, out: str, config: Config = Config()) -> DataFrame:
    """Read a corpus, write the filtered corpus, candidates, edges, partitions, mappings and resolved mappings below `out`, and return
    the latter. Stages are written and read again, so that a lost executor repeats one stage at most."""
    tables = checkpointed(L.load_corpus(spark, path, config.table_types))
    cells = L.to_cells(tables)
    scored = checkpointed(H.coherence(cells, config.skip_noise, index(spark, cells, out, config)))
    A.save(A.filtered_corpus(scored, cells, tables, config.coherence), out, "filtered_corpus")
    kept = cells.join(H.keep_columns(scored, config.coherence).select("table_idx", "col_idx"), ["table_idx", "col_idx"], "left_semi")
    A.save(_candidates(kept, config), out, "candidates")
    cands = A.load(spark, out, "candidates")
    pairs = C.explode_pairs(cands)
    A.save(scores(pairs, config), out, "edges")
    A.save(S.greedy_partition(A.load(spark, out, "edges"), cands, config.tau, config.theta_edge), out, "partitions")
    A.save(S.mappings(A.load(spark, out, "partitions"), pairs), out, "synthesized_mappings")
    return resolve_saved(spark, out)
