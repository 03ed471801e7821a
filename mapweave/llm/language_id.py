"""Multilingual mixture inference: the languages of a document and their shares.

Each language has a distribution of letter trigrams (hashed), counted over labelled documents. A text is cut into runs of
`segment` trigrams; expectation-maximisation estimates the shares with which the languages produce the runs. The set of
languages grows from the single best one by the language that raises the log-likelihood most, as long as it rises by more than a
penalty for each further language (a BIC term times `penalty`).

Learning: at most `train_rows` labelled rows for each language, chosen by a hash of the row's id; all text of those rows is counted, on
the executors. Everything else sees whole texts.

Results: texts that are null or have no letter get the language `und`, score 0 and no shares; so do all texts if nothing is labelled, for then there
is no language to predict. A text of up to `segment` letters is one run and has one language. Ties
go to the language first in order. Equal texts get equal results; repeated rows are independent. Extra columns pass through, and the
new columns replace columns of the same name.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import free_name, map_slices, relax, slices, small_batches, text_first

UNDETERMINED = "und"
COLUMNS = {"lang_pred": "string", "score": "double", "shares": "array<struct<lang:string,share:double>>"}
BUCKETS = 1 << 16
_BLOCK = 1 << 19
_tables: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For each code point the code of its small letter, or 0 for what is no letter."""
    if not _tables:
        out = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _tables.append(out)
    return _tables[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around each letter, and the number of letters of each text."""
    code = _folded()[np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    at = np.flatnonzero(code)
    h = (code[at - 1] * np.uint32(0x9E3779B1)) ^ (code[at] * np.uint32(0x85EBCA6B)) ^ (code[at + 1] * np.uint32(0xC2B2AE35))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.searchsorted(at, ends)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16), np.diff(cuts, prepend=0)


def learn(docs: DataFrame, text: str, lang: str, row_id: str, usable, train_rows: int = 3000) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities [bucket, language] with add-0.5 smoothing."""
    labelled = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"), F.col(row_id).alias("i"))
    count = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(count)
    if not langs:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    share = F.create_map(*[x for v in langs for x in (F.lit(v), F.lit(min(1.0, train_rows / count[v])))])
    unit = F.pmod(F.xxhash64(F.lit(3), F.col("i")), F.lit(1 << 20)) / float(1 << 20)
    number = {v: k for k, v in enumerate(langs)}

    def counted(batches):
        relax()  # what earlier stages left
        total = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                texts = part.column(0).to_pylist()
                h, n = grams(texts)
                who = np.repeat(np.array([number[x] for x in part.column(1).to_pylist()]), n)
                total += np.bincount(who * BUCKETS + h, minlength=total.size).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(langs)), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], ["l", "counts"])

    chosen = labelled.where(unit < share[F.col("l")]).select("t", "l").coalesce(16)
    seen = np.zeros((len(langs), BUCKETS))
    with small_batches(docs.sparkSession):
        for row in chosen.mapInArrow(counted, "l int, counts binary").toLocalIterator():
            seen[row["l"]] += np.frombuffer(row["counts"], dtype=np.int64)
    return langs, np.log((seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32).copy()


def segments(h: np.ndarray, n: np.ndarray, table: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods [run, language], and the number of runs of each text."""
    runs = -(-n // segment)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n
    inner = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(first, runs) + inner * segment
    out = np.empty((len(starts), table.shape[1]), dtype=np.float64)
    step = max(1, _BLOCK // segment)
    for i in range(0, len(starts), step):
        a, b = starts[i], starts[i + step] if i + step < len(starts) else len(h)
        out[i : i + step] = np.add.reduceat(table[h[a:b]], starts[i : i + step] - a, axis=0, dtype=np.float64)
    return out, runs


def em(p: np.ndarray, owner: np.ndarray, n: np.ndarray, sets: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Shares [text, language] and log-likelihoods of texts, for runs' scaled likelihoods `p` and allowed languages `sets`."""
    theta = sets / sets.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        w = p * theta[owner] + 1e-300
        w /= w.sum(axis=1, keepdims=True)
        theta = np.stack([np.bincount(owner, w[:, k], len(n)) for k in range(p.shape[1])], axis=1) * sets / n[:, None]
    return theta, np.bincount(owner, np.log((p * theta[owner]).sum(axis=1) + 1e-300), len(n))


def mixtures(ll: np.ndarray, runs: np.ndarray, segment: int, penalty: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shares [text, language] and confidence of texts with at least one run each."""
    owner = np.repeat(np.arange(len(runs)), runs)
    top = ll.max(axis=1)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    single, best = np.add.reduceat(ll, first, axis=0), np.add.reduceat(top, first)
    lead = single.argmax(axis=1)
    theta = np.zeros((len(runs), ll.shape[1]))
    theta[np.arange(len(runs)), lead] = 1
    now = single[np.arange(len(runs)), lead]
    sure = 1 / np.exp(single - now[:, None]).sum(axis=1)
    cost = penalty * np.log(np.maximum(runs * segment, 2))
    open_ = np.flatnonzero(best - now > cost)
    for _ in range(min(most or ll.shape[1], ll.shape[1]) - 1):
        if not len(open_):
            break
        pick = np.isin(owner, open_)
        p = np.exp(ll[pick] - top[pick][:, None])
        new = np.searchsorted(open_, owner[pick])
        base = np.bincount(new, top[pick], len(open_))
        gain, chosen = np.full(len(open_), -np.inf), theta[open_].copy()
        for k in range(ll.shape[1]):
            sets = (theta[open_] > 0).astype(float)
            fresh = sets[:, k] == 0
            sets[:, k] = 1
            t, v = em(p, new, runs[open_].astype(float), sets)
            better = fresh & (v + base > gain)
            gain[better], chosen[better] = (v + base)[better], t[better]
        kept = gain - now[open_] > cost[open_]
        open_, gain, chosen = open_[kept], gain[kept], chosen[kept]
        theta[open_], now[open_], sure[open_] = chosen, gain, 1.0
    return theta, sure


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id", usable=None, train_rows: int = 3000, segment: int = 48, penalty: float = 2.0, most: int | None = None) -> DataFrame:
    """All columns of `docs` and lang_pred (language of the largest share), score (that share times the confidence in a single
    language), shares (all languages of the set, largest first). usable: rows with which the languages may be learned. most: languages of a
    document at most; by default only the penalty bounds them."""
    langs, table = learn(docs, text, lang, row_id, F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)), train_rows)
    kept = [c for c in docs.columns if c.lower() not in COLUMNS]
    raw = free_name(docs, "text_in")
    sent = docs.sparkSession.sparkContext.broadcast(table)
    share = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in part.column(0).to_pylist()]
        pred, score, all_ = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        h, n = grams(texts)
        some = np.flatnonzero(n) if langs else []
        if len(some):
            ll, runs = segments(h, n[some], sent.value, segment)
            theta, sure = mixtures(ll, runs, segment, penalty, most)
            lead = theta.argmax(axis=1)
            for i, k, t, s in zip(some.tolist(), lead.tolist(), theta, sure.tolist()):
                pred[i], score[i] = langs[k], min(1.0, float(t[k]) * s)
                all_[i] = [{"lang": langs[j], "share": float(t[j])} for j in np.argsort(-t, kind="stable") if t[j] > 0]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.array(pred), pa.array(score), pa.array(all_, share)], [*kept, *COLUMNS])

    frame, places = text_first(docs, text, kept, raw)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema), *(f"{c} {t}" for c, t in COLUMNS.items())])
    return map_slices(frame, 0, ddl, work)


def accepted(lang_pred, score, min_score: float = 0.0):
    """Documents in a language that could be told, with at least `min_score`."""
    return (lang_pred != UNDETERMINED) & (score >= min_score)
