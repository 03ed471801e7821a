"""Pairwise quality ranking (Bradley-Terry): a linear score of text features, learned from preferences.

Every labelled good document is preferred to every labelled bad one. The weights minimise the logistic loss on feature differences
of random pairs in which every labelled row takes part, with a quadratic penalty. The threshold is the quantile of the learning rows' scores below which the share of bad
rows lies; scores are mapped to (0, 1) by a logistic curve through that quantile, so that `cut` stands for the threshold.

Learning: all labelled rows, in blocks of about `block_rows` by a hash of the id; Newton's steps, the quantile and the curve take sums over
the blocks, and only those go to the driver. Features are computed once for all rows, from whole texts, and stored.

Results: null texts count as empty and get a score as well. With no labels, or labels of one kind, all scores are 0.5 and nothing is
predicted good. Labels that are null, of other values or of unknown ids are ignored; repeated labels count repeatedly. Equal texts get
equal scores. Extra columns other than the text pass through, and the new columns replace columns of the same name.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import free_name, map_slices, stored

COLUMNS = {"score": "double", "predicted": "int"}
_KIND = np.zeros(256, dtype=np.int64)  # classes of bytes
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"-()", b"!", b"|", b"*#$%&", b"<>={}[]_/\\+^~`@"), 1):
    for _c in _chars:
        _KIND[_c] = _k
_KIND[128:] = 10
_KINDS = 11


def features(text: str) -> list[float]:
    """Numbers that follow from the text alone."""
    raw = text.encode("utf-8", "replace")
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=_KINDS) / max(1, len(raw))
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    unique = len(set(words)) / n if n else 1.0
    expected = min(1.0, 2.2 / max(1.0, np.log(n + 1)) ** 0.5) if n else 1.0  # vocabularies grow slower than texts
    length = len(raw) / max(1, n)
    repeats = 1 - len(set(lines)) / len(lines) if lines else 0.0
    capital = kinds[1]
    symbols = kinds[7] + kinds[8] + kinds[9] + kinds[6]
    x = [*kinds.tolist(), np.log1p(n), unique, max(0.0, expected - unique), repeats, min(length, 30.0) / 10, n / max(1, len(lines)) / 100 if n < 1e6 else 100.0]
    x += [float(symbols > 0.02), float(capital > 0.1), float(unique < 0.45), float(repeats > 0.2), float(kinds[7] > 0.01), float(kinds[6] > 0.01), float(length > 7), float(n < 5), np.sqrt(symbols), np.sqrt(capital), unique * np.log1p(n)]
    return [float(v) for v in x]


WIDTH = len(features(""))


def with_features(docs: DataFrame, text: str, name: str) -> DataFrame:
    raw = free_name(docs, "text_in")
    kept = docs.columns

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features(t or "") for t in part.column(0).to_pylist()], dtype=np.float32).reshape(-1, WIDTH)
        blob = pa.array([row.tobytes() for row in found], pa.binary())
        return pa.RecordBatch.from_arrays([*part.columns[1:], blob], [*kept, name])

    frame = docs.select(F.col(text).cast("string").alias(raw), *[F.col(f"`{c}`") for c in kept])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` binary"
    return map_slices(frame, 0, ddl, work)


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int, ridge: float, seed: int) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w(x_good - x_bad))) + ridge |w|^2 over random pairs, by Newton steps."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        s = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (s * (1 - s))[:, None]).T @ d / pairs + 2 * ridge * np.eye(len(w)), d.T @ s / pairs - 2 * ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(x: np.ndarray, y: np.ndarray, cut: float, pairs: int = 60_000, ridge: float = 1e-3, seed: int = 7):
    """Mean, scale, weights, slope and offset of the scores; None if one kind is missing."""
    if not (0 < y.sum() < len(y)):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    w = bradley_terry(z[y == 1], z[y == 0], pairs, ridge, seed)
    raw = z @ w
    threshold = np.quantile(raw, 1 - y.mean())
    slope, at = 1.0, np.log(cut / (1 - cut))
    for _ in range(30):  # the slope that fits the labels best
        s = 1 / (1 + np.exp(-np.clip(slope * (raw - threshold) + at, -30, 30)))
        g, h = ((y - s) * (raw - threshold)).sum(), (s * (1 - s) * (raw - threshold) ** 2).sum()
        slope = float(np.clip(slope + g / (h + 1e-6), 0.05, 20))
    return mean, scale, w, slope, at - slope * threshold


def _paired(good: np.ndarray, bad: np.ndarray, turns: int, seed: int) -> np.ndarray:
    """Feature differences of good and bad rows; every row takes part, `turns` times at least and with another partner where there is one."""
    rng = np.random.default_rng(seed)
    good, bad = good[rng.permutation(len(good))], bad[rng.permutation(len(bad))]
    most = max(len(good), len(bad))
    i = np.arange(most * turns)
    shift = i // most
    return good[(i + shift * (len(good) < len(bad))) % len(good)] - bad[(i + shift * (len(good) >= len(bad))) % len(bad)]


def _summed(packed: DataFrame, alone, work) -> np.ndarray:
    """The sum of work(good, bad) over all blocks; `alone` is the block if there is only one."""
    if alone is not None:
        return work(*alone)

    def run(batches):
        total = None
        for batch in batches:
            for g, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = work(_unpacked(g), _unpacked(b))
                total = out if total is None else total + out
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["s"])

    return sum(np.frombuffer(r["s"]) for r in packed.mapInArrow(run, "s binary").collect())  # a vector a task


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)


def learn_all(rows: DataFrame, cut: float, block_rows: int, turns: int = 4, ridge: float = 1e-3, seed: int = 7):
    """As `learn`, from all rows (d_id, l_y, x), in blocks by a hash of the id; sums alone go to the driver. The pairs are those that rows of
    a block make. None if one kind is missing."""
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("l_y"), F.lit(0))).first()
    if not 0 < good < n:
        return None
    blocks = max(1, min(n // block_rows, min(good, n - good) // 50))  # each block has rows of both kinds

    def pack(table: pa.Table) -> pa.Table:
        y, x = table.column("l_y").to_pylist(), table.column("x").to_pylist()
        both = [b"".join(sorted(v for v, k in zip(x, y) if k == kind)) for kind in (1, 0)]
        return pa.table({"good": pa.array([both[0]], pa.binary()), "bad": pa.array([both[1]], pa.binary())})

    packed = stored(rows.select(F.pmod(F.xxhash64(F.lit(5), "d_id"), F.lit(blocks)).alias("block"), "l_y", "x").groupBy("block").applyInArrow(pack, "good binary, bad binary"))
    alone = tuple(map(_unpacked, packed.first())) if blocks == 1 else None
    over = lambda work: _summed(packed, alone, work)

    mean = over(lambda g, b: g.sum(axis=0) + b.sum(axis=0)) / n
    scale = np.sqrt(over(lambda g, b: ((g - mean) ** 2).sum(axis=0) + ((b - mean) ** 2).sum(axis=0)) / n) + 1e-6
    z = lambda x: np.clip((x - mean) / scale, -8, 8)
    w = np.zeros(WIDTH)
    for _ in range(25):

        def slopes(g, b, w=w):
            if not (len(g) and len(b)):
                return np.zeros(1 + WIDTH + WIDTH * WIDTH)
            d = _paired(z(g), z(b), turns, seed)
            s = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            return np.concatenate([[len(d)], d.T @ s, ((d * (s * (1 - s))[:, None]).T @ d).ravel()])

        found = over(slopes)
        step = np.linalg.solve(found[1 + WIDTH :].reshape(WIDTH, WIDTH) / found[0] + 2 * ridge * np.eye(WIDTH), found[1 : 1 + WIDTH] / found[0] - 2 * ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    ends = 8 * np.abs(w).sum() + 1e-9

    def placed(k: int) -> float:
        """The k-th score from below, by histograms of the bin it lies in."""
        low, high = -ends, ends
        for _ in range(3):
            edges = np.linspace(low, high, 4097)
            counts = over(lambda g, b: np.histogram(np.concatenate([z(g) @ w, z(b) @ w]), edges)[0].astype(float))  # noqa: B023
            i = min(int(np.searchsorted(np.cumsum(counts), k, side="right")), 4095)
            k -= counts[:i].sum()
            low, high = edges[i], edges[i + 1]
        return (low + high) / 2

    where = (1 - good / n) * (n - 1)  # as numpy's quantile: between two scores in proportion
    under, beyond = placed(int(where)), placed(min(int(where) + 1, n - 1))
    threshold = under + (where - int(where)) * (beyond - under)
    slope, at = 1.0, np.log(cut / (1 - cut))
    for _ in range(30):  # the slope that fits the labels best

        def bend(g, b, slope=slope):
            raw = [z(x) @ w - threshold for x in (g, b)]
            s = [1 / (1 + np.exp(-np.clip(slope * r + at, -30, 30))) for r in raw]
            return np.array([((1 - s[0]) * raw[0]).sum() - (s[1] * raw[1]).sum(), sum((p * (1 - p) * r**2).sum() for p, r in zip(s, raw))])

        g, h = over(bend)
        slope, before = float(np.clip(slope + g / (h + 1e-6), 0.05, 20)), slope
        if abs(slope - before) < 1e-6:
            break
    return mean, scale, w, slope, at - slope * threshold


def rank(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "quality", usable=None, cut: float = 0.7, block_rows: int = 20_000) -> DataFrame:
    """All columns of `docs` but the text, which is not stored, and score, predicted (1 if score >= cut). usable: rows of `docs` whose labels
    may be learned."""
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in COLUMNS])
    name, flag = free_name(base, "features"), free_name(base, "usable")
    slim = base.withColumn(flag, F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)))
    full = stored(with_features(slim, text, name).drop(text))  # the text is joined to nothing, so it is not stored
    said = labels.where(F.col(label).isin(0, 1) & F.col(row_id).isNotNull()).select(F.col(row_id).alias("l_id"), F.col(label).cast("int").alias("l_y"))
    rows = full.where(F.col(flag)).select(F.col(row_id).alias("d_id"), F.col(name).alias("x")).join(said, F.col("d_id") == F.col("l_id"))
    rows = stored(rows.select("d_id", "l_y", "x"))
    model = learn_all(rows, cut, block_rows)
    kept = [c for c in full.columns if c not in (name, flag)]
    at, where = full.columns.index(name), [full.columns.index(c) for c in kept]

    def scored(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(at).to_pylist()), dtype=np.float32).reshape(-1, WIDTH).astype(np.float64)
            if model is None:
                s = np.full(len(x), 0.5)
            else:
                mean, scale, w, slope, offset = model
                s = 1 / (1 + np.exp(-np.clip(slope * (np.clip((x - mean) / scale, -8, 8) * w).sum(axis=1) + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in where), pa.array(s), pa.array((s >= cut if model is not None else np.zeros(len(s))).astype(np.int32))], [*kept, *COLUMNS])

    ddl = ", ".join([*(f"`{c}` {dict(full.dtypes)[c]}" for c in kept), *(f"{c} {t}" for c, t in COLUMNS.items())])
    return full.mapInArrow(scored, ddl)
