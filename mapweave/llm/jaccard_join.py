"""N-gram Jaccard join: near-duplicate groups of documents by a prefix-tree join.

A document's set holds its distinct shingles of `width` consecutive words (A-Z in lower case), as 64-bit hashes; a shorter document is one
shingle, and one without words has none. Two documents link when 100 * |A & B| >= percent * |A | B|.

Shingles are in one global order: the rare ones first (by hash), then the common ones by frequency, then those with large hashes, which are not counted. Two sets that link share a shingle among
the first |A| - ceil(percent * |A| / 100) + 1 of each, and k of them where the prefixes are k - 1 longer. So (1) equal texts count as one, (2)
prefixes, longer by a twentieth of the set where rare shingles fill them, are brought together by shingle, and documents of fitting sizes that share enough of them form candidate
groups, found as components of a graph: a shingle of up to `PAIRED` texts counts for each pair of them, and pairs with fewer than k get no edge (chance
brings single shingles together, ever more as the corpus grows); one of more texts gives a chain of edges, never all pairs; (3) a group's sets go to one task, once, where they are stored in a
trie in the global order, read from its other end: the frequent shingles lie at the top, where sets share them. Each set walks the trie, shares the
overlap with all sets below a node, and leaves subtrees that cannot reach the needed overlap by the remaining lengths or sizes.

A group of more than `block_sets` sets or `group_shingles` shingles is dealt into blocks by a hash. (a) Each block is joined by itself. (b) The `PIVOTS`
sets of the group from which most links were seen visit all blocks, which ties together what belongs to large clusters. (c) Of sets in different
components then, one at least lies outside the group's largest; such sets visit just the other blocks that hold a shingle of their prefix. So
no pair of blocks is joined for its own sake, a block is one task's work, visitors pass through it one at a time, and no link is lost.

Frequencies cover all documents; they only choose the order, so all common shingles are kept as levels in a table of one byte a slot, which grows
with the corpus up to 64 MB (beyond, slots are shared and rare shingles may pass for common ones). Hashes of 64 bits stand for words and shingles and of 128 bits for texts, of 64 bits for texts of divided groups. A filter of 16 bits for each text of a candidate group, 32 MB at most,
keeps other texts' sets from being shuffled; when it is full, more sets are shuffled than need be.

Results: component_id is the smallest id reachable by links. Texts that are null, empty or white space have no shingles, link with nothing and
keep their own id. Rows with a null id take part, but are never a component's id unless all its ids are null. Repeated rows are copies. Extra
columns are not carried along (join by id).
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import map_slices, relax, slices, small_batches, stored
from mapweave.llm.components import components, forest

#: Texts that share a prefix shingle and are counted as pairs; more are chained. A set shares one more shingle for each `SHARE` that it has.
PAIRED, SHARE = 8, 20
#: Marks of a size, below 2 ** 30: its shingle was chained before; its prefix is a longer one. What an edge of a chain counts.
_CHAINED, _LONGER, _SIZE, _ENOUGH = np.uint32(1 << 31), np.uint32(1 << 30), np.uint32((1 << 30) - 1), 1 << 20
#: The number of texts beyond which a shingle is common, and levels of frequency for each doubling.
COMMON, LEVELS = 2, 12
#: The table of levels has a slot for SLOT_SHINGLES shingles of all documents, 2 ** SLOT_BITS slots at most.
SLOT_SHINGLES, SLOT_BITS = 16, 26
#: Texts in candidate groups whose groups' names are sent to all executors (16 bytes each); beyond, the join is left to a shuffle.
BROADCAST_TEXTS = 500_000
#: Shingles of a task's buffer, for a bucket, and of a candidate group or block that one task joins.
BUFFER, BUCKET, GROUP = 400_000, 700_000, 2_000_000
#: Sets of a candidate group or block that one task joins, and sets of a divided group that visit all its blocks.
BLOCK_SETS, PIVOTS = 1000, 16
#: The largest filter that keeps documents outside all candidate groups from being shuffled has 2 ** FILTER_BITS bits.
FILTER_BITS = 28
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
#: Bytes hashed at once; a longer word is hashed whole.
_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P, _P_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte (A-Z as a-z), and n powers of an odd number and of its inverse."""
    if len(_tables.get("up", ())) < n:
        codes = np.random.default_rng(1234).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        codes[65:91] = codes[97:123]
        _tables["codes"] = codes
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            out = np.full(n, base, dtype=np.uint64)
            out[0] = 1
            _tables[name] = np.multiply.accumulate(out)
    return _tables["codes"], _tables["up"], _tables["down"]


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and the hashes of the words of some bytes that begin and end with white space."""
    codes, up, down = _powers(max(len(raw), _BYTES + 1))
    gap = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    total = np.cumsum(codes[raw] * up[: len(raw)])
    h = (total[end - 1] - total[start - 1]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return start, h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash for each word of each text."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw) - 1:
        stop = min(len(raw), at + _BYTES)
        if stop < len(raw):
            gaps = np.flatnonzero(_SPACE[raw[at + 1 : stop]])
            if len(gaps):
                stop = at + 2 + int(gaps[-1])
            else:  # a long word
                while stop < len(raw) and not _SPACE[raw[stop - 1]]:
                    more = np.flatnonzero(_SPACE[raw[stop : stop + _BYTES]])
                    stop = stop + 1 + int(more[0]) if len(more) else min(len(raw), stop + _BYTES)
        s, h = _hashed(raw[at:stop])
        starts.append(s + at)
        hashes.append(h)
        at = stop - 1
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    cuts = np.searchsorted(np.concatenate(starts) if starts else [], np.cumsum([len(t) + 1 for t in texts])[:-1]) if texts else []
    return np.split(hashes, cuts) if texts else []


def key_of(words: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a sequence of words, as two signed numbers."""
    d = xxhash.xxh3_128_digest(words.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a sequence of words' hashes."""
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    k = min(width, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out += h[i : i + n] * (_FACTORS[i % len(_FACTORS)] + np.uint64(2 * (i // len(_FACTORS))))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def least_shared(n):
    """How many shingles of prefixes longer by as many less one a set of n shares with any that it links with (of two sets, the smaller number)."""
    return 1 + n // SHARE


def longer(percent: int) -> float:
    """How many times a prefix a longer one is, about."""
    return 1 + 100 / (SHARE * (101 - percent))


def counted_below(percent: int) -> np.uint64:
    """The hash below which frequencies are counted: half as many again as a longer prefix of a set, about, have a smaller one."""
    return np.uint64(int(min(1.0, 1.5 * longer(percent) * (101 - percent) / 100) * ((1 << 64) - 1025)))


def _words(part: pa.RecordBatch) -> list[np.ndarray]:
    return word_hashes([t or b"" for t in part.column(0).to_pylist()])


def _texts(docs: DataFrame, text: str, *cols) -> DataFrame:
    return docs.select(F.col(text).cast("string").cast("binary").alias("t"), *cols)


def _bucketed(tokens: np.ndarray, bits: int) -> list[slice]:
    """Runs of sorted tokens by their leading bits."""
    cuts = np.searchsorted(tokens, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, dtype=np.int64)
    return [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(tokens)])]


def _buffered(batches, width, percent, slack, work, seen_most=500_000):
    """Calls work(sets, keys, sizes) with prefixes (in order of hash, `slack` times as long) of new texts, BUFFER shingles at a time."""
    seen: set[tuple[int, int]] = set()
    sets, keys, n = [], [], 0
    for batch in batches:
        for part in slices(batch, 0):
            for words in _words(part):
                if not len(words) or (k := key_of(words)) in seen:
                    continue
                if len(seen) >= seen_most:
                    seen.clear()
                seen.add(k)
                s = shingles(words, width)
                sets.append(s)
                keys.append(k[0])
                n += min(len(s), int(slack * prefix(len(s), percent)) + 1)
                if n >= BUFFER:
                    yield from work(sets, keys)
                    sets, keys, n = [], [], 0
    if sets:
        yield from work(sets, keys)
    del sets, keys, seen
    relax()


def _slot_bits(total: int, bits: int) -> int:
    """The table of levels has 2 ** this slots, for `total` shingles in 2 ** bits buckets."""
    return min(SLOT_BITS, max(16, bits, int(np.ceil(np.log2(max(1, total / SLOT_SHINGLES))))))


def _common(docs: DataFrame, text: str, width: int, percent: int, bits: int, slot_bits: int) -> np.ndarray:
    """Levels of frequency by a shingle's leading bits, 0 for rare ones: the higher, the further back in the order. They are counted over
    the shingles with small hashes of all documents; a slot has the level of its most frequent shingle."""
    own_bits = slot_bits - bits

    def counted(batches):
        def work(sets, _):
            tokens, n = np.unique(np.concatenate([s[: np.searchsorted(s, counted_below(percent))] for s in sets]), return_counts=True)
            short = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            for b, part in enumerate(_bucketed(tokens, bits)):
                if part.stop > part.start:
                    more = np.flatnonzero(n[part] > 1)
                    extra = np.stack([more, n[part][more] - 1]).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([short[part].tobytes()], pa.binary()), pa.array([extra.tobytes()], pa.binary())], ["bucket", "tokens", "extra"])

        yield from _buffered(batches, width, percent, 1.5 * longer(percent), work)

    def summed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        tokens, weights = [], []
        for t, e in zip(rows.column("tokens").to_pylist(), rows.column("extra").to_pylist()):
            tokens.append(np.frombuffer(t, dtype=np.uint32))
            w = np.ones(len(tokens[-1]), dtype=np.int64)
            where, more = np.frombuffer(e, dtype=np.uint32).reshape(2, -1)
            w[where] += more
            weights.append(w)
        tokens, weights = np.concatenate(tokens), np.concatenate(weights)
        order = np.argsort(tokens, kind="stable")
        tokens, weights = tokens[order], weights[order]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        total = np.add.reduceat(weights, first)
        keep = total > COMMON
        found, level = tokens[first][keep] >> np.uint32(32 - own_bits), np.minimum(255, 1 + LEVELS * np.log2(total[keep] / COMMON))
        table = np.zeros(1 << own_bits, dtype=np.uint8)
        np.maximum.at(table, found, level.astype(np.uint8))
        del tokens, weights, order
        relax()
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([table.tobytes()], pa.binary())})

    found = _texts(docs, text).mapInArrow(counted, "bucket int, tokens binary, extra binary").groupBy("bucket").applyInArrow(summed, "bucket int, levels binary")
    table = np.zeros((1 << bits, 1 << own_bits), dtype=np.uint8)
    rows = found.toArrow()  # a byte for each slot
    for b, levels in zip(rows.column("bucket").to_pylist(), rows.column("levels")):
        table[b] = np.frombuffer(levels.as_buffer(), dtype=np.uint8)
    return table.reshape(-1)


def _back(s: np.ndarray, sent) -> np.ndarray:
    """How far back the shingles come in the global order: 0 for the rare ones."""
    levels = sent.value
    return levels[s >> np.uint64(65 - len(levels).bit_length())]


def _head(s: np.ndarray, percent: int, sent, shared: int = 1) -> np.ndarray:
    """The prefix of a sorted set in the global order; where rare shingles are enough, one that holds `shared` shingles of each set that it links with."""
    p, back = prefix(len(s), percent), _back(s, sent).astype(np.int16)
    back[np.searchsorted(s, counted_below(percent)) :] = 256
    rare = s[back == 0]
    if len(rare) >= p + shared - 1:
        return rare[: p + shared - 1]
    if len(rare) >= p:
        return rare[:p]
    usual = back > 0
    return np.concatenate([rare, s[usual][np.argsort(back[usual], kind="stable")][: p - len(rare)]])


def _candidates(docs: DataFrame, text: str, width: int, percent: int, bits: int, sent) -> DataFrame:
    """Edges (a, b) between keys of texts that share enough prefix shingles, or one of many texts; these as chains in order of size."""

    def listed(batches):
        from pyspark import TaskContext

        turn = itertools.count(TaskContext.get().partitionId() * 7)

        def work(sets, keys):
            heads = [_head(s, percent, sent, least_shared(len(s))) for s in sets]
            n = [len(x) for x in heads]
            tokens = np.concatenate(heads)
            full = [len(s) | (int(_LONGER) if len(h) > prefix(len(s), percent) else 0) for s, h in zip(sets, heads)]
            key, size = np.repeat(np.array(keys, dtype=np.int64), n), np.repeat(np.array(full, dtype=np.uint32), n)
            tokens, key, size = in_order(tokens, key, size)
            keep = np.repeat(*runs(tokens)) <= PAIRED
            many = np.flatnonzero(~keep)
            edges, keep[many] = chained(tokens[many], key[many], size[many])
            size[many] |= _CHAINED
            tokens, key, size = tokens[keep], key[keep], size[keep]
            if edges.shape[1]:  # they need no certain bucket
                yield row(next(turn) % (1 << bits), b"", edges[0].tobytes(), edges[1].tobytes())
            for b, part in enumerate(_bucketed(tokens, bits)):
                if part.stop > part.start:
                    yield row(b, tokens[part].tobytes(), key[part].tobytes(), size[part].tobytes())

        yield from _buffered(batches, width, percent, longer(percent), work)

    def row(b, t, k, s):
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in (t, k, s))], ["bucket", "tokens", "keys", "sizes"])

    def runs(tokens):
        """The length of each run of equal numbers, twice: to be repeated by itself."""
        n = np.diff(np.r_[np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]), len(tokens)]) if len(tokens) else np.zeros(0, dtype=np.int64)
        return n, n

    def in_order(tokens, key, size):
        """By shingle and size, each text once; of equal rows one that was chained stays."""
        order = np.lexsort((~size, key, size & _SIZE, tokens))
        tokens, key, size = tokens[order], key[order], size[order]
        once = np.ones(len(tokens), dtype=bool)
        once[1:] = (tokens[1:] != tokens[:-1]) | (key[1:] != key[:-1])
        return tokens[once], key[once], size[once]

    def paired(tokens, key, size):
        """Each pair of texts of fitting sizes: a, b, how many shingles they share here, and how many they must share in all."""
        found = [np.zeros((3, 0), dtype=np.int64)]
        need, size = np.where(size & _LONGER, least_shared(size & _SIZE), 1).astype(np.int64), (size & _SIZE).astype(np.int64)
        for d in range(1, PAIRED):
            i = np.flatnonzero((tokens[d:] == tokens[:-d]) & (100 * size[:-d] >= percent * size[d:]))
            found.append(np.stack([np.minimum(key[i], key[i + d]), np.maximum(key[i], key[i + d]), np.minimum(need[i], need[i + d])]))
        a, b, need = np.concatenate(found, axis=1)
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        return a[first], b[first], np.diff(np.r_[first, len(a)]), need[first]

    def chained(tokens, key, size):
        """Edges between neighbours in (token, size), and which entries others still need: of a long chain every entry may go without which
        its neighbours still fit each other, for what fits between them fits one of them."""
        size = (size & _SIZE).astype(np.int64)
        same = (tokens[1:] == tokens[:-1]) & (100 * size[:-1] >= percent * size[1:]) & (key[1:] != key[:-1])
        a, b = key[:-1][same], key[1:][same]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), dtype=np.int64)
        keep = np.ones(len(tokens), dtype=bool)
        starts = np.flatnonzero(np.r_[True, ~((tokens[1:] == tokens[:-1]) & (100 * size[:-1] >= percent * size[1:]))])
        ends = np.r_[starts[1:], len(tokens)]
        for i, j in zip(starts[ends - starts > 4], ends[ends - starts > 4]):
            last = i
            for k in range(i + 1, j - 1):
                if 100 * size[last] >= percent * size[k + 1]:
                    keep[k] = False
                else:
                    last = k
        return pairs, keep

    def linked(rows: pa.Table) -> pa.Table:
        tokens, keys, sizes = [], [], []
        edges = [np.zeros((2, 0), dtype=np.int64)]
        for t, k, n in zip(*(rows.column(c).to_pylist() for c in ("tokens", "keys", "sizes"))):
            k = np.frombuffer(k, dtype=np.int64)
            if t:
                tokens.append(np.frombuffer(t, dtype=np.uint64))
                keys.append(k)
                sizes.append(np.frombuffer(n, dtype=np.uint32))
            else:
                edges.append(np.stack([k, np.frombuffer(n, dtype=np.int64)]))
        count = need = a = b = np.zeros(0, dtype=np.int64)
        if tokens:
            tokens, keys, sizes = np.concatenate(tokens), np.concatenate(keys), np.concatenate(sizes)
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            again = np.r_[False, tokens[1:] == tokens[:-1]]
            again[:-1] |= again[1:]  # only what two texts have
            tokens, keys, sizes = tokens[again], keys[order][again], sizes[order][again]
            tokens, keys, sizes = in_order(tokens, keys, sizes)
            many = np.repeat(*runs(tokens)) > PAIRED
            many |= np.isin(tokens, tokens[sizes >= _CHAINED])
            edges.append(chained(tokens[many], keys[many], sizes[many])[0])
            a, b, count, need = paired(tokens[~many], keys[~many], sizes[~many])
            sure = count >= need
            edges.append(np.stack([a[sure], b[sure]]))
            a, b, count, need = a[~sure], b[~sure], count[~sure], need[~sure]
        x, y = forest(*np.concatenate(edges, axis=1))
        del tokens, keys, sizes, edges
        relax()
        enough = np.full(len(x), _ENOUGH)
        return pa.table({c: pa.array(np.concatenate(v)) for c, v in (("a", (x, a)), ("b", (y, b)), ("count", (enough, count)), ("need", (enough, need)))})

    rows = _texts(docs, text).mapInArrow(listed, "bucket int, tokens binary, keys binary, sizes binary")
    pairs = rows.groupBy("bucket").applyInArrow(linked, "a long, b long, count long, need long")
    return pairs.groupBy("a", "b").agg(F.sum("count").alias("count"), F.min("need").alias("need")).where("count >= need").select("a", "b")


class Trie:
    """Sets of numbers in ascending order, in a trie whose nodes hold runs of numbers; `full` are the sizes that count."""

    def __init__(self, sets: list[np.ndarray], full: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        start, length, parent, ends, low, high, rest = [], [], [], [], [], [], []
        pool, at = [], 0
        path: list[tuple[int, int, int]] = []  # node, depth where it begins, depth where it ends
        previous = np.zeros(0, dtype=np.int64)

        def new(up: int, tokens_at: int, n: int) -> int:
            start.append(tokens_at)
            length.append(n)
            parent.append(up)
            ends.append([])
            return len(start) - 1

        new(-1, 0, 0)
        for i in order:
            s = sets[i]
            m = min(len(s), len(previous))
            differ = np.flatnonzero(s[:m] != previous[:m])
            common = int(differ[0]) if len(differ) else m
            while path and path[-1][1] >= common:
                path.pop()
            if path and path[-1][2] > common:  # a node is cut in two; its first part stays above
                node, a, b = path.pop()
                tail = new(node, start[node] + common - a, b - common)
                ends[tail], ends[node] = ends[node], []
                for k in range(node + 1, tail):
                    if parent[k] == node:
                        parent[k] = tail
                length[node] = common - a
                path.append((node, a, common))
            up = path[-1][0] if path else 0
            pool.append(s)
            if len(s) > common:
                up = new(up, at + common, len(s) - common)
                path.append((up, common, len(s)))
            ends[up].append(i)
            at += len(s)
            previous = s
        self.pool = np.concatenate(pool) if pool else np.zeros(0, dtype=np.int64)
        self.start, self.length, self.parent = np.array(start), np.array(length), np.array(parent)
        n = len(start)
        low, high, rest = np.full(n, 1 << 60), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        depth = np.zeros(n, dtype=np.int64)
        levels = [[0]]
        kids: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            kids[parent[k]].append(k)
        while nxt := [k for p in levels[-1] for k in kids[p]]:
            levels.append(nxt)
        for level in reversed(levels):
            for k in level:
                for i in ends[k]:
                    low[k], high[k] = min(low[k], full[i]), max(high[k], full[i])
                for c in kids[k]:
                    low[k], high[k], rest[k] = min(low[k], low[c]), max(high[k], high[c]), max(rest[k], rest[c] + length[c])
        self.low, self.high, self.rest = low, high, rest
        self.kids = np.array([k for x in kids for k in x], dtype=np.int64)
        self.kid_n = np.array([len(x) for x in kids])
        self.kid_at = np.cumsum(self.kid_n) - self.kid_n
        self.end = np.array([i for x in ends for i in x], dtype=np.int64)
        self.end_n = np.array([len(x) for x in ends])
        self.end_at = np.cumsum(self.end_n) - self.end_n
        del depth

    def walk(self, member: np.ndarray, size: int, full: np.ndarray, percent: int) -> np.ndarray:
        """The sets that link with a set of `size`, of which `member` marks the numbers."""
        out = []
        nodes, above = np.array([0]), np.array([0])
        while len(nodes):
            n, a = self.length[nodes], self.start[nodes]
            total = int(n.sum())
            overlap = above
            if total:
                before = np.cumsum(n) - n
                hit = member[self.pool[np.arange(total) + np.repeat(a - before, n)]]
                sums = np.concatenate([[0], np.cumsum(hit)])
                overlap = above + sums[before + n] - sums[before]
            # the needed overlap is smallest for the smallest set below
            need = percent * (size + np.maximum(self.low[nodes], -(-percent * size // 100)))
            live = ((overlap + self.rest[nodes]) * (100 + percent) >= need) & (100 * self.high[nodes] >= percent * size) & (percent * self.low[nodes] <= 100 * size)
            nodes, overlap = nodes[live], overlap[live]
            found = _ranges(self.end_at[nodes], self.end_n[nodes])
            if len(found):
                who, o = self.end[found], np.repeat(overlap, self.end_n[nodes])
                out.append(who[(100 + percent) * o >= percent * (size + full[who])])
            found = _ranges(self.kid_at[nodes], self.kid_n[nodes])
            above, nodes = np.repeat(overlap, self.kid_n[nodes]), self.kids[found]
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n) if total else np.zeros(0, dtype=np.int64)


class Block:
    """Sets in a trie, each in the global order from its frequent end. `alone`: nothing but these sets walks it, so that shingles of one
    set only are left out."""

    def __init__(self, sets: list[np.ndarray], back_of, percent: int, alone: bool):
        self.percent, self.full = percent, np.array([len(s) for s in sets], dtype=np.int64)
        self.tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.lexsort((self.tokens, -back_of(self.tokens).astype(np.int64)))
        if alone:
            order = order[count[order] > 1]
        self.number = np.full(len(self.tokens), -1, dtype=np.int64)
        self.number[order] = np.arange(len(order))
        numbers, at, self.local = self.number[inverse], 0, []
        for k in self.full.tolist():
            x = np.sort(numbers[at : at + k])
            self.local.append(x[np.searchsorted(x, 0) :])
            at += k
        self.trie, self.member = Trie(self.local, self.full), np.zeros(max(1, len(order)), dtype=np.int64)

    def _walk(self, numbers: np.ndarray, size: int) -> np.ndarray:
        self.member[numbers] = 1
        found = self.trie.walk(self.member, size, self.full, self.percent)
        self.member[numbers] = 0
        return found

    def own(self, i: int) -> np.ndarray:
        """The places of the sets that link with set i, itself included."""
        return self._walk(self.local[i], int(self.full[i]))

    def visit(self, s: np.ndarray) -> np.ndarray:
        """The places of the sets that link with a set from elsewhere."""
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        numbers = self.number[at[self.tokens[at] == s]]
        return self._walk(numbers, len(s)) if len(numbers) else np.zeros(0, dtype=np.int64)


class Union:
    """Groups of 0 to n - 1, each named by its smallest member."""

    def __init__(self, n: int):
        self.root, self.groups = list(range(n)), n

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.groups -= 1
        return a != b


def join(sets: list[np.ndarray], back_of, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set the smallest place in the group that links connect, and the links seen from it, up to where all were connected."""
    n = len(sets)
    union, seen = Union(n), np.zeros(n, dtype=np.int64)
    if n > 1:
        block = Block(sets, back_of, percent, True)
        for i in np.argsort(-block.full, kind="stable").tolist():
            if union.groups == 1:
                break
            found = block.own(i).tolist()
            seen[i] = len(found) - 1
            for j in found:
                union.tie(i, j)
    return np.array([union.find(i) for i in range(n)], dtype=np.int64), seen


def _members(docs: DataFrame, text: str, width: int, vertices: DataFrame, count: int) -> DataFrame:
    """key, key2, n and set of the documents whose key may be one of the `count` vertices (column v)."""
    size = min(FILTER_BITS, max(10, int(np.ceil(np.log2(16 * max(1, count))))))
    pos = F.col("v").bitwiseAND((1 << size) - 1)
    words = vertices.groupBy(F.shiftright(pos, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(v & {(1 << 6) - 1} AS INT))")).alias("w")).toPandas()
    bits = np.zeros(1 << (size - 6), dtype=np.int64)
    bits[words["i"].to_numpy(dtype=np.int64)] = words["w"].to_numpy(dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, 0):
                out = []
                for w in _words(part):
                    if not len(w):
                        continue
                    k = key_of(w)
                    p = k[0] & ((1 << size) - 1)
                    if k in seen or not int(sent.value[p >> 6]) >> (p & 63) & 1:
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(k)
                    s = shingles(w, width)
                    out.append((k[0], k[1], len(s), s.tobytes()))
                if out:
                    a, b, n, s = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.binary())], ["key", "key2", "n", "set"])

    return _texts(docs, text).mapInArrow(run, "key long, key2 long, n long, set binary")


def _grouped(batches, group_columns: int):
    """Runs of rows with equal leading columns, as lists of tuples, from sorted input."""
    now, held = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:group_columns] != now:
                if held:
                    yield now, held
                now, held = r[:group_columns], []
            held.append(r[group_columns:])
    if held:
        yield now, held


def near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = 5, percent: int = 75, group_shingles: int = GROUP, block_sets: int = BLOCK_SETS) -> DataFrame:
    """row_id, n_shingles, component_id for each row of `docs`."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, text, row_id, width, percent, group_shingles, block_sets)


def _near_duplicates(docs: DataFrame, text: str, row_id: str, width: int, percent: int, group_shingles: int, block_sets: int) -> DataFrame:
    def keyed(part: pa.RecordBatch) -> pa.RecordBatch:
        k1, k2, n = [], [], []
        for w in _words(part):
            a, b = key_of(w)
            k1.append(a)
            k2.append(b)
            n.append(len(shingles(w, width)))
        return pa.RecordBatch.from_arrays([part.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64())], ["row", "key", "key2", "n"])

    sc = docs.sparkSession.sparkContext
    kind = dict(docs.dtypes)[row_id]
    keys = stored(map_slices(_texts(docs, text, F.col(f"`{row_id}`")), 0, f"row {kind}, key long, key2 long, n long", keyed))
    total = keys.agg(F.sum("n")).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1.0, 0.4 * total / BUCKET)))))
    sent = sc.broadcast(_common(docs, text, width, percent, bits, _slot_bits(total, bits)))  # 2 ** SLOT_BITS bytes at most
    groups = stored(components(stored(_candidates(docs, text, width, percent, bits, sent))))
    sized = groups.join(keys.select("key", "n").groupBy("key").agg(F.max("n").alias("n")), F.col("v") == F.col("key")).groupBy("root").agg(F.sum("n").alias("total"), F.count("*").alias("count"))
    blocks = F.greatest(F.when(F.col("total") > group_shingles, F.ceil(2 * F.col("total") / group_shingles)).otherwise(1), F.ceil(F.col("count") / block_sets))
    sized = stored(sized.withColumn("blocks", blocks.cast("int")))
    names = groups.join(sized.select(F.col("root").alias("r2"), "blocks"), F.col("root") == F.col("r2")).select("v", "root", "blocks")
    count, large = groups.count(), sized.where("blocks > 1").limit(1).count() > 0
    members = _members(docs, text, width, groups.select("v"), count).join(F.broadcast(names) if count <= BROADCAST_TEXTS else names, F.col("key") == F.col("v"))
    members = members.select("root", "blocks", "key", "key2", "set")
    members = stored(members) if large else members
    parts = max(sc.defaultParallelism, int(total // (4 * GROUP)))

    def whole(batches):
        for _, rows in _grouped(batches, 1):
            unique = {(a, b): s for a, b, s in rows}
            names = sorted(unique)
            label, _ = join([np.frombuffer(unique[k], dtype=np.uint64) for k in names], lambda t: _back(t, sent), percent)
            size = np.bincount(label, minlength=len(names))
            out = [(*names[i], names[r][0]) for i, r in enumerate(label.tolist()) if size[r] > 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "key2", "label"])
        relax()

    small = members.where("blocks = 1").select("root", "key", "key2", "set").repartition(parts, "root").sortWithinPartitions("root")
    labels = small.mapInArrow(whole, "key long, key2 long, label long")
    if large:
        labels = labels.union(_divided(members.where("blocks > 1"), percent, sent, bits, parts))
    labels = stored(labels.withColumnsRenamed({"key": "l1", "key2": "l2"}))
    full = keys.join(labels, (F.col("key") == F.col("l1")) & (F.col("key2") == F.col("l2")), "left")
    full = full.select("row", F.col("n").alias("n_shingles"), F.coalesce("label", "key").alias("g1"), F.when(F.col("label").isNull(), F.col("key2")).otherwise(F.lit(0)).alias("g2"))
    lowest = stored(full.where("n_shingles > 0").groupBy(F.col("g1").alias("m1"), F.col("g2").alias("m2")).agg(F.min("row").alias("low"), F.count("*").alias("m")).where("m > 1").drop("m"))
    out = full.join(lowest, (F.col("g1") == F.col("m1")) & (F.col("g2") == F.col("m2")) & (F.col("n_shingles") > 0), "left")
    return out.select(F.col("row").alias(row_id), "n_shingles", F.coalesce("low", "row").alias("component_id"))


def _divided(members: DataFrame, percent: int, sent, bits: int, parts: int) -> DataFrame:
    """key, key2, label for the texts of groups that are too large for one task."""
    back_of = lambda t: _back(t, sent)
    rows = members.select("root", "blocks", F.pmod(F.xxhash64(F.lit(1), "key", "key2"), F.col("blocks")).cast("int").alias("x"), F.xxhash64("key", "key2").alias("u"), "key", "key2", "set")
    rows = stored(rows.repartition(parts, "root", "x").dropDuplicates(["root", "x", "u"]))

    def alone(batches):
        for (r, x), sets in _grouped(batches, 2):
            label, seen = join([np.frombuffer(s, dtype=np.uint64) for _, s in sets], back_of, percent)
            u = np.array([k for k, _ in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), r, dtype=np.int64)), pa.array(u), pa.array(u[label]), pa.array(seen)], ["root", "u", "label", "seen"])

    dealt = lambda df, *cols: df.repartition(parts, "root", "x").sortWithinPartitions("root", "x", *cols)
    own = stored(dealt(rows.select("root", "x", "u", "set")).mapInArrow(alone, "root long, u long, label long, seen long"))

    def visited(batches):
        """Links (a, b) between visitors' labels and residents' labels, each once; a block's residents come first."""
        for _, some in _runs(batches, 2):
            block, sets, c = None, [], []
            for visitor, label, s in some:
                if not visitor:
                    sets.append(np.frombuffer(s, dtype=np.uint64))
                    c.append(label)
                    continue
                if not sets:
                    break  # no text was dealt to this block
                if block is None:
                    block, labels, out = Block(sets, back_of, percent, False), np.array(c, dtype=np.int64), set()
                for other in np.unique(labels[block.visit(np.frombuffer(s, dtype=np.uint64))]).tolist():
                    if other != label and (label, other) not in out:
                        out.add((label, other))
                        if len(out) >= 50_000:
                            yield _edges(out)
                            out = set()
            if block is not None and out:
                yield _edges(out)
        relax()

    def visits(residents: DataFrame, visitors: DataFrame) -> DataFrame:
        """residents: root, x, c, set; visitors: the same, each where it goes. Blocks without visitors stay where they are."""
        asked = visitors.select("root", "x").distinct()
        both = residents.join(asked, ["root", "x"], "left_semi").select("root", "x", F.lit(False).alias("visitor"), "c", "set").union(visitors.select("root", "x", F.lit(True), "c", "set"))
        return stored(dealt(both, "visitor").mapInArrow(visited, "a long, b long"))

    # the sets from which most links were seen visit all blocks of their group
    at = rows.select("root", "u", "x", "blocks", "set").join(own.select(F.col("u").alias("o"), F.col("label").alias("c"), "seen"), F.col("u") == F.col("o"))
    best = Window.partitionBy("root").orderBy(F.desc("seen"), "u")
    pivots = own.withColumn("k", F.row_number().over(best)).where(F.col("k") <= PIVOTS).select(F.col("u").alias("p"))
    sent_out = at.join(pivots, F.col("u") == F.col("p"), "left_semi").select("root", "c", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    first = components(visits(at, sent_out))
    tied = stored(at.drop("o").join(first.withColumnsRenamed({"root": "first"}), F.col("c") == F.col("v"), "left").select("root", "u", "x", "set", F.coalesce("first", "c").alias("c")))

    # sets outside their group's largest component visit the other blocks that hold a shingle of their prefix
    count = tied.groupBy("root", "c").agg(F.count("*").alias("n"))
    largest = count.groupBy(F.col("root").alias("r")).agg(F.max_by("c", F.struct("n", "c")).alias("most"))
    marked = stored(tied.join(largest, F.col("root") == F.col("r")).select("root", "x", "u", "c", (F.col("c") != F.col("most")).alias("other"), "set"))
    others = marked.where("other")
    labels = tied.select("u", "c")
    if others.limit(1).count():
        going = marked.select("root", "x", "u", "other", "set").mapInArrow(_prefixes(percent, sent, bits), "bucket int, tokens binary, x binary, u binary, other binary")
        going = stored(going.groupBy("bucket").applyInArrow(_destinations, "u long, x int").distinct())
        visitors = going.withColumnRenamed("u", "w").join(others.select("root", "u", "c", "set"), F.col("w") == F.col("u")).select("root", "x", "c", "set")
        second = components(visits(marked, visitors))
        labels = tied.join(second.withColumnsRenamed({"root": "second"}), F.col("c") == F.col("v"), "left").select("u", F.coalesce("second", "c").alias("c"))
    many = labels.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select(F.col("c").alias("label"))
    named = labels.join(many, F.col("c") == F.col("label"), "left_semi").select(F.col("u").alias("w"), F.col("c").alias("label"))
    return rows.select("u", "key", "key2").join(named, F.col("u") == F.col("w")).select("key", "key2", "label")


def _prefixes(percent: int, sent, bits: int):
    """The prefixes of sets (root, x, u, other, set) by their shingles' leading bits, packed: shingle (mixed with the group, so that only a group's
    own sets meet, but for chance), block, set, and whether it looks for others."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                root, x, u, other = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                heads = [_head(np.frombuffer(s, dtype=np.uint64), percent, sent) for s in part.column(4).to_pylist()]
                n = [len(h) for h in heads]
                tokens = np.concatenate(heads) ^ np.repeat(root.view(np.uint64) * _FACTORS[0], n)
                order = np.argsort(tokens, kind="stable")
                columns = [tokens[order], *(np.repeat(v, n)[order] for v in (x.astype(np.int32), u, other.astype(bool)))]
                for b, part in enumerate(_bucketed(columns[0], bits)):
                    if part.stop > part.start:
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *(pa.array([c[part].tobytes()], pa.binary()) for c in columns)], ["bucket", "tokens", "x", "u", "other"])

    return run


def _destinations(rows: pa.Table) -> pa.Table:
    """(u, x): the blocks that hold a shingle of a set that looks for others, but its own."""
    tokens, x, u, other = (np.concatenate([np.frombuffer(v, dtype=t) for v in rows.column(c).to_pylist()]) for c, t in (("tokens", np.uint64), ("x", np.int32), ("u", np.int64), ("other", bool)))
    order = np.lexsort((x, tokens))
    held, place = tokens[order], x[order]
    once = np.r_[True, (held[1:] != held[:-1]) | (place[1:] != place[:-1])]
    held, place = held[once], place[once]
    who, home = u[other], x[other]
    first = np.searchsorted(held, tokens[other], "left")
    n = np.searchsorted(held, tokens[other], "right") - first
    to = place[_ranges(first, n)]
    away = to != np.repeat(home, n)
    pairs = np.unique(np.stack([np.repeat(who, n)[away], to[away].astype(np.int64)]), axis=1) if away.any() else np.zeros((2, 0), dtype=np.int64)
    relax()
    return pa.table({"u": pa.array(pairs[0]), "x": pa.array(pairs[1].astype(np.int32))})


def _edges(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _runs(batches, group_columns: int):
    """(leading columns, an iterator over the other columns' tuples) for each run of equal leading columns of sorted input."""
    rows = (r for batch in batches for k in range(0, batch.num_rows, 100) for r in zip(*(c.to_pylist() for c in batch.slice(k, 100).columns)))
    for key, some in itertools.groupby(rows, key=lambda r: r[:group_columns]):
        yield key, (r[group_columns:] for r in some)
