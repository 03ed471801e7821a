"""Benchmark decontamination: which document words lie in passages of benchmark items.

Texts are reduced to words: A-Z in lower case; a word is a run of digits, letters a-z and characters outside ASCII. A window is
`window` consecutive words of an item; an item of fewer words, but not none, is one window. All windows of a block of items go into
one Aho-Corasick automaton over word numbers, and each document is scanned once. Hits are mapped back to offsets of the original
text.

The items of a block are sent to the executors; a block holds at most `block_words` words (or one item), so its size is bounded
however large the benchmark is, and the driver holds one block at a time. More blocks mean more scans of the documents, and their hits are
united by document row. A Python worker keeps the automaton of a block from task to task, by the digest of its items.

Results: null texts and texts without words have no words, no hits and aren't contaminated. Items without words are ignored; items
with equal windows are all found; repeated item ids count once; null item ids are ignored, for they cannot be reported. Repeated
document rows are independent. Extra columns pass through, and the new columns replace columns of the same name. With no items,
nothing is hit.
"""

import hashlib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import free_name, map_slices, stored, text_first

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Bytes of separators become spaces, A-Z lower case; bytes of characters outside ASCII stay.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
COLUMNS = {"n_words": "bigint", "n_hit": "bigint", "hit_items": "array<string>", "hit_spans": "array<struct<start:int,end:int>>"}


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Items:
    """The automaton of a block of items: (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            seq = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                found.setdefault(tuple(seq[i : i + window]), set()).add(item)
        for key, ids in found.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(ids))))
        self.any = bool(found)
        if found:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """The number of words, the hit runs of words [from, to) in order, and the items that occur."""
        found = words(text)
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if self.any and found:
            get = self.number.get
            for end, (n, ids) in self.automaton.iter(tuple([get(w, 0) for w in found])):
                items.update(ids)
                start = end - n + 1
                while runs and runs[-1][1] >= start:  # ends come in order, so that only the last runs can touch
                    start = min(start, runs.pop()[0])
                runs.append((start, end + 1))
        return len(found), runs, items


def spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of runs of words."""
    if not runs:
        return []
    at = [(m.start(), m.end()) for m in WORD.finditer(text.translate(_TABLE))]
    out, byte, chars = [], 0, 0
    for a, b in runs:
        start = chars + len(text[byte : at[a][0]].decode())
        end = start + len(text[at[a][0] : at[b - 1][1]].decode())
        byte, chars = at[b - 1][1], end
        out.append((start, end))
    return out


def blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks, one at a time, read by the driver a partition at a time; one empty block if there are none."""
    out: list[tuple[str, bytes]] = []
    n = 0
    for item, t in items.select(F.col(item_id).cast("string"), F.col(text).cast("string").cast("binary")).dropna().distinct().toLocalIterator():
        k = len(words(bytes(t)))
        if out and n + k > block_words:
            yield out
            out, n = [], 0
        if k:
            out.append((item, bytes(t)))
            n += k
    yield out


#: The automaton that this worker made last, by the digest of its items.
_made: dict[str, Items] = {}


def _automaton(key: str, sent) -> Items:
    if key not in _made:
        _made.clear()
        _made[key] = Items(*sent.value)
    return _made[key]


def _digest(block: list[tuple[str, bytes]], window: int) -> str:
    out = hashlib.blake2b(str(window).encode(), digest_size=20)
    for item, text in block:
        for part in (item.encode(), text):
            out.update(len(part).to_bytes(8, "little") + part)
    return out.hexdigest()


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_words: int = 200_000) -> DataFrame:
    """All columns of `docs` and n_words, n_hit (words inside occurrences of windows), hit_items (sorted ids of the items that occur)
    and hit_spans (offsets of hit runs in the text, in characters)."""
    kept = [c for c in docs.columns if c.lower() not in COLUMNS]
    raw = free_name(docs, "text_bytes")
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema
    cuts = blocks(items, item_id, item_text, block_words)
    head, following = next(cuts), next(cuts, None)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    sc = docs.sparkSession.sparkContext

    def scanned(frame: DataFrame, places: list[int], names: list[str], kinds, block: list[tuple[str, bytes]], only_hits: bool) -> DataFrame:
        sent, key = sc.broadcast((block, window)), _digest(block, window)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = _automaton(key, sent)
            texts = [t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()]
            rows = [found.scan(t) for t in texts]
            out = [pa.array([n for n, _, _ in rows], pa.int64()), pa.array([sum(b - a for a, b in r) for _, r, _ in rows], pa.int64()), pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.string()))]
            out.append(pa.array([[{"start": a, "end": b} for a, b in (r if only_hits else spans(t, r))] for t, (_, r, _) in zip(texts, rows)], pa.list_(span)))
            batch = pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *out], [*names, *COLUMNS])
            return batch.filter(pc.greater(batch.column(len(names) + 1), 0)) if only_hits else batch

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
        return map_slices(frame, 0, ", ".join(x for x in (ddl, *(f"{c} {t}" for c, t in COLUMNS.items())) if x), work)

    if following is None:
        frame, places = text_first(docs, text, kept, raw)
        return scanned(frame, places, kept, schema, head, False)
    # more blocks: number the rows, scan for each block, unite word runs by row
    row = free_name(docs, "row_no")
    base = stored(docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.expr("uuid()").alias(row)))
    numbered = base.select(F.col(text).cast("string").cast("binary").alias(raw), F.col(row))
    hits = None
    for block in itertools.chain([head, following], cuts):
        one = scanned(numbered, [1], [row], numbered.drop(raw).schema, block, True)
        hits = one if hits is None else hits.unionByName(one)
    united = hits.groupBy(row).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"), F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("runs"))
    joined = base.select(F.col(text).cast("string").cast("binary").alias(raw), F.col(row), *[F.col(f"`{c}`") for c in kept]).join(united, row, "left").drop(row)
    order = joined.select(raw, *[F.col(f"`{c}`") for c in kept], "hit_items", "runs")

    def finish(part: pa.RecordBatch) -> pa.RecordBatch:
        n, hit, where = [], [], []
        for t, runs in zip(part.column(0).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
            t, merged = t or b"", []
            for r in runs or []:
                if merged and merged[-1][1] >= r["start"]:
                    merged[-1] = (merged[-1][0], max(merged[-1][1], r["end"]))
                else:
                    merged.append((r["start"], r["end"]))
            n.append(len(words(t)))
            hit.append(sum(b - a for a, b in merged))
            where.append([{"start": a, "end": b} for a, b in spans(t, merged)])
        ids = pa.array([x or [] for x in part.column(part.num_columns - 2).to_pylist()], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([*part.columns[1:-2], pa.array(n, pa.int64()), pa.array(hit, pa.int64()), ids, pa.array(where, pa.list_(span))], [*kept, *COLUMNS])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return map_slices(order, 0, ", ".join(x for x in (ddl, *(f"{c} {t}" for c, t in COLUMNS.items())) if x), finish)


def contaminated(n_words, n_hit, share_inverse: int = 20):
    """A document counts as contaminated if a twentieth of its words is hit, and any at all."""
    return (n_hit > 0) & (share_inverse * n_hit >= n_words)
