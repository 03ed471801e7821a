"""SentencePiece (BPE, byte fallback) encoding and decoding without the library's encoder.

A text is cut into units that no merge can cross: a unit starts at a run of spaces or at a line feed. Each unit is encoded by
exact merge-type backtracking: an Aho-Corasick automaton lists the pieces at each position, the longest is tried first, a piece may
follow another only if merging the two pieces' text anew yields just these two, and positions from which no way led on are marked
in a bitfield and never tried again. Units recur, so that results are kept in two bounded generations of a cache.

Results: null texts encode as the empty text, which has no ids and decodes to "". Rows keep their order and number; repeated rows are
independent. Extra columns pass through; the two new columns replace columns of the same name.
"""

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import free_name, relax, slices, text_first

SPACE = "▁"
#: Units kept in a generation of the cache, and the longest unit that is kept.
CACHE_UNITS, CACHE_CHARS = 750_000, 40
_NORMAL, _USER, _UNUSED = 1, 4, 5
_UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")


class Codec:
    """Encoder and decoder for one model file; `model` is its content."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (_NORMAL, _USER, _UNUSED)}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER, _UNUSED)}
        self.bytes = [0] * 256
        self.byte_of = {}
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.byte_of[i] = int(p.piece[3:5], 16)
        #: What each id decodes to; bytes outside ASCII as lone surrogates, which are put together afterwards.
        self.glyphs = [bytes([self.byte_of[i]]).decode("ascii", "surrogateescape") if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or len(self.byte_of) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.scores) or any("\n" in p for p in self.scores):
            raise ValueError("only BPE models with byte fallback, no normalisation and pieces that begin words are supported")
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Neighbouring characters that some piece holds; no merge crosses any other two.
        self.joints = {a + b for piece in self.scores for a, b in zip(piece, piece[1:])}
        self.automaton = ahocorasick.Automaton()
        for piece in self.scores:
            if self.merged(piece) == [piece]:  # no other piece is ever the result of merging
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by plain merging: always the best scored neighbours, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters together yields the two again."""
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) > CACHE_UNITS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a unit; characters without a piece stand alone."""
        n = len(text)
        starts: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(text):
            starts[end - len(piece) + 1].append(piece)
        for i, found in enumerate(starts):
            if not found:
                found.append(text[i])
            # shorter pieces at a place end earlier, so the list is in order of length: the longest is last
        open_ = (1 << (n + 1)) - 1  # a set bit: from here the rest may still be encoded
        out: list[str] = []
        tried: list[int] = []  # the choice made at each place of the path
        at, choice = 0, len(starts[0]) - 1 if n else 0
        while at < n:
            found, last = starts[at], out[-1] if out else None
            while choice >= 0:
                piece = found[choice]
                if open_ >> (at + len(piece)) & 1 and (last is None or self.fits(last, piece)):
                    break
                choice -= 1
            if choice >= 0:
                out.append(piece)
                tried.append(choice)
                at += len(piece)
                choice = len(starts[at]) - 1 if at < n else 0
            else:
                open_ &= ~(1 << at)
                if not out:
                    raise ValueError("no encoding")
                at -= len(out.pop())
                choice = tried.pop() - 1
        return out

    def fits(self, left: str, right: str) -> bool:
        scores = self.scores
        return left not in scores or right not in scores or self.compatible(left, right)

    def unit(self, key: str) -> bytes:
        """The ids of a unit, as bytes of int32. A key is a unit's text; it begins with a line feed, or else stands for a space and the
        key."""
        text = key if key[:1] == "\n" else SPACE + key.replace(" ", SPACE)
        joints = self.joints
        cuts = [i for i, x in enumerate(map(str.__add__, text, text[1:]), 1) if x not in joints]
        if cuts:
            head = text[: cuts[0]]  # mostly a word without the sign after it, which is a unit itself
            first = self.kept(head[1:]) if head[:1] == SPACE and head[1:2] not in ("\n", "\0") else self.kept("\0" + head)
            return first + b"".join([self.kept("\0" + text[i:j]) for i, j in zip(cuts, [*cuts[1:], len(text)])])
        return self.part(text)

    def part(self, text: str) -> bytes:
        """The ids of a text without such cuts."""
        ids: list[int] = []
        for piece in self.backtrack(text):
            if (i := self.ids.get(piece)) is not None:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in piece.encode()]
        return array("i", ids).tobytes()

    def kept(self, name: str) -> bytes:
        """The ids of a unit, or of a part if a NUL comes first, from the cache where it can be."""
        value = self.young.get(name) or self.old.get(name)
        if value is None:
            value = self.part(name[1:]) if name[:1] == "\0" else self.unit(name)
        if len(name) <= CACHE_CHARS:
            if len(self.young) >= CACHE_UNITS:
                self.old, self.young = self.young, {}
            self.young[name] = value
        return value

    def encode(self, text: str | None) -> bytes:
        """The ids, as bytes of int32."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or "\0" in text:
            return b"".join([self.unit(u if u[0] == "\n" else u[1:]) for u in _UNIT.findall(" " + text)])
        keys = text.replace("\n", " \n").split(" ")
        found = list(map(self.young.get, keys))
        if None in found:
            for i, v in enumerate(found):
                if v is None:
                    found[i] = self.kept(keys[i])
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space before the first word; bytes that are no UTF-8 become U+FFFD, one each."""
        text = "".join(map(self.glyphs.__getitem__, ids))
        if not text.isascii():
            try:
                text.encode()
            except UnicodeEncodeError:
                text = _joined(text.encode("utf-8", "surrogateescape"))
        return text[1:] if text[:1] == " " and ids[0] not in self.byte_of else text


def _joined(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                pass
        else:
            n = 1
            out.append("\ufffd")
        at += n
    return "".join(out)


_codecs: dict[int, Codec] = {}


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of `docs`, and `ids` (array of int: the text's pieces) and `decoded` (what they decode to).

    model_path: a model file that the driver can read; its content goes to the executors with the tasks (0.5 MB for 32,000 pieces).
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c.lower() not in (ids.lower(), decoded.lower())]
    key = free_name(docs, "text_in")
    frame, places = text_first(docs, text, kept, key)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({ids: F.lit(None).cast("array<int>"), decoded: F.lit(None).cast("string")}).schema

    def run(batches):
        relax()  # what earlier stages left
        codec = _codecs.get(hash(model.value))
        if codec is None:
            _codecs.clear()
            codec = _codecs[hash(model.value)] = Codec(model.value)
        for batch in batches:
            for part in slices(batch, 0):
                out = [codec.encode(t or "") for t in part.column(0).to_pylist()]
                offsets = np.zeros(len(out) + 1, dtype=np.int32)
                np.cumsum([len(b) // 4 for b in out], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(out), dtype=np.int32))
                texts = [codec.decode(array("i", b).tolist()) for b in out]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(texts, pa.string())], [*kept, ids, decoded])
        del codec
        _codecs.clear()
        relax()

    return frame.mapInArrow(run, schema)
