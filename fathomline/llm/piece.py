"""SentencePiece BPE encoding and decoding, exactly as the library does them, by backtracking.

A text is cut where no merge can ever cross: before each run of blanks, and around characters that no piece holds. Each
unit between cuts is encoded from the left: Aho-Corasick gives the longest piece at each place, a piece is taken if it and
the piece before it survive re-merging side by side, shorter prefixes are tried if not, and a bitfield remembers the places
from which no encoding goes on, so that no place is left twice. Units are remembered in a bounded table.

Defined results: null counts as the empty text, whose only id is the end id; texts of any length are encoded whole, a unit
without cuts in linear time; ids are the library's, for any text; repeated rows give repeated results, an empty table an
empty one; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Units and pairs that a worker remembers at most; the tables are emptied when full.
MEMORY = 300_000
LONGEST_REMEMBERED = 48
BLANK = "▁"


def read_model(path: str) -> dict:
    """What encoding needs of a model file: pieces by id, their scores and kinds, end id. Its size is that of the file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    kinds = proto.ModelProto.SentencePiece.Type
    if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not train.byte_fallback or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation are encoded")
    if any(p.type in (kinds.Value("USER_DEFINED"), kinds.Value("UNUSED")) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not encoded")
    return {
        "pieces": [p.piece for p in model.pieces],
        "scores": [p.score for p in model.pieces],
        "normal": [i for i, p in enumerate(model.pieces) if p.type == kinds.Value("NORMAL")],
        "bytes": {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.Value("BYTE")},
        "control": [i for i, p in enumerate(model.pieces) if p.type == kinds.Value("CONTROL")],
        "end": next(i for i, p in enumerate(model.pieces) if p.piece == (train.eos_piece or "</s>")),
    }


class Memo(dict):
    """A dict that asks `make` for what it lacks. When full it starts anew, and what is asked for again comes over."""

    def __init__(self, make, limit: int = MEMORY) -> None:
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= LONGEST_REMEMBERED:
            self[key] = value
        return value


class PieceCoder:
    def __init__(self, model: dict) -> None:
        import ahocorasick

        pieces, self.pieces = model["pieces"], model["pieces"]
        self.id = {pieces[i]: i for i in model["normal"]}
        self.score = {pieces[i]: model["scores"][i] for i in model["normal"]}
        self.bytes, self.end = model["bytes"], model["end"]
        self.byte_of = {i: b for b, i in model["bytes"].items()}
        self.silent = set(model["control"])
        for p in self.id:
            if BLANK in p.lstrip(BLANK):
                raise ValueError("a piece has a blank after its first letter; texts can't be cut at blanks")
        self.known = {c for p in self.id for c in p}
        self._runs = re.compile("[{0}]+|[^{0}]".format("".join(map(re.escape, sorted(self.known)))))
        self.name = {p: str(i) for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter = Memo(self._shorter)
        self.fits = Memo(self._fits)
        self.units = Memo(self._unit)
        self.splits_lines = "\n" not in self.known

    # -- pieces

    def _shorter(self, piece: str) -> str:
        """The longest piece that piece begins with, itself excepted; empty if there is none."""
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.id), "")

    def merged(self, text: str) -> list[str]:
        """The definition: join the pair of neighbours with the best score, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, pair: tuple[str, str]) -> bool:
        """Whether the second piece, after the first (or none), comes out of re-merging as it is."""
        first, second = pair
        return self.merged(first + second) == ([first, second] if first else [second])

    def _backtrack(self, text: str) -> list[str]:
        """text of known characters only."""
        size = len(text)
        longest = [1] * size
        for end, n in self.automaton.iter(text):
            if n > longest[end - n + 1]:
                longest[end - n + 1] = n
        alive = bytearray(b"\xff" * (size // 8 + 1))  # a bit for each place: not yet known to fail
        fits, taken, last = self.fits, [], ""
        at, piece = 0, text[: longest[0]]
        while True:
            end = at + len(piece)
            if alive[end >> 3] >> (end & 7) & 1 and fits[last, piece]:
                taken.append(piece)
                if end == size:
                    return taken
                last, at, piece = piece, end, text[end : end + longest[end]]
                continue
            shorter = self.shorter[piece]
            if shorter:
                piece = shorter
                continue
            alive[at >> 3] &= ~(1 << (at & 7)) & 0xFF
            piece = taken.pop()
            at -= len(piece)
            last = taken[-1] if taken else ""

    # -- units

    def _unit(self, unit: str) -> tuple[str, str]:
        """Ids of a unit, as decimals joined by a blank, and the text they decode to."""
        if self.known.issuperset(unit):
            parts = self._backtrack(unit)
            return " ".join([self.name[p] for p in parts]), "".join(parts).replace(BLANK, " ")
        ids: list[int] = []
        for run in self._runs.findall(unit):
            if run[0] in self.known:
                ids += [self.id[p] for p in self._backtrack(run)]
            else:
                ids += [self.bytes[b] for b in run.encode("utf-8", "replace")]
        return " ".join(map(str, ids)), self.surface(ids)

    def surface(self, ids: list[int]) -> str:
        """Text of ids, blanks shown as blanks, without regard to the beginning of a text."""
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i is not None and i not in self.silent:
                out.append(self.pieces[i].replace(BLANK, " "))
        return "".join(out)

    _cuts = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

    def _line(self, line: str) -> list[str]:
        """Units of a line whose blanks are marked."""
        if BLANK + BLANK in line or line.endswith(BLANK):
            return self._cuts.findall(line)
        first, *rest = line.split(BLANK)
        units = [BLANK + w for w in rest]
        return [first, *units] if first else units

    def encode(self, text: str) -> tuple[str, str]:
        """Ids of text and the end id, as decimals joined by a blank, and the text that they decode to."""
        if not text:
            return str(self.end), ""
        marked = BLANK + text.replace(" ", BLANK)
        ids, texts = [], []
        lines = marked.split("\n") if self.splits_lines else [marked]
        units = self.units
        feed = units["\n"] if self.splits_lines else None
        for k, line in enumerate(lines):
            if k:
                ids.append(feed[0])
                texts.append(feed[1])
            if line:
                got = [units[u] for u in self._line(line)]
                ids += [x[0] for x in got]
                texts += [x[1] for x in got]
        ids.append(str(self.end))
        decoded = "".join(texts)
        return " ".join(ids), decoded[1:] if decoded.startswith(" ") else decoded


_coders: dict[str, PieceCoder] = {}


def _coder(key: str, model: dict) -> PieceCoder:
    if key not in _coders:
        _coders[key] = PieceCoder(model)
    return _coders[key]


def _arrow(values: list, kind: str) -> pa.Array:
    """Values of a column; arrays of numbers without a Python object each."""
    if kind != "array<int>":
        return pa.array(values, {"bigint": pa.int64(), "string": pa.string()}[kind])
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))


def _apply(docs: DataFrame, model_path: str, columns: str, of) -> DataFrame:
    """doc_id and what `of` makes of (ids as text, decoded text), for each row."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))  # as large as the model file
    kind = common.numbered_types(docs, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model_path, model.value)
        for batch in batches:
            for part in common.slices(batch, 1_000_000):
                rows = [of(*coder.encode(t or "")) for t in part.column("text").to_pylist()]
                made = [_arrow(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", *names])

    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    return common.map_arrow(docs.select("doc_id", "text"), run, f"{kind}, {columns}")


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (end id included) and decoded for each of docs(doc_id, text)."""
    return _apply(docs, model_path, "ids array<int>, decoded string", lambda ids, decoded: (np.fromstring(ids, np.int32, sep=" "), decoded))


def digest_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimals joined by a blank) and of the decoded text."""

    def digest(ids: str, decoded: str) -> tuple[int, str, str]:
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest()

    return _apply(docs, model_path, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest)
