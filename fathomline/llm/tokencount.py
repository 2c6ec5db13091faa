"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A text is cut into pre-tokens by the tokenizer's pattern; leaves hold some tens of them, and the tree holds sums of characters
and tokens. An edit finds its leaves by going down the sums, cuts anew only from a little before it until the old and new
cuts meet, counts those pre-tokens, and updates the sums above the touched leaves. The counts are those of the whole edited text.

Defined results: null text counts as empty and has 0 tokens; null edits count as none; an edit's start and stop are clipped to the
text as it then is (a null bound is its end, a null text nothing); edits apply one after the other, in their order; texts are
taken whole, of any length; repeated rows give repeated results, an empty table an empty one; other columns are never looked at.
A pattern may look ahead of a pre-token through white space and three characters more, as those of public byte-level tokenizers
do; one that looks behind is refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common
from .piece import Memo

#: Pre-tokens of a leaf, and how many times that a leaf may grow to before the tree is built anew.
LEAF, OVERGROWN = 32, 8
#: Characters before an edit, and before white space in front of them, that may still decide how a pre-token ends: what the pattern
#: looks ahead, and one.
LOOK_AHEAD = 4


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of each, remembering counts."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        whole = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=table, special_tokens={})
        if "(?<=" in pattern or "(?<!" in pattern:
            raise ValueError("a pattern that looks behind cuts differently from the middle of a text on")
        self.pattern = regex.compile(pattern)
        self.count = Memo(lambda piece: len(whole.encode_ordinary(piece)))

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class TokenTree:
    """Sums of characters and tokens over the leaves of one text; node i has the children 2 i and 2 i + 1."""

    def __init__(self, counter: Counter, text: str) -> None:
        self.counter, self.recounted = counter, 0
        self._build(counter.cut(text))

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(len(self.leaves)):
            self._sum_leaf(k)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum_leaf(self, k: int) -> None:
        count = self.counter.count
        self.chars[self.size + k] = sum(map(len, self.leaves[k]))
        self.tokens[self.size + k] = sum([count[p] for p in self.leaves[k]])

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at place (the last one, at the end), and the place that it begins at."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if place >= begin + self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), begin

    def _settled(self, start: int) -> tuple[int, int, int]:
        """A leaf, the place that it begins at, and a place in it: pre-tokens that end before that see no change from start on."""
        safe = max(0, start - LOOK_AHEAD)
        first, begin = self._find(safe)
        while True:
            bare = "".join(self.leaves[first])[: safe - begin].rstrip()
            safe = begin + len(bare)
            if bare or not begin:
                return first, begin, safe
            first, begin = self._find(begin - 1)

    def edit(self, start: int | None, stop: int | None, new: str | None) -> None:
        """Put `new` in place of the characters from start to stop."""
        n, new = self.chars[1], new or ""
        start = n if start is None else min(max(start, 0), n)
        stop = max(start, n if stop is None else min(max(stop, 0), n))
        first, begin, safe = self._settled(start)
        # Whole pre-tokens that end well before the edit stay.
        kept, at = [], begin
        for p in self.leaves[first]:
            if at + len(p) >= safe:
                break
            kept.append(p)
            at += len(p)
        last, last_begin = self._find(stop)
        old: list[str] = [p for leaf in self.leaves[first : last + 1] for p in leaf][len(kept) :]
        old_ends, end = {}, at
        for k, p in enumerate(old):
            end += len(p)
            old_ends[end] = k + 1
        shift = len(new) - (stop - start)
        head = "".join(old)
        while True:
            # Cut the touched leaves; take in one more leaf as long as no cut after the edit is also an old one.
            region = head[: start - at] + new + head[stop - at :]
            more = "".join(p for leaf in self.leaves[last + 1 : last + 2] for p in leaf)
            cut, place, pieces, met = self.counter.pattern.finditer(region + more), at, [], None
            for m in cut:
                place += m.end() - m.start()
                pieces.append(m.group())
                if place - shift in old_ends and place - shift >= stop and place >= start + len(new) and (place - at < len(region) + len(more) or last + 1 >= len(self.leaves)):
                    met = old_ends[place - shift]
                    break
            if met is not None or last + 1 >= len(self.leaves):
                break
            last += 1
            for p in self.leaves[last]:
                old.append(p)
                end += len(p)
                old_ends[end] = len(old)
            head = "".join(old)
        self.recounted += sum(map(len, pieces))
        rest = old[met:] if met is not None else []
        self._put(first, last, kept + pieces + rest)

    def _put(self, first: int, last: int, pieces: list[str]) -> None:
        """Deal pieces out to the leaves first to last."""
        slots = last - first + 1
        if len(pieces) > OVERGROWN * LEAF * slots:
            self._build([p for leaf in self.leaves[:first] for p in leaf] + pieces + [p for leaf in self.leaves[last + 1 :] for p in leaf])
            return
        each = -(-len(pieces) // slots) or 1
        for k in range(slots):
            self.leaves[first + k] = pieces[k * each : (k + 1) * each]
            self._sum_leaf(first + k)
        above = {(self.size + k) // 2 for k in range(first, last + 1)}
        while above - {0}:
            for i in above:
                self._sum(i)
            above = {i // 2 for i in above} - {0}


def count_edited(text: str, edits: Iterable[tuple], counter: Counter) -> tuple[int, int, int, str]:
    """Tokens before and after edits(start, stop, text), characters that edits made to be cut again, and the edited text."""
    tree = TokenTree(counter, text)
    before = tree.n_tokens
    for start, stop, new in edits:
        tree.edit(start, stop, new)
    return before, tree.n_tokens, tree.recounted, tree.text()


#: By path of the ranks and pattern: a worker may serve several calls.
_counters: dict[tuple[str, str], Counter] = {}


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, with_text: bool = False) -> DataFrame:
    """For each of docs(doc_id, text, edits array<struct<start int, stop int, text string>>): doc_id, n_chars (of the edited text),
    n_tokens, n_tokens_edited, n_recounted (characters cut again), and edited_text if with_text."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (ranks_path, pattern) not in _counters:
            _counters[ranks_path, pattern] = Counter(ranks.value, pattern)
        counter = _counters[ranks_path, pattern]
        for whole in batches:
            for batch in common.slices(whole):
                rows = []
                for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                    before, after, again, new = count_edited(text or "", [(e["start"], e["stop"], e["text"]) for e in edits or () if e], counter)
                    rows.append((len(new), before, after, again, *[new] * with_text))
                kinds = [pa.int64()] * 4 + [pa.string()] * with_text
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    names = ["doc_id", "n_chars", "n_tokens", "n_tokens_edited", "n_recounted", *["edited_text"] * with_text]
    schema = f"{common.numbered_types(docs, 'doc_id')}, n_chars bigint, n_tokens bigint, n_tokens_edited bigint, n_recounted bigint" + ", edited_text string" * with_text
    return common.map_arrow(docs.select("doc_id", "text", "edits"), run, schema)
