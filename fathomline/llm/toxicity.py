"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a general lexicon and of one learned from labels, second-person words near its words, capitals,
punctuation, digits and obfuscated words, lengths and repetition. The lexicon is learned crosswise: the rows of each half of the
sample get features from the stems of the other half, so that trees never see a stem chosen by their own row's label.

Defined results: null text counts as empty; an empty text gets a score like any other (all its features are 0); texts are
read whole, of any length; repeated rows score alike; without labelled rows of both classes every score is the overall
rate (0.5 if there are none); an empty table gives an empty result; labels, lang, source and doc_id are no inputs of a score;
other columns are never looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .trees import Boosted, isotonic

#: Labelled rows that the classifier is fitted on at most: those with the smallest hash of their doc_id.
MAX_TRAIN = 20_000
#: Stems of the learned lexicon at most; rows of a half that have to hold a stem; odds against other rows.
MAX_STEMS, LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 3000, 4, 0.005, 3.0
#: Lengths of a word's beginnings that are tried as stems, besides the word.
STEM_LENGTHS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
#: General insults and abuse.
LEXICON = frozenset(
    "arse arsehole ass asshole bastard bitch bloody bollocks bullshit clown coward crap creep cretin cunt damn dick dickhead dimwit disgusting "
    "douche dumb dumbass dunce fag faggot filth filthy fool freak fuck fucker fucking garbage gross hate idiot idiotic ignorant imbecile "
    "jackass jerk kill kys liar loser lunatic maggot moron moronic motherfucker nazi nigger numbskull parasite pathetic pervert pig piss "
    "prick psycho pussy rape rat retard retarded rubbish scum scumbag shame shit shithead sick slut snake stupid suck sucks swine toxic "
    "trash twat ugly useless vermin vile wanker weirdo whore worthless wretch".split()
)
#: Second-person words of English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine euch euer ihr ihre sie tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
#: Letters that signs and digits stand for in obfuscated words.
LEET = str.maketrans("013457@$!|", "oieastasil")
NEAR = 5
FEATURES = ("lexicon_share", "lexicon_count", "lexicon_first_places", "learned_share", "learned_count", "learned_weight", "learned_top", "near_second", "second_share", "caps_share", "caps_words", "marks_share", "bangs_share", "symbols_share", "digits_share", "obfuscated_share", "obfuscated_hits", "log_words", "log_bytes", "word_length", "distinct_share", "lines_share", "high_bytes")

_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¿¡«»„“”‘’…"
#: Tried at the beginning of a run of letters only, so that long runs take linear time.
_MIXED = re.compile(rb"(?<![A-Za-z])[A-Za-z]+(?:[0-9@$!*|._-]+[A-Za-z]+)+")
_CAPS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = b"!\"'(),-./:;?"
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"
_HIGH = bytes(range(128, 256))


def stems(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    return [word + "$", *(word[:n] for n in STEM_LENGTHS if len(word) > n)]


def _words(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(_EDGE))]


class Reader:
    """Features of texts, given the weights of the learned stems."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned
        self.seen: dict[str, tuple[bool, float]] = {}

    def _look(self, raw: str) -> tuple[int, float]:
        """Of a token as it stands: 1 if it is in the lexicon; its largest learned weight."""
        w = raw.strip(_EDGE)
        found = (int(w in LEXICON), max((self.learned.get(s, 0.0) for s in stems(w)), default=0.0) if w else 0.0)
        if len(self.seen) >= 100_000:
            self.seen.clear()
        if len(raw) <= 40:
            self.seen[raw] = found
        return found

    def features(self, text: str) -> list[float]:
        raw = text.encode("utf-8", "replace")
        size, tokens = len(raw), text.lower().split()
        n, seen, look = len(tokens), self.seen, self._look
        if not n:
            return [0.0] * len(FEATURES)
        got = [seen.get(t) or look(t) for t in tokens]
        hits = [i for i, (a, b) in enumerate(got) if a or b]
        lexicon = sum(got[i][0] for i in hits)
        weights = [got[i][1] for i in hits if got[i][1]]
        second = [t.strip(_EDGE) in SECOND for t in tokens] if hits else []
        near = sum(any(second[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
        count = lambda chars: size - len(raw.translate(None, chars))
        mixed = _MIXED.findall(raw)
        clear = [x.decode().lower().translate(LEET) for x in mixed]
        hidden = sum(re.sub("[^a-z]", "", x) in LEXICON for x in clear)
        caps_words = sum(1 for t in text.split() if len(t) > 2 and t.isupper())
        return [
            lexicon / n, float(lexicon), float(sum(got[i][0] for i in hits if i < 50)), len(weights) / n, float(len(weights)), sum(weights) / n, max(weights, default=0.0),
            float(near), sum(second) / n if second else 0.0, count(_CAPS) / size, caps_words / n, count(_MARKS) / size, count(b"!?") / size, count(_SYMBOLS) / size,
            count(_DIGITS) / size, len(mixed) / n, float(hidden), math.log1p(n), math.log1p(size), size / n, len(set(tokens)) / n, text.count("\n") / n, count(_HIGH) / size,
        ]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learn_stems(sample: DataFrame) -> dict[int, dict[str, float]]:
    """For sample(half, toxic, text): weights of the stems that tell toxic rows, for each half (0, 1) and for all (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("half", "toxic", "text")), strict=True)
            for half, toxic, text in rows:
                counts.update((half, toxic, s) for s in {s for w in set(_words(text or "")) for s in stems(w)})
        items = list(counts.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.int32()), pa.array([k[2] for k, _ in part]), pa.array([v * k[1] for k, v in part], pa.int64()), pa.array([v * (1 - k[1]) for k, v in part], pa.int64())],
                names=["half", "stem", "hits", "misses"],
            )

    rows = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    counts = common.map_arrow(sample, run, "half int, stem string, hits bigint, misses bigint")
    counts = counts.groupBy("stem").agg(*(F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("hits", "misses")))
    counts = common.materialise(counts.where(f"hits0 + hits1 >= {LEAST_ROWS}"), "toxicity-stems")
    out: dict[int, dict[str, float]] = {}
    for part, halves in ((0, (0,)), (1, (1,)), (2, (0, 1))):
        n1, n0 = (sum(rows.get((h, t), 0) for h in halves) for t in (1, 0))
        hits, misses = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in ("hits", "misses"))
        odds = F.log((hits + 0.5) / (n1 + 1.0)) - F.log((misses + 0.5) / (n0 + 1.0))
        scored = counts.select("stem", hits.alias("hits"), odds.alias("odds")).where((F.col("hits") >= max(LEAST_ROWS, LEAST_SHARE * n1)) & (F.col("odds") >= LEAST_ODDS))
        # The stems with the most evidence; MAX_STEMS rows at most come to the driver.
        best = scored.orderBy((F.col("odds") * F.sqrt("hits")).desc(), "stem").limit(MAX_STEMS).collect()
        out[part] = {r["stem"]: r["odds"] for r in best}
    return out


class Model:
    def __init__(self, learned: dict[str, float], trees: Boosted | None, at: np.ndarray, rate: np.ndarray) -> None:
        self.learned, self.trees, self.at, self.rate = learned, trees, at, rate

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate[0])
        raw = self.trees.score(x)
        # Calibrated rates are steps; a little of the raw score orders what a step holds.
        return 0.999 * np.interp(raw, self.at, self.rate) + 0.001 / (1 + np.exp(-raw))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from labels(doc_id, toxic) that aren't held out, for docs(doc_id, text)."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    some = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(max_train)
    half = F.pmod(F.xxhash64(F.concat(F.lit("half"), F.col("doc_id").cast("string"))), F.lit(2)).cast("int")
    # The sample is bounded by max_train rows of two numbers.
    texts = docs.select(F.col("doc_id").alias("_doc"), "text").join(F.broadcast(some), F.col("_doc") == F.col("doc_id"))
    # One text for each id that is given more than once; a partial aggregate, so that no task gathers the sample.
    sample = texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("doc_id", half.alias("half"), "toxic", "text")
    sample = common.materialise(sample, "toxicity-sample")
    learned = _learn_stems(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(learned[1]), Reader(learned[0])]  # each half by the other's stems
        for batch in batches:
            halves, toxic = batch.column("half").to_pylist(), batch.column("toxic").to_pylist()
            x = [readers[h].features(t or "") for h, t in zip(halves, batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("half"), pa.array(toxic, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["id", "half", "toxic", "x"])

    rows = common.map_arrow(sample, run, "id string, half int, toxic int, x array<double>").collect()  # max_train rows at most
    rows.sort(key=lambda r: (r["id"], r["x"]))
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    y, halves = (np.array([r[k] for r in rows], dtype=float) for k in ("toxic", "half"))
    if not 0 < y.sum() < len(y):
        return Model(learned[2], None, np.zeros(1), np.full(1, y.mean() if len(y) else 0.5))
    cross = np.zeros(len(y))  # calibration by scores of trees that haven't seen the row
    fold = np.arange(len(y)) % 5
    for k in range(5):
        own = fold == k
        cross[own] = Boosted().fit(x[~own], y[~own]).score(x[own])
    return Model(learned[2], Boosted().fit(x, y), *isotonic(cross, y))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_STEMS and the number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.learned)
        for batch in batches:
            for part in common.slices(batch, 1_000_000):
                x = np.array([reader.features(t or "") for t in part.column("text").to_pylist()]).reshape(part.num_rows, len(FEATURES))
                p = np.clip(shared.value.predict(x), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return common.map_arrow(rows, run, f"{common.numbered_types(docs, 'doc_id')}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.learned)
        for batch in batches:
            for part in common.slices(batch, 1_000_000):
                x = np.array([reader.features(t or "") for t in part.column("text").to_pylist()]).reshape(part.num_rows, len(FEATURES))
                yield part.filter(pa.array(shared.value.predict(x) < threshold))

    return common.map_arrow(docs, run, docs.schema)
