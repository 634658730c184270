"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary
text, one on toxic text, and the lengths to which each compresses every window of a text.

Training takes a bounded sample of labelled rows. The ordinary dictionary is trained on
windows of ordinary texts. The toxic one is trained on those parts of toxic texts whose
words toxic texts hold far oftener than ordinary ones. Both are used with the same entropy
tables and the same plain content, which the toxic part or as many bytes that match nothing
follow, so that plain words cost the same with either and a window's gain is what toxic text
explains. A text is described by its largest gains and by the number
of windows above fixed gains; thresholds on these are calibrated by a logistic fit on the
other half of the sample. All windows of whole texts are scored.

Defined cases: a null or empty text has no windows and gets the score of no gain at all; a
null doc_id has a null fold, is never learned from and is not held out; labels with a null
toxic are left out, conflicting ones of one doc_id count as toxic; with no labelled row of
one class every score is the share of toxic rows (0 without any).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, words

#: Labelled rows to learn from, per class: those with the smallest hash of their id.
SAMPLE_ROWS = 2500
WINDOW_BYTES = 48
#: Ordinary windows that the dictionary is trained on, evenly spaced in the sample.
TRAIN_WINDOWS = 50_000
ORDINARY_BYTES, TOXIC_BYTES = 24 << 10, 4 << 10
#: A word is toxic text's own above this log-odds ratio and from so many contexts on; its
#: beginnings count from PREFIX bytes on.
LOG_ODDS, MIN_CONTEXTS, PREFIX = 2.0, 6, 4
GAINS = (1, 2, 3, 5)
TOP = 4
SHARD_BYTES = 1 << 20
STRATEGY = zstandard.STRATEGY_BTOPT
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(data: np.ndarray, begins: np.ndarray, size: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of whole words, about `size` bytes: begin, end and the text they are of. A
    window begins with the first word that begins in each `size` bytes of its text."""
    start, end = words.spans(data, words.NON_SPACE)
    text = np.searchsorted(begins, start, "right") - 1
    cell = (start - begins[text]) // size
    first = np.ones(len(start), bool)
    first[1:] = (text[1:] != text[:-1]) | (cell[1:] != cell[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(start))[: len(at)] - 1
    return start[at], end[last], text[at]


#: Ends the header of a zstandard dictionary: the three repeat offsets it begins with.
_HEADER_END = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


def _trained(samples: list[bytes], size: int) -> tuple[bytes, bytes]:
    """Header (entropy tables) and content of a dictionary that zstandard's trainer makes.
    Too few samples to train from are their own content, without a header."""
    if sum(map(len, samples)) > 4 * size and len(samples) > 64:
        try:
            made = zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
            at = made.index(_HEADER_END) + len(_HEADER_END)
            return made[:at], made[at:]
        except (zstandard.ZstdError, ValueError):
            pass
    return b"", b" ".join(samples)[-size:]


@dataclass
class Model:
    """Entropy tables, the two contents that follow them, logistic weights."""

    header: bytes = b""
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    prior: float = 0.0

    def __post_init__(self):
        self._zips = None

    def __getstate__(self):
        return {"header": self.header, "ordinary": self.ordinary, "toxic": self.toxic, "weights": self.weights, "prior": self.prior, "_zips": None}

    def _compressors(self):
        if self._zips is None:
            params = zstandard.ZstdCompressionParameters(strategy=STRATEGY, min_match=4, window_log=17, hash_log=13, chain_log=13, search_log=5, write_content_size=False)
            kind = zstandard.DICT_TYPE_FULLDICT if self.header else zstandard.DICT_TYPE_RAWCONTENT
            self._zips = []
            for content in (self.ordinary, self.toxic):
                shared = zstandard.ZstdCompressionDict(self.header + content, dict_type=kind)
                shared.precompute_compress(compression_params=params)
                self._zips.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=params))
        return self._zips

    def gains(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        if not len(start):
            return np.zeros(0, np.int64)
        segments = np.stack([start, end - start], 1).astype(np.uint64)
        given = zstandard.BufferWithSegments(data.tobytes(), segments.tobytes())
        lengths = []
        for z in self._compressors():
            made = z.multi_compress_to_buffer(given)
            lengths.append(np.array([len(x) for x in made], np.int64))
        return lengths[0] - lengths[1]

    def features(self, texts: list[str | None]) -> np.ndarray:
        data, begins = words.joined(texts)
        data = words.LOWER[data]
        start, end, text = windows(data, begins)
        gain = self.gains(data, start, end)
        n = np.bincount(text, minlength=len(texts))
        order = np.lexsort((-gain, text))
        head = np.cumsum(n) - n
        columns = []
        for k in range(TOP):
            best = np.zeros(len(texts))
            has = n > k
            best[has] = gain[order[head[has] + k]]
            columns.append(np.clip(best, -2, 8))
        for g in GAINS:
            columns.append(np.log1p(np.bincount(text, gain >= g, minlength=len(texts))))
            columns.append(np.minimum(1.0, columns[-1] / np.maximum(n, 1) * 10))
        columns.append(np.log1p(n))
        columns.append(np.ones(len(texts)))
        return np.stack(columns, 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.weights) == 1:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic weights by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _beginnings(w: bytes):
    """A word, closed by a space, and its beginnings from PREFIX bytes to 7."""
    yield w + b" "
    for n in range(PREFIX, min(len(w), 8)):
        yield w[:n]


def _in_texts(texts: list[bytes]) -> Counter:
    """In how many texts each word and beginning of a word is."""
    out: Counter = Counter()
    for t in texts:
        out.update({x for w in set(_WORD.findall(t)) for x in _beginnings(w)})
    return out


def _contexts(texts: list[bytes], wanted: set[bytes]) -> dict[bytes, set]:
    """The distinct neighbours that each wanted one stands between. Copies of a text add
    nothing to a set."""
    out: dict[bytes, set] = defaultdict(set)
    for t in texts:
        found = _WORD.findall(t)
        for before, w, after in zip([b"", *found[:-1]], found, [*found[1:], b""], strict=True):
            for x in _beginnings(w):
                if x in wanted:
                    out[x].add(hash((before, after)))
    return out


def _own_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words (with a space) and beginnings of words that toxic texts hold far oftener, the
    strongest last; none that begins with another one."""
    least = max(MIN_CONTEXTS, len(toxic) // 25)
    often = {w: n for w, n in _in_texts(toxic).items() if n >= MIN_CONTEXTS}
    wanted: set[bytes] = set()
    plain: Counter = Counter()
    for t in ordinary:
        plain.update({x for w in set(_WORD.findall(t)) for x in _beginnings(w) if x in often})
    wanted = {w for w, n in often.items() if np.log((n + 0.5) / len(toxic)) - np.log((plain[w] + 0.5) / len(ordinary)) >= LOG_ODDS / 2}
    a, b = _contexts(toxic, wanted), _contexts(ordinary, wanted)
    na, nb = sum(map(len, toxic)) + 1, sum(map(len, ordinary)) + 1
    found = {}
    for w, places in a.items():
        n, m = len(places), len(b.get(w, ()))
        if n >= least and np.log((n + 0.5) / na) - np.log((m + 0.5) / nb) >= LOG_ODDS:
            found[w] = n
    kept: list[bytes] = []
    for w in sorted(found, key=lambda w: (-found[w], w)):
        # a beginning that a longer one explains gives way to it
        if any(x.startswith(w) and found[x] >= 0.9 * found[w] for x in found if len(x) > len(w)) or any(w.startswith(x) for x in kept):
            continue
        kept.append(w)
    return kept[::-1]


def _around(text: bytes, own: re.Pattern | None) -> list[bytes]:
    """The toxic words of a text with the bytes that stand beside them."""
    return [text[max(0, m.start() - 1) : m.end() + 1] for m in own.finditer(text)] if own else []


def train(texts: list[str | None], toxic: list[int], share: float | None = None) -> Model:
    """A model from a labelled sample: dictionaries from one half, thresholds from the other,
    then dictionaries from all of it. `share`: of toxic rows among all labelled ones, when
    the sample has another one."""
    y = np.array(toxic, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    raw = [words.LOWER[np.frombuffer((t or "").encode(), np.uint8)].tobytes() for t in texts]

    def dictionaries(rows: np.ndarray) -> Model:
        bad, good = ([raw[i] for i in rows if y[i] == k] for k in (1, 0))
        own = _own_words(bad, good)
        data, begins = words.joined([g.decode() for g in good])
        start, end, _ = windows(data, begins)
        whole = data.tobytes()
        every = max(1, len(start) // TRAIN_WINDOWS)
        plain = [whole[a:b] for a, b in zip(start[::every].tolist(), end[::every].tolist(), strict=True)]
        pattern = re.compile(b"|".join(rb"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + re.escape(w.rstrip()) for w in own)) if own else None
        samples = [s for t in bad for s in _around(t, pattern)]
        best = b" ".join(w.rstrip() for w in own)[-TOXIC_BYTES // 2 :]
        room = TOXIC_BYTES - len(best)
        tail = _trained(samples, room)[1][-room:] + b" " + best + b" "
        header, content = _trained(plain, ORDINARY_BYTES)
        # bytes that match nothing stand where the other has the toxic part: all distances agree
        blank = bytes(np.random.default_rng(0).integers(0, 8, len(tail), np.uint8))
        return Model(header, content + blank, content + tail, prior=float(y.mean()))

    half = np.arange(len(y)) % 2 == 0
    model = dictionaries(np.flatnonzero(half))
    rows = np.flatnonzero(~half)
    x = np.concatenate([model.features([texts[i] for i in rows[k : k + 256]]) for k in range(0, len(rows), 256)])
    weights = _fit(x, y[rows]) if y[rows].min() != y[rows].max() else np.zeros(1)
    model = dictionaries(np.arange(len(y)))
    if share and len(weights) > 1:  # the sample's share moves the odds, not their order
        weights[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    model.weights = weights
    return model


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def _known(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1) of the rows that may be learned from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def sample(documents: DataFrame, known: DataFrame, rows: int = SAMPLE_ROWS) -> pa.Table:
    """text and toxic of the labelled rows to learn from; at most `rows` ids of each class
    come to the driver and are sent out, whatever the tables' size."""
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("l_id"), "toxic")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic")
    return got.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").toArrow()


def learned(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    known = _known(labels)
    share = known.agg(F.avg("toxic").alias("share")).first().share
    got = sample(documents, known, rows)
    return train(got["text"].to_pylist(), got["toxic"].to_pylist(), share if share and share < 1 else None)


def score(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    spark = documents.sparkSession
    common.text_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for shard in common.rows_of(batches, SHARD_BYTES):
            yield pa.RecordBatch.from_arrays([shard["doc_id"].combine_chunks(), pa.array(sent.value.score(shard["text"].to_pylist()))], ["doc_id", "score"])

    out = docs.mapInArrow(common.lean(run), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """`documents` without the toxic ones; columns stay as they are."""
    spark = documents.sparkSession
    model = learned(documents, labels, rows)
    common.text_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for shard in common.rows_of(batches, SHARD_BYTES):
            yield from shard.filter(pa.array(sent.value.score(shard["text"].to_pylist()) < 0.5)).combine_chunks().to_batches()

    return documents.mapInArrow(common.lean(run), documents.schema)
