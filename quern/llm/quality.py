"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is
encoded (hashed byte trigrams and character statistics, then a learned layer); gated
attention ``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages, and the weighted
representation gives the score. Weights of all layers are learned together from document
labels alone, on at most ``sample_docs`` labelled documents (those of least hashed id) and
``train_passages`` passages of each, spread over the whole text; their features are made in tasks, so
what reaches the driver is bounded (1 kB a passage). Scoring is one pass over the documents and
all of their passages, without a shuffle.

Inputs of a score are the text's bytes and nothing else. Defined cases: a null, empty or
blank text is one passage without words; a very long text is read whole, in segments of about
``GROUP`` bytes that are cut between passages; repeated label rows count as their largest label,
repeated documents in the sample once; null labels and ids are not learned from; without
any label every score is 0.5; held_out is false for a null doc_id; an empty table gives none; extra
columns are ignored by ``score_documents`` and pass through ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, trimmed

PASSAGE = 50
TRIGRAMS = 512
STATS = 8
#: Passages encoded at a time, and bytes of text in a group.
STEP, GROUP = 2048, 1_000_000
#: Passages of a training document that are learned from at most.
TRAIN_PASSAGES = 32

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.zeros(256, np.int64)  # 0 others, 1 upper case, 2 digits, 3 punctuation, 4 not ASCII
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


@dataclass
class Bags:
    """Bytes of some texts, cut into passages; ``doc`` is the document of each passage."""

    data: np.ndarray
    passage: np.ndarray  # of each byte
    doc: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Bags:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        white = _WHITE[data]
        begins = ~white & np.concatenate([[True], white[:-1]])
        words = np.cumsum(begins)  # words begun up to each byte
        before = words[starts] - begins[starts]
        n_words = np.diff(np.append(before, words[-1]))
        n_passages = np.maximum(1, -(-n_words // PASSAGE))
        first = np.cumsum(n_passages) - n_passages
        in_doc = words - np.repeat(before, sizes)
        passage = np.repeat(first, sizes) + np.maximum(in_doc - 1, 0) // PASSAGE
        return Bags(data, passage, np.repeat(np.arange(len(texts)), n_passages))

    def features(self, a: int, b: int) -> np.ndarray:
        """Rows of passages a to b - 1."""
        lo, hi = np.searchsorted(self.passage, [a, b])
        x, at = self.data[lo:hi].astype(np.uint32), self.passage[lo:hi] - a
        n = b - a
        out = np.zeros((n, TRIGRAMS + STATS), np.float32)
        if len(x) > 2:
            mixed = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
            h = (mixed >> np.uint32(32 - TRIGRAMS.bit_length() + 1)).astype(np.int64)
            inside = at[:-2] == at[2:]
            counts = np.bincount((at[:-2] * TRIGRAMS + h)[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
            seen = np.log1p(counts).astype(np.float32)
            out[:, :TRIGRAMS] = 4 * seen / np.maximum(np.sqrt((seen * seen).sum(1, keepdims=True)), 1e-6)
            out[:, -1] = 8 * (counts > 0).sum(1) / np.maximum(counts.sum(1), 1)
            out[:, -2] = counts.max(1, initial=0) / np.maximum(counts.sum(1), 1) * 16
        size = np.maximum(np.bincount(at, minlength=n), 1)
        kinds = np.bincount(at * 5 + _CLASS[self.data[lo:hi]], minlength=n * 5).reshape(n, 5)
        out[:, TRIGRAMS : TRIGRAMS + 4] = 4 * kinds[:, 1:] / size[:, None]
        white = np.bincount(at[_WHITE[self.data[lo:hi]]], minlength=n)
        out[:, TRIGRAMS + 4], out[:, TRIGRAMS + 5] = 4 * white / size, np.log1p(size) / 4
        return out


def groups(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts of at most GROUP bytes together, or one alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def segments(text: bytes, most: int = GROUP) -> Iterator[bytes]:
    """The text in pieces of whole passages, of about ``most`` bytes unless a passage is longer."""
    at, size = 0, most
    while len(text) - at > size:
        white = _WHITE[np.frombuffer(text, np.uint8, size, at)]
        begins = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
        n = (len(begins) - 1) // PASSAGE * PASSAGE  # the last word may go on
        if n <= 0:
            size *= 2
            continue
        cut = at + int(begins[n])
        yield text[at : cut - 1]  # without the white space that stands between texts anyway
        at, size = cut, most
    yield text[at:]


def bags_of(texts: Iterable[bytes]) -> Iterator[tuple[Bags, np.ndarray]]:
    """Bags of bounded size, and the number of the text that each passage is of."""
    owned = [(i, s) for i, t in enumerate(texts) for s in segments(t)]
    at = 0
    for group in groups(s for _, s in owned):
        bags = Bags.of(group)
        yield bags, np.array([i for i, _ in owned[at : at + len(group)]])[bags.doc]
        at += len(group)


def some_features(text: bytes, most: int) -> np.ndarray:
    """Features of at most ``most`` passages, spread evenly over the whole text."""
    parts = [bags.features(a, min(a + STEP, len(bags.doc)))[keep] for bags, a, keep in _spread(text, most)]
    return np.concatenate(parts).astype(np.float16)


def _spread(text: bytes, most: int) -> Iterator[tuple[Bags, int, np.ndarray]]:
    total = sum(len(bags.doc) for bags, _ in bags_of([text]))
    chosen = np.unique(np.linspace(0, total - 1, min(most, total)).astype(np.int64))
    first = 0
    for bags, _ in bags_of([text]):
        for a in range(0, len(bags.doc), STEP):
            here = chosen[(chosen >= first + a) & (chosen < first + min(a + STEP, len(bags.doc)))]
            if len(here):
                yield bags, a, here - first - a
        first += len(bags.doc)


@dataclass
class Model:
    """Encoder W, b; gates V, U, w; scorer c, d."""

    hidden: int = 32
    attention: int = 16
    seed: int = 5
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> Model:
        r, d, m, a = np.random.default_rng(self.seed), TRIGRAMS + STATS, self.hidden, self.attention
        shapes = {"W": (d, m), "V": (m, a), "U": (m, a), "w": (a, 1), "c": (m, 1)}
        self.p = {k: r.normal(0, s[0] ** -0.5, s).astype(np.float32) for k, s in shapes.items()} | {"b": np.zeros(m, np.float32), "d": np.zeros(1, np.float32)}
        return self

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Representation, both gates and attention logit of each passage."""
        h = np.tanh(x @ self.p["W"] + self.p["b"])
        g1, g2 = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-(h @ self.p["U"])))
        return h, g1, g2, (g1 * g2 @ self.p["w"])[:, 0]

    def bags(self, h: np.ndarray, e: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Attention, bag representation and score; passages of a document stand together."""
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
        a = np.exp(e - np.maximum.reduceat(e, starts)[group])
        a = a / np.add.reduceat(a, starts)[group]
        z = np.add.reduceat(a[:, None] * h, starts)
        return group, a, z, 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["d"])[:, 0]))

    def gradients(self, x: np.ndarray, doc: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p, (h, g1, g2, e) = self.p, self.passages(x)
        group, a, z, y = self.bags(h, e, doc)
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ds = ((y - target) / len(target)).astype(np.float32)[:, None]
        dz = (ds @ p["c"].T)[group]
        da = (h * dz).sum(1)
        de = (a * (da - np.add.reduceat(a * da, starts)[group]))[:, None]
        d1, d2 = de @ p["w"].T * g2 * (1 - g1 * g1), de @ p["w"].T * g1 * g2 * (1 - g2)
        dh = (a[:, None] * dz + d1 @ p["V"].T + d2 @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ d1, "U": h.T @ d2, "w": (g1 * g2).T @ de, "c": z.T @ ds, "d": ds.sum(0)}

    def fit(self, texts: list[bytes], labels: np.ndarray, most: int = TRAIN_PASSAGES, **how) -> Model:
        return self.fit_features([some_features(t, most) for t in texts], labels, **how)

    def fit_features(self, found: list[np.ndarray], labels: np.ndarray, steps: int = 1000, batch: int = 64, rate: float = 2e-3, decay: float = 1e-4) -> Model:
        """About ``steps`` minibatches, however many documents there are; ``found`` has the
        features of each document's passages."""
        self.start()
        epochs = max(1, round(steps * batch / max(batch, len(found))))
        x, edges = np.concatenate(found), np.concatenate([[0], np.cumsum([len(f) for f in found])])
        r, t = np.random.default_rng(self.seed), 0
        m, v = ({k: np.zeros_like(g) for k, g in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(found))
            step = rate * (1 - epoch / epochs)
            for i in range(0, len(order), batch):
                docs = order[i : i + batch]
                rows = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in docs])
                own = np.repeat(np.arange(len(docs)), [edges[d + 1] - edges[d] for d in docs])
                t += 1
                for k, g in self.gradients(x[rows].astype(np.float32), own, labels[docs]).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (1 - decay * (k in "WVU")) * self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.p:
            return np.full(len(texts), 0.5)
        h, e, doc = [], [], []
        for bags, owner in bags_of(texts):
            for a in range(0, len(bags.doc), STEP):
                of, _, _, logit = self.passages(bags.features(a, min(a + STEP, len(bags.doc))))
                h.append(of)
                e.append(logit)
            doc.append(owner)
        return self.bags(np.concatenate(h), np.concatenate(e), np.concatenate(doc))[3].astype(np.float64)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0: never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 4000, label: str = "quality", train_passages: int = TRAIN_PASSAGES) -> Model:
    """The model learned from at most ``sample_docs`` labelled documents that are not held out.

    The ids are chosen from the labels first, so only chosen texts leave the scan. Of rows that
    repeat an id the smallest text counts.
    """

    @F.arrow_udf("binary")
    def featured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(pa.array([some_features(t.as_py().encode(), train_passages).tobytes() for t in texts], pa.binary()) for texts in batches)

    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    found = sorted(rows.select("doc_id", "label", featured(F.col("text")).alias("x")).collect())  # at most sample_docs rows
    if not found:
        return Model()
    features = [np.frombuffer(r["x"], np.float16).reshape(-1, TRIGRAMS + STATS) for r in found]
    return Model().fit_features(features, np.array([min(1, max(0, r["label"])) for r in found], np.float32))


def with_score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the score of each text; other columns do not go through Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 70 kB

    def of(texts: pa.Array) -> pa.Array:
        scores = [sent.value.score(group) for group in groups((t.as_py() or "").encode() for t in texts)]
        return pa.array(np.concatenate(scores) if scores else [], pa.float64())

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(map(of, batches))

    return docs.withColumn(out, score(F.col("text").cast("string")))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_docs: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, sample_docs)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_docs: int = 4000) -> DataFrame:
    """The rows and columns of ``docs`` whose score is at least ``threshold``."""
    score = free_name("__quality_score", docs.columns)
    scored = with_score(docs, train(docs, labels, sample_docs), score)
    return scored.filter(F.col(score) >= threshold).select(*docs.columns)
