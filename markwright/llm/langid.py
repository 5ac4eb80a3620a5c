"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is lower-cased and cut into runs of letters. Each run gives itself and its byte n-grams (2 to 5, with
word-boundary marks) as features, hashed into ``BUCKETS`` rows of an embedding table. A text is the mean of its
features' rows; a linear softmax over that mean gives the languages. As the mean is linear, each distinct word's sum
of logits is worked out once and a whole text is a sum over its words. Runs of any length count whole; new ones are
worked through in batches of ``BYTES_AT_ONCE``, a longer one in parts.

Training reads a bounded sample (``per_language`` rows of each label at most in expectation, chosen by a hash of the
id; this is the documented bound), cut into spans of various lengths so that short texts are covered, of which a text
gives ``SPANS`` at most, picked at random (both are bounds of the training sample alone; of more than ``MOST_LABELS``
labels the most frequent ones are learned). A fifth of the sample is kept out of the gradient steps; on its spans a
temperature is fitted, so that scores are probabilities.
Rejection is calibrated on its whole documents, and on their spans for short texts, in groups of similar length: a text
is rejected if its score, or the familiarity of its features (their mean log frequency in training, which tells
other languages and letter junk even where one language is learned), is below what all but ``reject_rate`` of the right
answers of its length reach. Samples of under 20 rows have no calibration, and reject only texts without letters.

Results: a text that is null or has no letter is ``und`` with score 0 and is rejected. Repeated rows get equal
results; an empty table gives an empty result; without labelled rows every text is ``und``. Columns other than those
named are ignored; label and source are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markwright.llm.common import mix64, tidy

BUCKETS = 1 << 16
DIM = 16
PER_LANGUAGE = 400
ROWS_AT_ONCE = 1000
BYTES_AT_ONCE = 1 << 17
LONGEST = 5
SPANS = 12
MOST_LABELS = 1000
LONG_RUN = 64
PIECE = 16
GROUP = 300  # right answers, of similar length, that share a threshold
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray  # buckets x dim
    weights: np.ndarray  # dim x languages
    bias: np.ndarray
    temperature: float = 1.0
    familiar: np.ndarray | None = None  # buckets: log frequency in training
    lengths: np.ndarray | None = None  # each group's least number of features
    least_score: np.ndarray | None = None
    least_familiar: np.ndarray | None = None

    def rejects(self, score: float, familiar: float, n: float) -> bool:
        if self.lengths is None:
            return False
        group = max(0, int(np.searchsorted(self.lengths, n, side="right")) - 1)
        return bool(score < self.least_score[group] or familiar < self.least_familiar[group])


def _grams(raw: np.ndarray, left: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, where n-grams begin before ``upto`` and their buckets. ``left``: bytes to the end of the word."""
    h = np.zeros(len(raw), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        part = np.zeros(len(raw), dtype=np.uint64)
        part[: max(0, len(raw) - n + 1)] = raw[n - 1 :]
        h = h * np.uint64(0x100000001B3) + part + np.uint64(n)
        if n >= 2:
            keep = np.flatnonzero(left[:upto] >= n)
            yield keep, (mix64(h[keep]) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _marked(word: str) -> bytes:
    return b"<" + word.encode("utf-8", "replace") + b">"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each feature of each word, and where each word's features begin."""
    marked = [_marked(w) for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    raw = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(raw))
    buckets, owner = [], []
    with np.errstate(over="ignore"):
        for keep, found in _grams(raw, left, len(raw)):
            buckets.append(found)
            owner.append(word[keep])
        whole = np.add.reduceat(mix64(raw + left.astype(np.uint64) * np.uint64(256)), ends - sizes) if len(sizes) else np.zeros(0, np.uint64)
    buckets.append((mix64(whole) & np.uint64(BUCKETS - 1)).astype(np.int32))
    owner.append(np.arange(len(words)))
    own = np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(len(words)))
    return np.concatenate(buckets)[order], starts


def long_subwords(word: str, at_once: int) -> Iterator[np.ndarray]:
    """The buckets that ``subwords`` gives for one word, in parts of ``at_once`` bytes of it."""
    data = _marked(word)
    whole = np.zeros(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), at_once):
            raw = np.frombuffer(data[at : at + at_once + LONGEST - 1], dtype=np.uint8).astype(np.uint64)
            left, own = len(data) - at - np.arange(len(raw)), min(at_once, len(data) - at)
            yield np.concatenate([found for _, found in _grams(raw, left, own)])
            whole += mix64(raw[:own] + left[:own].astype(np.uint64) * np.uint64(256)).sum(dtype=np.uint64)
        yield (mix64(whole) & np.uint64(BUCKETS - 1)).astype(np.int32)


def _spans(words: list[str], rng: np.random.Generator) -> list[list[str]]:
    """Cuts a text's words into spans of 1 to 64, so that all of it is used and short texts are practised.

    A run of over ``LONG_RUN`` letters, as scripts without spaces have, counts as consecutive words of ``PIECE`` letters.
    """
    words = [part for w in words for part in ([w] if len(w) <= LONG_RUN else [w[i : i + PIECE] for i in range(0, len(w), PIECE)])]
    out, at = [], 0
    while at < len(words):
        n = int(2 ** rng.uniform(0, 6))
        out.append(words[at : at + n])
        at += n
    return out


def fit(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 3, rate: float = 0.5, batch: int = 64, reject_rate: float = 0.001) -> Model:
    """``rows``: (text, language)."""
    languages = sorted({lang for _, lang in rows})
    label = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    model = Model(languages, rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    if not languages:
        return model
    model.weights += rng.normal(0, 0.1, model.weights.shape).astype(np.float32)
    train: list[tuple[np.ndarray, int]] = []
    check: list[tuple[np.ndarray, int]] = []
    kept_out: list[tuple[str, str]] = []
    for i, (text, lang) in enumerate(rows):
        spans = _spans(LETTERS.findall((text or "").lower()), rng)
        if spans and i % 5 == 0 and len(rows) >= 20:
            kept_out += [(text, lang), *((" ".join(span), lang) for span in spans[:4])]
        if len(spans) > SPANS:
            spans = [spans[j] for j in rng.permutation(len(spans))[:SPANS]]
        for span in spans:
            (check if i % 5 == 0 and len(rows) >= 20 else train).append((subwords(span)[0], label[lang]))
    epochs = max(epochs, min(40, 60_000 // max(1, len(train))))  # small samples are passed more often
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(train))
        for at in range(0, len(order), batch):
            picked = [train[j] for j in order[at : at + batch]]
            sizes = np.array([len(x) for x, _ in picked])
            ids = np.concatenate([x for x, _ in picked])
            owner = np.repeat(np.arange(len(picked)), sizes)
            mean = np.add.reduceat(model.embedding[ids], np.cumsum(sizes) - sizes) / sizes[:, None]
            logits = mean @ model.weights + model.bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(picked)), [y for _, y in picked]] -= 1
            back = (p @ model.weights.T) / sizes[:, None]
            model.weights -= step * (mean.T @ p) / 8
            model.bias -= step * p.sum(0) / 8
            np.add.at(model.embedding, ids, (-step * back).astype(np.float32)[owner])
    if check:
        counts = np.zeros(BUCKETS)
        for ids, _ in train:
            counts += np.bincount(ids, minlength=BUCKETS)
        model.familiar = np.log((counts + 0.5) / (counts.sum() + 0.5 * BUCKETS))
        _fit_temperature(model, check)
        _calibrate(model, kept_out, reject_rate)
    return model


def _fit_temperature(model: Model, check: list[tuple[np.ndarray, int]]) -> None:
    logits = np.array([model.embedding[x].mean(0) @ model.weights + model.bias for x, _ in check])
    truth = np.array([y for _, y in check])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]))

    model.temperature = float(min(np.geomspace(0.05, 10, 80), key=loss))


def _calibrate(model: Model, kept_out: list[tuple[str, str]], reject_rate: float) -> None:
    found = judge(model, [text for text, _ in kept_out])
    right = np.array([(n, score, familiar) for (lang, score, familiar, n), (_, truth) in zip(found, kept_out, strict=True) if lang == truth])
    if len(right):
        groups = np.array_split(right[np.argsort(right[:, 0], kind="stable")], max(1, len(right) // GROUP))
        model.lengths = np.array([g[0, 0] for g in groups])
        model.least_score = np.array([np.quantile(g[:, 1], reject_rate) for g in groups])
        model.least_familiar = np.array([np.quantile(g[:, 2], reject_rate) for g in groups])


class WordLogits(dict):
    """word -> row in a table of summed logits, summed familiarity and numbers of features; filled in batches, bounded by the two limits."""

    LIMIT = 150_000
    LETTERS_LIMIT = 8_000_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.pending: list[str] = []
        self.letters = 0
        self.rows = np.zeros((1024, len(model.languages) + 2), dtype=np.float64)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.pending.append(word)
        self.letters += len(word)
        return at

    def full(self) -> bool:
        return len(self) > self.LIMIT or self.letters > self.LETTERS_LIMIT

    def clear(self) -> None:
        super().clear()
        self.letters = 0

    def _batches(self) -> Iterator[tuple[int, int]]:
        """Ranges of pending words of ``BYTES_AT_ONCE`` in all, or of one longer word."""
        low = held = 0
        for at, word in enumerate(self.pending):
            size = len(word.encode("utf-8", "replace")) + 2
            if at > low and held + size > BYTES_AT_ONCE:
                yield low, at
                low, held = at, 0
            held += size
        if self.pending:
            yield low, len(self.pending)

    def settle(self) -> None:
        if len(self) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(self), self.rows.shape[1]))])
        first = len(self) - len(self.pending)
        familiar = np.zeros(BUCKETS) if self.model.familiar is None else self.model.familiar
        for low, high in self._batches():
            part = self.rows[first + low : first + high]
            if high - low == 1:
                sums, known, n = np.zeros((1, self.model.embedding.shape[1])), 0.0, 0
                for ids in long_subwords(self.pending[low], BYTES_AT_ONCE):
                    sums += self.model.embedding[ids].sum(0, dtype=np.float64)
                    known += familiar[ids].sum()
                    n += len(ids)
                counts = np.array([n])
            else:
                ids, starts = subwords(self.pending[low:high])
                sums, counts = np.add.reduceat(self.model.embedding[ids].astype(np.float64), starts), np.diff(np.append(starts, len(ids)))
                known = np.add.reduceat(familiar[ids], starts)
            part[:, :-2] = sums @ self.model.weights
            part[:, -2] = known
            part[:, -1] = counts
        self.pending = []


def predict(model: Model, texts: list[str | None], words: WordLogits | None = None) -> tuple[list[str], list[float]]:
    found = judge(model, texts, words)
    return [f[0] for f in found], [f[1] for f in found]


def judge(model: Model, texts: list[str | None], words: WordLogits | None = None) -> list[tuple[str, float, float, float]]:
    """Each text's language, score, familiarity and number of features."""
    words = WordLogits(model) if words is None else words
    out = [(UNDETERMINED, 0.0, 0.0, 0.0)] * len(texts)
    if not model.languages:
        return out
    if words.full():
        words.clear()
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def settle() -> None:
        words.settle()
        for i, ids in waiting:
            total = words.rows[ids].sum(0)
            z = (total[:-2] / total[-1] + model.bias) / model.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            out[i] = model.languages[best], float(p[best]), float(total[-2] / total[-1]), float(total[-1])
        waiting.clear()

    for i, text in enumerate(texts):
        found = LETTERS.findall(text.lower()) if text else []
        if not found or not any(map(str.isalpha, text)):
            continue
        waiting.append((i, np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found))))
        held += len(found)
        if held > 100_000 or words.full():
            settle()
            held = 0
            if words.full():
                words.clear()
    settle()
    return out


def sample(docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE, seed: int = 11) -> list[tuple[str, str]]:
    """At most about ``per_language`` rows of each label, chosen by a hash of the id among those ``learn_from`` allows."""
    rows = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), per_language / F.col("_n"))
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(sizes.orderBy(F.desc("_n"), "_lang").limit(MOST_LABELS)), F.col("lang") == F.col("_lang")).where(spread < share)
    return sorted((r["text"], r["lang"]) for r in chosen.select("text", "lang").collect())


def train(docs: DataFrame, learn_from: Column, per_language: int = PER_LANGUAGE) -> Model:
    return fit(sample(docs, learn_from, per_language))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected added (columns of those names are replaced)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: BUCKETS x DIM floats

    at = kept.index("text")

    def run(batches: Iterator):
        import pyarrow as pa

        known = shared.value
        words = WordLogits(known)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(lo, ROWS_AT_ONCE)
                found = judge(known, batch.column(at).to_pylist(), words)
                langs, scores = [f[0] for f in found], [f[1] for f in found]
                flags = [lang == UNDETERMINED or known.rejects(*rest) for lang, *rest in found]
                new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())]
                yield pa.RecordBatch.from_arrays(batch.columns + new, names=[*kept, "lang_pred", "score", "rejected"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*kept).mapInArrow(tidy(run), schema)
