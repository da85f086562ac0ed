"""Language identification of code-switched text: a linear-chain conditional random field over words."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words are letters with their marks; longer runs (scripts without spaces) are parted into pieces of PIECE letters.
WORD, PIECE = regex.compile(r"\p{L}[\p{L}\p{M}]*"), 24
#: Feature buckets; labelled documents to learn from, for each language and in all, and characters of each; training sequences and their words.
BUCKETS, PER_LANGUAGE, MOST_DOCS, LEARNED, SEQUENCES, STEPS = 1 << 16, 250, 4000, 20_000, 1600, 40
ROUNDS, RATE, DECAY = 40, 0.3, 1e-4
#: Words in a stretch of the chain, words after which a block is handled, and words whose features are remembered.
STRETCH, BLOCK, REMEMBERED = 64, 100_000, 300_000
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    out = []
    for w in WORD.findall(text):
        w = w.lower()
        out += [w] if len(w) <= PIECE else [w[k : k + PIECE] for k in range(0, len(w), PIECE)]
    return out


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word: the word itself (lexicon), affixes of one to four letters, inner bigrams and trigrams."""
    w = word.encode("utf-8", "surrogatepass")
    out = [b"w" + w]
    for k in (1, 2, 3, 4):
        out += [b"p" + word[:k].encode("utf-8", "surrogatepass"), b"s" + word[-k:].encode("utf-8", "surrogatepass")]
    framed = f"^{word}$"
    for k in (2, 3):
        out += [b"n" + framed[i : i + k].encode("utf-8", "surrogatepass") for i in range(len(framed) - k + 1)]
    return [zlib.crc32(x) % BUCKETS for x in out]


class Crf:
    """Weights of features by label and of transitions."""

    def __init__(self, labels: list[str], emit: np.ndarray, move: np.ndarray):
        self.labels, self.emit, self.move = labels, emit, move
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of each word's label scores, scaled to a largest value of 1."""
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, []
        fresh = sorted({w for w in words if w not in self.known})
        if fresh:
            feats = [features(w) for w in fresh]
            cuts = np.cumsum([0] + [len(f) for f in feats[:-1]])
            score = np.add.reduceat(self.emit[np.concatenate(feats)], cuts, axis=0)
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.rows.append(np.exp(score - score.max(axis=1, keepdims=True)))
            self.rows = [np.concatenate(self.rows)]
        return self.rows[0][[self.known[w] for w in words]]

    def posteriors(self, words: list[list[str]]) -> list[np.ndarray]:
        """Label probabilities of each word, by forward-backward over each text's whole chain.

        Texts are cut into stretches, handled side by side: each stretch's transfer matrix comes first, the matrices
        give the messages at its ends, and with these each stretch runs forward and backward on its own. That is exact.
        """
        n_labels, move = len(self.labels), np.exp(self.move - self.move.max())
        sizes = np.array([len(w) for w in words])
        flat = self.emissions([x for w in words for x in w])
        count = -(-sizes // STRETCH)
        first = np.cumsum(count) - count
        e = np.ones((int(count.sum()), STRETCH, n_labels))
        held = np.zeros((len(e), STRETCH), dtype=bool)
        start = np.cumsum(sizes) - sizes
        inner = np.arange(len(flat)) - np.repeat(start, sizes)
        at = np.repeat(first, sizes) + inner // STRETCH, inner % STRETCH
        e[at], held[at] = flat, True
        full = np.broadcast_to(np.eye(n_labels), (len(e), n_labels, n_labels)).copy()
        for t in range(STRETCH):
            step = (full @ move) * e[:, t, None, :]
            full = np.where(held[:, t, None, None], step / step.max(axis=(1, 2), keepdims=True), full)
        ahead, behind = np.full((len(e), n_labels), 1 / n_labels), np.full((len(e), n_labels), 1 / n_labels)
        for k in range(1, int(count.max(initial=0))):
            own = first[count > k] + k
            a = np.einsum("il,ilm->im", ahead[own - 1], full[own - 1])
            ahead[own] = a / a.sum(axis=1, keepdims=True)
            back = first[count > k] + count[count > k] - 1 - k
            b = np.einsum("ilm,im->il", full[back + 1], behind[back + 1])
            behind[back] = b / b.sum(axis=1, keepdims=True)
        alpha = np.empty_like(e)
        for t in range(STRETCH):
            a = (ahead @ move) * e[:, t]
            ahead = np.where(held[:, t, None], a / a.sum(axis=1, keepdims=True), ahead)
            alpha[:, t] = ahead
        for t in range(STRETCH - 1, -1, -1):
            alpha[:, t] *= behind
            b = (e[:, t] * behind) @ move.T
            behind = np.where(held[:, t, None], b / b.sum(axis=1, keepdims=True), behind)
        p = alpha[at]
        p /= p.sum(axis=1, keepdims=True)
        return np.split(p, start[1:]) if len(sizes) else []

    def classify(self, texts: list[str]) -> list[tuple[str, float]]:
        """The label with the most word probability and its share; UNKNOWN for a text without letters."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.labels:
            return out
        own: list[int] = []
        found: list[list[str]] = []

        def settle() -> None:
            for k, p in zip(own, self.posteriors(found), strict=True):
                share = p.mean(axis=0)
                out[k] = self.labels[int(share.argmax())], float(min(1.0, share.max()))
            own.clear()
            found.clear()

        size = 0
        for k, text in enumerate(texts):
            words = words_of(text)
            if words:
                own.append(k)
                found.append(words)
                size += len(words)
            if size >= BLOCK:
                settle()
                size = 0
        if own:
            settle()
        return out


def train(rows: list[tuple[str, str]], seed: int = 7) -> Crf:
    """Fit on (language, text): sequences of words that switch between languages, by gradients of the log-likelihood."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in rows})
    by = {lang: [w for w in (words_of(t) for own, t in rows if own == lang) if w] for lang in labels}
    labels = [lang for lang in labels if by[lang]]
    if len(labels) < 2:
        return Crf(labels, np.zeros((BUCKETS, len(labels))), np.zeros((len(labels), len(labels))))
    words, truth = [], np.zeros((SEQUENCES, STEPS), dtype=np.int64)
    for s in range(SEQUENCES):
        line: list[str] = []
        while len(line) < STEPS:
            k = int(rng.integers(len(labels)))
            text = by[labels[k]][int(rng.integers(len(by[labels[k]])))]
            at, n = int(rng.integers(len(text))), int(rng.integers(6, STEPS))
            got = text[at : at + n][: STEPS - len(line)]
            truth[s, len(line) : len(line) + len(got)] = k
            line += got
        words += line
    vocab, which = np.unique(np.array(words, dtype=object), return_inverse=True)
    feats = [features(w) for w in vocab]
    flat, owner = np.concatenate(feats), np.repeat(np.arange(len(vocab)), [len(f) for f in feats])
    cuts = np.cumsum([0] + [len(f) for f in feats[:-1]])
    n = len(labels)
    emit, move = np.zeros((BUCKETS, n)), np.zeros((n, n))
    emit_sq, move_sq = np.full((BUCKETS, n), 1e-8), np.full((n, n), 1e-8)
    onehot = np.eye(n)[truth]
    pairs = np.einsum("stl,stm->lm", onehot[:, :-1], onehot[:, 1:])
    for _ in range(ROUNDS):
        score = np.add.reduceat(emit[flat], cuts, axis=0)[which].reshape(SEQUENCES, STEPS, n)
        e, m = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(move - move.max())
        alpha, beta = np.empty_like(e), np.ones_like(e)
        a = np.full((SEQUENCES, n), 1 / n)
        for t in range(STEPS):
            a = (a @ m) * e[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, t] = a
        expected = np.zeros((n, n))
        for t in range(STEPS - 2, -1, -1):
            b = e[:, t + 1] * beta[:, t + 1]
            both = alpha[:, t, :, None] * m * b[:, None, :]
            expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ m.T
            beta[:, t] = b / b.sum(axis=1, keepdims=True)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        wrong = (onehot - p).reshape(-1, n)
        by_word = np.stack([np.bincount(which, wrong[:, k], len(vocab)) for k in range(n)], axis=1)
        grad = np.stack([np.bincount(flat, by_word[owner, k], BUCKETS) for k in range(n)], axis=1) / SEQUENCES - DECAY * emit
        grad_move = (pairs - expected) / SEQUENCES - DECAY * move
        emit_sq += grad**2
        move_sq += grad_move**2
        emit += RATE * grad / np.sqrt(emit_sq)
        move += RATE * grad_move / np.sqrt(move_sq)
    return Crf(labels, emit, move)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame) -> Crf:
    """Learn from a bounded sample of labelled documents, drawn by a hash of the id.

    The first PER_LANGUAGE documents of each language stand in line, the first of every language before the second of
    any, and MOST_DOCS in all are taken, so each language is learned. A stretch of at most LEARNED characters, its place drawn
    by the hash too, is read of each. Ties are broken by the text's hash; equal rows are interchangeable.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    k, tag = F.xxhash64("doc_id", F.lit(3)), F.xxhash64("text")
    order = Window.partitionBy("lang").orderBy("k", "tag")
    first = rows.select("lang", k.alias("k"), tag.alias("tag")).withColumn("row", F.row_number().over(order)).where(F.col("row") <= PER_LANGUAGE)
    # MOST_DOCS rows at most, so the broadcast is bounded
    asked = F.broadcast(first.orderBy("row", "k", "lang", "tag").limit(MOST_DOCS).select("lang", "k", "tag").distinct())
    at = F.pmod(k, F.greatest(F.length("text") - LEARNED, F.lit(0)) + 1).cast("int") + 1
    own = rows.select("lang", k.alias("k"), tag.alias("tag"), F.substring("text", at, F.lit(LEARNED)).alias("text"))
    got = own.join(asked, ["lang", "k", "tag"], "left_semi").orderBy("k", "lang", "text").limit(MOST_DOCS).collect()
    if not got:
        return Crf([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)))
    return train([(r.lang, r.text) for r in got])


def with_language(docs: DataFrame, model: Crf, lang: str = "_lang", score: str = "_score") -> DataFrame:
    """Append two columns, the language and its score, to each document, from its text alone. Their names must be new ones."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.emit.astype(np.float32), model.move))
    state: dict = {}

    def run(texts: list[str]) -> list[pa.Array]:
        if "crf" not in state:
            state["crf"] = Crf(*shared.value)
        got = state["crf"].classify(texts)
        return [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]

    return common.map_texts(docs, "text", run, [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; null text and text without letters are ``und``, score 0.

    Of equal shares the label first in order wins. Repeated rows each have a row, with one prediction. Only doc_id,
    text and lang are read, so other columns of any name don't matter; without labelled documents all is ``und``; an
    empty table gives an empty one. A very long text is one chain of words, handled in stretches of STRETCH words.
    """
    got = with_language(docs.select("doc_id", "text"), fit(docs))
    return got.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.round("_score", 6).alias("score"))
