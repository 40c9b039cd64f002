"""Quality rules: base counts, and a linear-chain conditional random field over lines, decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.common import ensure_workers
from triagegrid.llm.wordhash import Texts, mix, words as hashed_words

# The characters that count as symbols, and the limits of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CONTENT_SHARE = 0.5

PRIME = np.uint64(0xD6E8FEB86659FD93)
SPACE, SYMBOL, UPPER, LOWER, DIGIT, MARK, WIDE = range(7)
CLASS = np.full(256, MARK, np.uint8)
CLASS[list(b" \t\n\v\f\r")] = SPACE
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = UPPER, LOWER, DIGIT, WIDE
CLASS[list(SYMBOLS)] = SYMBOL
FEATURES = 9


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    h = hashed_words(Texts(data, np.array([0, len(data)])), lower=False).hash
    kinds = np.bincount(CLASS[data], minlength=7)
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if len(h) >= 4:
        window = mix(mix(mix(h[:-2]) + h[1:-1] * PRIME) + h[2:])
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(h), bool)
        for i in range(3):
            covered[i : i + len(window)] |= twice
        repeat = int(covered.sum())
    return len(h), len(text) - int(kinds[SPACE]), int(kinds[SYMBOL]), dup, repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, words): a row of FEATURES numbers and the number of words for each line with a word."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    kind = CLASS[raw]
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    inside = kind != SPACE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    per = {k: np.add.reduceat((kind == k).astype(np.int64), starts) for k in (SYMBOL, UPPER, LOWER, DIGIT, MARK, WIDE)}
    words = np.add.reduceat(first.astype(np.int64), starts)
    chars = sum(per.values())
    keep = words > 0
    n, c = words[keep], np.maximum(1, chars[keep])
    letters = per[UPPER] + per[LOWER] + per[WIDE]
    x = np.stack([
        np.ones(len(n)),
        np.minimum(1.0, 4.0 * per[SYMBOL][keep] / c),
        per[UPPER][keep] / np.maximum(1, letters[keep]),
        per[DIGIT][keep] / c,
        np.minimum(1.0, 4.0 * per[MARK][keep] / c),
        letters[keep] / c,
        np.log1p(n) / 5.0,
        (n <= 3).astype(float),
        np.minimum(2.0, c / n / 8.0),
    ], axis=1)
    return x, n


@dataclass
class LineModel:
    """States 0 boilerplate, 1 content. emit: FEATURES x 2, move: from x to."""

    emit: np.ndarray
    move: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most likely states of a sequence of lines, by Viterbi; ties go to content."""
        score = x @ self.emit
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = score[0].tolist()
        back = np.zeros((len(x), 2), np.int8)
        for i, (e0, e1) in enumerate(score[1:].tolist(), 1):
            stay0, stay1 = a + m00 > b + m10, a + m01 > b + m11
            back[i] = (0 if stay0 else 1, 0 if stay1 else 1)
            a, b = e0 + (a + m00 if stay0 else b + m10), e1 + (a + m01 if stay1 else b + m11)
        out = np.zeros(len(x), np.int8)
        out[-1] = 0 if a > b else 1
        for i in range(len(x) - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def train(docs: list[tuple[np.ndarray, int]], rounds: int = 3, epochs: int = 5, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> LineModel:
    """Fit the field by stochastic gradient ascent of the conditional likelihood, with forward-backward sums.

    docs: (features of the lines, label). Lines of documents with label 1 are
    content. Lines of label 0 start as boilerplate; from the second round on
    those that the last round's field decodes as content are content, as poor
    documents hold good lines too. Without both labels all is content.
    """
    emit, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    if len({y for _, y in docs}) < 2:
        emit[0, 1] = 1.0
        return LineModel(emit, move)
    rng = np.random.default_rng(seed)
    states = [np.full(len(x), y, np.int8) for x, y in docs]
    for turn in range(rounds):
        if turn:
            model = LineModel(emit, move)
            states = [s if y else model.decode(x) for (x, y), s in zip(docs, states)]
        emit, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
        for epoch in range(epochs):
            for d in rng.permutation(len(docs)):
                x, gold = docs[d][0], np.eye(2)[states[d]]
                n, lr = len(x), rate / (1 + epoch)
                psi, trans = x @ emit, np.exp(move)
                e = np.exp(psi - psi.max(1, keepdims=True))
                alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
                alpha[0] = e[0] / e[0].sum()
                for i in range(1, n):
                    v = (alpha[i - 1] @ trans) * e[i]
                    alpha[i] = v / v.sum()
                for i in range(n - 2, -1, -1):
                    v = trans @ (e[i + 1] * beta[i + 1])
                    beta[i] = v / v.sum()
                gamma = alpha * beta
                gamma /= gamma.sum(1, keepdims=True)
                emit += lr * (x.T @ (gold - gamma) / n - decay * emit)
                if n > 1:
                    pair = alpha[:-1, :, None] * trans[None] * (e[1:] * beta[1:])[:, None, :]
                    pair /= pair.sum((1, 2), keepdims=True)
                    move += lr * ((gold[:-1].T @ gold[1:] - pair.sum(0)) / n - decay * move)
    return LineModel(emit, move)


def fit_lines(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 800, longest: int = 20_000) -> LineModel:
    """Train on a bounded sample: about `sample` documents of each label 0 and 1, of at most longest characters, chosen by a hash of the id.

    The chosen ids, about 2 * sample at any size of the tables, are broadcast.
    """
    ensure_workers(spark)
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = {r["quality"]: r["count"] for r in good.groupBy("quality").count().collect()}
    share = F.when(F.col("quality") == 1, min(1.0, sample / n.get(1, 1))).otherwise(min(1.0, sample / n.get(0, 1)))
    chosen = good.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) < share * 1_000_003)
    texts = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id").select("quality", "text")
    rows = [(line_features(r["text"])[0], int(r["quality"])) for r in texts.collect()]
    rows = sorted(((x, y) for x, y in rows if len(x)), key=lambda r: (r[1], len(r[0]), r[0].tobytes()))
    return train(rows)


def judge(spark: SparkSession, docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and verdict for every whole text.

    (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_lines, n_content_lines, content_words, kept). n_lines counts
    lines with a word. kept: the base rules hold and at least CONTENT_SHARE of
    the words stand in lines that are marked content. Null and empty texts have
    no words and fail; repeated rows give repeated results, null ids like any other;
    an empty table gives no rows; columns other than id and text are not read. Of
    equally likely labellings of lines the one that Viterbi meets first counts. A
    text of any length is read whole.
    """
    ensure_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_content_lines", "content_words", "kept"]
    types = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_()]

    def one(text: str | None) -> tuple:
        base = base_counts(text or "")
        failed = base_failed(base[0], base[4])
        if not base[0]:
            return (*base, failed, 0, 0, 0, False)
        x, words = line_features(text)
        good = shared.value.decode(x).astype(bool)
        content = int(words[good].sum())
        return (*base, failed, len(x), int(good.sum()), content, bool(not failed and content >= CONTENT_SHARE * base[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_lines bigint, n_content_lines bigint, content_words bigint, kept boolean")
