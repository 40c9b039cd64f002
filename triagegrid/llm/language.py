"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid.llm.common import ensure_workers, frugal

UNKNOWN = "und"
BITS = 14
ORDERS = (2, 3, 4)
CHUNK = 1 << 20
REJECTED = 0.001


def has_letter(text: str) -> bool:
    """Whether a character of Unicode category L stands in the text."""
    return any(map(str.isalpha, text))


def subword_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of hashed character n-grams (ORDERS) of the whole lower-cased text, in 2**bits buckets.

    ASCII characters that are not letters count as a space. Long texts go in
    chunks that overlap by the longest n-gram less one, so memory is bounded.
    """
    out = np.zeros(1 << bits, np.float32)
    low = text.lower()
    for at in range(0, max(1, len(low)), CHUNK):
        part = low[at : at + CHUNK + max(ORDERS) - 1]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where((code < 128) & ((code < 97) | (code > 122)), np.uint32(32), code)
        mixed = code * np.uint32(2654435761)
        rolled = mixed
        for n in range(2, max(ORDERS) + 1):
            if len(code) < n:
                break
            rolled = rolled[:-1] * np.uint32(16777619) + mixed[n - 1 :]
            if n in ORDERS:
                starts = min(CHUNK, len(rolled))
                out += np.bincount(rolled[:starts] >> np.uint32(32 - bits), minlength=1 << bits)
    return out


@dataclass
class LanguageModel:
    """scores is the product of embedding and output matrix: averaging and the linear layer commute."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int = BITS
    foreign_rejected: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); (UNKNOWN, 0.0) for null, without letters or without a learned language."""
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        counts = subword_counts(text, self.bits)
        logits = (counts @ self.scores / max(1.0, float(counts.sum())) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


class Example(NamedTuple):
    """A text as the counts of its subwords, 4 bytes for each that it has: kind is text, window, head (a held-back text's beginning) or foreign (the same with its letters in another order)."""

    key: int
    kind: str
    lang: str
    at: np.ndarray
    count: np.ndarray

    def share(self) -> np.ndarray:
        return shares_of(self.count)


def shares_of(count: np.ndarray) -> np.ndarray:
    return (count / max(1.0, float(count.sum()))).astype(np.float32)


def held_back(key: int) -> bool:
    return key % 5 == 0


def examples(key: int, text: str, lang: str) -> Iterator[Example]:
    """What is learned from a text: itself and two windows of 20 to 200 characters; of a held-back one also head and foreign. Chance comes from the key."""
    rng = np.random.default_rng(key % (1 << 63))

    def counted(kind: str, part: str) -> Example:
        c = subword_counts(part)
        at = np.flatnonzero(c)
        return Example(key, kind, lang, at.astype(np.uint16), np.minimum(c[at], 65535).astype(np.uint16))  # BITS are fewer than 16

    yield counted("text", text)
    for _ in range(2):
        n = int(rng.integers(20, 201))
        at = int(rng.integers(0, max(1, len(text) - n)))
        if has_letter(text[at : at + n]):
            yield counted("window", text[at : at + n])
    if held_back(key):
        yield counted("head", text[:2000])
        yield counted("foreign", "".join(rng.permutation(list(text[:2000]))))


def train(rows: list[tuple[str, str]], **how) -> LanguageModel:
    """fit() on (text, lang) rows."""
    return fit([e for i, (text, lang) in enumerate(sorted(rows)) for e in examples(i, text, lang)], **how)


def fit(given: list[Example], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Fit on examples by mini-batch SGD in numpy.

    A fifth of the texts is held back: on it the temperature is chosen by log loss (texts in two languages count half for each),
    and reject_below is the quantile that leaves REJECTED of what must stay below
    it: right answers, and texts half in one known language and half in another,
    which are two held-back ones' heads in equal parts. foreign_rejected tells how many texts of no known language
    (held-back ones with their letters in another order) it rejects.
    """
    rng = np.random.default_rng(seed)
    given = sorted(given, key=lambda e: (e.key, e.kind, e.lang, len(e.at)))
    langs = sorted({e.lang for e in given})
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    number = {lang: i for i, lang in enumerate(langs)}
    known = [(e.at, e.count, number[e.lang]) for e in given if e.kind in ("text", "window") and not held_back(e.key)]
    check = [(e.at, e.count, number[e.lang]) for e in given if e.kind in ("text", "window") and held_back(e.key)]
    heads = [e for e in given if e.kind == "head"]
    foreign = [(e.at, e.count) for e in given if e.kind == "foreign"]
    mixed = [(np.concatenate([a.at, b.at]), np.concatenate([a.share(), b.share()]) / 2, number[a.lang], number[b.lang]) for a, b in zip(heads, heads[1:]) if a.lang != b.lang]
    if not known:
        known, check = check, []
    fit = known
    size = 1 << BITS
    emb = rng.normal(0, 0.1, (size, dim)).astype(np.float32)
    out = np.zeros((dim, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    count = np.bincount([y for *_, y in fit], minlength=len(langs))
    weight = (len(fit) / (len(langs) * np.maximum(1, count))).astype(np.float32)
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            at, c, y = fit[i]
            v = shares_of(c)
            lr = rate * (1 - step / steps) * weight[y]
            step += 1
            hidden = v @ emb[at]
            z = hidden @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            down = out @ g
            out -= lr * np.outer(hidden, g)
            bias -= lr * 0.1 * g
            emb[at] -= (lr * 20.0) * np.outer(v, down)
    model = LanguageModel(langs, emb @ out, bias, 1.0, 0.0)
    if check:
        y = np.array([k for *_, k in check])
        logits = lambda rows: np.stack([shares_of(c) @ model.scores[at] + bias for at, c, *_ in rows])

        def spread(z: np.ndarray, t: float) -> np.ndarray:
            p = np.exp((z - z.max(1, keepdims=True)) / t)
            return p / p.sum(1, keepdims=True)

        z = logits(check)
        both = logits(mixed) if mixed else np.zeros((0, len(langs)))
        told = lambda p, ks: np.log(p[np.arange(len(p)), ks] + 1e-12)

        def log_loss(t: float) -> float:
            """Of held-back answers, and of texts in two languages, where half the probability belongs to each."""
            half = [told(spread(both, t), np.array([m[i] for m in mixed], int)) / 2 for i in (2, 3)]
            return -float((told(spread(z, t), y).sum() + half[0].sum() + half[1].sum()) / (len(y) + len(mixed)))

        model.temperature = min((0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=log_loss)
        p = spread(z, model.temperature)
        stay = p.max(1)[p.argmax(1) == y]
        if mixed:
            stay = np.concatenate([stay, spread(both, model.temperature).max(1)])
        if len(stay):
            model.reject_below = float(np.quantile(stay, REJECTED))
        model.foreign_rejected = float((spread(logits(foreign), model.temperature).max(1) < model.reject_below).mean())
    return model


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1200, longest: int = 2_000) -> LanguageModel:
    """Train on a bounded sample of labelled rows: about per_lang texts of each language, of at most longest characters.

    Rows are chosen by a hash of their id, alike at every size; of a longer text
    the sample holds a window of that length, which starts at a place chosen by the
    hash. Tasks send the subwords of the sample, not its texts, to one task, which fits
    the model: the driver gets the model alone, of one size whatever the sample. Texts that are null or have no letter and null languages are not learned
    from; an empty table gives a model that answers UNKNOWN.
    """
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    known = known.where(F.col("l").isNotNull() & F.col("i").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = known.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    chance = F.pmod(F.xxhash64("i", F.lit(9)), F.lit(1_000_003)) * F.col("n") < F.lit(per_lang) * 1_000_003
    at = F.pmod(F.xxhash64("i", F.lit(10)), F.greatest(F.lit(1), F.length("t") - longest + 1)).cast("int") + 1
    key = F.xxhash64("i", F.lit(11)).bitwiseAND((1 << 62) - 1)
    chosen = known.join(counts, "l").where(chance).select(key.alias("key"), F.substring("t", at, F.lit(longest)).alias("t"), "l").where(F.col("t").rlike(r"\p{L}"))
    ensure_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3))):
                made = list(examples(*row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e.key for e in made]), pa.array([e.kind for e in made]), pa.array([e.lang for e in made], pa.string()), pa.array([e.at.tobytes() for e in made], pa.binary()), pa.array([e.count.tobytes() for e in made], pa.binary())],
                    names=["key", "kind", "lang", "at", "count"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = []
        for b in batches:
            for key, kind, lang, at, count in zip(*(c.to_pylist() for c in b.columns)):
                given.append(Example(key, kind, lang, np.frombuffer(at, np.uint16), np.frombuffer(count, np.uint16)))
        m = fit(given)
        row = {"langs": m.langs, "scores": m.scores.tobytes(), "bias": m.bias.tobytes(), "temperature": m.temperature, "reject_below": m.reject_below, "foreign_rejected": m.foreign_rejected}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("langs", pa.list_(pa.string())), ("scores", pa.binary()), ("bias", pa.binary()), *((c, pa.float64()) for c in ("temperature", "reject_below", "foreign_rejected"))]))

    sent = chosen.mapInArrow(frugal(run), "key bigint, kind string, lang string, at binary, count binary").repartition(1)
    got = sent.mapInArrow(frugal(learn), "langs array<string>, scores binary, bias binary, temperature double, reject_below double, foreign_rejected double").collect()
    if not got:
        return fit([])
    m = got[0]
    scores = np.frombuffer(m["scores"], np.float32).reshape(1 << BITS, len(m["langs"]))
    return LanguageModel(list(m["langs"]), scores, np.frombuffer(m["bias"], np.float32), m["temperature"], m["reject_below"], foreign_rejected=m["foreign_rejected"])


def identify(spark: SparkSession, docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Language of every whole text: (id, *keep, lang_pred, score, rejected).

    Null text, empty text and text without letters: 'und', score 0, rejected.
    Rejected otherwise where the calibrated score is under the model's reject_below.
    Of languages with the same probability the first by name is told. Repeated
    rows give repeated results; an empty table gives an empty result; columns other
    than id, text and keep are not read. Kept columns may not be called lang_pred,
    score or rejected; `prefix` names the three otherwise.
    """
    ensure_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col), *[F.col(c) for c in keep if c != text_col], F.col(text_col).alias("__text"))
    rest = [f for f in src.schema.fields if f.name != "__text"]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ([f"`{text_col}` string"] if text_col in keep else []) + [f"{prefix}lang_pred string", f"{prefix}score double", f"{prefix}rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("__text"))
            got = [m.predict(t.as_py()) for t in texts]
            cols = [b.column(i) for i in range(len(rest))] + ([texts] if text_col in keep else [])
            names = [f.name for f in rest] + ([text_col] if text_col in keep else [])
            cols += [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == UNKNOWN or g[1] < m.reject_below for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *(prefix + c for c in ("lang_pred", "score", "rejected"))])

    return src.mapInArrow(frugal(run), ddl)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
