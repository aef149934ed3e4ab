"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are runs of 2 to 4 UTF-8 bytes of a word with its edges. A text's vector is the mean of its
subwords' embeddings; once trained, embeddings and softmax fold into one small table of scores. The
scores' temperature and the confidence below which a prediction is rejected are set on rows that the
training leaves aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clarifex.llm.common import of, text_bytes

#: Hash bins, width of an embedding, subword lengths in bytes.
BINS, WIDTH, LENGTHS = 1 << 15, 16, (2, 3, 4)
#: The bounded training sample: rows of each language and of all at most, and languages at most.
PER_LANGUAGE, SAMPLE, MAX_LANGUAGES = 600, 12_000, 200
EPOCHS, RATE, BATCH, SEED = 6, 2.0, 16, 7
#: Predictions are rejected below the confidence that this share of right calibration predictions reaches.
KEEP_RIGHT = 0.995
#: ASCII letters in lower case, bytes of other letters as they are, all else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII, _LETTER = re.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII.search(text) or not text.isascii() and _LETTER.search(text.decode()))


def subwords(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the bins of all subwords and the number of the text of each; a space stands at edges of words only."""
    lines = [b" " + t.translate(FOLD) + b" " for t in texts]
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    raw = np.frombuffer(b"".join(lines), np.uint8)
    space, wide = raw == 32, raw.astype(np.uint32)
    for n in LENGTHS:
        if len(raw) < n:
            return
        ok = ~(space[: len(raw) - n + 1] & space[1 : len(raw) - n + 2])
        code = wide[: len(raw) - n + 1].copy()
        for k in range(1, n):
            code = code * np.uint32(257) + wide[k : len(raw) - n + 1 + k]
            if k < n - 1:
                ok &= ~space[k : len(raw) - n + 1 + k]
        at = np.flatnonzero(ok)
        mixed = (code[at] ^ np.uint32(n * 0x01000193)) * np.uint32(0x9E3779B1)
        yield (mixed >> np.uint32(32 - (BINS.bit_length() - 1))).astype(np.int32), owner[at]


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct bins and their counts, over the whole text."""
    found = list(subwords(texts))
    out = []
    for k in range(len(texts)):
        out.append(np.unique(np.concatenate([b[np.searchsorted(o, k) : np.searchsorted(o, k, side="right")] for b, o in found] or [np.zeros(0, np.int32)]), return_counts=True))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row of scores for each bin: embeddings and softmax in one
    bias: np.ndarray
    temperature: float
    least: float  # the confidence below which a prediction is rejected

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for bins, owner in subwords(texts):
            if len(bins):
                starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                total[owner[starts]] += np.add.reduceat(self.table[bins], starts, axis=0, dtype=np.float64)
                n += np.bincount(owner, minlength=len(texts))
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.scores(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, bins, counts) of up to about ``per_language`` rows of each language, chosen by a hash of the row; texts stay on the executors."""
    known = docs.where(F.col(f"`{lang_col}`").isNotNull())
    sizes = known.groupBy(F.col(f"`{lang_col}`").alias("_lang")).count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MAX_LANGUAGES} values")
    if not sizes:
        return []
    per_language = min(per_language, SAMPLE // len(sizes))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[0], min(1.0, per_language / r[1]))])
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`"), F.length(f"`{text_col}`")), F.lit(1_000_003)) / 1_000_003.0
    rows = known.where(draw < share[F.col(f"`{lang_col}`")]).select(F.col(f"`{lang_col}`"), F.col(f"`{text_col}`"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches, 1 << 20):
            found = bags(text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], ["lang", "bins", "counts"])

    got = rows.mapInArrow(each, "lang string, bins binary, counts binary").limit(2 * per_language * len(sizes)).collect()
    out = [(r.lang, np.frombuffer(r.bins, "<i4"), np.frombuffer(r.counts, "<i4").astype(np.float64)) for r in got if r.bins]
    return sorted(out, key=lambda r: (r[0], len(r[1]), r[1].tolist(), r[2].tolist()))


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """A model of the languages in ``rows``; None if there are none. The same rows give the same model."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    aside = set(order[: len(rows) // 5].tolist()) if len(rows) >= 50 else set()
    fit = [k for k in order.tolist() if k not in aside]
    y = np.array([languages.index(r[0]) for r in rows])
    share = [c / c.sum() for _, _, c in rows]
    embed = rng.normal(0, 0.1, (BINS, WIDTH))
    soft, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    even = len(fit) / (len(languages) * np.maximum(1, np.bincount(y[fit], minlength=len(languages))))
    steps, done = EPOCHS * (len(fit) // BATCH + 1), 0
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        for at in range(0, len(fit), BATCH):
            own = fit[at : at + BATCH]
            rate = RATE * (1 - done / steps)
            done += 1
            bins, w = np.concatenate([rows[k][1] for k in own]), np.concatenate([share[k] for k in own])
            lengths = np.array([len(rows[k][1]) for k in own])
            starts = np.cumsum(lengths) - lengths
            means = np.add.reduceat(embed[bins] * w[:, None], starts, axis=0)
            gap = _softmax(means @ soft + bias)
            gap[np.arange(len(own)), y[own]] -= 1
            gap *= even[y[own], None]
            back = gap @ soft.T
            soft -= rate / len(own) * means.T @ gap
            bias -= rate / len(own) * gap.sum(axis=0)
            push = np.repeat(back, lengths, axis=0) * (w * -rate)[:, None]
            for k in range(WIDTH):
                embed[:, k] += np.bincount(bins, weights=push[:, k], minlength=BINS)
    model = Model(languages, (embed @ soft).astype(np.float32), bias, 1.0, 0.0)
    check = [k for k in order.tolist() if k in aside] or fit
    scores = np.array([share[k] @ model.table[rows[k][1]] + bias for k in check])
    right = y[check]
    loss = lambda t: -np.log(np.maximum(1e-12, _softmax(scores / t)[np.arange(len(right)), right])).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = _softmax(scores / model.temperature)
    good = np.sort(p.max(axis=1)[p.argmax(axis=1) == right])
    model.least = float(good[int(len(good) * (1 - KEEP_RIGHT))]) if len(good) else 0.0
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, lang_pred, score, rejected.

    lang_pred is a learned language; ``und``, with score 0 and not rejected, for null texts, texts
    without a letter, and if nothing was learned. score is the calibrated probability of the
    prediction; it is rejected if the score is below the model's. Whole texts are read; no rows give no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of(batches, 1 << 20):
            texts = text_bytes(batch.column(1))
            known = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
            names, score, low = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if known:
                best, p = model.predict([texts[k] for k in known])
                for k, b in zip(known, best.tolist(), strict=True):
                    names[k] = model.languages[b]
                score[known], low[known] = p, p < model.least
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(np.clip(score, 0, 1)), pa.array(low)], ["_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(each, f"_id {dict(rows.dtypes)['_id']}, lang_pred string, score double, rejected boolean").withColumnRenamed("_id", id_col)
