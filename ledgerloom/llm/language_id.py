"""Language of statement texts by a small byte convolutional network, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.batches import packed, small_batches, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
CLASSES = 64
SAMPLE_PER_LANGUAGE = 512
SAMPLE_CHARACTERS = 512
MOST_LANGUAGES = 200
LEAST_SCORE = 0.3
EPOCHS = 12
BATCH = 64
WINDOWS_AT_ONCE = 2048


def byte_classes() -> np.ndarray:
    """64 classes of bytes: blank, other ASCII, letters without case, and high bytes by their low bits."""
    table = np.ones(256, np.uint8)
    table[[0, 9, 10, 11, 12, 13, 32]] = 0
    table[ord("a"):ord("z") + 1] = table[ord("A"):ord("Z") + 1] = np.arange(2, 28)
    table[128:] = 32 + (np.arange(128, 256) & 31)
    return table


@dataclass
class Network:
    """``taps[w][j]``: weights (class, filter) of tap j of the filters of width w."""

    languages: list[str]
    taps: dict[int, list[np.ndarray]]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters as sums of two look-ups by pairs of classes: all widths, then the wide ones."""
        pair = lambda t: (t[0][:, None, :] + t[1][None, :, :]).reshape(CLASSES * CLASSES, -1)
        none = np.zeros((CLASSES, FILTERS), np.float32)
        first = np.concatenate([pair(self.taps[w][:2]) for w in WIDTHS], axis=1)
        second = np.concatenate([pair([*self.taps[3][2:], none]), pair(self.taps[4][2:])], axis=1)
        bias = np.concatenate([self.bias[w] for w in WIDTHS])
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(second, np.float32), bias

    def pooled(self, codes: np.ndarray, tables=None) -> np.ndarray:
        """Max over the positions of each window; ``codes`` (windows, WINDOW + 3)."""
        first, second, bias = tables or self.tables()
        across = np.ascontiguousarray(codes.T).astype(np.int32)
        pairs = across[:-1] * CLASSES + across[1:]
        n = codes.shape[0]
        best = np.full((n, first.shape[1]), -np.inf, np.float32)
        a, b = np.empty_like(best), np.empty((n, second.shape[1]), np.float32)
        for i in range(WINDOW):
            np.take(first, pairs[i], axis=0, out=a, mode="clip")
            np.take(second, pairs[i + 2], axis=0, out=b, mode="clip")
            a[:, FILTERS:] += b
            np.maximum(best, a, out=best)
        return np.maximum(best + bias, 0)

    def probabilities(self, codes: np.ndarray, tables=None) -> np.ndarray:
        z = self.pooled(codes, tables) @ self.dense + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class codes of all windows of all texts (padded with blanks), and the text of each window."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-sizes // WINDOW))
    owner = np.repeat(np.arange(len(texts)), counts)
    firsts = np.cumsum(counts) - counts
    within = (np.arange(len(owner)) - firsts[owner]) * WINDOW
    body, starts, _ = packed(texts)
    at = starts[owner] + within
    index = at[:, None] + np.arange(WINDOW + 3)
    inside = within[:, None] + np.arange(WINDOW + 3) < sizes[owner][:, None]
    if not len(body):
        return np.zeros((len(owner), WINDOW + 3), np.uint8), owner
    codes = np.where(inside, byte_classes()[body[np.minimum(index, len(body) - 1)]], 0)
    return codes.astype(np.uint8), owner


def train(texts: list[bytes], languages: list[str], seed: int = 7) -> Network:
    """Fit the network by Adam on the windows of the given texts; classes weigh alike."""
    names = sorted(set(languages))
    codes, owner = windows_of(texts)
    target = np.array([names.index(x) for x in languages])[owner]
    rng = np.random.default_rng(seed)
    taps = {w: [rng.normal(0, 0.3, (CLASSES, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS}
    bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32)
    net = Network(names, taps, bias, dense, np.zeros(len(names), np.float32))
    weight = (len(target) / (len(names) * np.maximum(1, np.bincount(target, minlength=len(names)))))[target]
    params = [*[t for w in WIDTHS for t in taps[w]], *[bias[w] for w in WIDTHS], net.dense, net.offset]
    moment = [np.zeros_like(p) for p in params]
    square = [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for first in range(0, len(order), BATCH):
            pick = order[first:first + BATCH]
            c, n = codes[pick].astype(np.int64), len(pick)
            active, places = [], []
            for w in WIDTHS:
                z = sum(taps[w][j][c[:, j:j + WINDOW]] for j in range(w))
                at = z.argmax(axis=1)
                places.append(at)
                active.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + bias[w])
            raw = np.concatenate(active, axis=1)
            out = np.maximum(raw, 0)
            logits = out @ net.dense + net.offset
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), target[pick]] -= 1
            p *= weight[pick][:, None] / n
            back = (p @ net.dense.T) * (raw > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS:(k + 1) * FILTERS]
                for j in range(w):
                    g = np.zeros_like(taps[w][j])
                    np.add.at(g, (c[np.arange(n)[:, None], places[k] + j], np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
            grads += [back[:, k * FILTERS:(k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            grads += [out.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, s in zip(params, grads, moment, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                q -= (0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(q.dtype)
    return net


def training_sample(statements: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` passages of each label of ``statements`` (text, lang).

    Each label deals its texts into ``per_language`` slots by hash, and a slot keeps the text with
    the smallest hash: bounded for any number of rows, with map-side combine, and independent of
    order.  Of a long text a passage of ``SAMPLE_CHARACTERS`` characters at a hashed place is taken.
    """
    order = F.xxhash64("text", F.lit(1))
    span = F.greatest(F.length("text") - SAMPLE_CHARACTERS + 1, F.lit(1))
    passage = F.substr("text", F.pmod(F.xxhash64("text", F.lit(3)), span).cast("int") + 1, F.lit(SAMPLE_CHARACTERS))
    return (statements.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .select("lang", F.pmod(F.xxhash64("text"), F.lit(per_language)).alias("slot"),
                    order.alias("order"), passage.alias("passage"))
            .groupBy("lang", "slot").agg(F.min_by("passage", F.struct("order", "passage")).alias("passage")))


def common_languages(labelled: DataFrame, most: int = MOST_LANGUAGES) -> list[str]:
    """The ``most`` labels with the most labelled texts (ties by name): what is learned, however dirty the column is."""
    counted = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).groupBy("lang").count()
    return [r["lang"] for r in counted.orderBy(F.desc("count"), "lang").limit(most).collect()]


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """Train on ``labelled`` (text, lang); None if it holds no labelled letter."""
    labelled = labelled.where(F.col("lang").isin(common_languages(labelled)))
    rows = sorted((r["lang"], r["passage"]) for r in training_sample(labelled, per_language).collect())
    return train([r[1].encode() for r in rows], [r[0] for r in rows]) if rows else None


def predict(statements: DataFrame, net: Network | None, carry: tuple[str, ...] = ("stmt_id",)) -> DataFrame:
    """``statements`` (stmt_id, text) -> (the columns to ``carry``, lang_pred, score), one row per row.

    Every window of the whole text is judged; the score is the mean probability of the best
    language over windows, weighted by the letters in each.  A text that is null or has no letter is
    ``und`` with score 0, and so is every text if no language could be learned.  Repeated rows and
    ids stay as they are.
    """
    small_batches(statements.sparkSession)
    names = [f"carried_{k}" for k in range(len(carry))]
    kinds = [f"{n} {statements.schema[c].dataType.simpleString()}" for n, c in zip(names, carry)]

    def run(batches):
        tables = net.tables() if net else None
        letters = np.zeros(CLASSES, np.float32)
        letters[2:28] = letters[32:] = 1
        for batch in batches:
            texts, has = text_bytes(batch.column(0)), np.asarray(batch.column(1))
            total = np.zeros((len(texts), len(net.languages) if net else 1))
            row = 0
            while net and row < len(texts):
                size, last = 0, row
                while last < len(texts) and (last == row or size + len(texts[last]) < WINDOW * WINDOWS_AT_ONCE):
                    size += len(texts[last])
                    last += 1
                for first in range(0, max(1, size), WINDOW * WINDOWS_AT_ONCE):
                    one = last == row + 1
                    part = ([texts[row][first:first + WINDOW * WINDOWS_AT_ONCE + 3]] if one else texts[row:last])
                    codes, owner = windows_of(part)
                    if one and size > WINDOW * WINDOWS_AT_ONCE:
                        codes, owner = codes[:WINDOWS_AT_ONCE], owner[:WINDOWS_AT_ONCE]
                    weight = letters[codes[:, :WINDOW]].sum(axis=1)
                    np.add.at(total, owner + row, net.probabilities(codes, tables) * weight[:, None])
                    if not one:
                        break
                row = last
            sums = total.sum(axis=1)
            known = has & (sums > 0)
            best = total.argmax(axis=1)
            score = np.where(known, total.max(axis=1) / np.where(sums > 0, sums, 1), 0.0)
            found = [net.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(found, pa.string()),
                                              pa.array(np.clip(score, 0, 1))], [*names, "lang_pred", "score"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    return (statements.select("text", has_letter, *[F.col(c).alias(n) for n, c in zip(names, carry)])
            .mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"])))


def held_out(number: str = "stmt_id"):
    """True for the quarter of ids whose CRC-32 leaves 2; they are never learned from (null: learned from)."""
    return F.coalesce(F.crc32(F.col(number).cast("string")) % 4 == 2, F.lit(False))


def identify_languages(statements: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learn languages from the labelled statements that are not held out and judge all of them.

    ``statements`` (stmt_id, text, lang, ...) -> (stmt_id, held_out, lang_pred, score), one row per row.  ``lang``
    teaches and is no input of a prediction; of more than ``MOST_LANGUAGES`` labels the most common ones are learned.
    A null text, or one without a letter, is ``und``; every window of a text of any length counts; between
    equally likely languages the first by name wins; repeated rows and null ids stay; an empty table gives an
    empty result.
    """
    net = fit(statements.where(~held_out()).select("text", "lang"), per_language)
    return predict(statements, net).withColumnRenamed("carried_0", "stmt_id").select(
        "stmt_id", held_out().alias("held_out"), "lang_pred", "score")


def with_known_language(statements: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, least: float = LEAST_SCORE) -> DataFrame:
    """The statements, with all their columns, whose text is in some language that was learned.

    A text goes if it is null or has no letter, or if the network gives its best language less than ``least``: far below
    what texts of a learned language get, and only reachable with more than three languages.  If no language
    could be learned (no labels), every text with a letter stays.  Repeated rows stay; an empty table stays empty.
    """
    columns = statements.columns
    net = fit(statements.where(~held_out()).select("text", "lang"), per_language)
    if net is None:
        return statements.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    judged = predict(statements, net, tuple(columns)).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return judged.select(*[F.col(f"carried_{k}").alias(c) for k, c in enumerate(columns)])
