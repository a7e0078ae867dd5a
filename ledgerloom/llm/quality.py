"""Quality of statement texts: a weak-label model of heuristic labellers teaches a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.batches import chunked, mixed, packed, small_batches

GOOD, BAD, ABSTAIN = 1, -1, 0
FEATURES = 1 << 18
GRAM = 4
SAMPLE = 4000
SAMPLE_CHARACTERS = 4000
CHUNK_BYTES = 1 << 20
ROUNDS = 200
EPOCHS = 6


def _kinds() -> np.ndarray:
    """0 other ASCII, 1 blank, 2 small letter, 3 capital, 4 digit, 5 high byte, 6 plain punctuation, 7 table mark."""
    table = np.zeros(256, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 1
    table[97:123], table[65:91], table[48:58], table[128:] = 2, 3, 4, 5
    table[[ord(c) for c in ".,;:?'\"()-"]] = 6
    table[[ord("|"), ord("\t")]] = 7
    return table


KINDS = _kinds()

# Labellers by name: each looks for one defect and abstains if it finds none; the last one votes for good prose.
LABELLERS = ("symbols", "tables", "capitals", "shouts", "repeated_lines", "repeated_words", "word_length", "no_letters", "prose")
PRIOR_COUNT = 50  # grams that a text is taken to have besides its own, with weight zero


def measures(texts: list[bytes]) -> np.ndarray:
    """Rows of measures of whole texts, the basis of all labellers."""
    out = np.zeros((len(texts), 10))
    for k, text in enumerate(texts):
        n = np.bincount(KINDS[np.frombuffer(text, np.uint8)], minlength=8) if text else np.zeros(8, np.int64)
        words = text.split()
        lines = [x for x in text.split(b"\n") if x.strip()]
        letters = int(n[2] + n[3] + n[5])
        out[k] = (len(words), letters, n[0] / max(1, len(words)), n[7] / max(1, len(words)),
                  n[3] / max(1, n[2] + n[3]), 1 - len(set(lines)) / max(1, len(lines)),
                  letters / max(1, len(words)), sum(map(eq, words, words[1:])) / max(1, len(words)),
                  sum(text.count(c) for c in (b".", b"?", b"\n")) / max(1, len(words)),
                  text.count(b"!!") / max(1, len(words)))
    return out


def votes(m: np.ndarray) -> np.ndarray:
    """Votes of the ``LABELLERS`` (texts, labellers) on measures."""
    words, letters, symbols, tables, capitals, repeated, length, stutter, stops, shouts = m.T
    defects = [symbols > 0.3, tables > 0.15, (capitals > 0.5) & (letters > 20), (shouts > 0.1) & (words > 3),
               (repeated > 0.3) & (words > 5), (stutter > 0.3) & (words > 5),
               (words > 5) & ((length < 1.5) | (length > 25)), (letters == 0) & (words > 0)]
    prose = ((words >= 4) & (symbols < 0.1) & (tables < 0.05) & (capitals < 0.35) & (shouts == 0) & (repeated <= 0.3)
             & (stutter < 0.1) & (stops > 0.02))
    return np.stack([*[np.where(d, BAD, ABSTAIN) for d in defects], np.where(prose, GOOD, ABSTAIN)], axis=1).astype(np.int8)


@dataclass
class LabelModel:
    """P(vote | class) of each labeller, (labellers, vote + 1, class), and the share of good texts."""

    table: np.ndarray
    prior: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        score = np.log([1 - self.prior, self.prior]) + np.log(
            self.table[np.arange(patterns.shape[1]), patterns.astype(np.int64) + 1]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Chance that a labeller that votes is right."""
        right = self.table[:, 2, 1] * self.prior + self.table[:, 0, 0] * (1 - self.prior)
        voted = right + self.table[:, 0, 1] * self.prior + self.table[:, 2, 0] * (1 - self.prior)
        return right / np.maximum(voted, 1e-12)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Accuracies of overlapping labellers from the counts of all vote patterns, without any true label.

    Starts from what most votes that are no abstentions say (good if there are none); add-one smoothing
    keeps every chance positive.
    """
    good = np.where(patterns.sum(axis=1) >= 0, 0.9, 0.1)
    hot = np.stack([patterns == v for v in (BAD, ABSTAIN, GOOD)], axis=2).astype(float)
    model = None
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts], axis=1)
        table = np.einsum("plv,pc->lvc", hot, weight) + 1
        table /= table.sum(axis=1, keepdims=True)
        prior = (weight[:, 1].sum() + 1) / (counts.sum() + 2)
        model = LabelModel(table, float(prior))
        after = model.posterior(patterns)
        if np.abs(after - good).max() < 1e-9:
            break
        good = after
    return model


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte grams of each text (digits alike), and the text of each."""
    body, starts, sizes = packed(texts, gap=GRAM - 1)
    body = np.where(KINDS[body] == 4, np.uint8(48), body).astype(np.uint64)
    value = body[: max(0, len(body) - GRAM + 1)].copy()
    for k in range(1, GRAM):
        value = (value << np.uint64(8)) | body[k: len(body) - GRAM + 1 + k]
    owner = np.repeat(np.arange(len(texts)), sizes + GRAM - 1)[: len(value)]
    inside = np.arange(len(value)) - starts[owner] < np.maximum(sizes[owner] - GRAM + 1, 0)
    return (mixed(value[inside]) & np.uint64(FEATURES - 1)).astype(np.int64), owner[inside]


def bins(m: np.ndarray) -> np.ndarray:
    """Hashed features of the measures of each text: which tenth each of them is in."""
    tenth = np.minimum(np.floor(m[:, 2:] * 10), 30).astype(np.uint64)
    return (mixed(tenth | (np.arange(1, tenth.shape[1] + 1, dtype=np.uint64) << np.uint64(40)))
            & np.uint64(FEATURES - 1)).astype(np.int64)


def linear_scores(texts: list[bytes], m: np.ndarray, weight: np.ndarray, offset: float) -> np.ndarray:
    """Chance of a good text: offset, mean weight of its grams (shrunk for short texts) and weights of its bins."""
    index, owner = grams(texts)
    total = np.bincount(owner, weights=weight[index], minlength=len(texts))
    count = np.bincount(owner, minlength=len(texts))
    z = offset + total / (count + PRIOR_COUNT) + weight[bins(m)].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_scorer(texts: list[bytes], good: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer on hashed features, taught by soft labels."""
    index, owner = grams(texts)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    tenths = bins(measures(texts))
    weight = np.zeros(FEATURES, np.float32)
    offset = float(np.log(min(max(good.mean(), 1e-3), 1 - 1e-3) / (1 - min(max(good.mean(), 1e-3), 1 - 1e-3))))
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        rate = 1 / (1 + epoch)
        for k in rng.permutation(len(texts)).tolist():
            own = index[ends[k]:ends[k + 1]]
            z = offset + float(weight[own].sum()) / (len(own) + PRIOR_COUNT) + float(weight[tenths[k]].sum())
            step = good[k] - 1 / (1 + np.exp(-min(max(z, -30), 30)))
            offset += 0.05 * rate * step
            np.add.at(weight, tenths[k], np.float32(0.2 * rate * step))
            np.add.at(weight, own, np.float32(50 * rate * step / (len(own) + PRIOR_COUNT)))
    return weight, offset


def _voted(statements: DataFrame, *columns: str) -> DataFrame:
    kept = [f"{c} {statements.schema[c].dataType.simpleString()}" for c in columns]

    def run(batches):
        for table in chunked(batches, CHUNK_BYTES, "text"):
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            v = votes(measures(texts))
            code = ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in columns], pa.array(code)],
                                             [*columns, "pattern"])

    picked = dict.fromkeys([*columns, "text"])
    return statements.select(*picked).mapInArrow(run, ", ".join([*kept, "pattern bigint"]))


def pattern_votes(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8)


def label_model(statements: DataFrame) -> LabelModel | None:
    """The label model over the votes on all statements; the driver sees at most 3**9 pattern counts."""
    rows = _voted(statements).groupBy("pattern").count().collect()
    if not rows:
        return None
    rows = sorted((r["pattern"], r["count"]) for r in rows)
    return expectation_maximisation(pattern_votes(np.array([r[0] for r in rows])), np.array([r[1] for r in rows], float))


def score_quality(statements: DataFrame, sample: int = SAMPLE, threshold: float = 0.35) -> DataFrame:
    """Quality of whole statement texts, learned without labelled texts.

    ``statements`` (stmt_id, text, ...) -> (stmt_id, weak_label, score, keep), one row per row.
    Heuristic labellers vote on every text; expectation-maximisation over the counts of all vote
    patterns estimates how often each is right; ``weak_label`` is the posterior chance of a good text.
    On passages of at most ``sample`` texts chosen by hash (at most ``SAMPLE_CHARACTERS`` each) these
    posteriors teach a linear scorer over hashed features (byte grams, and the tenth each measure is in), which scores every whole text; ``keep`` is
    score >= threshold.  A null text is empty and scores as one; texts of any length are scored whole; an empty table
    gives an empty result; repeated rows, null ids and other
    columns change nothing.
    """
    spark = statements.sparkSession
    small_batches(spark)
    model = label_model(statements)
    text = F.coalesce("text", F.lit(""))
    span = F.greatest(F.length(text) - SAMPLE_CHARACTERS + 1, F.lit(1))
    passage = F.substr(text, F.pmod(F.xxhash64("text", F.lit(3)), span).cast("int") + 1, F.lit(SAMPLE_CHARACTERS))
    slots = (statements.select(F.pmod(F.xxhash64("text"), F.lit(sample)).alias("slot"),
                               F.xxhash64("text", F.lit(1)).alias("order"), passage.alias("passage"))
             .groupBy("slot").agg(F.min_by("passage", F.struct("order", "passage")).alias("text")))
    taught = sorted(r["text"] for r in slots.select("text").collect())
    taught = [t.encode() for t in taught]
    if taught:
        weight, offset = train_scorer(taught, model.posterior(votes(measures(taught))))
    else:
        weight, offset = np.zeros(FEATURES, np.float32), 0.0
    shared = spark.sparkContext.broadcast((weight, offset, model))
    kind = statements.schema["stmt_id"].dataType.simpleString()

    def run(batches):
        weight, offset, model = shared.value
        for table in chunked(batches, CHUNK_BYTES, "text"):
            texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
            m = measures(texts)
            score = linear_scores(texts, m, weight, offset)
            yield pa.RecordBatch.from_arrays(
                [table.column("stmt_id").combine_chunks(), pa.array(model.posterior(votes(m))),
                 pa.array(score), pa.array(score >= threshold)], ["stmt_id", "weak_label", "score", "keep"])

    return statements.select("stmt_id", "text").mapInArrow(
        run, f"stmt_id {kind}, weak_label double, score double, keep boolean")
