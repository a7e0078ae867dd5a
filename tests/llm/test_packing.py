import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import hostile_rows, statements
from tokenizers import Tokenizer

from ledgerloom.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("capacity", [2048, 32])
def test_pieces_and_sequences(spark, capacity):
    model = Tokenizer.from_file(JSON)
    rows = hostile_rows() + [(70, "a <|endoftext|> b")]
    got = packing.pack_statements(statements(spark, rows), JSON, capacity, RANKS).collect()
    want = []
    for i, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    assert len(sequences) <= 1.1 * total / capacity + 2


def test_same_ids_with_and_without_ranks():
    rng = random.Random(1)
    parts = ["a", "Ab", " ", "  ", "\n", "\t", "'s", "1", "23", "!", "é", "漢", "\u00a0", "\u3000", "don't", "<|endoftext|>",
             "%%", "\u0301", "_", "\r\n", "\x00", "🙂", "\u0085"]
    slow, fast = packing.Encoder(JSON), packing.Encoder(JSON, RANKS)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert slow.encode(text) == fast.encode(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length_once(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range(rng.choice([1, 5, 400, 3000])):
        n = rng.choice([rng.randint(1, 2048), rng.randint(1, 300), 2048, 1100])
        histogram[n] = histogram.get(n, 0) + rng.choice([1, 1, 50])
    placed = {}
    sequences = 0
    for content, times in packing.plan(histogram):
        assert sum(n * c for n, c in content) <= 2048 and times > 0
        sequences += times
        for n, c in content:
            placed[n] = placed.get(n, 0) + c * times
    assert placed == histogram
    items = sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True)
    rooms = []
    for n in items:
        for k, room in enumerate(rooms):
            if room >= n:
                rooms[k] -= n
                break
        else:
            rooms.append(2048 - n)
    assert sequences <= len(rooms) * 1.1 + 2


def test_empty_table(spark):
    assert packing.pack_statements(statements(spark, []), JSON).count() == 0
