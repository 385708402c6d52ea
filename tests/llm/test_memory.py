"""What workers keep: they share an executor's memory with its JVM."""

import random
import tracemalloc

import pyarrow as pa

from tallyframe.llm import common, piece_codec
from tallyframe.llm.subsequence import Landmarks, bordered, kernel


def test_bounds_of_long_words_take_little_memory():
    rng = random.Random(5)
    words = [bordered("".join(rng.choice("abcdefgh") for _ in range(24))) for _ in range(4096)]
    marks = Landmarks([bordered(w) for w in ("zyxwvu", "abcdef", "hgfedc")], 0.3)
    tracemalloc.start()
    found = marks.against(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # 4,096 words at once take 30 MB
    for w in words[:300]:
        for value, mark in zip(found.get(w, [0.0] * 3), marks.words, strict=True):
            exact = kernel(w, mark)
            assert abs(value - exact) < 1e-9 or (value == 0.0 and exact < 0.3 + 1e-9)


def test_what_large_batches_took_is_given_back_before_the_next_one(monkeypatch):
    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append("back"))

    def batches():
        for k in range(3):
            said.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([b"x" * 1000] * 10)], names=["text"])

    assert [x.num_rows for x in common._slices(batches(), 4000)] == [3, 3, 3, 1] * 3
    assert said == [0, "back", 1, "back", 2, "back"]


def test_the_codec_remembers_merges_and_neighbours_by_the_pieces_own_strings():
    codec = piece_codec.PieceCodec(piece_codec.model_bytes())
    codec.encode("Several unremarkable sentences, interrupted by words like antidisestablishmentarianism and überflüssigerweise.")
    made = [x for _, events in codec.history.values() for e in events for x in e[1:] if x is not None]
    kept = made + [x for pair in codec.pairs for x in pair if x in codec.ids]
    assert codec.pairs and made
    assert all(x is codec.same[x] for x in kept)
