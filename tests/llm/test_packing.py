from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import packing

from . import helpers

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_plan_places_every_piece_once(histogram):
    rows = packing.plan_bins(histogram, 40)
    bins = defaultdict(list)
    seen = defaultdict(int)
    for n, first, last, sequence, each, offset in sorted(rows):
        assert first == seen[n]
        seen[n] = last
        for r in range(first, last):
            bins[sequence + (r - first) // each].append((offset + n * ((r - first) % each), n))
    assert dict(seen) == histogram
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 40


def test_two_for_one():
    """7 + 2 leaves 1 of 10; the 2 gives way to two pieces that fill 3."""
    rows = packing.plan_bins({7: 1, 2: 2, 1: 1}, 10)
    first = [r[0] for r in rows if r[3] == 0]
    assert sorted(first) == [1, 2, 7]


def test_close_to_the_bound():
    random.seed(2)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(2048, int(random.lognormvariate(6, 1)) + 1)] += 1
    rows = packing.plan_bins(dict(histogram))
    used = max(r[3] + -(-(r[2] - r[1]) // r[4]) for r in rows)
    bound = -(-sum(n * k for n, k in histogram.items()) // 2048)
    assert used <= 1.01 * bound + 1


def test_ids_are_the_tokenizers():
    random.seed(1)
    letters = list("abzAZ09.,'!|é́̃ ß中ﬁ \n\t\x1c\x85\xa0 İΣ²½Ⅷ<>#-_") + ["'s", "<|endoftext|>", "Don't.", "naïve,"]
    letters += ["<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "|>"]
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(3000)] + [helpers.words(400), "x" * 500 + "."]
    marks = list(".,!%<|>=") + ["\u0338", "\u0301", "\u093c", "\u0323"]
    for block in range(0, 0x30000, 0x100):  # letters of all scripts, with marks and accents after them
        near = [chr(c) for c in range(block, block + 0x100) if not 0xD800 <= c < 0xE000] or ["x"]
        texts += ["".join(random.choice([*random.choices(near, k=3), *random.choices(marks, k=2), " ", "a", "A", "9"]) for _ in range(random.randint(1, 30))) for _ in range(20)]
    t = tokenizers.Tokenizer.from_file(PATH)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = packing._encoder(PATH)([x.encode() for x in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_pieces_round_trip(spark):
    docs = helpers.awkward(spark)
    out = packing.pack_documents(docs, PATH, with_ids=True).collect()
    t = tokenizers.Tokenizer.from_file(PATH)
    sequences = defaultdict(list)
    whole = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert packing.crc32_of(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[r.doc_id].append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    texts = defaultdict(list)
    for k, text in helpers.texts_of(docs):
        texts[k].append(t.encode(text or "", add_special_tokens=False).ids + [0])
    for k, ids in texts.items():
        if len(ids) == 1:
            assert [x for p in sorted(whole[k]) for x in p[2]] == ids[0]
        else:
            assert sorted(len(p[2]) for p in whole[k]) == sorted(min(2048, len(i) - s) for i in ids for s in range(0, len(i), 2048))


def test_no_rows(spark):
    assert packing.pack_documents(helpers.empty(spark), PATH).count() == 0
