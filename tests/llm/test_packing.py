from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
from tokenizers import Tokenizer

from aerolith.llm import packing, tokens

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(name):
    own, lib = tokens.Encoder(vocabularies.path(name)), Tokenizer.from_file(vocabularies.path(name))
    lib.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", None, " a", "a ", "a  b", "a \n b", "\n\nx", "é ́x", "it's  ok", "ΑΣ ΟΔΟΣ", "a\x1cb c", "\ta b c d", "  ", "a　 b\xa0c", "x" * 300 + " y", "<|endoftext|> a <|endoftext|>", "İ I ı", "foo×, bar…, baz", "don't, I'll. x'", "a\x01b \x01 c", "…,é,É.", "y" * 100 + ", " + "z" * 70, "日本 語. 12,5%", "🙂 ok🙂."]
    texts += ["".join(rng.choice(" \n\tabÉß'1.,́  x") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    want = [np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == want
    assert own.encode(texts[::-1]) == want[::-1]  # from the table of known parts
    own.first = np.concatenate([own.first])
    assert own.encode(texts[:1]) == want[:1] and own.encode([]) == []


def check(counts, capacity):
    p = packing.plan(counts, capacity)
    length = np.concatenate([np.full(n, k) for k, n in counts.items()])
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = p.place(length, rank)
    assert set(sequence.tolist()) == set(range(p.sequences))
    for s in range(p.sequences):
        at = 0
        for o, n in sorted(zip(offset[sequence == s].tolist(), length[sequence == s].tolist(), strict=True)):
            assert o == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for n in length[sequence == s].tolist()) <= 2
    return p.sequences


def test_plans_hold_and_are_tight():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 64, 300])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        n = check(counts, capacity)
        bins: list[int] = []  # first fit, largest first
        for k in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            at = next((i for i, left in enumerate(bins) if left >= k), None)
            if at is None:
                bins.append(capacity - k)
            else:
                bins[at] -= k
        assert n <= 1.05 * len(bins) + 1
    assert check({5: 10, 4: 10}, 10) == 10 and check({1: 100}, 10) == 10 and check({10: 3}, 10) == 3


def test_pack_equals_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "of", "erenblan", "thnd"]) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(80)] + [(80, None), (None, "x"), (3, "the"), (3, "the")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int")
    path = vocabularies.path(FILES[1])
    table = packing.common.saved(packing.pieces(df, path, 1, 64, with_ids=True), "p")[0]
    packed = packing.pack(table, 64)
    rows = packed.collect()
    lib = Tokenizer.from_file(path)
    want = []
    for k, t in docs:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(k, n, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for n, at in enumerate(range(0, len(ids), 64))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    made = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert bytes(made[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids)
    total = sum(r.length for r in rows)
    assert sum(len(x) for x in made.values()) == 4 * total and len(made) <= -(-total // 64) + 2
    assert packing.run(df.limit(0), path, 1).count() == 0
