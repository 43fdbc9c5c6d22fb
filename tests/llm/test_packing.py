"""Packing: ids as the library gives them, places without gaps or overlaps, all capacities kept, few sequences."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing

PATH = P.path("word_bpe_49k.json")
ODD = [
    "a\x0bb\x0c.c\x1cd\x1fe\x85f g h",
    "é ́x Σας ΑΣ İstanbul",
    "<|endoftext|>hi <|startoftext|> x<|endoftext|>y <|endof text|>",
    "can't we'll 's 12 345 ABC\n\t\rdef",
    "\x01 a\x01b c\x01",
    "日本語 テキスト ​x﻿ y =  ̸",
    "x" * 9000 + " " + "yz" * 70,
]


def expected(library, text, most=packing.TOKENS, end=1):
    ids = library.encode(text or "", add_special_tokens=False).ids + [end]
    return [(k, a, ids[a : a + most]) for k, a in enumerate(range(0, len(ids), most))]


def check(spark, rows, most=packing.TOKENS, tokens=packing.TOKENS, documents=None, cost=None, **settings):
    library = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, part string").repartition(3)
    got = packing.packed(docs, PATH, tokens=tokens, documents=documents, cost=cost, **settings).collect()
    wanted = Counter((i, k, a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, *_ in rows for k, a, x in expected(library, t, most))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= tokens and len(own) <= (documents or tokens) and sum(n * n for _, n in own) <= (cost or tokens**2)
    return got, held


def corpus(n, seed=13):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé,.'9", k=rng.randint(1, 9))) for _ in range(500)]
    return [(i, " ".join(rng.choices(words, k=int(rng.paretovariate(0.7) * 12) % 6000)), "x", "y") for i in range(n)]


def test_pieces_and_places(spark):
    rows = corpus(400) + [(1000 + i, t, "x", "y") for i, t in enumerate(ODD)] + [(7, "again", "x", "y"), (None, None, None, None), (None, "", None, None)]
    got, held = check(spark, rows)
    bound = math.ceil(sum(r.length for r in got) / packing.TOKENS)
    assert len(held) <= bound + 1


@pytest.mark.parametrize("choice", ["norm", "dot"])
def test_every_capacity(spark, choice):
    rows = corpus(200, 3)
    _, held = check(spark, rows, tokens=512, most=300, documents=5, cost=90_000, choice=choice)
    assert max(len(x) for x in held.values()) == 5


def test_copies_share_a_length(spark):
    rows = [(i, "one hot text of a third of all rows", "x", "y") for i in range(300)] + corpus(50, 4)
    check(spark, rows)


def test_empty_and_bad(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(docs, PATH).collect() == []
    with pytest.raises(ValueError):
        packing.Plan({1: 1}, choice="best")


def test_plan_against_one_by_one():
    """The classes' plan gives what best fit gives piece by piece: the same number of sequences."""
    rng = random.Random(2)
    for _ in range(20):
        lengths = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
        plan = packing.Plan(Counter(lengths), tokens=64)
        left: list[int] = []
        for n in lengths:
            fits = [i for i, x in enumerate(left) if x >= n]
            if fits:
                left[min(fits, key=lambda i: left[i])] -= n
            else:
                left.append(64 - n)
        assert abs(plan.sequences - len(left)) <= 1
        assert len(plan.first) <= 4 * 60


def test_sequences_hold_their_documents(spark):
    library = Tokenizer.from_file(PATH)
    rows = corpus(60, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, part string")
    texts = {(i, k): x for i, t, *_ in rows for k, _, x in expected(library, t, 256)}
    seen = 0
    for r in packing.sequences(docs, PATH, tokens=256).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert sum(d.length for d in r.documents) == len(ids) <= 256
        for d in r.documents:
            assert ids[d.offset : d.offset + d.length] == texts[d.id, d.piece]
            seen += 1
    assert seen == len(texts)
