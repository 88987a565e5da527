"""Packing: every id lies in one piece, checksums hold, sequences are gapless and full."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from sheetlake.llm import packing as P
from sheetlake.llm.common import table
from sheetlake.llm.queries import tokenizer_files
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, route string, rest string"
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb c", "x y z", " a b", "a <|endoftext|> b",
       "it's we'll 12 345 !?", "é è ü ß 漢字 😀 y", "tab\tand  more\t x", "a" * 5000, "word " * 3000, "\n" * 50,
       "\x1c a", "a \x85 b", "1 2 3", " .", ". .", "a 　 b"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokenizer_files()[0])


def plain_ids(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids + [0]


def checked(reference, rows, pieces, most_padding=0.02):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    texts = defaultdict(list)
    for doc, text in rows:
        texts[doc].append(plain_ids(reference, text))
    assert set(by_doc) == set(texts)
    for doc, all_ids in texts.items():
        if len(all_ids) > 1:
            assert sum(p.length for p in by_doc[doc]) == sum(map(len, all_ids))
            continue
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(all_ids[0]) and p.length > 0
            piece = np.array(all_ids[0][at:at + p.length], "<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(piece)
            at += p.length
        assert at == len(all_ids[0])
    padding = total = 0
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= most_padding * total
    return by_sequence


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return P.pack_documents(docs, *tokenizer_files()).collect()


def test_encoder_gives_the_tokenizer_ids(spark, reference):
    encoder = P.load_encoder(*tokenizer_files())
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices(" \n\tab'sé1. ", k=60)) for _ in range(3000)]
    texts += [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    alone = P.load_encoder(tokenizer_files()[0], None)
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain_ids(reference, text)[:-1], repr(text)
    assert [alone.encode(t) for t in ODD] == [encoder.encode(t) for t in ODD]


def test_odd_rows(spark, reference):
    rows = list(enumerate(ODD)) + [(None, "no id"), (900, None), (901, "same twice"), (901, "same twice")]
    checked(reference, rows, run(spark, rows))


def test_copies_and_very_long_texts(spark, reference):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    same = " ".join(rng.choices(words, k=200))
    rows = [(i, same) for i in range(1500)] + [(5000, " ".join(rng.choices(words, k=60000)))]
    checked(reference, rows, run(spark, rows))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_neighbours_share_windows(spark, reference):
    """Documents of one topic, shuffled, meet in the same sequences."""
    rng = random.Random(8)
    topics = [[f"{chr(97 + t)}{rng.randint(100, 999)}{chr(97 + t)}" for _ in range(40)] for t in range(12)]
    rows = [(i, " ".join(rng.choices(topics[i % 12], k=rng.randint(40, 80)))) for i in range(600)]
    rng.shuffle(rows)
    sequences = checked(reference, rows, run(spark, rows))
    shares = [max(Counter(p.doc_id % 12 for p in s).values()) / len(s) for s in sequences.values()]
    assert sum(shares) / len(shares) > 0.8


def test_scores_are_bm25():
    rng = np.random.default_rng(1)
    rests = [rng.integers(0, 50, n).astype("<u2") for n in (5, 30, 80, 1, 200)]
    statistics = np.append(rng.random(1 << 16), 63.2).astype(np.float32)
    shard = P.Shard(rests, statistics)
    for seed in range(len(rests)):
        expected = []
        for other in rests:
            score = 0.0
            for term in set(rests[seed].tolist()):
                count = int((other == term).sum())
                if count:
                    score += statistics[term] * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * len(other) / 63.2))
            expected.append(score)
        assert np.allclose(shard.scores(seed), expected, rtol=1e-5)


def test_given_table(spark, reference):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    checked(reference, rows, P.pack_documents(docs, *tokenizer_files()).collect())
