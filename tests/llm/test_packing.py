"""Packing: every id in exactly one piece, sequences without gaps, little padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing
from millrace.llm.common import WordEncoder, documents, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, rank int, bucket int, start string"


def check(rows, docs, size):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    ids_of = {}
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        ids_of.setdefault((doc_id, len(ids)), []).append(ids)
    seen = Counter()
    for r in rows:
        assert any(
            zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in ids_of[r.doc_id, r.doc_tokens]
        )
        seen[r.doc_id, r.doc_tokens] += r.length
    assert seen == Counter({k: k[1] * len(v) for k, v in ids_of.items()})
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return 1 - sum(seen.values()) / (len(sequences) * size)


def test_whole_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = packing.packed(docs, PATH).collect()
    assert check(rows, [(r.doc_id, r.text) for r in docs.collect()], 4096) < 0.03


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "long Text! " * 40_000), (5, "same <|endoftext|> text"), (5, "same <|endoftext|> text")]
    docs += [(None, "no id"), (6, "ÅNGSTRÖM é   wide blank 12345 don't"), (7, "a" * 9000), (7, "another text")]
    df = spark.createDataFrame([(*d, "x", 1, None, "s") for d in docs], SCHEMA)
    rows = packing.packed(df, PATH).collect()
    check(rows, docs, 4096)
    again = packing.packed(df.repartition(3), PATH).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_patterns_place_every_rank_once(seed):
    rng = random.Random(seed)
    size = 64
    histogram = {n: rng.randrange(1, 50) for n in rng.sample(range(1, size + 1), 30)}
    placed = defaultdict(list)
    for count, parts in packing.patterns(histogram, size):
        at = 0
        for length, rank, offset in parts:
            assert offset == at
            at += length
            placed[length] += range(rank, rank + count)
        assert at <= size
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(n)) for k, n in histogram.items()}
    used = sum(n * c for n, c in histogram.items())
    packs = sum(count for count, _ in packing.patterns(histogram, size))
    assert used / (packs * size) > 0.85  # any 30 lengths; documents pack far closer


def test_known_words_give_the_same_ids_as_whole_texts(spark, sf_dir):
    tokenizer, encode = Tokenizer.from_file(PATH), WordEncoder(PATH, most=500)
    texts = [r.text for r in documents(spark, sf_dir).collect()]
    odd = "".join(chr(c) for c in range(0x21, 0x250))
    texts += [" ".join(odd), odd, "Don't ÇA, ça! ŒUVRE İI ΣΑΣ e\u0301 <|endoftext|>. a.b word... İ a\u00a0b c\x1cd ª º µ ÿ Ÿ"]
    texts += [" ".join(f"x{c}. Y{c}{c}z,;" for c in odd)]
    for text in texts:
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
