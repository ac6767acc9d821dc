"""Counts after edits against encoding the edited text from the beginning."""

import random

import pytest
from tokenizers import Tokenizer

from millrace.llm import edit_counts as ec
from millrace.llm.common import Scratch, documents, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, sums string, at int, known int"


def count(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    out, done = [], 0
    for at, removed, inserted in sorted(edits, key=lambda e: e[0]):
        at = max(done, min(max(at, 0), len(text)))
        out += [text[done:at], inserted]
        done = max(at, min(at + max(removed, 0), len(text)))
    return "".join([*out, text[done:]])


def test_whole_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: r for r in ec.edited_counts(docs, PATH).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    edits = {}
    for e in ec.edits_of(docs).collect():
        edits.setdefault(e.doc_id, []).append((e.at, e.removed, e.inserted))
    assert set(got) == set(texts)
    for i, r in got.items():
        assert (r.tokens_before, r.tokens_after) == (count(texts[i]), count(edited(texts[i], edits[i])))
        assert r.n_edits == len(edits[i])
    assert sum(r.n_encoded for r in got.values()) < 0.6 * sum(map(len, texts.values()))


def in_leaves(text, starts):
    return [count(text[s:e]) for s, e in zip(starts, [*starts[1:], len(text)], strict=True)]


ALPHABETS = ("ab'sÉ1. \n \t <|endoftext|>", "中文字。，！！ab1'\u0301\u3099か。 ", "文。")


@pytest.mark.parametrize("seed", range(6))
def test_rounds_of_any_edits(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice(ALPHABETS[seed % 3]) for _ in range(rng.randrange(n)))
    for _ in range(40):
        text = some(200)
        starts = ec.leaves(text, 8)
        sums = ec.tree(in_leaves(text, starts))
        assert sums[1] == count(text)
        for _ in range(4):
            edits = [(rng.randrange(-2, 210), rng.randrange(0, 30), some(12 if rng.random() < 0.8 else 90)) for _ in range(rng.randrange(5))]
            after = ec.apply(text, starts, sums, edits, count, 8)
            assert after.text == edited(text, edits)
            assert after.sums[1] == count(after.text)
            assert after.starts == sorted(set(after.starts)) and after.starts[0] == 0
            assert after.sums == ec.tree(in_leaves(after.text, after.starts))
            text, starts, sums = after.text, after.starts, after.sums


def test_texts_without_blanks_have_leaves():
    text = ("文" * 30 + "。") * 600
    starts = ec.leaves(text, 512)
    assert len(starts) > 30 and sum(in_leaves(text, starts)) == count(text)
    after = ec.apply(text, starts, ec.tree(in_leaves(text, starts)), [(9000, 3, "字")], count, 512)
    assert after.sums[1] == count(after.text) and after.encoded < 1200


def test_trees_serve_the_next_edits(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(("one", "Two,", "three.", "vier")) for _ in range(rng.randrange(900))) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    known = Scratch(spark, "t").put(ec.trees(docs, PATH, 64), "trees")
    for r in range(3):
        edits = [(i, rng.randrange(4000), rng.randrange(20), " new words" * rng.randrange(30)) for i in range(0, 40, r + 1) for _ in range(2)]
        table = spark.createDataFrame(edits, "doc_id long, at long, removed long, inserted string")
        counts = {x.doc_id: x for x in ec.recounted(docs, known, table, PATH, 64).collect()}
        rows = Scratch(spark, "t").put(ec.edited_trees(docs, known, table, PATH, 64), "rows")
        docs, known = rows.select("doc_id", "text"), ec.of_edited(rows)
        for i, text in texts.items():
            texts[i] = edited(text, sorted(e[1:] for e in edits if e[0] == i))
            assert (counts[i].tokens_before, counts[i].tokens_after) == (count(text), count(texts[i]))
        assert {x.doc_id: x.text for x in docs.collect()} == texts
        assert all(x.sums == ec.tree(in_leaves(texts[x.doc_id], x.starts)) for x in known.collect())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "long text here " * 20_000), (5, "same text"), (5, "same text"), (5, "other"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA)
    edits = [(1, 0, 0, "new"), (2, None, None, None), (4, 10**9, 5, " end"), (5, 4, 1, "-"), (9, 0, 0, "x"), (None, 0, 0, "x")]
    edits = spark.createDataFrame(edits, "doc_id long, at long, removed long, inserted string")
    known = Scratch(spark, "t").put(ec.trees(docs, PATH), "trees")
    got = ec.recounted(docs, known, edits, PATH).collect()
    want = [(1, 0, 1), (2, 0, 0), (3, 0, 0), (4, 60_000, 60_001), (None, 2, 2), (5, 1, count("othe-"))]
    want[5] = (5, count("other"), count(edited("other", [(4, 1, "-")])))
    want += [(5, 2, count("same-text"))] * 2
    assert sorted(((r.doc_id, r.tokens_before, r.tokens_after) for r in got), key=str) == sorted(want, key=str)
    assert next(r for r in got if r.doc_id == 4).n_encoded < 1000


def test_empty_table(spark):
    assert ec.edited_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0
