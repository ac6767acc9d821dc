"""Alignment of two tokenizers against a version that looks at every pair of ends."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import alignment
from millrace.llm import queries as _registered  # noqa: F401
from millrace.llm.alignment import Coders, Tokens
from millrace.llm.common import documents, tokenizer_path
from millrace.llm.registry import QUERIES

CODERS = Coders(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, chunk string, pairs string, n_a int"


def spans(ids, spelled):
    ends = np.cumsum([len(spelled[i]) for i in ids]).tolist()
    return list(zip(ids, [0, *ends], ends, strict=False))


def brute_one(text, a, b):
    """Groups and links of one text, or none."""
    if not text:
        return [], []
    ids_a, ids_b = a.own.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
    whole = (" " + text).encode()
    if any(b"".join(c.spelled[i] for i in ids) != whole for c, ids in ((a, ids_a), (b, ids_b))):
        return [], []
    sa, sb = spans(ids_a, a.spelled), spans(ids_b, b.spelled)
    cuts = sorted({e for *_, e in sa} & {e for *_, e in sb})
    found = [([], []) for _ in cuts]
    for side, tokens in enumerate((sa, sb)):
        for i, _, e in tokens:
            found[bisect_left(cuts, e)][side].append(i)
    links, at = [], 0
    for i, s, e in sa:
        while at and sb[at - 1][2] > s:
            at -= 1
        while at < len(sb) and sb[at][1] < e:
            if sb[at][2] > s:
                links.append((i, sb[at][0]))
            at += 1
    return found, links


def brute(rows):
    words = CODERS.load()
    a, b = words.a, words.b
    each = [(doc_id, *brute_one(text, a, b)) for doc_id, text in rows]
    held = Counter(p for _, _, links in each for p in set(links))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for doc_id, found, links in each:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in found)
        out.append((
            doc_id, sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), len(links),
            hashlib.sha256(text.encode()).hexdigest() if found else "",
            sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
        ))
    return sorted(out, key=str)


def got(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


@pytest.mark.parametrize("chunk_bytes", [20_000, 8_000_000])
def test_whole_table_equals_brute_force(spark, sf_dir, chunk_bytes):
    docs = documents(spark, sf_dir).where("n_chars < 20000")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(alignment.aligned(docs, CODERS, chunk_bytes)) == want


def test_query_covers_every_document(spark, sf_dir):
    df = QUERIES["op12_alignment"](spark, sf_dir)
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents(spark, sf_dir).collect())
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows)


def odd_texts():
    return [
        None, "", " ", "a", "  two  blanks ", "▁ a mark that one tokenizer reads as a space", "汉字和ひらがな" * 30, "\x00\x01\n\t\r\n",
        "<s> <|endoftext|> </s> <unk> <0x41>", "\U0001f468‍\U0001f469‍\U0001f467 naïve ﬁ é", "x" * 3000, " " * 5000 + "end", "don't WE'LL 12345678901234567890",
    ]


def test_odd_texts_repeats_and_clashing_columns(spark):
    rows = [(n, t) for n, t in enumerate(odd_texts())] + [(3, "a"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    found = got(alignment.aligned(docs, CODERS))
    assert found == brute(rows)
    assert [r for r in found if r[0] == 5] == [(5, 0, 0, 0, 0, "", 0, 0)]
    assert alignment.aligned(docs.limit(0), CODERS).count() == 0


def test_groups_spell_the_text(spark):
    rows = [(n, t) for n, t in enumerate(odd_texts())]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    words = CODERS.load()
    a, b = words.a, words.b
    parts = defaultdict(list)
    for r in alignment.groups(docs, CODERS).collect():
        one, other = (b"".join(c.spelled[i] for i in ids) for c, ids in ((a, r.a), (b, r.b)))
        assert one == other and r.end - r.start == len(one)
        parts[r.doc_id].append((r.group, r.start, one))
    for n, text in rows:
        if n in parts:
            found = sorted(parts[n])
            assert [g for g, *_ in found] == list(range(len(found)))
            whole = b"".join(x for *_, x in found)
            assert whole == (" " + text).encode() and all(whole[s : s + len(x)] == x for _, s, x in found)
    assert {n for n, t in rows if n not in parts} == {0, 1, 5}


def test_leaves_have_no_common_end_inside():
    rng = np.random.default_rng(4)
    for share in (0.0, 0.02, 0.5, 1.0):
        sides = []
        lengths = [1, 2, 50, 3000]
        common = [np.sort(rng.choice(np.arange(1, n + 1), max(1, int(share * n)), replace=False)) for n in lengths]
        for skip in (0, 1):
            firsts, ends, base = [0], [], 0
            for n, cuts in zip(lengths, common, strict=True):
                own = np.unique(np.r_[cuts, n, np.arange(1 + skip, n, 2) if n > 2 else []]).astype(int)
                ends.append(own + base)
                firsts.append(firsts[-1] + len(own))
                base += n
            sides.append(Tokens(np.zeros(firsts[-1], np.int64), np.concatenate(ends), np.array(firsts)))
        a, b = sides
        group_a, group_b = alignment.leaves(a, b)
        both = np.intersect1d(a.ends, b.ends)
        assert a.ends[np.r_[group_a[1:], len(a.ends)] - 1].tolist() == both.tolist()
        assert b.ends[np.r_[group_b[1:], len(b.ends)] - 1].tolist() == both.tolist()


def test_fast_ids_are_the_file_s_own():
    words = CODERS.load()
    a, b = words.a, words.b
    texts = [t for t in odd_texts() if t] + ["".join(f" a{chr(c)}1{chr(c)} {chr(c)}b " for c in range(lo, lo + 500)) for lo in range(32, 0xD000, 500)]
    texts = [t.replace("▁", "") for t in texts]
    own = [a.own.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert a.ids(texts) == own
    assert b.by_word
    for text, ids in zip(texts, own, strict=True):
        one, other = words.ids(text)
        assert one.tolist() == ids and other.tolist() == b.model.encode(text)
    assert all(len(w) <= words.longest for w in words.known[0]) and len(words.known[0]) == len(words.known[1])
    few = alignment.Words(a, b, most=3)
    assert [[x.tolist() for x in few.ids(t)] for t in texts] == [[x.tolist() for x in words.ids(t)] for t in texts]
