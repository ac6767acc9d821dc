"""SimHash against a brute-force version."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import Scratch, documents

SCHEMA = "doc_id long, text string, fp string, component_id string, key int"


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_classes(prints)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(brute_classes(prints).values())


def test_nulls_blanks_long_texts_repeats_and_clashing_columns(spark):
    long_text = "Ein sehr langer Text " * 30_000
    rows = [
        (5, None, "x", "y", 1),
        (6, "", "x", "y", 1),
        (7, " \t\n\x0b\x0c\r ", "x", "y", 1),
        (8, "One two", None, None, None),
        (9, "oNe  two", None, None, None),
        (3, long_text, "", "", 2),
        (4, long_text, "", "", 2),
        (4, long_text, "", "", 2),
        (None, long_text, "", "", 2),
        (None, "a text alone", "", "", 2),
    ]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    classes = {(r.doc_id, r.component_id) for r in got}
    assert {(5, 5), (6, 5), (7, 5), (8, 8), (9, 8), (3, 3), (4, 3), (None, 3), (None, None)} == classes
    assert {r.fingerprint for r in got if r.doc_id in (5, 6, 7)} == {"0" * 16}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.keep_first(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_id_link_and_one_of_each_class_is_kept(spark):
    words = [f"word{n}" for n in range(400)]
    near = " ".join(words[:-1] + ["other"])
    assert 0 < (brute_print(" ".join(words)) ^ brute_print(near)).bit_count() <= 2
    rows = [(None, " ".join(words), "x", "y", 1), (7, near, "x", "y", 2), (2, near, "x", "y", 3), (2, "apart", "x", "y", 4)]
    rows += [(None, "nobody names this", "x", "y", 5), (None, "nobody names this", "x", "y", 5), (9, None, "x", "y", 6), (9, None, "x", "y", 6)]
    schema = "doc_id long, text string, h string, `row` string, root int"  # names that the operator uses itself
    docs = spark.createDataFrame(rows, schema)
    classes = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    want = [(None, 2), (7, 2), (2, 2), (2, 2), (None, None), (None, None), (9, 9), (9, 9)]
    assert classes == sorted((str(a), str(b)) for a, b in want)
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    found = sorted((str(r.doc_id), r.root) for r in kept.collect())
    assert found in ([("2", 3), ("9", 6), ("None", 5)], [("2", 4), ("9", 6), ("None", 5)])


def test_bit_sliced_pairs_equal_all_pairs():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.repeat(centre, 70) ^ (np.uint64(1) << rng.integers(0, 64, 420).astype(np.uint64)))
    groups = np.sort(rng.integers(0, 3, len(fps)))
    i, j = simhash.close_pairs(fps, groups, 2)
    want = {
        (a, b)
        for a in range(len(fps))
        for b in range(a + 1, len(fps))
        if groups[a] == groups[b] and int(fps[a] ^ fps[b]).bit_count() <= 2
    }
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_refined_buckets_lose_no_pair(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(np.int64(2**40 + 5) ^ (rng.integers(0, 2, 300) << rng.integers(0, 63, 300)) ^ (1 << rng.integers(0, 63, 300)))
    df = spark.createDataFrame([(int(x), n) for n, x in enumerate(fps)], "fp long, rep long")
    pairs = {
        refine: {(r.a, r.b) for r in simhash.links(df, Scratch(spark, "t"), refine=refine).collect()}
        for refine in (2, 10_000)
    }
    want = {
        (a, b)
        for a in range(len(fps))
        for b in range(a + 1, len(fps))
        if (int(fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2
    }
    assert pairs[2] == pairs[10_000] == want


def test_wide_keys_do_not_meet(spark):
    df = spark.createDataFrame([(-1, 1), (1, 2), (2**62, 3)], "fp long, rep long")
    assert simhash._keys(df, 2).where(F.col("key") < 0).count() == 0
