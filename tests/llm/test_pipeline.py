"""The pipeline stage by stage: each stage against what it should do to its own input."""

import corpus_pipeline
from millrace.llm import quality
from millrace.llm.common import Scratch, documents
from millrace.sources.tables import table

from test_simhash import brute_classes, brute_print  # noqa: I001
from test_substrings import brute


def words(text):
    return (text or "").encode().split()


def test_every_stage(spark, sf_dir):
    scratch = Scratch(spark, "stages")
    docs, inputs = documents(spark, sf_dir), []
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        docs = scratch.put(stage(spark, docs, sf_dir), f"s{n}")
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    raw, good, single, cut, mix = ({r.doc_id: r for r in x.collect()} for x in inputs)

    scores = quality.scored(inputs[0], table(spark, sf_dir, "labels")).collect()
    assert set(good) == {r.doc_id for r in scores if r.predicted == 1}
    assert all(good[i] == raw[i] for i in good)

    classes = brute_classes({i: brute_print(r.text) for i, r in good.items()})
    assert set(single) == set(classes.values())

    want = {i: (n, gone) for i, n, gone, _ in brute([(i, r.text) for i, r in single.items()], 50)}
    assert set(cut) == set(single)
    for i, (n, gone) in want.items():
        assert len(words(cut[i].text)) == n - gone
        assert cut[i] == single[i] if not gone else cut[i].n_chars == len(cut[i].text)

    before = sum(len(words(r.text)) for r in cut.values())
    after = sum(len(words(r.text)) for r in inputs[4].collect())
    assert abs(after / before - 1.5) < 0.01 and set(mix) <= set(cut)

    packed = docs.collect()
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(r.length for r in packed)


def odd_documents(spark, sf_dir):
    """Null and empty texts, copies, a repeated id, a row without id, and columns that operators use themselves."""
    said = [r for r in documents(spark, sf_dir).orderBy("doc_id").collect() if 300 < r.n_chars < 4000]
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good = [r.text for r in said if labels.get(r.doc_id) == 1][:4]
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, good[0], "en", "a"), (4, good[0], "en", "b"), (4, good[0], "en", "b")]
    rows += [(5, good[1], "de", None), (None, good[2], "fr", "c"), (6, good[3] * 200, "en", "c")]
    names = [(*r, len(r[1] or ""), f"k{n}", n, 0.5, "x", "y") for n, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(names, schema + ", `key` string, size long, score double, `row` string, root string")


def test_odd_documents_by_stage(spark, sf_dir):
    docs = odd_documents(spark, sf_dir)
    rows = docs.collect()
    stage = {name: lambda d, f=f: f(spark, d, sf_dir) for name, f in corpus_pipeline.STAGES}

    good = stage["quality classifier"](docs)
    scores = quality.scored(docs, table(spark, sf_dir, "labels")).collect()
    want = {r.doc_id for r in scores if r.predicted}
    assert good.schema == docs.schema and {r.doc_id for r in good.collect()} == want and {3, 4, 5, None} <= want

    single = stage["SimHash near-dedup"](docs)
    found = sorted(str(r.doc_id) for r in single.collect())
    assert single.schema == docs.schema and found == ["1", "3", "5", "6", "None"]
    assert all(r in rows for r in single.collect())

    cut = {r.doc_id: r for r in stage["substring dedup"](single).collect()}
    assert set(cut) == {1, 3, 5, 6, None}
    assert cut[3].text == next(r.text for r in rows if r.doc_id == 3) and not cut[1].text

    mix = stage["mixing sources to target weights"](docs)
    total = sum(len(words(r.text)) for r in rows)
    assert mix.columns == docs.columns
    assert abs(sum(len(words(r.text)) for r in mix.collect()) - 1.5 * total) <= 0.02 * total

    packed = stage["packing"](docs).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
    assert all(r.length >= 1 for r in packed)


def test_no_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, sf_dir)
        assert got.count() == 0
        if n < 4:
            assert got.columns == docs.columns
