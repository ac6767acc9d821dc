import io
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered as o
from millrace.operators import sequence as sq
from millrace.runtime import names_in, shared_root, work_dir
from millrace.sources import connectors, files, lines, records
from millrace.sources.index import BucketedIndex, DocumentIndex


def write(path, content):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())
    return path


def test_lines_keep_an_unterminated_last_line(spark, tmp_path):
    path = write(str(tmp_path / "in" / "a.txt"), "one\ntwo\nthree")
    found = lines.read_lines(spark, path)
    assert [r["line"] for r in found.collect()] == ["one", "two", "three"]
    fits, rejects = lines.over_long(found, 3)
    assert (fits.count(), rejects.count()) == (2, 1)
    assert rejects.first()["error"] == "line is longer than 3"


def test_parse_fields_names_the_first_bad_field(spark, tmp_path):
    path = write(str(tmp_path / "in" / "a.csv"), "id, name, n\n1, a , 5\n2,b,NA\n3\n")
    parsed = lines.parse_fields(lines.read_lines(spark, path), "id INT, name STRING, n INT")
    got = {r["raw"]: (r["id"], r["name"], r["n"], r["error"]) for r in parsed.collect()}
    assert got["1, a , 5"] == (1, "a", 5, None)
    assert got["id, name, n"][3] == "id has another type"
    assert got["2,b,NA"] == (2, "b", None, "n has another type")
    assert got["3"] == (3, None, None, "fields are missing")
    rare = lines.pick_fields(lines.read_lines(spark, path), "n INT", [2], clean=True)
    assert sorted(str(r["n"]) for r in rare.collect()) == ["5", "None", "None", "None"]
    picked = lines.pick_fields(lines.read_lines(spark, path), "n INT", [2])
    assert sorted(str(r["n"]) for r in picked.collect()) == ["5", "None", "None", "None"]


def test_read_delimited_and_gzip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    out = str(tmp_path / "z")
    df.coalesce(1).write.option("compression", "gzip").option("sep", ";").csv(out)
    assert any(f.endswith(".gz") for f in os.listdir(out))
    back = lines.read_delimited(spark, out, "i INT, s STRING", ";")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def test_ordered_lines_round_trip(spark, tmp_path, heavy):
    out = str(tmp_path / "log")
    df = spark.range(40).select("id", F.format_string("line %02d", "id").alias("t"))
    lines.write_ordered_lines(df, out, "t", ["id"], parts=4)
    log = lines.read_ordered_lines(spark, out)
    placed = o.ordered(log, (), lines.ORDER).add(i=o.index()).df
    assert [r["line"] for r in placed.orderBy("i").collect()] == [f"line {i:02d}" for i in range(40)]
    found = lines.after_marker(log, "line 37", "line")
    assert sorted(r["line"] for r in found.collect()) == ["line 37", "line 38", "line 39"]


SUBTITLES = """1
00:00:01,000 --> 00:00:02,500
Hello there.

2
00:00:02,900 --> 00:00:04,000
-Who is it?
-Me.

3
00:01:09,319 --> 00:01:12,500
A long time later"""


def test_subtitles_round_trip(spark, tmp_path):
    path = write(str(tmp_path / "in" / "a.srt"), SUBTITLES)
    blocks = records.read_subtitles(spark, path)
    got = [(r["start"], r["end"], r["lines"]) for r in blocks.orderBy("start").collect()]
    assert got == [
        (1000, 2500, ["Hello there."]), (2900, 4000, ["-Who is it?", "-Me."]),
        (69319, 72500, ["A long time later"]),
    ]
    grouped = sq.scenes(o.ordered(blocks, (), ["start", "end"]), "start", "end", 1000).df
    assert [r["scene_no"] for r in grouped.orderBy("start").collect()] == [0, 0, 1]
    out = str(tmp_path / "out")
    records.write_subtitles(blocks, out, ["start"])
    parts = sorted(f for f in os.listdir(out) if f.startswith("part"))
    whole = "".join(open(os.path.join(out, f)).read() for f in parts)
    assert whole.strip() == SUBTITLES


POINTS = """load,sensorID=s1,nPoints=3 hr=1i,text="a b" 1500
load,sensorID=s2 hr=2.5
broken line without fields"""


def test_line_protocol(spark, tmp_path):
    path = write(str(tmp_path / "in" / "p.txt"), POINTS)
    got = records.points(lines.read_lines(spark, path)).collect()
    assert (got[0]["measurement"], got[0]["tags"]) == ("load", {"sensorID": "s1", "nPoints": "3"})
    assert (got[0]["fields"], got[0]["at"]) == ({"hr": "1", "text": "a b"}, 1500)
    assert (got[1]["fields"], got[1]["at"]) == ({"hr": "2.5"}, None)
    assert got[2]["measurement"] is None
    texts = [
        r'm,tag=a f="p,q" 1', r"m,tag=a\,b f=1 1", r'm,t=1 f="x y" 5', r"a\ b,c\=d=e\ f g=1,g=2i,g=3i",
        r'm f="say \"a, b\" \\" 7', "m, f=1", "m f", ",t=1 f=1", "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, line string")
    found = [tuple(r)[1:] for r in records.points(df).orderBy("n").collect()]
    assert found[:5] == [
        ("m", {"tag": "a"}, {"f": "p,q"}, 1), ("m", {"tag": "a,b"}, {"f": "1"}, 1),
        ("m", {"t": "1"}, {"f": "x y"}, 5), ("a b", {"c=d": "e f"}, {"g": "3"}, None),
        ("m", {}, {"f": 'say "a, b" \\'}, 7),
    ]
    assert all(r == (None, None, None, None) for r in found[5:])
    long = spark.range(1).select(
        records.point_line(F.lit("m"), {}, {"f": records.text_field(F.repeat(F.lit('a" \\,='), 200_000))}).alias("line")
    )
    assert records.points(long).first()["fields"]["f"] == 'a" \\,=' * 200_000
    line = records.point_line(F.lit("m"), {"t": F.lit("x")}, {"n": records.integer_field(F.lit(3))}, F.lit(9))
    assert spark.range(1).select(line).first()[0] == "m,t=x n=3i 9"


def test_embedded_documents_in_xml_files(spark, tmp_path):
    xml = (
        "<docs><head>x</head>"
        '<embeddedDoc id="1" mediaType="image/png">aGVs\nbG8=</embeddedDoc>'
        '<embeddedDoc id="2" mediaType="text/plain">eA==</embeddedDoc></docs>'
    )
    path = write(str(tmp_path / "in" / "d.xml"), xml)
    got = records.read_embedded_documents(spark, path).orderBy("id").collect()
    assert [(r["id"], r["ending"], bytes(r["content"])) for r in got] == [
        ("1", "png", b"hello"), ("2", "plain", b"x"),
    ]
    table = spark.createDataFrame([(7, xml)], "k int, xml string")
    got = records.embedded_documents(table, "k", "xml").orderBy("number").collect()
    assert [(r["k"], r["number"], bytes(r["content"])) for r in got] == [(7, 1, b"hello"), (7, 2, b"x")]


def zipped(*entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return buffer.getvalue()


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_inventory_and_archives(spark, tmp_path):
    top = str(tmp_path / "up")
    names = ["b.zip", "sub/a.zip", "sub/deep/c.zip", "d.txt"]
    for i, name in enumerate(names):
        path = write(os.path.join(top, name), zipped(("x.txt", b"1"), ("x.txt", b"2"), ("y/", b""), ("y/z", b"3")))
        os.utime(path, (1_700_000_000 - i, 1_700_000_000 - i))
    found = [os.path.relpath(r["path"].replace("file:", ""), top) for r in files.inventory(spark, top).collect()]
    assert found == ["sub/a.zip", "b.zip"]  # oldest first, not deeper than two levels
    assert files.inventory(spark, str(tmp_path / "none")).count() == 0
    archives = spark.read.format("binaryFile").load(os.path.join(top, "b.zip"))
    entries = files.expand_archives(archives).orderBy("name").collect()
    assert [(r["name"], bytes(r["content"])) for r in entries] == [("x.txt", b"1"), ("y/z", b"3")]


def test_packing_cuts_large_archives_into_parts(spark):
    entries = spark.createDataFrame(
        [("big", f"f{i:02d}", os.urandom(100)) for i in range(10)] + [("small", "s", b"x")],
        "archive string, name string, content binary",
    )
    packed = files.pack_archives(entries, 300)
    sizes = {r["archive"]: r["count"] for r in packed.groupBy("archive").count().collect()}
    assert sizes == {"big": 4, "small": 1}
    back = files.expand_archives(packed, "archive").drop("part")
    key = lambda r: (r["archive"], r["name"])
    assert sorted(back.collect(), key=key) == sorted(entries.collect(), key=key)


def test_split_with_counts_and_per_value(spark, tmp_path):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(9)], "i int, k string")
    out = str(tmp_path / "split")
    files.split_with_counts(df, out, "k")
    assert sorted(d for d in os.listdir(out) if "=" in d) == ["k=__HIVE_DEFAULT_PARTITION__", "k=a"]
    assert os.listdir(os.path.join(out, "k=a")) == ["n_rows=6"]
    assert spark.read.schema("i int, k string, n_rows bigint").parquet(out).count() == 9
    one = str(tmp_path / "one")
    files.write_per_value(df.na.fill("none"), one, "k", files_per_value=2)
    files.write_per_value(df.na.fill("none").where("k = 'a'"), one, "k")  # replaces
    assert spark.read.schema("i int, k string").parquet(one).count() == 6


def test_index_keeps_the_later_of_two_in_one_second(spark, tmp_path):
    index = DocumentIndex(spark, str(tmp_path / "index"), ["id"], ["ts"])
    rows = lambda *data: spark.createDataFrame(list(data), "id string, ts double, v string")
    index.upsert(rows(("10:00:01", 1.2, "first"), ("10:00:01", 1.9, "second")), 0)
    assert [r["v"] for r in index.read().collect()] == ["second"]
    index.upsert(rows(("10:00:01", 1.5, "late"), ("10:00:02", 2.0, "other")), 1)
    index.upsert(rows(("10:00:01", 1.5, "late"), ("10:00:02", 2.0, "other")), 1)
    current = lambda i: {r["id"]: r["v"] for r in i.read().collect()}
    assert current(index) == {"10:00:01": "second", "10:00:02": "other"}
    compacted = index.compact(str(tmp_path / "compact"))
    assert current(compacted) == current(index)
    assert spark.read.parquet(compacted.path).count() == 2


def test_bucketed_index_over_twenty_batches(spark, tmp_path):
    index = BucketedIndex(spark, str(tmp_path / "index"), ["id"], ["ts"], buckets=6, most_runs=3)
    with pytest.raises(ValueError):
        index.read()
    want, rng = {}, random.Random(6)
    for batch in range(20):
        rows = [(None if rng.random() < 0.05 else f"id{rng.randrange(40)}", rng.randrange(9), f"{batch}.{n}") for n in range(12)]
        best = {}
        for i, ts, v in rows:  # of equal times in a batch one wins; here none are equal
            if (i, ts) not in {(a, b) for a, (b, _) in best.items()}:
                best[i] = max(best.get(i, (-1, "")), (ts, v))
        rows = [(i, ts, v) for i, (ts, v) in best.items()]
        df = spark.createDataFrame(rows, "id string, ts long, v string")
        index.upsert(df, batch)
        for i, ts, v in rows:
            want[i] = (ts, v) if i not in want or ts >= want[i][0] else want[i]  # later batches win ties
        if batch in (7, 8):
            index.upsert(df.withColumn("v", F.lit("again")), batch)  # delivered twice
        assert max(index.runs_per_bucket().values()) <= 3
    got = lambda df: {r.id: (r.ts, r.v) for r in df.collect()}
    assert got(index.read()) == want
    before = len(names_in(spark, f"{index.path}/runs"))
    index.vacuum()
    assert got(index.read()) == want and len(names_in(spark, f"{index.path}/runs")) < before
    some = spark.createDataFrame([("id3",), ("id5",), ("none",)], "id string")
    assert got(index.lookup(some)) == {i: want[i] for i in ("id3", "id5") if i in want}


def test_bucketed_index_touches_only_buckets_of_the_batch(spark, tmp_path):
    index = BucketedIndex(spark, str(tmp_path / "index"), ["id"], ["ts"], buckets=8, most_runs=2)
    rows = lambda ids, ts: spark.createDataFrame([(i, ts) for i in ids], "id int, ts int")
    index.upsert(rows(range(100), 0), 0)
    first = index._state()["runs"]
    for n in range(1, 4):
        index.upsert(rows([5], n), n)
    now = index._state()["runs"]
    changed = [b for b in now if now[b] != first[b]]
    assert len(now) == 8 and len(changed) == 1
    # a version that was written and not yet named is not seen
    index._write(rows([5], 99).withColumn("batch_id", F.lit(99).cast("bigint")), "unnamed")
    assert index.lookup(rows([5], 0)).first()["ts"] == 3 and index.read().count() == 100


def test_json_rows(spark, tmp_path):
    out = str(tmp_path / "json")
    schema = "myfloat_nullable FLOAT, mystr STRING, myint_id INT"
    files.write_json_rows(spark.createDataFrame([(3.0, "3", 3), (None, "1", 1)], schema), out)
    files.write_json_rows(spark.createDataFrame([(2.0, "2", 2)], schema), out)
    got = files.read_json_rows(spark, out, schema, "myint_id").collect()
    assert [tuple(r) for r in got] == [(None, "1", 1), (2.0, "2", 2), (3.0, "3", 3)]


def test_connector_options(spark):
    options = connectors.jdbc_read_options("jdbc:x:y", "users", "id", 1, 20_000, 8, 10)
    assert options["fetchsize"] == "10" and options["numPartitions"] == "8"
    with pytest.raises(ValueError):
        connectors.jdbc_read_options("jdbc:x:y", "users", "id", 5, 5, 8)
    df = spark.range(20).select((F.col("id") % 3).alias("k"), "id")
    rows = connectors.as_topic_rows(df, "t", F.col("k"), F.col("id"), 4, F.col("id"), F.lit(0))
    assert rows.schema.simpleString() == (
        "struct<key:binary,value:binary,topic:string,partition:int,offset:bigint,timestamp:timestamp>"
    )
    per_key = rows.groupBy("key").agg(F.count_distinct("partition").alias("n")).collect()
    assert all(r["n"] == 1 for r in per_key)


def test_scratch_paths_are_below_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == root
    assert work_dir(spark, "x").startswith(f"{root}/millrace/x-")
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_objects_put_listed_and_read(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.range(10).select(F.format_string("o%02d", "id").alias("name"), F.lit("hello").alias("body"))
    files.put_text_objects(df, store, "name", "body")
    objects = files.read_objects(spark, store, "*.txt")
    assert objects.count() == 10
    assert {bytes(r["content"]) for r in objects.collect()} == {b"hello\n"}
    listing = objects.select("path", "length")
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_objects_of_one_partition_are_put_by_many_tasks(spark, tmp_path):
    store = str(tmp_path / "many")
    df = spark.range(0, 60, 1, 1).select(F.col("id").alias("name"), F.lit("hello").alias("body"))
    files.put_text_objects(df, store, "name", "body")
    paths = [r.path for r in files.read_objects(spark, store, "*.txt").select("path").collect()]
    assert len(paths) == 60 and len({p.split("/part-")[1][:5] for p in paths}) > 4


@pytest.mark.parametrize("separator", ["|", ".", ";", "\t", "^", "||", "$"])
def test_separators_are_taken_literally(spark, separator):
    df = spark.createDataFrame([(separator.join(["1", "b", "2"]),)], "line string")
    got = lines.pick_fields(df, "a INT, b STRING, c INT", separator=separator).first()
    assert tuple(got) == (1, "b", 2)
