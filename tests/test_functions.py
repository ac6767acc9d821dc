import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays, messages, numbers, protect, text
from millrace.functions import time as clock
from millrace.sources import records


def one(spark, value, kind, column):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column(F.col("v")).alias("r")).first()["r"]


def each(spark, data, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", column(F.col("v")).alias("r")).orderBy("i").collect()]


def test_hashtags(spark):
    found = each(spark, ["#other #flow aBody #flow", "#flow #other aBody", "none"], "string", text.hashtags)
    assert found == [["#other", "#flow"], ["#flow", "#other"], []]


def test_tokens_and_words(spark):
    assert one(spark, " one  two\tthree\n", "string", text.tokens) == ["one", "two", "three"]
    assert one(spark, "A,b!! c", "string", text.words) == ["a", "b", "c"]


def test_clean_line(spark):
    data = ["a\tb\x01c", '"quoted"', '"', "plain", '""']
    assert each(spark, data, "string", text.clean_line) == ["abc", "quoted", "", "plain", ""]


def test_split_line(spark):
    short = "x" * 40
    comma = "this sentence has a comma, and it goes on after it"
    early = "well, this sentence has its comma too early to be cut"
    none = "one two three four five six seven eight nine ten eleven"
    found = each(spark, [short, comma, early, none], "string", text.split_line)
    assert found[0] == [short]
    assert found[1] == ["this sentence has a comma,", " and it goes on after it"]
    assert found[2] == ["well, this sentence has its", "comma too early to be cut"]
    assert found[3] == ["one two three four five", "six seven eight nine ten eleven"]


def test_dialogue_lines(spark):
    assert one(spark, "-Hello there.-Who are you?", "string", text.display_lines) == [
        "-Hello there.", "-Who are you?",
    ]


def test_plausible_lines(spark):
    df = spark.createDataFrame([("a\n\nb", 2), ("a\nb\nc", 2)], "t string, n int")
    assert [r[0] for r in df.select(text.plausible_lines("t", "n")).collect()] == [True, False]


def test_escapes_paths_and_padding(spark):
    assert one(spark, "caf\\u00e9 \"x\"", "string", text.unescape_unicode) == 'café "x"'
    assert one(spark, "/a/b/file.tar.gz", "string", text.base_name) == "file.tar"
    assert one(spark, "image/png", "string", text.file_ending) == "png"
    assert one(spark, 7, "int", lambda c: text.pad_number(c, 3)) == "007"
    assert one(spark, "PID|1||", "string", text.strip_trailing_separators) == "PID|1"


def test_clock_texts(spark):
    assert one(spark, "00:01:09,319", "string", clock.clock_ms) == 69319
    assert one(spark, 72500, "bigint", clock.clock_text) == "00:01:12,500"
    back = each(spark, ["00:00:00,000", "23:59:59,999", "no time", None], "string", clock.clock_ms)
    assert back == [0, 86_399_999, None, None]


def test_floor_and_zones(spark):
    assert each(spark, [25, -1, 30], "int", lambda c: clock.floor_to(c, 10)) == [20, -10, 30]
    assert one(spark, 0, "bigint", lambda c: clock.local_seconds(c, "Europe/Zurich")) == "1970-01-01T01:00:00"


def test_numbers_in_texts(spark):
    found = each(spark, ["5", " -7 ", "NA", "1.5", "", None, "99999999999"], "string",
                 lambda c: numbers.whole_or(c, -1))
    assert found == [5, -7, -1, -1, -1, -1, -1]
    assert each(spark, ["1.5", ".5", "2.", "1e3", "x", "."], "string",
                lambda c: numbers.number_in(c, "double")) == [1.5, 0.5, 2.0, 1000.0, None, None]


def test_integer_average(spark):
    df = spark.createDataFrame([(7, 2), (7, 0), (2**60 + 1, 2)], "t bigint, n bigint")
    assert [r[0] for r in df.select(numbers.integer_average("t", "n")).collect()] == [3, 0, 2**59]


def test_primes(spark):
    found = spark.range(-2, 30).where(numbers.is_prime("id")).orderBy("id").collect()
    assert [r["id"] for r in found] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    large = {961: False, 1369: False, 1373: True, 37 * 41: False, 10**12 + 39: True, 10**12 + 61: True,
             1_000_003 * 1_000_033: False, 999_983**2: False,
             # near the end of 64 bits: the largest primes, a product of two, and strong pseudoprimes
             2**63 - 25: True, 2**63 - 165: True, 2**61 - 1: True, 2**63 - 1: False, 2**63 - 27: False,
             3_037_000_493 * 3_037_000_453: False, 3215031751: False, 3825123056546413051: False}
    df = spark.createDataFrame([(n,) for n in large], "n bigint")
    assert {r["n"]: r["p"] for r in df.select("n", numbers.is_prime("n").alias("p")).collect()} == large


def test_both_number_paths_take_the_same_texts(spark):
    texts = ["1", " 2 ", "+3", "-4", "007", "0" * 30 + "12", "9" * 19, "9" * 25, "1.5", "1.", ".5", ".", "1e3", "1e", "1.5f",
             "2D", "NaN", "nan", "Infinity", "-inf", "inf", "0x1p3", "abc", "", "-", "1 2", "NA", "1_0", "12x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind in ("tinyint", "int", "bigint", "float", "double"):
        looked = df.select(numbers.number_in("t", kind).cast("string").alias("n")).collect()
        cast = df.select(F.trim("t").try_cast(kind).cast("string").alias("n")).collect()
        assert [r["n"] for r in looked] == [r["n"] for r in cast], kind


def test_array_parts_and_pairs(spark):
    assert one(spark, [1, 2, 3], "array<int>", arrays.head) == 1
    assert one(spark, [], "array<int>", arrays.last) is None
    assert one(spark, [1, 2, 3], "array<int>", arrays.without_head) == [2, 3]
    pairs = one(spark, [1, 2, 3, 4, 5], "array<int>", arrays.pairs)
    assert [tuple(p) for p in pairs] == [(a, b) for a in range(1, 5) for b in range(a + 1, 6)]
    assert one(spark, [9], "array<int>", arrays.pairs) == []


@pytest.mark.parametrize("mode, extra", [("GCM", 12 + 16), ("CBC", None)])
def test_encryption_puts_the_iv_first(spark, mode, extra):
    key = F.unhex(F.sha2(F.lit("k"), 256))
    df = spark.createDataFrame([("abc",), ("abc",)], "v string")
    coded = df.select(protect.encrypt("v", key, mode).alias("c"))
    wrong = F.unhex(F.sha2(F.lit("other"), 256))
    rows = coded.select(
        "c",
        F.octet_length("c").alias("n"),
        protect.decrypt("c", key, mode).cast("string").alias("p"),
        protect.decrypt("c", wrong, mode).alias("wrong"),
    ).collect()
    assert [r["p"] for r in rows] == ["abc", "abc"]
    assert rows[0]["n"] == (3 + extra if extra else 16 + 16)
    assert rows[0]["c"] != rows[1]["c"]  # a new IV per row
    assert mode == "CBC" or rows[0]["wrong"] is None
    with pytest.raises(ValueError):
        protect.encrypt("v", key, "ECB")


@pytest.mark.parametrize("alphabet", ["basic", "url", "mime"])
def test_base64_alphabets(spark, alphabet):
    data = bytes(range(256)) * 3
    coded = one(spark, data, "binary", lambda c: protect.to_base64(c, alphabet))
    assert ("+" in coded) == (alphabet != "url")
    assert all(len(line) <= 76 for line in coded.split("\r\n")) or alphabet != "mime"
    assert bytes(one(spark, coded, "string", lambda c: protect.from_base64(c, alphabet))) == data


def test_change_events_have_defaults(spark):
    data = [
        '{"type":"log"}',
        '{"type":"edit","bot":true,"user":"MyBot","length":{"new":7,"old":5},"timestamp":12,"title":"T"}',
        '{"type":"edit","bot":"maybe","user":"MyBot","length":{"new":"x"},"timestamp":"soon"}',
        '{"type":"log","length":{"new":7,"old":5},"bot":true,"user":"human"}',
        "no json",
    ]
    df = spark.createDataFrame(list(enumerate(data)), "i int, json string")
    got = [r["change"].asDict() for r in records.change_events(df, "json").orderBy("i").collect()]
    empty = dict(timestamp=0, title="", server_name="", user="", cmd_type="", is_bot=False,
                 is_named_bot=False, length_new=0, length_old=0, delta=0)
    assert got[0] == {**empty, "cmd_type": "log"}
    assert got[1] == {**empty, "timestamp": 12, "title": "T", "user": "MyBot", "cmd_type": "edit",
                      "is_bot": True, "is_named_bot": True, "length_new": 7, "length_old": 5, "delta": 2}
    assert got[2] == {**empty, "user": "MyBot", "cmd_type": "edit"}
    assert got[3] == {**empty, "user": "human", "cmd_type": "log", "is_bot": True}
    assert got[4] == empty


# Own messages in the two versions that must be told apart.
ADMIT = (
    "MSH|^~\\&|SEND|HOSP|RECV|LAB|20240101||ADT^A01|ctl-{v}|P|{v}||\r"
    "PID|1||77^^^ID||||\rOBX|1|NM|first||Test Value|||\rOBX|2|NM|second||Value number 2||\r"
)


def test_hl7_segments_and_fields(spark):
    df = spark.createDataFrame(
        [(v, "\x0b" + ADMIT.format(v=v) + "\x1c\r") for v in ("2.3", "2.5")], "id string, m string"
    )
    got = records.hl7_segments(df, "id", "m")
    counts = {(r["id"], r["name"]): r["count"] for r in got.groupBy("id", "name").count().collect()}
    assert counts[("2.3", "OBX")] == 2 and counts[("2.5", "MSH")] == 1
    second = got.where("name = 'OBX' AND occurrence = 2 AND id = '2.3'")
    assert second.select(messages.field("segment", 5)).first()[0] == "Value number 2"
    acks = records.hl7_acknowledge(df, "id", "m").orderBy("id").collect()
    assert [(r["control_id"], r["version"], r["code"]) for r in acks] == [
        ("ctl-2.3", "2.3", "AA"), ("ctl-2.5", "2.5", "AA"),
    ]


def test_hl7_refusals(spark):
    df = spark.createDataFrame([(1, "PID|1|"), (2, ""), (3, "MSH|^~\\&|a")], "id int, m string")
    replies = records.hl7_acknowledge(df, "id", "m").orderBy("id").collect()
    assert [r["error"] for r in replies] == [
        "message does not start with MSH", "message is empty", "control id is missing",
    ]
    assert all(r["code"] == "AE" for r in replies)
    assert each(spark, ["MSA|AA|1", "MSA|AE|1", "xxCRxx"], "string", messages.refused) == [False, True, True]


def test_hl7_stripped(spark):
    assert one(spark, "MSH|a||\rPID|1|||\n", "string", messages.stripped) == "MSH|aPID|1"
    framed = one(spark, "MSH|a", "string", messages.frame)
    assert framed == "\x0bMSH|a\x1c\r"
    assert one(spark, framed, "string", messages.unframe) == "MSH|a"


def test_escaped_quotes_and_long_numbers(spark):
    from millrace.functions import numbers, text

    rows = [(r'a\"b "c" \\"d\u0041',), (r"plain",)]
    got = spark.createDataFrame(rows, "t string").select(text.unescape_unicode("t").alias("t")).collect()
    assert [r.t for r in got] == ['a"b "c" \\"dA', "plain"]
    many = spark.createDataFrame([("000000000000000000000012",), ("99999999999999999999",)], "t string")
    assert [r.n for r in many.select(numbers.number_in("t", "bigint").alias("n")).collect()] == [12, None]


def test_names_of_a_dictionary(spark):
    from millrace.operators import names

    dictionary = spark.createDataFrame([("New York",), ("new york",), ("New York Times",), ("York",), ("Ada",), ("!?",), (None,)], "n string")
    texts = ["He read the NEW YORK, times in York.", "Ada; ada New", "new york time", "", None, "nothing here"]
    rows = spark.createDataFrame([(i, t, f"k{i}") for i, t in enumerate(texts)], "id int, text string, first string")
    got = names.find_names(rows, dictionary, "text", "n")
    assert got.columns == ["id", "first", "at", "n_words", "name"]
    found = sorted((r.id, r.at, r.n_words, r.name) for r in got.collect())
    assert found == [(0, 3, 3, "New York Times"), (0, 4, 1, "York"), (0, 7, 1, "York"), (1, 0, 1, "Ada"), (1, 1, 1, "Ada"),
                     (2, 0, 2, "New York"), (2, 1, 1, "York")]
    assert names.find_names(rows, dictionary.limit(0), "text", "n").count() == 0
