"""Exact dedup, mixing, WARC, chat formatting and the pipeline on small and awkward tables."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from replistat.llm import exact, mixing, toolchat, warc
from replistat.llm.common import shared_folder, word_count


# exact copies ----------------------------------------------------------------------------------------------------

ROWS = [(1, "a  b"), (2, "a\tb"), (3, "a\nb\n"), (4, None), (5, ""), (6, " "), (None, "a b"), (None, "n"), (None, "n"), (7, "a b"), (7, "a b"), (8, "x" * 100_000), (9, "x" * 100_000)]


def test_exact_copies(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("kept", F.lit("old")).withColumn("more", F.lit(1))
    got = exact.tag_copies(df).collect()
    assert Counter(r["keep_id"] for r in got) == {1: 5, 3: 1, 4: 2, 6: 1, 8: 2, None: 2}
    assert sum(r["kept"] for r in got) == 6 and {r["more"] for r in got} == {1}
    assert sorted(str(r["doc_id"]) for r in exact.drop_copies(df).collect()) == ["1", "3", "4", "6", "8", "None"]
    assert exact.drop_copies(df).columns == df.columns
    assert exact.tag_copies(df.limit(0)).count() == 0


def test_exact_copies_with_colliding_digests(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    cols = ["doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"]
    poor = exact.tag_copies(df, digest=lambda t: F.substring(t, 1, 1)).select(cols)
    good = exact.tag_copies(df).select(cols)
    assert Counter(map(tuple, poor.collect())) == Counter(map(tuple, good.collect()))


# mixing ----------------------------------------------------------------------------------------------------------

def test_mixing_near_targets_and_reruns(spark):
    rows = [(i, f"s{i % 7}" if i % 5 else None, "w " * (1 + i * 37 % 90)) for i in range(1, 1500)] + [(None, "s1", "a b"), (None, "s1", "a b"), (2, "s2", None), (3, "empty", " ")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("x"))
    sized = df.withColumn("size", word_count(F.col("text")))
    got = mixing.mix(sized).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix(sized.repartition(9)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    total, taken, target, size = sum(r["size"] for r in got), Counter(), {}, {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total and sum(taken.values()) <= 1.5 * total
    weights = dict(zip([*sorted(s for s in target if s is not None), None], [5, 2, 1] * 4))
    level = [target[s] / weights[s] for s in target if 0 < target[s] < 2 * size[s]]
    assert max(level) - min(level) < 1e-6 * max(level)
    assert all(abs(taken[s] - target[s]) <= 181 for s in target)
    assert mixing.mix(sized.limit(0)).count() == 0
    mixed = mixing.mixed(df)
    assert mixed.columns == [*df.columns, "copies"] and {r[0] for r in mixed.select("copies").distinct().collect()} <= {1, 2}


# archive ---------------------------------------------------------------------------------------------------------

def test_archive_round_trip(spark):
    big, odd = "é" * 700, "\r\n\r\nWARC/1.1\r\n\x00 &" + "z" * 1200
    rows = [(1, "http://a", big), (5, "http://b", big), (3, "http://c\r\nX: y", big), (7, None, "s"), (8, "u", "s"), (9, "v", None), (10, "w", ""), (None, "x", odd), (11, "y", odd), (12, "z", "1" * 999), (13, "z", "1" * 999)]
    path = shared_folder(spark)
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)), path)
    got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(rows) and all(r["intact"] for r in got.values())
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    for i, _, html in rows:
        data = (html or "").encode()
        r = got[i]
        assert bytes(r["payload"]) == data and r["payload_digest"] == hashlib.sha1(data).hexdigest() and r["payload_bytes"] == len(data)
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
        assert rest[length:] == b"\r\n\r\n" and rest[:length].partition(b"\r\n\r\n")[2] == (data if r["record_type"] == "response" else b"")
    assert {i: (got[i]["record_type"], got[i]["refers_to"]) for i in (1, 3, 5, None, 11, 7, 8, 12, 13)} == {
        1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), None: ("revisit", 11), 11: ("response", None), 7: ("response", None), 8: ("response", None), 12: ("response", None), 13: ("response", None)}
    out = shared_folder(spark)
    warc.write_warc_files(spark, path, out)
    data = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(out).filter("path NOT LIKE '%SUCCESS%'").collect())
    records = 0
    while data:  # a plain reader of the format
        head, _, data = data.partition(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and data[length:length + 4] == b"\r\n\r\n"
        data, records = data[length + 4:], records + 1
    assert records == len(rows)
    empty = shared_folder(spark)
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_archive_shows_damage(spark):
    path, bad = shared_folder(spark), shared_folder(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "a" * 2000)], "page_id long, url string, html string"), path)
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("b" * 2000), "UTF-8")).write.parquet(f"{bad}/payloads")
    assert [r["intact"] for r in warc.read_archive(spark, bad).collect()] == [False]


# chats -----------------------------------------------------------------------------------------------------------

SCHEMA = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["n"], "additionalProperties": False}


def calls(*some):
    return json.dumps({"tool_calls": list(some)})


def call(id_, after=(), name="f", **args):
    return {"id": id_, "name": name, "arguments": args, "after": list(after)}


def result(id_, content="ok"):
    return json.dumps({"tool_call_id": id_, "content": content})


def test_chats_link_order_and_validate(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "assistant", calls(call("b", after=["a"], n=2), call("a", n=1))), (1, 2, "tool", result("b")), (1, 4, "tool", result("a", {"z": 1, "a": [1.5, None]})), (1, 5, "assistant", "done"),
        (2, 0, "assistant", calls(call("x", after=["y"], n=1), call("y", after=["x"], n=1), call("z", after=["y", "none", "z"], n=0))), (2, 1, "tool", result("gone")),
        (3, 0, "assistant", calls(call("d", n=1), call("d", n=2), {"id": "e", "name": "g", "arguments": "{bad"}, {"name": "f", "arguments": {"n": True, "m": 1, "tags": ["a", 3]}})),
        (3, 1, "tool", result("d")), (3, 2, "tool", result("d", "again")), (None, 0, "tool", result("d")), (4, None, None, None), (4, 1, "user", '{"tool_calls": 3}'), (4, 2, "user", "{not json"), (4, 2, "user", "{not json"),
    ]
    chain = [(5, 20 - i, "assistant", calls(call(f"c{i}", after=[f"c{i - 1}"] if i else [], n=1))) for i in range(9)]
    df = spark.createDataFrame(rows + chain, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("x"))
    schemas = spark.createDataFrame([("f", json.dumps(SCHEMA)), ("f", json.dumps(SCHEMA))], "name string, schema string")
    got = toolchat.format_chats(df, schemas).collect()
    assert len(got) == len(rows) + len(chain) + 1 + 2 + 3
    lines = lambda c: [r for r in sorted((r for r in got if r["conv_id"] == c), key=lambda r: (r["place"] is not None, r["place"] or 0, r["level"], r["turn"] or 0, r["seq"]))]
    assert [(r["kind"], r["call_id"]) for r in lines(1)] == [("message", None), ("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("message", None)]
    assert lines(1)[2]["line"] == '{"content":{"a":[1.5,null],"z":1},"id":"a","type":"result"}'
    assert {r["call_id"]: r["status"] for r in lines(2)} == {"x": "cycle", "y": "cycle", "z": "cycle", "gone": "orphan"}
    assert [r["errors"] for r in lines(2) if r["call_id"] == "z"] == [["$.n: out of bounds"]]
    third = lines(3)
    assert sorted((r["kind"], str(r["call_id"]), r["status"]) for r in third) == [("call", "None", "no_id"), ("call", "d", "duplicate"), ("call", "d", "linked"), ("call", "e", "unanswered"), ("result", "d", "linked"), ("result", "d", "linked")]
    assert {str(r["call_id"]): r["errors"] for r in third if r["kind"] == "call" and r["call_id"] != "d"} == {"e": ["$: not JSON", "no schema"], "None": ["$.m: unknown", "$.n: not of type integer", "$.tags[1]: not of type string"]}
    assert [r["status"] for r in got if r["conv_id"] is None] == ["no_id"]
    assert [r["line"] for r in lines(4)][0] == '{"content":null,"role":null,"type":"message"}' and len(lines(4)) == 4
    order = [r["call_id"] for r in lines(5)]
    assert order == [f"c{i}" for i in range(9)] and [r["level"] for r in lines(5)] == [2 * i for i in range(9)]
    assert toolchat.format_chats(df.limit(0), schemas).count() == 0


def test_chats_with_odd_json_and_schemas(spark):
    schemas = [("bad", "not json"), ("list", "[1]"), ("pat", '{"properties":{"s":{"pattern":"("}}}'), ("any", '{"anyOf":[{"type":"string"},{"const":1}]}'), ("odd", '{"dependentRequired":{}}'),
               ("items", '{"type":"array","minItems":2,"items":{"exclusiveMinimum":0}}'), ("no", "false"), ("yes", "true"), ("kind", '{"type":"money"}'), ("enum", '{"enum":[1]}')]
    call = lambda n, a, i="x": '{"tool_calls":[{"id":"%s","name":"%s","arguments":%s}]}' % (i, n, a)
    rows = [(1, 0, "assistant", call("bad", "1")), (2, 0, "assistant", call("list", "1")), (3, 0, "assistant", call("pat", '{"s":"a"}')), (4, 0, "assistant", call("any", "2")), (5, 0, "assistant", call("any", "1")),
            (6, 0, "assistant", call("odd", "{}")), (7, 0, "assistant", call("items", "[0]")), (8, 0, "assistant", call("items", "[1,2]")), (9, 0, "assistant", call("no", "1")), (10, 0, "assistant", call("yes", "1")),
            (11, 0, "assistant", call("kind", "1")), (12, 0, "assistant", call("enum", "true")), (13, 0, "assistant", call("items", "1" + "0" * 400)),
            (20, 0, "tool", '{"tool_call_id":"1","content":1e999}'), (21, 0, "user", '{"a":"\\ud800"}'), (22, 0, "tool", '{"tool_call_id":"\\udc00","content":"\\ud800"}'),
            (23, 0, "assistant", '{"tool_calls":[],"content":"hello"}'), (24, 0, "assistant", '{"content":"aside","tool_calls":[{"id":"q","type":"function","function":{"name":"yes","arguments":"{\\"k\\":1}"}}]}'),
            (25, 0, "assistant", '{"tool_calls":[{"id":{"a":1},"name":7,"arguments":"\\ud800","after":[null,3]}, null]}')]
    got = toolchat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame(schemas, "name string, schema string")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["seq"])):
        by.setdefault(r["conv_id"], []).append(r)
    errors = {c: e[0]["errors"] for c, e in by.items() if c < 20}
    unusable, fine = ["schema: not usable"], []
    assert errors == {1: unusable, 2: unusable, 3: unusable, 4: ["$: none of the forms"], 5: fine, 6: ["$: keyword dependentRequired is not read"], 7: ["$: number of items", "$[0]: out of bounds"], 8: fine,
                      9: ["$: not allowed"], 10: fine, 11: unusable, 12: ["$: not one of the values"], 13: ["$: not of type array"]}
    assert by[20][0]["kind"] == "message" and by[20][0]["line"] == '{"content":"{\\"tool_call_id\\":\\"1\\",\\"content\\":1e999}","role":"tool","type":"message"}'
    assert by[22][0]["call_id"] == "\\udc00" and by[22][0]["line"].startswith('{"content":"\\ud800"')
    assert [(r["kind"], r["line"]) for r in by[23]] == [("message", '{"content":"hello","role":"assistant","type":"message"}')]
    assert [(r["kind"], r["call_id"]) for r in by[24]] == [("message", None), ("call", "q")] and by[24][1]["line"] == '{"arguments":{"k":1},"id":"q","name":"yes","type":"call"}'
    assert [(r["kind"], r["call_id"], r["status"]) for r in by[25]] == [("call", '{"a":1}', "unanswered"), ("call", None, "no_id")]


def test_own_tool_json_of_turns_is_read(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"own","name":"f","arguments":{}}]}'), (1, 2, "user", "more"), (1, 3, "assistant", "yes"), (1, 4, "user", '{"tool_call_id":"own","content":2}')]
    got = toolchat.format_chats(toolchat.as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), spark.createDataFrame([("f", "{}")], "name string, schema string")).collect()
    assert {r["turn"]: (r["kind"], r["call_id"], r["status"], r["level"]) for r in got} == {
        0: ("call", "1:0", "unanswered", 0), 1: ("call", "own", "linked", 0), 2: ("call", "1:2", "linked", 2), 3: ("result", "1:2", "linked", 3), 4: ("result", "own", "linked", 1)}


def test_canonical_json():
    assert toolchat.canonical(toolchat.loads('{ "b": 1.0, "a": "\\u00e9\\n" }')) == '{"a":"é\\n","b":1.0}'
    with pytest.raises(ValueError):
        toolchat.loads("NaN")


# pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    passage = spark.read.parquet(f"{d}/benchmark.parquet").first()["text"]
    text = docs.filter("lang = 'en' AND n_chars BETWEEN 800 AND 2000").first()["text"]
    more = [(10**6, "123 456", "en", "a", 7), (10**6 + 1, text, "en", "a", 1), (10**6 + 2, text + "  ", "en", "a", 1), (10**6 + 3, f"{text[:200]} {passage} {text[:100]}", "en", "b", 1), (None, None, None, None, None)]
    start = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("kept", F.lit(3))
    at, seen = start, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, d)
        assert at.columns == start.columns + (["copies"] if i == 4 else [])
        seen[name] = Counter(r["doc_id"] for r in at.select("doc_id").collect())
        assert all(n == 1 for n in seen[name].values())
    ids = {k: set(v) for k, v in seen.items()}
    assert 10**6 not in ids["language ID"] and None not in ids["language ID"] and len(ids["language ID"]) >= docs.count() * 0.97
    assert not ids["exact dedup"] & {10**6 + 1, 10**6 + 2} or 10**6 + 2 in ids["exact dedup"]
    assert 10**6 + 3 in ids["SimHash near-dedup"] and 10**6 + 3 not in ids["benchmark decontamination"]
    empty = start.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 50 and out.columns[-1] == "copies"
