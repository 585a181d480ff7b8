"""Archives, chat records and the pipeline."""

import base64
import gzip
import hashlib
import io
import json

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat, exact_dedup, minhash, quality, toxicity, warc
from tesserae.runtime import scratch_path, table

LONG = "é<p>x</p>\r\n\r\n" * 60000


@pytest.fixture(scope="module")
def pages(spark):
    big = "y" * 1000
    rows = [(1, "http://a/1", big), (3, "http://a/ b\r\nX: y", big), (2, None, big), (3, "http://a/3", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", LONG), (None, "u", LONG), (None, "u", "z")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, _sha int")


def test_archives_read_back(spark, pages):
    got = sorted(map(tuple, warc.archived(pages).collect()), key=str)
    want = []
    for r in pages.collect():
        data = (r.html or "").encode()
        best = max((p.page_id for p in pages.collect() if p.html == r.html and p.page_id is not None), default=None) if len(data) >= 1000 else None
        again = best is not None and r.page_id != best
        want.append((r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", best if again else None, True))
    assert got == sorted(want, key=str)
    assert warc.archived(pages.limit(0)).count() == 0


def test_chunks_hold_the_payload_and_running_digests(spark, pages):
    chunks = warc.read(warc.write(pages.filter("page_id = 8"), scratch_path(spark, "warc-test"))).orderBy("chunk_no").collect()
    assert len(chunks) > 2 and b"".join(bytes(c.data) for c in chunks) == LONG.encode()
    seen = hashlib.sha1()
    for c in chunks:
        seen.update(bytes(c.data))
        assert c.payload_digest == seen.hexdigest() and len(c.data) <= 2 * warc.CHUNK
    assert [c.is_last for c in chunks] == [False] * (len(chunks) - 1) + [True]


def test_archive_bytes_follow_the_format(spark, pages):
    folder = scratch_path(spark, "warc-bytes")
    path = warc.write(pages.filter("page_id = 4").coalesce(1), folder).first().path
    raw = gzip.decompress(open(path.removeprefix("file:"), "rb").read())
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert raw.startswith(b"WARC/1.1\r\n") and rest.endswith(b"small\r\n\r\n") and int(fields["Content-Length"]) == len(rest) - 4
    assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"small").digest()).decode()
    plain = list(warc.chunks_of(io.BytesIO(raw), True))
    assert [(c[0], c[2], c[11]) for c in plain] == [(4, "response", b"small")]


def test_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame(
        [("a", 1, 0, "f", '{"x": 1, "b": "é"}', None), ("b", 1, 2, "f", '{"x": "no"}', ["a"]), ("c", 1, 4, "f", "{bad", ["a", "b", "b"]), ("c", 1, 3, "g", None, ["b", "a"]), ("d", 2, 1, "f", '{"x": 2}', ["missing"]), ("e", 2, 1, "f", '{"x": 2}', ["g"]), ("g", 2, 2, "f", '{"x": 2}', ["e"]), (None, 9, 9, "f", "{}", None), ("h", 3, 1, "f", '{"x": 3}', ["c"]), ("i", 3, 1, "f", '{"x": 3}', ["h"])],
        "call_id string, conv_id long, turn long, name string, arguments string, needs array<string>",
    )
    results = spark.createDataFrame([("a", 5, "late"), ("a", 1, "first"), ("z", 1, "lost"), ("i", 2, None)], "call_id string, turn long, content string")
    schema = {"f": {"required": ["x"], "properties": {"x": {"type": "integer"}}}}
    got = {r.call_id: r for r in chat.formatted(calls, results, schema).collect()}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "g": None, "h": 3, "i": 4, "z": None}
    assert {k: r.status for k, r in got.items()} == {"a": "linked", "b": "unanswered", "c": "unanswered", "d": "unordered", "e": "unordered", "g": "unordered", "h": "unanswered", "i": "linked", "z": "orphan"}
    assert [got[k].valid for k in "abc"] == [True, False, False] and got["c"].problems == ["$: no such tool"]
    assert got["a"].message_json == '{"arguments":{"b":"é","x":1},"id":"a","name":"f","result":"first","valid":true}'
    assert chat.formatted(calls.limit(0), results.limit(0), schema).count() == 0


def test_every_row_of_a_conversation_has_a_record(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 1, "user", "other"), (1, 2, "assistant", "yes"), (1, 2, "assistant", "no"), (1, 3, "tool", "x"), (1, None, "user", "when"), (1, 4, None, None), (2, 5, "user", "alone"), (2, 9, "assistant", "late"), (None, 1, "user", "who"), (3, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.records(df).collect()
    made = {tuple(json.loads(r.message_json)[k] for k in ("conv_id", "turn", "role", "text")): r for r in got}
    assert len(got) == len(rows) and made.keys() == set(rows)
    want = ["context", "linked", "repeated", "repeated", "linked", "context", "unlinked", "context", "unanswered", "orphan", "unanswered", "context"]
    assert [made[r].status for r in rows] == want
    assert (made[rows[1]].n_calls, made[rows[1]].n_results, made[rows[0]].n_calls) == (2, 2, 0)


def test_long_chains_take_few_rounds(spark):
    calls = spark.range(300).select(F.col("id").cast("string").alias("call_id"), F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("f").alias("name"), F.lit("{}").alias("arguments"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("needs"))
    results = calls.limit(0).select("call_id", "turn", F.lit("x").alias("content"))
    assert {(int(r.call_id), r.level) for r in chat.levels(chat.link(calls, results)).collect()} == {(i, i) for i in range(300)}


def test_schema_problems():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"enum": [1, 2]}}, "b": {"type": ["string", "null"], "maxLength": 2}, "n": {"type": "number", "minimum": 0, "maximum": 5}}}
    assert chat.problems({"a": [1, 2], "b": None, "n": 2.5}, schema) == []
    assert chat.problems({"a": [3], "b": "xyz", "n": True, "q": 1}, schema) == ["$.a[0]: not in enum", "$.b: too long", "$.n: not of type number", "$.q: not allowed"]
    assert chat.problems({"n": -1}, schema) == ["$.a: missing", "$.n: too small"] and json.loads(chat.canonical({"b": 1, "a": "é"})) == {"a": "é", "b": 1}


def test_pipeline_is_its_stages_one_by_one(spark, sf):
    docs, left = table(spark, sf, "documents"), None
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    kept = docs.filter(F.col("doc_id").isin([i for i, s in scores.items() if s < 0.5]))
    for stage in (quality.clean, exact_dedup.drop_copies, minhash.drop_near_copies):
        kept = spark.createDataFrame(stage(kept).collect(), docs.schema)
    left = {r.doc_id for r in kept.collect()}
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "exact dedup", "MinHash near-dedup", "best-fit packing"]


@pytest.mark.parametrize("text", ['{"x": NaN}', '{"x": "\\ud800"}', '{"x": 1e999}', '{"x": ' + "[" * 100_000 + "]" * 100_000 + "}"])
def test_arguments_that_are_no_json_stay_text(text):
    value, found = chat.checked(text, {})
    assert value == text and found == ["$: not JSON"]


def test_arguments_are_judged_and_written_one_way():
    assert chat.checked(None, {}) == ({}, []) and chat.checked("", {}) == ({}, [])
    assert chat.checked('{"x": 1.0}', {"properties": {"x": {"type": "integer"}}})[1] == []
    assert chat.checked('{"x": 1.5}', {"properties": {"x": {"type": "integer"}}})[1] == ["$.x: not of type integer"]
    assert chat.checked('{"x": 1}', {"properties": {"x": {"type": "decimal"}}})[1] == ["$.x: schema names no known type: decimal"]
    assert chat.canonical({"b": 1.0, "a": [{"\U0001f600": 2.5, "￼": True}]}) == '{"a":[{"\U0001f600":2.5,"￼":true}],"b":1}'


def test_odd_digests_and_heads_of_foreign_archives():
    body = b"<p>hi</p>"
    sha = hashlib.sha1(body).hexdigest()

    def record(digest, content):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: {len(content)}\r\n\r\n"
        return head.encode() + content + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n" + body
    for digest, sound in ((f"sha1:{sha}", True), (f"sha1:{'0' * 40}", False), ("sha1:odd!", True), ("md5:xyz", True), ("", True)):
        row = list(warc.chunks_of(io.BytesIO(record(digest, http)), True))[-1]
        assert row[9] == sha and row[10] is sound
    endless = b"HTTP/1.1 200 OK\r\nX: " + b"y" * (warc.HEAD + 5)
    assert sum(c[6] for c in warc.chunks_of(io.BytesIO(record("", endless)), False)) == len(endless)


def test_clean_keeps_blank_lines_and_knows_other_stops(spark):
    line = "The cat sat on the mat, and the dog lay by the door. It was a long day. Nobody came to the house at all."
    long = " ".join(["शब्द"] * 12 + [f"क{i}" for i in range(18)]) + "।"
    df = spark.createDataFrame([(1, f"{line}\n\n\nMore of it.\nMore of it.\n\nThat is all.\n"), (2, line + "\n" + long)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert got[1] == f"{line}\n\n\nMore of it.\n\nThat is all.\n"
    why = {r.line: r.why for r in df.filter("doc_id = 2").select(F.explode(quality.judged_lines(F.col("text"))).alias("x")).select("x.*").collect()}
    assert why[long] != "punctuation"
