"""Fill-in-the-middle, token alignment and sharding against brute force, with odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import alignment, fim, licenses, sharding, toxicity

SCHEMA = "doc_id long, text string, n long, _id string, pairs long, output string, shard int, bytes string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(texts):
    """Documents with columns whose names clash with those the operators use inside."""
    return [(i, t, 3, "x", 9, "y", 1, "z") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    alphabet = "abcdeé ß\n\t  ,.;'sü🙂漢字0123  ́\r_<>"
    texts = ["".join(r.choices(alphabet, k=r.randint(1, 200))) for _ in range(80)]
    vocab = ["the", "Haus", "maison,", "perro.", "don't", "  two", "x\n\ny", "ﬁ", "2024", "éá"]
    texts += [" ".join(r.choices(vocab, k=r.randint(1, 60))) for _ in range(80)]
    texts += [texts[100]] * 30 + ["", None, " ", "  ", "\n", "a<P>b", "<S>", "x<M", "with ▁ mark", "▁", "<0x41> <|endoftext|> </s>", "word " * 20000, "n" * 30000, " lead", "trail "]
    found = list(enumerate(texts))
    return spark.createDataFrame(rows_of([*found, (5, texts[5]), (5, texts[5]), (None, texts[0]), (None, None)]), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def written_out(id_, text):
    """The contract of fill-in-the-middle, said once more."""
    text = text or ""
    n, hexes = len(text), hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(hexes[i : i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return id_, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return id_, n, form, a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_in_middle(docs, empty):
    want = Counter(written_out(r.doc_id, r.text) for r in docs.collect())
    found = fim.transformed(docs, digests=True)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, found.collect())) == want
    assert {k[2] for k in want} == {"plain", "psm", "spm"}
    assert fim.transformed(empty).count() == 0


@pytest.mark.parametrize("unit", [fim.WORDS, fim.LINES, fim.CHARACTERS, r"[a-z]+"])
def test_fill_in_middle_by_units(docs, unit):
    rows = fim.restored(fim.transformed(docs, unit), out_col="back").collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    pattern = re.compile(unit)
    for r in rows:
        assert r.back in texts[r.doc_id]
        ends = [m.end() for m in pattern.finditer(r.back)]
        assert r.n == len(ends)
        if r.form != "plain":
            assert r.prefix_chars in [0, *ends] and r.prefix_chars + r.middle_chars in [0, *ends]


def test_runs_of_units_end_where_single_units_do():
    for text in ("a" * 1000, "ab 12cd  e", "", "🙂é\n" * 300):
        for unit in (fim.CHARACTERS, fim.WORDS, fim.LINES, "[a-z]+"):
            assert list(fim.unit_ends(text, fim.runs_of(unit))) == [m.end() for m in re.finditer(unit, text)]


def token_bytes():
    from tesserae.llm.bpe import byte_symbols

    t, s = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    symbols = byte_symbols()
    of_a = lambda i: bytes(symbols[c] for c in t.id_to_token(i))
    of_b = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()
    return t, s, of_a, of_b


def linked(rows):
    """Alignment of every text by walking over its tokens, with the libraries' own encoders."""
    t, s, of_a, of_b = token_bytes()
    out, holds = [], Counter()
    for r in rows:
        text = r.text or ""
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, s.encode(text)) if text else ([], [])
        want = (" " + text).encode()
        if b"".join(map(of_a, a)) != want or b"".join(map(of_b, b)) != want:
            a, b = [], []
        spans = []
        for ids, of in ((a, of_a), (b, of_b)):
            at, found = 0, []
            for i in ids:
                found.append((at, at := at + len(of(i))))
            spans.append(found)
        i = j = 0
        links, groups, ga, gb = [], [], [], []
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            (_, ea), (_, eb) = spans[0][i], spans[1][j]
            if ea <= eb:
                ga.append(str(a[i]))
                i += 1
            if eb <= ea:
                gb.append(str(b[j]))
                j += 1
            if ea == eb:
                groups.append(f"{','.join(ga)}|{','.join(gb)}")
                ga, gb = [], []
        holds.update(set(links))
        out.append((r.doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    return Counter((d, na, nb, ng, len(ls), sum(holds[x] == top[x[0]] for x in ls), sum(holds[x] for x in ls), sha) for d, na, nb, ng, ls, sha in out)


@pytest.fixture(scope="module")
def brute_links(docs):
    return linked(docs.collect())


@pytest.mark.parametrize("hot", [alignment.HOT, 20, 0])
def test_alignment(docs, brute_links, hot):
    found = alignment.scored(docs, A, B, hot=hot)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == brute_links


def test_alignment_forgets_and_takes_whole_texts(docs, brute_links, spark):
    """One task in which nearly nothing is kept, and texts that aren't cut at all, come to the same."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], names=["_id", "_text"])
    want = Counter((k[0], *k[1:5], k[7]) for k in brute_links.elements())
    kept, block = alignment.KEPT, alignment.BLOCK
    alignment.KEPT, alignment.BLOCK = 5, 1000
    alignment.load.cache_clear()
    try:
        for parted in (True, False):
            pair = alignment.load(A, B)
            pair.b.parted = parted
            found = Counter()
            for out in alignment._measured(A, B)(iter([batch])):
                found.update((r["_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in out.to_pylist())
                assert len(pair.known.good) <= 5
            assert found == want
    finally:
        alignment.KEPT, alignment.BLOCK = kept, block
        alignment.load.cache_clear()


def test_alignment_in_full_and_on_an_empty_table(docs, empty):
    assert alignment.scored(empty, A, B).count() == 0
    t, s, of_a, of_b = token_bytes()
    for r in alignment.aligned(docs.filter("length(text) < 500"), A, B).collect():
        parts = defaultdict(lambda: [b"", b""])
        for ids, groups, side, of in ((r.a_ids, r.a_groups, 0, of_a), (r.b_ids, r.b_groups, 1, of_b)):
            for i, g in zip(ids, groups, strict=True):
                parts[g][side] += of(i)
        assert all(x == y for x, y in parts.values())
        assert len(set(zip(r.link_a, r.link_b, strict=True))) == len(r.link_a)


def shard_rows(df):
    return [tuple(r[c] for c in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")) for r in df.collect()]


def check_shards(given, found, shards, most_apart):
    """The contract: whole rows, right sizes and checksums, gapless slots, near-equal bytes."""
    sha = lambda t: ((t or "").encode(), len((t or "").encode()) + 16)
    want = Counter((i, sha(t)[1], zlib.crc32(sha(t)[0])) for i, t in given)
    assert Counter(r[:3] for r in found) == want
    slots, total = defaultdict(list), Counter()
    for r in found:
        assert r[3] == "bytes" and 0 <= r[4] < shards and r[6] is None
        slots[r[4]].append(r[5])
        total[r[4]] += r[1]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total[i] for i in range(shards)) - min(total[i] for i in range(shards)) <= most_apart


def test_shards_of_equal_rows_and_distinct_rows(spark, sf):
    r = random.Random(3)
    rows = [(i, "w" * r.randint(0, 300), r.choice(["de", "en", None]), r.choice("abc"), float(r.randint(0, 9))) for i in range(3000)]
    rows += [(7, "same text", "en", "a", 9.0)] * 1500 + [(10_000 + i, "copy", "en", "a", 9.0) for i in range(1500)]
    rows += [(None, None, None, None, None)] * 40 + [(9, "x" * 60, "en", "b", float("nan"))] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars double").repartition(7)
    found = shard_rows(sharding.assigned(docs, 40))
    check_shards([(x[0], x[1]) for x in rows], found, 40, 6 * 316)
    by_shard = defaultdict(set)
    for x in found:
        by_shard[x[2]].add(x[4])
    assert len(by_shard[zlib.crc32(b"same text")]) > 1  # a third of the rows is cut like others
    one = shard_rows(sharding.assigned(docs, 1))
    check_shards([(x[0], x[1]) for x in rows], one, 1, 0)


def test_shards_are_neighbours_in_the_metadata(spark):
    """With one dimension shards are ranges of it."""
    rows = [(i, "t" * 84, "en", "a", (i * 7919) % 4000) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sharding.assigned(docs, 10, ("n_chars",)).join(docs.select("doc_id", "n_chars"), "doc_id").groupBy("shard").agg(F.min("n_chars").alias("a"), F.max("n_chars").alias("b"), F.count("*").alias("n")).orderBy("shard").collect()
    assert [r["n"] for r in found] == [400] * 10
    assert [(r["a"], r["b"]) for r in found] == [(400 * k, 400 * k + 399) for k in range(10)]


def test_shards_clashing_names_and_empty(docs, empty):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    check_shards(given, shard_rows(sharding.assigned(docs, 4, ("n", "_id", "bytes"))), 4, 600_000)
    assert sharding.assigned(empty, 40, ("n", "_id")).count() == 0


def test_shards_are_written(docs, spark, tmp_path):
    made = sharding.sharded(docs, f"{tmp_path}/out", 40_000, ("n", "shard"))
    back = spark.read.parquet(f"{tmp_path}/out")
    assert "shard_" in back.columns and back.select("shard_").distinct().count() <= made
    assert Counter(map(tuple, back.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))


CONFUSIONS = [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0 notice"),
    ("Licensed under CC BY-NC 3.0.", None),
    ("Licensed under CC BY-NC-SA 4.0.", None),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0 notice"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", None),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", None),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", None),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0 notice"),
    ("This work is licensed under the GNU General Public License, version 2.", None),
    ("This work is licensed under the GNU Affero General Public License, version 3.", None),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", None),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0 notice"),
    ("Licensed under the Apache License, Version 1.1.", None),
    ("Licensed under the Apache License, Version 2.", "Apache-2.0 notice"),
]


def test_licences_that_differ_by_a_word(spark):
    long = [
        (licenses.TEMPLATES["GPL-3.0"], "GPL-3.0"), (licenses.TEMPLATES["GPL-2.0"], "GPL-2.0"), (licenses.TEMPLATES["LGPL-3.0"], "LGPL-3.0"),
        (licenses.TEMPLATES["GPL-3.0"].replace("GNU GENERAL", "GNU AFFERO GENERAL").replace("GNU General", "GNU Affero General"), None),
        (licenses.TEMPLATES["CC-BY-SA-4.0"].replace("ShareAlike", "NonCommercial"), None), (licenses.TEMPLATES["CC-BY-SA-4.0"], "CC-BY-SA-4.0"),
        (licenses.TEMPLATES["AGPL-3.0 header"], "AGPL-3.0 header"), (licenses.TEMPLATES["GPL-2.0 header"], "GPL-2.0 header"), (licenses.TEMPLATES["GPL-3.0 header"], "GPL-3.0 header"),
        (licenses.TEMPLATES["GPL-3.0 header"].replace("version 3", "version 4"), None), (licenses.TEMPLATES["MPL-2.0 header"].replace("2.0", "1.1"), None),
    ]
    cases = CONFUSIONS + long
    inside = [(f"Some words before it. {text} And some behind.", name) for text, name in CONFUSIONS]
    rows = [(i, t) for i, (t, _) in enumerate(cases + inside)]
    got = defaultdict(set)
    for r in licenses.scan(spark.createDataFrame(rows_of(rows), SCHEMA)).collect():
        got[r.doc_id].add(r.license)
    for i, (text, name) in enumerate(cases + inside):
        if name:
            assert name in got[i] and not any(n.startswith(licenses.UNKNOWN) for n in got[i]), (text[:80], got[i])
        else:
            assert all(n.startswith(licenses.UNKNOWN) for n in got[i]), (text[:80], got[i])


def test_one_long_text_shuts_no_other_out(spark):
    bad, fine = ["you filthy idiot scum", "shut up moron scum"], ["a quiet walk by the river", "the recipe needs two eggs"]
    rows = [(i, (bad if i % 2 else fine)[i // 2 % 2] + f" {i}") for i in range(80)]
    docs = spark.createDataFrame([*rows, *((1000 + i, "x " * 3000) for i in range(4))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(1000 + i, 0) for i in range(4)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, chars=32_000)
    assert model is not None
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i in range(1, 80, 2)) > max(scores[i] for i in range(0, 80, 2))
