"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import bpe, exact_dedup, licenses, line_dedup, minhash, packing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, kept boolean, _id long, _sha string, bucket long"


def rows_of(texts):
    """Documents with columns whose names clash with those the operators use inside."""
    return [(i, t, bool(i), 7, "x", 1) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["The", "the", "of", "Ünïcode", "a,b."]
    texts = [" ".join(r.choices(vocab, k=r.randint(1, 120))) for _ in range(60)]
    base = r.choices(vocab, k=150)
    for n in range(12):
        w = list(base)
        for _ in range(n % 4):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].replace(" ", "\n\t"), "", None, "   ", "one", "ONE", "two words", "x " * 30000, texts[3].upper()]
    found = list(enumerate(texts))
    return spark.createDataFrame(rows_of([*found, (5, texts[5]), (None, texts[0]), (None, "alone with a null id")]), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    groups, norm = defaultdict(list), lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    given = docs.select("doc_id", "text").collect()
    for r in given:
        groups[norm(r.text)].append(r.doc_id)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r.doc_id, keep[norm(r.text)], len(groups[norm(r.text)]), r.doc_id == keep[norm(r.text)], hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in given)
    assert Counter(map(tuple, exact_dedup.mark_copies(docs).collect())) == want
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(norm(r.text) for r in left.collect()) == Counter(list(groups))
    assert exact_dedup.mark_copies(empty).count() == 0


def sets_of(given):
    out = []
    for r in given:
        w = WORD.findall((r.text or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def test_near_copies(docs, empty):
    given = docs.select("doc_id", "text").collect()
    sets = sets_of(given)
    parent = {r.doc_id: r.doc_id for r in given if r.doc_id is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([(r.doc_id, s) for r, s in zip(given, sets, strict=True) if r.doc_id is not None and s], 2):
        if 100 * len(s & t) >= 85 * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = Counter((r.doc_id, len(s), None if r.doc_id is None else find(r.doc_id), r.doc_id is None or find(r.doc_id) == r.doc_id) for r, s in zip(given, sets, strict=True))
    assert Counter(map(tuple, minhash.near_copies(docs).collect())) == want
    assert minhash.near_copies(empty).count() == 0


def test_drop_near_copies_keeps_one_of_each(docs):
    left = minhash.drop_near_copies(docs, percent=85)
    assert left.columns == docs.columns
    want = {r.doc_id for r in minhash.near_copies(docs).filter("kept").collect()}
    assert {r.doc_id for r in left.collect()} == want


def test_densified_signatures_agree_as_sets_do():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:340], r.integers(0, 1 << 63, 60, dtype=np.uint64)]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - j) < 0.12
    assert len(set(minhash.signature(a[:1]).tolist())) == 1


def base_of(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


CLEAN = "The cat sat on the mat, and the dog lay by the door. It was a long day. Nobody came to the house at all."
JUNK = ["home | about | contact | login", "a### b### c### d###", "WIN!! NOW!! BUY!! FAST!!", "la la la la la la", "we uses cookies here, accept all cookies", "one two " * 20]


def test_quality_lines_and_base(spark, docs, empty):
    extra = spark.createDataFrame(rows_of([(1000 + i, CLEAN + "\n" + x) for i, x in enumerate(JUNK)] + [(2000, CLEAN), (2001, "\n".join(JUNK)), (2002, CLEAN + "\n" + CLEAN)]), SCHEMA)
    both = docs.unionByName(extra)
    given = both.select("doc_id", "text").collect()
    got = quality.signals(both).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r.doc_id, *base_of(r.text)) for r in given)
    by = {r.doc_id: r for r in got}
    assert by[2000].kept and by[2000].lost_share == 0 and not by[2001].kept
    assert all(0 < by[1000 + i].lost_share for i in range(len(JUNK)))
    text = {r.doc_id: r.text for r in quality.clean(both).collect()}
    assert text[2000] == CLEAN and all(text.get(1000 + i, CLEAN) == CLEAN for i in range(len(JUNK)))
    assert quality.clean(both).columns == both.columns and quality.signals(empty).count() == 0


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def test_line_dedup(spark):
    r = random.Random(9)
    line = " ".join(f"word{r.randrange(500)}" for _ in range(160))
    other = line.replace(line.split()[80], "changed")
    texts = [(3, f"{line}\nfirst line here\n\n"), (1, f"{other}\nFirst  LINE here"), (2, None), (4, ""), (5, "page 12 of 30\n" + line), (6, "page 7 of 9"), (6, "page 7 of 9"), (None, "first line here")]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    rows = df.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "raw")).select("doc_id", "no", line_dedup.normalised(F.col("raw")).alias("line")).filter("line <> ''")
    rows = rows.collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    first = {}
    for x in rows:
        o = (x.doc_id, x.no)
        first[x.line] = min(first.get(x.line, o), o, key=key)
    parent = {x: x for x in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a, b in itertools.combinations(first, 2):
        if lev(a, b) <= max(len(a), len(b)) * 20 // 100:
            parent[find(a)], links = find(b), links + 1
    best = {}
    for x in first:
        best[find(x)] = min(best.get(find(x), first[x]), first[x], key=key)
    want = Counter((x.doc_id, x.no, *best[find(x.line)], (x.doc_id, x.no) == best[find(x.line)]) for x in rows)
    assert Counter(map(tuple, line_dedup.mark_lines(df).collect())) == want
    left = line_dedup.drop_lines(df)
    assert left.columns == df.columns and left.count() == df.count()


def test_line_dedup_finds_all_lines_with_one_word_changed(spark):
    r = random.Random(10)
    lines = []
    for n in (3, 4, 5, 5, 6, 7, 8, 9, 12, 15, 20, 24, 32, 40, 60, 80):
        words = ["".join(r.choices("abcdefghijkl", k=r.randint(2, 7))) for _ in range(n)]
        words[n // 2] = "bad"
        lines += [" ".join(words), " ".join([*words[: n // 2], "god", *words[n // 2 + 1 :]])]
    df = spark.createDataFrame(rows_of(list(enumerate(lines))), SCHEMA)
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(lines)), 2):
        if min(len(lines[a]), len(lines[b])) * 5 >= max(len(lines[a]), len(lines[b])) * 4 and lev(lines[a], lines[b]) <= max(len(lines[a]), len(lines[b])) * 20 // 100:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert sum(find(x) != x for x in range(len(lines))) >= 15
    got = {x.doc_id: x.keep_id for x in line_dedup.mark_lines(df).collect()}
    assert got == {i: find(i) for i in range(len(lines))}


PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "<|endoftext|>x<|endoftext|>", " hello  world\n\n\tfoo ", "it's we'll don't I'm", "日本語テスト 🎉🎉 é", "a" * 500, "  x", "x \n y", "   ", "\n", "1234567 89", "!!!???...", "foo\r\nbar", "' 's 't", "\x00\x01", "x\u0085y z", "\x1c a \x1d", "thththe"]


def test_bpe_is_the_librarys(spark, sf, docs):
    known = Tokenizer.from_file(PATH)
    known.no_padding()
    known.no_truncation()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    encoder = bpe.load(PATH)
    for t in texts:
        ids = known.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == ids
        assert encoder.decode(np.array(ids, "<u4").tobytes()) == known.decode(ids, skip_special_tokens=False)
    assert encoder.decode(np.array([0, 50256, 127, 200, 181], "<u4").tobytes()) == known.decode([0, 50256, 127, 200, 181], skip_special_tokens=False)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).select("doc_id", F.col("text").alias("t"))
    assert Counter((r.doc_id, r.t) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())


def test_merge_gadgets_on_a_small_alphabet():
    r = random.Random(3)
    for _ in range(40):
        labels, merges, made = [bytes([c]) for c in b"abc"], [], {b"a", b"b", b"c"}
        while len(merges) < 8:
            x, y = r.randrange(len(labels)), r.randrange(len(labels))
            if labels[x] + labels[y] not in made:
                made.add(labels[x] + labels[y])
                merges.append((x, y, len(labels)))
                labels.append(labels[x] + labels[y])
        machine = bpe.Automaton(labels, merges)
        rank = {(x, y): (k, m) for k, (x, y, m) in enumerate(merges)}
        for word in map(bytes, itertools.product(b"abc", repeat=6)):
            ids = [b"abc".index(c) for c in word]
            while found := [(rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]:
                _, i = min(found)
                ids[i : i + 2] = [rank[ids[i], ids[i + 1]][1]]
            assert machine.encode(word) == ids


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= items[i]}.values():
            bins[k] -= items[i]
            go(i + 1, bins)
            bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_loses_no_optimum():
    r = random.Random(1)
    for _ in range(400):
        c = r.choice([10, 12, 20, 30])
        items = [r.randint(1, c) for _ in range(r.randint(1, 8))]
        rest = np.bincount(items, minlength=c + 1)
        fixed = packing.dominated(rest)
        left = [s for s in range(c + 1) for _ in range(rest[s])]
        assert fewest(items, c) == sum(t for _, t in fixed) + (fewest(left, c) if left else 0)


def test_pack(docs, empty):
    known = Tokenizer.from_file(PATH)
    want = Counter()
    for r in docs.collect():
        ids = [*known.encode(r.text or "", add_special_tokens=False).ids, 2]
        start = piece = 0
        while start < len(ids):
            n = (len(ids) - start) % 1024 or 1024
            want[(r.doc_id, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
            start, piece = start + n, piece + 1
    got = packing.pack(docs, PATH).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [0, *itertools.accumulate(n for _, n in p[:-1])] and sum(n for _, n in p) <= 1024
    assert len(places) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(empty, PATH).count() == 0


def test_licences(spark, docs, empty):
    templates = dict(licenses.TEMPLATES)
    texts = [(1, templates["MIT"]), (2, "Something else.\n" + templates["MIT notice"] + "\nMore."), (3, templates["ISC"].replace("software", "program")), (4, None), (5, "word"), (6, templates["Zlib"][:300] + "\n" + templates["Zlib"][300:])]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).unionByName(docs)
    got = Counter((r.doc_id, r.unit, r.license, round(r.dice, 9), r.start, r.end) for r in licenses.scan(df).collect())
    scanner, want = licenses.Scanner(templates, 0.8), Counter()
    scanner.best = lambda unit: max(((n, licenses.dice(licenses.bigrams(unit), licenses.bigrams(t)), 0) for n, t in sorted(templates.items())), key=lambda x: x[1]) if licenses.bigrams(unit) else None
    for r in df.collect():
        for unit, name, score, a, b in scanner.scan(r.text or "") if len(r.text or "") < 20000 else []:
            if score >= 0.8:
                want[(r.doc_id, unit, name, round(score, 9), a, b)] += 1
    assert got == want and {1, 2, 3, 6} <= {k[0] for k in got}
    assert licenses.scan(empty).count() == 0


def test_licences_in_no_unit_are_found(spark):
    mit, apache, gpl = (licenses.TEMPLATES[n] for n in ("MIT", "Apache-2.0 header", "GPL-3.0 header"))
    parts = mit.replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    filler = "Some words about a project that nobody knows. " * 40
    texts = [
        f"{filler}\n\n{parts}\n\n{filler}\n\n{parts}\n{filler}",
        f"{filler}\n" + apache.replace(" Unless", "\n\nUnless").replace(" You may", "\n\nYou may") + f"\n{filler}",
        "İ " + filler + gpl.replace(" This program is", "\n\nThis program is").replace(" You should", "\n\nYou should") + "\nint main() { return 0; }\n" + filler,
        "My project is a tool for many things and it is Released under the MIT License. See the file for more of that.",
    ]
    got = licenses.scan(spark.createDataFrame(rows_of(enumerate(texts)), SCHEMA)).filter("unit = 'span'").collect()
    assert Counter((r.doc_id, r.license) for r in got) == Counter([(0, "MIT"), (0, "MIT"), (1, "Apache-2.0 header"), (2, "GPL-3.0 header"), (3, "MIT notice")])
    for r in got:
        assert r.dice == pytest.approx(licenses.dice(licenses.bigrams(texts[r.doc_id][r.start : r.end]), licenses.bigrams(licenses.TEMPLATES[r.license])))
        assert r.dice > 0.95


def test_complete_licence_texts_are_found(spark):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"]
    assert all(len(licenses.TEMPLATES[n].split()) > 180 for n in names)
    disclaimer = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE"
    assert disclaimer in licenses.TEMPLATES["BSD-2-Clause"] and "Neither the name" in licenses.TEMPLATES["BSD-3-Clause"]
    filler = "Some words about a project that nobody knows. " * 100
    rows = [(i, licenses.TEMPLATES[n]) for i, n in enumerate(names)] + [(100 + i, f"{filler}\n\n{licenses.TEMPLATES[n]}\n{filler}" * 2) for i, n in enumerate(names)]
    got = licenses.scan(spark.createDataFrame(rows_of(rows), SCHEMA)).collect()
    assert {r.doc_id: r.license for r in got if r.unit == "text" and r.doc_id < 100} == dict(enumerate(names))
    for i, n in enumerate(names):
        assert sum(r.license == n and r.unit in ("span", "block") and r.dice > 0.95 for r in got if r.doc_id == 100 + i) >= 2


def test_toxicity_learns_words_and_stems(spark, empty):
    r = random.Random(4)
    plain = ["".join(r.choices("aeioulmnrst", k=r.randint(3, 8))) for _ in range(400)]
    bad = ["vilxq" + "".join(r.choices("aeiou", k=3)) for _ in range(12)]
    rows = []
    for i in range(500):
        words = r.choices(plain, k=r.randint(20, 150))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3 + len(words) // 25):
                words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9002, "")], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.judged(df.select("doc_id", "text").unionByName(odd), labels).collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.5) and 0 <= x.score <= 1 for i, x in got.items())
    held = [(t, got[i].predicted) for i, _, t in rows if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert got[9001].score == got[9002].score == 0.0
    assert toxicity.judged(empty, labels.limit(0)).count() == 0


def test_gradients():
    net, r = toxicity.Net(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, at = r.normal(size=(9, toxicity.INPUTS)), r.integers(0, 9, (5, toxicity.WINDOW))
    there, y = np.ones_like(at, bool), np.array([0, 1, 1, 0, 1.0])
    there[:, 20:] = False
    loss = lambda: np.mean(np.logaddexp(0, z := net.forward(x, at, there)) - y * z)
    kept: dict = {}
    grads = net.backward(kept, (1 / (1 + np.exp(-net.forward(x, at, there, kept))) - y) / 5)
    for name, v in net.p.items():
        i = tuple(r.integers(0, s) for s in v.shape)
        was = v[i]
        v[i] = was + 1e-4
        up = loss()
        v[i] = was - 1e-4
        down = loss()
        v[i] = was
        assert grads[name][i] == pytest.approx((up - down) / 2e-4, abs=1e-6)


def test_windows_cover_every_word():
    place, owner = toxicity.windows(np.array([0, 1, 32, 33, 100]))
    assert sorted(set(place[place >= 0].tolist())) == list(range(166)) and set(owner.tolist()) == {1, 2, 3, 4}
    assert pa.array([1]).null_count == 0
