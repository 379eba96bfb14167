"""Each method beside a plain implementation."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bagminhash as B
from tidemark.llm import linededup, mixing, outliers, pieces, pii, records, tokens, toxicity, winnowing
from tidemark.llm.common import words
from tidemark.session import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def fuzz(n, seed, top=60):
    rng = random.Random(seed)
    parts = [
        " ", "  ", "\n", "\t", "\x1c", "\x85", "e", "́", "É", "Σ", "ΟΣ", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "中", "1", "23",
        "!", "​", "ß", "ﬁ", "😀", "▁", "\x00", "<s>", "<0x41>", "한", "the", "tion",
    ]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, top))) for _ in range(n)]


# 1: mixing

def test_targets_share_all_words_and_are_capped(spark):
    rng = np.random.default_rng(4)
    for trial in range(4):
        given = [(f"s{i:02d}" if i else None, int(x)) for i, x in enumerate(rng.integers(0, 1000, 7) ** (1 + trial % 2))]
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(given, "source STRING, source_size LONG")).collect()}
        order = sorted((s for s, _ in given if s), key=lambda s: s) + [None]
        weight, size = {s: 1 + i % 3 for i, s in enumerate(order)}, dict(given)
        free, left, want = set(order), float(sum(size.values())), {}
        while True:
            share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = {s for s in free if share[s] > 3 * size[s]}
            if not over:
                want |= share
                break
            want |= {s: 3.0 * size[s] for s in over}
            left -= sum(3 * size[s] for s in over)
            free -= over
        assert got == pytest.approx(want)


def test_taken_words_come_near_targets_and_reruns_agree(docs, labels):
    mixed = mixing.mix(docs, labels)
    first, again = mixed.collect(), mixing.mix(docs.repartition(5), labels).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    per = Counter()
    for r in first:
        assert r.taken <= 3 * r["size"]
        per[r.source] += r.taken
    largest = Counter()
    for r in first:
        largest[r.source] = max(largest[r.source], r["size"])
    for r in first:
        assert abs(per[r.source] - r.target) <= largest[r.source] / 2 + 1e-6
    assert mixing.mixed_documents(docs, labels).count() == sum(r.copies for r in first)


def test_heavier_documents_come_first(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"))
    keyed = rows.select("id", mixing.exponential_key(F.col("w"), F.col("id")).alias("k")).orderBy("k").limit(400).collect()
    share = sum(r.id % 2 == 0 for r in keyed) / 400
    assert 0.74 < share < 0.86  # four to one


# 2: outliers

def test_counts_of_whole_texts(docs, texts):
    for r in outliers.judge(docs).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(grams)
        covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)}
        seen, again = set(), 0
        for line in texts[r.doc_id].split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        symbols = len(re.findall(r"[#*$%&|<>]", texts[r.doc_id]))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), symbols, again, len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_planted_outliers_go_and_the_rest_stays(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        w = ["".join(rng.choice(list("abcdeorst"), rng.integers(2, 9))) for _ in range(rng.integers(60, 200))]
        if i >= 390:
            w = [x for y in w for x in (y, "|" if rng.random() < 0.9 else "%")]
        rows.append((i, " ".join(w), "en", "s"))
    kept = {r.doc_id for r in outliers.judge(spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING")).filter("kept").collect()}
    assert kept == set(range(390))


def plain_mcd(x, h, starts=200):
    """Smallest log determinant over concentration from random subsets."""
    rng, best = np.random.default_rng(1), None
    for _ in range(starts):
        take, last = rng.choice(len(x), outliers.DIMS + 1, replace=False), np.inf
        while True:
            centre = x[take].mean(0)
            cov = np.cov(x[take].T, bias=True) + np.diag(np.square(outliers.FLOOR))
            det = np.linalg.slogdet(cov)[1]
            if len(take) == h:
                if det > last - 1e-9:
                    break
                last = det
            y = x - centre
            take = np.argsort(np.einsum("ij,ij->i", y @ np.linalg.inv(cov), y))[:h]
        if best is None or last < best[0]:
            best = (last, centre)
    return best


def test_minimum_determinant_beside_random_starts(spark):
    rng = np.random.default_rng(3)
    for trial in range(2):
        mix = np.eye(5) + 0.3 * rng.normal(size=(5, 5))
        x = rng.normal(size=(60, 5)) @ mix
        x[:12] = rng.normal(size=(12, 5)) * 0.3 + 9
        whole = np.round(x * outliers.GRID).astype(int)
        frame = spark.createDataFrame([("g", *map(int, r)) for r in whole], "grp STRING, " + ", ".join(f"{f} LONG" for f in outliers.FEATURES))
        got = outliers.minimum_determinant(frame).first()
        best, centre = plain_mcd(whole / outliers.GRID, 45)
        # A whole bin of distances enters, so a vector more than 45 may count.
        assert abs(got.log_det - best) < 0.6
        cov = np.zeros((5, 5))
        for k, (i, j) in enumerate(outliers.PAIRS):
            cov[i, j] = cov[j, i] = got.cov[k]
        y = whole / outliers.GRID - np.array(got.centre)
        d = np.einsum("ij,ij->i", y @ np.linalg.inv(cov), y)
        assert d[:12].min() > d[12:].max(), trial


def test_small_groups_lean_on_their_language_at_every_size(spark):
    rng = np.random.default_rng(5)
    def rows(n, pair, shift):
        return [([pair, "langx", "all"], *map(int, np.round((rng.normal(size=5) + shift) * outliers.GRID))) for _ in range(n)]
    given = rows(2000, "big", 0.0) + rows(1, "one", 3.0) + rows(50, "even", 3.0)
    frame = spark.createDataFrame(given, "levels ARRAY<STRING>, " + ", ".join(f"{f} LONG" for f in outliers.FEATURES))
    got = {r.grp: r.centre for r in outliers.estimates(frame, 0.75, 8, 50).collect()}
    assert set(got) == {"big", "one", "even"}
    assert abs(np.mean(got["big"])) < 0.1 and abs(np.mean(got["one"])) < 0.2
    assert 1.0 < np.mean(got["even"]) < 2.0


# 3: winnowing

def test_winnowing_takes_rightmost_minima(docs):
    rows = docs.select(winnowing.gram_hashes(words(F.col("text"))).alias("h"), winnowing.fingerprint(F.col("text")).alias("m")).collect()
    for h, m in rows:
        want, width = [], min(winnowing.WINDOW, len(h))
        for i in range(len(h) - width + 1 if h else 0):
            part = h[i : i + width]
            p = i + width - 1 - part[::-1].index(min(part))
            if p not in want:
                want.append(p)
        assert [(x.hash, x.pos) for x in m] == [(h[p], p) for p in want]


def test_shared_runs_share_a_mark(spark):
    run = " ".join(f"w{i}" for i in range(winnowing.K + winnowing.WINDOW - 1))
    rows = [(0, "a b c d " + run + " e f g"), (1, run + " x y"), (2, "q r s t u v " + run)]
    marks = [{x.hash for x in r.marks} for r in winnowing.fingerprint_documents(spark.createDataFrame(rows, "doc_id LONG, text STRING")).orderBy("doc_id").collect()]
    assert marks[0] & marks[1] and marks[1] & marks[2] and marks[0] & marks[2]


def test_next_document_over_many_buckets(spark):
    ids = random.Random(2).sample(range(10_000), 300)
    led = winnowing.with_next(spark.createDataFrame([(i, str(i)) for i in ids], "doc_id LONG, text STRING"), {"id": F.col("doc_id")}, buckets=40)
    order = sorted(ids)
    assert {r.doc_id: r.next_id for r in led.collect()} == dict(zip(order, order[1:] + order[:1], strict=True))


# 4 and 9: tokens, records

def test_token_counts_equal_the_library(spark, docs, texts):
    library = tokens.load(tokens.TOKENIZER)
    for r in tokens.count_tokens(docs, chunk=2000, overlap=16).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048)
    many = fuzz(800, 1)
    counts, ids = tokens.WordEncoder(tokens.TOKENIZER, limit=50).encode(pa.array(many))
    want = [library.encode(t, add_special_tokens=False).ids for t in many]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_overlap_resynchronisation_equals_whole_encoding():
    library = tokens.load(tokens.TOKENIZER)
    for i, t in enumerate(fuzz(150, 2, 600)):
        t = t if i % 3 else re.sub(r"\s", "", t)
        assert tokens.encode_long(library, t, 50, 8).tolist() == library.encode(t, add_special_tokens=False).ids


def test_records_read_back(spark, docs, texts, tmp_path):
    library = tokens.load(tokens.TOKENIZER)
    index = records.write_records(docs, f"file://{tmp_path}/r")
    got = {r.doc_id: r for r in records.record_digests(index).collect()}
    start = 0
    for i in sorted(texts):
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = records.read_records(index.filter("doc_id = 7")).first()
    assert one.ids == library.encode(texts[7], add_special_tokens=False).ids + [2]
    path = index.first().file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged record"):
        records.record_digests(index).collect()


def test_crc32c_known_answers():
    data = np.frombuffer(b"123456789" + bytes(32) + b"ab", np.uint8)
    got = records.crc32c_many(data, np.array([0, 9, 41, 0]), np.array([9, 32, 2, 0]))
    assert [hex(x) for x in got[:2]] == ["0xe3069283", "0x8a9136aa"] and got[3] == 0
    long = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    c = np.uint32(0xFFFFFFFF)
    for byte in long:
        c = records._step(c, np.uint32(byte))
    assert records.crc32c_many(long, np.array([0]), np.array([5000]))[0] == c ^ np.uint32(0xFFFFFFFF)


# 5: personal data

def test_outliers_of_one_statistic_alone_go(spark):
    rng = np.random.default_rng(2)
    word = lambda low=2, high=9: "".join(rng.choice(list("abcdeorst"), rng.integers(low, high)))
    lines = lambda n, **k: [" ".join(word(**k) for _ in range(10)) for _ in range(n)]
    rows = [(i, "\n".join(lines(rng.integers(8, 20)))) for i in range(400)]
    again = lines(1)
    planted = {
        "length": lines(900), "words": lines(14, low=14, high=24), "symbols": [x.replace(" ", " $ ", 4) for x in lines(14)],
        "lines": [x for y in lines(14) for x in (y, "more")], "repeats": [x for k, y in enumerate(lines(13)) for x in ((y, f"{again[0]} {word()}") if k in (3, 6, 9) else (y,))],
    }
    rows += [(1000 + k, "\n".join(x)) for k, x in enumerate(planted.values())]
    frame = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id LONG, text STRING, lang STRING, source STRING")
    got = {r.doc_id: r for r in outliers.judge(frame).collect()}
    assert not any(got[1000 + k].base_failed for k in range(len(planted)))
    assert [name for k, name in enumerate(planted) if got[1000 + k].kept] == []
    assert sum(not got[i].kept for i in range(400)) <= 4


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            fits = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    parts = [*"aB..-+@@ 0149(%)_é😀\n", "255", "256", "12", "4111111111111111", "+1 (456) 555-2186", "1.2.3.4"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(700)]
    many += ["1" * 30_000, "1 " * 20_000, "a@" + "b." * 20_000 + "c", "a" * 30_000, "1." * 20_000, "+1" + " " * 20_000, "a.b@" * 5_000]
    frame = spark.createDataFrame(list(enumerate(many)), "doc_id LONG, text STRING")
    for r in pii.find_personal_data(frame, fit=False).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == plain_spans(many[r.doc_id])


def test_spans_without_overlap_and_first_of_each_equal_plain_search(spark):
    rng = random.Random(8)
    draw = lambda n: [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 900) for _ in range(n))]
    given = [(i, draw(n), draw(m)) for i, (n, m) in enumerate([(0, 0), (0, 9), (9, 0), (1, 1), (40, 60), (300, 40), (700, 20)])]
    span = "ARRAY<STRUCT<start: INT, end: INT>>"
    frame = spark.createDataFrame(given, f"doc_id INT, a {span}, b {span}")
    kinds = F.transform("a", lambda x: F.struct(F.lit("card").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    for r in frame.select("doc_id", "a", "b", pii.without_overlap(F.col("a"), F.col("b")).alias("free"), pii._first_of_each(kinds).alias("first")).collect():
        a, b = [tuple(x) for x in r.a], [tuple(x) for x in r.b]
        assert sorted(tuple(x) for x in r.free) == sorted(x for x in a if not any(x[0] < y[1] and y[0] < x[1] for y in b))
        want, at = [], 0
        for s, e in sorted(a, key=lambda x: (x[0], -x[1])):
            if s >= at:
                want.append((s, e))
                at = e
        assert [(x.start, x.end) for x in r["first"]] == want


def test_long_texts_keep_places_and_context(spark):
    one = "call 0171-555-%04d, mail bob(at)example.com, from 10.0.0.7 on é; "
    text = "".join(one % i for i in range(3000))
    frame = spark.createDataFrame([(text,)], "text STRING")
    for pattern in (pii.CANDIDATES["number"], pii.CANDIDATES["address"], pii.PATTERNS["ip"]):
        got = frame.select(pii.find_spans(F.col("text"), pattern).alias("s")).first().s
        assert len(got) >= 3000
        for x in got:
            assert text[x.start : x.end] == x.found and text[max(0, x.start - pii.CONTEXT_CHARS) : x.start] == x.before
            assert text[x.end : x.end + 1] == x.after


def test_trees_add_lookalikes_and_leave_other_numbers(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        phone = f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        ticket = f"{rng.randint(1000, 9999)}:{rng.randint(100, 999)}:{rng.randint(1000, 9999)}"
        rows.append((i, f"please call {phone} about item {ticket} soon, mail me{i}@site{i % 9}.example.org"))
    rows.append((1000, "please call (456) 555-2186 about it, and mail me9(at)site1.example.org or 5555:444:3333"))
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    judge = pii.train(frame)
    found = {r.doc_id: r for r in pii.find_personal_data(frame, judge).collect()}
    assert all(len(found[i].base) == 2 and not found[i].added for i in range(600))
    text = rows[-1][1]
    assert not any(":" in text[s.start : s.end] for s in found[1000].added)
    redacted = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([found[0]], pii.find_personal_data(frame, fit=False).schema)).collect()}
    assert redacted[0].startswith("please call [phone] about item") and redacted[0].endswith("mail [email]")


def test_national_phones_and_spelt_addresses_are_added(spark):
    rng = random.Random(3)
    n = lambda k: str(rng.randint(10 ** (k - 1), 10**k - 1))
    rows = []
    for i in range(300):
        rows.append((i, f"see +1 ({n(3)}) {n(3)}-{n(4)} and me{i}@site{i % 9}.example.org on 2021-0{i % 9 + 1}-1{i % 9} item {n(4)}:{n(3)}:{n(4)}"))
        # As many without a base span: a reading of them as negatives would refuse what follows.
        rows.append((1000 + i, f"see ({n(3)}) {n(3)}-{n(4)} and {n(3)}-{n(3)}-{n(4)} or me{i} (at) site{i % 9} (dot) org"))
    text = "so ask (456) 555-2186 or 555-218-6412 or joe (at) site (dot) org, since 2021-03-14, for 5555:444:3333"
    frame = spark.createDataFrame([*rows, (5000, text)], "doc_id LONG, text STRING")
    got = pii.find_personal_data(frame, pii.train(frame)).filter("doc_id = 5000").first()
    assert [text[x.start : x.end] for x in got.added] == ["(456) 555-2186", "555-218-6412", "joe (at) site (dot) org"]


def test_trees_learn_from_all_examples(spark):
    """Cards whose examples come last in the hash order, after more than 20,000 others."""
    rng = random.Random(5)
    n = lambda k: str(rng.randint(10 ** (k - 1), 10**k - 1))
    rows = [(i, f"see +1 ({n(3)}) {n(3)}-{n(4)} and me{i}@site{i % 9}.example.org on 2021-0{i % 9 + 1}-1{i % 9} item {n(4)}:{n(3)}:{n(4)}") for i in range(2500)]
    last = spark.range(10_000, 60_000).orderBy(F.xxhash64("id", F.lit(5), F.lit(24), F.lit("card")).desc()).limit(200)
    rows += [(r.id, "paid 4111 1111 1111 1111 for it") for r in last.collect()]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    base = F.concat(*[pii.found_base(F.col("text"), k) for k in pii.KINDS])
    assert frame.select(F.explode(pii.examples(F.col("text"), base))).count() > 20_000
    assert "card" in pii.train(frame).cuts


# 6: near duplicates

def test_registers_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        base = [f"w{i}" for i in rng.integers(0, 60, 300)]
        other = list(base)
        for i in rng.integers(0, 300, rng.integers(1, 120)):
            other[i] = f"x{i}"
        t, e, c = B.bags(pa.array([" ".join(base), " ".join(other)]), 1)
        s = B.signatures(t, e, c, 2)
        errors.append((s[0] == s[1]).mean() - B.overlap((e[t == 0], c[t == 0]), (e[t == 1], c[t == 1])))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def bag(text):
    w = [x for x in re.split(r"[ \t-\r]+", text) if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def plain_classes(texts):
    """Components of links between all pairs."""
    ids, bags = sorted(texts), {i: bag(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = sum((bags[i] & bags[j]).values())
            total = sum(bags[i].values()) + sum(bags[j].values()) - both
            if texts[i] == texts[j] or (total and both / total >= 0.8):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def varied_copies(seed, groups=6, each=25):
    rng, texts = random.Random(seed), {}
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        for k in range(each):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            texts[g * 1000 + k] = " ".join(w)
    return texts


def test_classes_equal_all_pairs(spark):
    texts = varied_copies(3)
    frame = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING").repartition(4)
    assert {r.doc_id: r.class_id for r in B.duplicate_classes(frame).collect()} == plain_classes(texts)


def marked_rows(texts):
    """(id, weight, parity marks) of each text."""
    weight, marks, begin = B.parity_marks(*B.bags(pa.array(list(texts.values()))), len(texts))
    return [(i, int(weight[k]), marks[begin[k] : begin[k + 1]].tolist()) for k, i in enumerate(texts)]


def test_bucket_roots_connect_what_all_pairs_connect(spark, monkeypatch):
    texts = varied_copies(7, groups=2, each=20)
    nodes = spark.createDataFrame(list(texts.items()), "node LONG, text STRING")
    members = nodes.select(F.lit(1).cast("long").alias("bucket"), "node")
    marked = spark.createDataFrame(marked_rows(texts), "node LONG, n LONG, marks ARRAY<LONG>")
    for pivots, strangers in ((20, 5), (1024, 256)):
        monkeypatch.setattr(B, "PIVOTS", pivots)
        monkeypatch.setattr(B, "SLICE_STRANGERS", strangers)
        rooted = {r.node: r.root for r in B.bucket_roots(members, nodes, marked).collect()}
        assert {i: rooted.get(i, i) for i in texts} == plain_classes(texts)


def test_parity_marks_never_drop_a_similar_pair(spark):
    rng, texts = random.Random(12), {}
    for k in range(240):
        # Lengths either side of a power of two, so that marks of unlike sizes meet; repeated words give counts above one.
        base = [f"b{k % 6}w{(j * j) % 97}" for j in range(rng.choice([6, 60, 76, 80, 84, 130]))] + ["again"] * rng.choice([0, 9])
        for _ in range(rng.randint(0, 6)):
            base[rng.randrange(len(base))] = f"n{rng.random()}"
        texts[k] = " ".join(base)
    rows = spark.createDataFrame(marked_rows(texts), "node LONG, n LONG, marks ARRAY<LONG>")
    other = rows.toDF("other", "other_n", "other_marks")
    may = B.may_reach(F.col("marks"), F.col("other_marks"), F.col("n"), F.col("other_n"), 0.8)
    passed = {(r.node, r.other) for r in rows.join(other, F.col("node") < F.col("other")).filter(may).collect()}
    bags = {i: bag(t) for i, t in texts.items()}
    alike = set()
    for a, b in itertools.combinations(texts, 2):
        both, total = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
        if both >= 0.8 * total:
            alike.add((a, b))
    sizes = {r[0]: len(r[2]) for r in marked_rows(texts)}
    assert any(sizes[a] != sizes[b] for a, b in alike)
    assert alike <= passed and len(passed) < 2 * len(alike)


# 7: pieces

def test_pieces_equal_the_library(spark, docs, texts):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    codec = pieces.PieceEncoder()
    many = fuzz(800, 3) + [re.sub("[ ▁]", "", t) for t in fuzz(10, 4, 2000)] + list(texts.values())
    counts, ids = codec.encode(pa.array(many))
    want = [library.encode(t) for t in many]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert all(codec.decode(np.array(w, np.int64)) == library.decode(w) for w in want)
    for r in pieces.piece_digests(docs).collect():
        raw = np.array(library.encode(texts[r.doc_id]), "<u4")
        assert (r.n_pieces, r.ids_crc32, r.restored) == (len(raw), zlib.crc32(raw.tobytes()), True)
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(docs)).collect()}
    assert back == texts


# 8: lines

def cut_by_all_earlier_runs(texts, least=50):
    """Every run of at least ``least`` words that is equal to any run at an earlier place."""
    lines = {i: [(n, x) for n, x in enumerate(t.split("\n")) if x.encode().split()] for i, t in texts.items()}
    places = [(i, a) for i in sorted(texts) for a in range(len(lines[i]))]
    gone = {i: set() for i in texts}
    for n, (i, a) in enumerate(places):
        long = 0
        for j, c in places[:n]:
            k = 0
            while a + k < len(lines[i]) and c + k < len(lines[j]) and lines[i][a + k][1] == lines[j][c + k][1]:
                k += 1
            long = max(long, k)
        if long and sum(len(x.encode().split()) for _, x in lines[i][a : a + long]) >= least:
            gone[i].update(range(lines[i][a][0], lines[i][a + long - 1][0] + 1))
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in texts.items()}


def test_line_dedup_equals_plain_search(spark, docs, texts):
    rng = random.Random(9)
    pool = [" ".join(f"p{k}w{j}" for j in range(rng.choice([1, 3, 10, 30, 60]))) for k in range(40)]
    made = {1000 + i: "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randint(0, 12))) for i in range(150)}
    made |= {2000 + i: "\n".join(pool[(i % 5) : (i % 5) + 8]) for i in range(30)}
    every = texts | made
    frame = spark.createDataFrame(list(every.items()), "doc_id LONG, text STRING").repartition(4)
    assert {r.doc_id: r.text for r in linededup.delete_repeats(frame).collect()} == cut_by_all_earlier_runs(every)


def test_line_dedup_finds_runs_equal_to_any_earlier_run(spark):
    rng = random.Random(4)
    line = lambda k, n: " ".join(f"q{k}w{j}" for j in range(n))
    p, q, other = line(0, 60), line(1, 10), line(2, 60)
    every = {1: f"{p}\n{other}", 2: f"{p}\n{q}", 3: f"{p}\n{q}", 4: f"{q}\n{p}", 5: f"tail\n{q}\n{p}"}
    pool = [line(10 + k, rng.choice([1, 3, 10, 30, 60])) for k in range(12)]
    every |= {100 + i: "\n".join(rng.choice([*pool, ""]) for _ in range(rng.randint(0, 12))) for i in range(120)}
    frame = spark.createDataFrame(list(every.items()), "doc_id LONG, text STRING").repartition(4)
    found = {r.doc_id: r.text for r in linededup.delete_repeats(frame).collect()}
    assert found[3] == "" and found[5] == "tail"
    assert found == cut_by_all_earlier_runs(every)


def test_window_minima_are_rightmost():
    found = linededup.window_minima([5, 3, 3, 9], [10, 10, 10, 10], 30)
    assert [(i, n, least) for i, n, least, _ in found] == [(0, 3, 3), (1, 3, 3)]


# 10: toxicity

def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    chain = toxicity.train(docs, labels.filter(half == 0), toxicity.standard_categories())
    unseen = docs.select("doc_id", "text").join(labels.filter((half == 1) & (F.col("quality") == 1)).select("doc_id", "toxic"), "doc_id")
    judged = toxicity.score(unseen, chain).groupBy("toxic", (F.col("p_toxic") >= chain.cuts[1]).alias("rejected")).count().collect()
    n = {(r.toxic, bool(r.rejected)): r["count"] for r in judged}
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.85
    assert n.get((0, True), 0) / (n[0, False] + n.get((0, True), 0)) < 0.015


def test_chain_uses_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    x = (rng.random((600, 6)) < 0.4).astype(float)
    first = ((x[:, 0] + x[:, 1] + rng.random(600)) > 1.4).astype(float)
    second = ((first + 0.6 * x[:, 2] + 0.5 * rng.random(600)) > 1.2).astype(float)
    chain = toxicity.fit_chain(x, np.stack([first, second], 1), np.arange(600) % 3, list("abcdef"), ["one", "two"])
    rows, columns = np.nonzero(x)
    p = chain.predict(rows, columns, 600)
    assert ((p[:, 1] > 0.5) == second).mean() > 0.7 and len(chain.weights[1]) == 1 + 6 + 1
    assert abs(chain.weights[1][-1]) > 0.5
