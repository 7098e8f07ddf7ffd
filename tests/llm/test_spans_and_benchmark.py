"""Sentence-span dedup and benchmark decontamination against brute force."""

import hashlib
import random
import re
from collections import defaultdict

from mosaiq.llm import common, decontaminate, span_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spans_brute(rows):
    seen = defaultdict(set)
    cut = {}
    for d, t in set(rows):
        pieces = re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+\Z", t or "")
        own = [i for i, p in enumerate(pieces) if p.split()]
        cut[d, t] = (pieces, own)
        lines = [tuple(pieces[i].lower().split()) for i in own]
        words = lambda a, b, x=lines: sum(map(len, x[a:b]))
        for a in range(len(lines)):
            for b in range(a + 2, len(lines) + 1):
                full = words(a, b) >= 12 and (b == a + 2 or words(a, b - 1) < 12)
                ending = words(a, b) < 12 and b == len(lines) and (a == 0 or b - a >= 3)
                if full or ending:
                    seen[tuple(lines[a:b])].add((d, t, a, b - a))
    gone = defaultdict(set)
    for places in seen.values():
        for d, t, s, k in sorted(places)[1:]:
            gone[d, t] |= set(range(s, s + k))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        pieces, own = cut[d, t]
        kept, at = [], -1
        for p in pieces:
            at += bool(p.split())
            if at not in gone[d, t] or at < 0:
                kept.append(p)
        out.append((d, "".join(kept), len(own), len(gone[d, t])))
    return sorted(out, key=repr)


def test_spans_equal_brute_force(spark):
    r = random.Random(4)
    line = lambda: " ".join(f"w{r.randrange(40)}" for _ in range(r.choice([1, 3, 5, 8, 14, 27]))) + r.choice([". ", "! ", "\n", "?\n\n", ". . "])
    shared = ["".join(line() for _ in range(6)) for _ in range(4)]
    rows = []
    for i in range(60):
        text = "".join(r.choice([line(), line(), r.choice(shared)]) for _ in range(r.randrange(0, 7)))
        rows.append((i, text.upper() if r.random() < 0.1 else text))
    rows += [(100, None), (101, ""), (102, " \n"), (103, rows[5][1]), (104, "one short. two."), (105, "same text of just one sentence with enough words"), (106, "same text of just one sentence with enough words"), rows[7]]
    df = spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, n_removed int").repartition(4)
    got = sorted(((x["doc_id"], x["text"], x["n_sentences"], x["n_removed"]) for x in span_dedup.dedup_spans(df).collect()), key=repr)
    assert got == spans_brute(rows)
    assert sum(g[3] for g in got) > 20
    assert span_dedup.dedup_spans(df.limit(0)).count() == 0


def test_a_run_that_most_texts_share(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 5)
    rows = [(i, f"own words {i}. This passage of many words is shared by nearly all. It goes on a little. own end {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(((x["doc_id"], x["text"], x["n_sentences"], x["n_removed"]) for x in span_dedup.dedup_spans(df).collect()), key=repr) == spans_brute(rows)


def test_long_blocks_of_short_lines_are_seen():
    lines = [f"word{i}.\n" for i in range(40)]
    places = [p for p, _ in span_dedup._runs(lines)]
    assert [(p // span_dedup.PLACE, p % span_dedup.PLACE) for p in places] == [(i, min(12, 40 - i)) for i in range(38)]
    assert [r for _, r in span_dedup._runs(["one sentence of more than twelve words is not a run of several of them."])] == []


def test_endings_and_short_texts_have_runs(spark):
    end = "Buy now. Call us. Thank you."
    rows = [(1, end), (2, f"A long sentence of this text alone that nobody else has ever written down. {end}"), (3, f"Another one of many words which is found nowhere else in the whole corpus! {end}"), (4, "Yes. No."), (5, "yes.  NO."), (6, "Just one."), (7, "Just one."), (8, "Other words here. Thank you."), (9, "More words there. Thank you.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"], x["text"], x["n_sentences"], x["n_removed"]) for x in span_dedup.dedup_spans(df).collect()), key=repr)
    assert got == spans_brute(rows)
    assert [g[3] for g in got] == [0, 3, 3, 0, 2, 0, 0, 0, 0] and got[1][1].endswith("written down.")


def test_spans_keep_other_columns(spark):
    text = "A b c d. E f g h. I j k l."
    df = spark.createDataFrame([("s", text, 2, 1.5), ("t", text, None, 2.5)], "at string, text string, doc_id int, __x double")
    got = {r["at"]: r for r in span_dedup.dedup_spans(df).collect()}
    assert got["t"]["text"] == text and got["s"]["text"] == "" and got["s"]["__x"] == 1.5 and got["s"]["doc_id"] == 2


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def contamination_brute(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else []:
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contamination(spark, rows, items):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, items string").repartition(3)
    got = decontaminate.digest(docs, spark.createDataFrame(items, "item_id long, text string"))
    return sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_huge_words(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_BYTES", 4000)
    huge = "x" * 5000
    items = [(1, f"a {huge} b"), (2, huge.upper()), (3, "c d"), (4, "y" * 1024 + " e"), (5, " ".join(f"{huge}{i}" for i in range(12)))]
    rows = [(1, f"see a {huge} b"), (2, huge[:-1]), (3, f"a {huge}y b"), (4, "c d"), (5, "y" * 1024 + " e"), (6, "y" * 1025 + " e"), (7, items[4][1]), (8, hashlib.sha256(huge.encode()).hexdigest())]
    assert contamination(spark, rows, items) == contamination_brute(rows, items)


def test_contamination_equals_brute_force(spark, monkeypatch):
    r = random.Random(9)
    word = lambda: r.choice(["the", "of", "Élan", "é", "x1", *(f"w{i}" for i in range(30))])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, "..."), (7, "the of the of"), (None, "zzz yyy")]
    rows = []
    for i in range(50):
        parts = [word() for _ in range(r.randrange(0, 40))]
        for _ in range(r.randrange(0, 3)):
            k = r.randrange(len(parts) + 1)
            parts[k:k] = r.choice(items)[1].split() if r.random() < 0.6 else ["the"] * 12
        text = r.choice([" ", ", ", "\n- "]).join(p.upper() if r.random() < 0.3 else p for p in parts)
        rows.append((i, text))
    rows += [(90, None), (91, ""), (92, "?!"), (None, "zzz, yyy"), (3, rows[3][1]), (3, "other text")]
    items = [(i, t) for i, t in items if t is not None] + [(50, None)]
    want = contamination_brute(rows, items)
    assert contamination(spark, rows, items) == want
    monkeypatch.setattr(decontaminate, "PART_ROWS", 60)  # more parts than one
    monkeypatch.setattr(common, "FEW_ROWS", 3)  # and hot windows
    assert contamination(spark, rows, items) == want
    monkeypatch.setattr(decontaminate, "PART_ROWS", 1000)
    monkeypatch.setattr(decontaminate, "PART_BYTES", 6000)  # by bytes
    assert contamination(spark, rows, items) == want


def test_no_benchmark_or_documents(spark):
    assert [r[:4] for r in contamination(spark, [(1, "a b")], [])] == [(1, 2, 0, 0)]
    assert contamination(spark, [], [(1, "a")]) == []
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (None, "a")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect()) == ["2", "None"]
