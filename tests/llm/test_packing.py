"""Best-fit packing: plans, token ids, cuts, places."""

import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mosaiq.llm import packing
from mosaiq.llm.tokens import default_path, encoder

ODD = ["", " ", "a", "a b", " lead", "trail ", "two  blanks", "tab\t x", "line\nend \n\n x", "don't we'll 12 34,5!", "Édu çà ß ñ", "x" * 3000, "<|endoftext|> inside", "a <|endoftext|><|endoftext|> b", "<|endoftext| > <|end", "a b c", "日本 語", "word " * 2000, None, "\x00 \x1f z"]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizer():
    t, e = tokenizer(), encoder(default_path())
    for text in ODD:
        for _ in range(2):  # the second time from the cache
            assert np.frombuffer(e.encode(text or ""), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_an_added_token_has_its_id():
    assert np.frombuffer(encoder(default_path()).encode("<|endoftext|> inside"), "<u4").tolist() == [50256, 2641]


@given(st.text(alphabet="ab .\n\té'1", max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_equal_the_tokenizer_on_any_text(text):
    assert np.frombuffer(encoder(default_path()).encode(text), "<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=20))
@settings(max_examples=300, deadline=None)
def test_plan_places_every_piece_once(counts):
    rows = packing.best_fit_plan(counts, 30)
    ranks, filled, large = defaultdict(list), defaultdict(list), defaultdict(int)
    for n, a, b, sequence, offset in rows:
        for k in range(b - a + 1):
            ranks[n].append(a + k)
            filled[sequence + k].append((offset, n))
            large[sequence + k] += 3 * n > 30
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for places in filled.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 30
    assert all(v <= 2 for v in large.values())


def test_plan_is_tight():
    r = np.random.default_rng(1)
    counts = dict(zip(*np.unique(np.minimum(1024, r.lognormal(5, 1, 20000).astype(int) + 1), return_counts=True), strict=True))
    counts = {int(k): int(v) for k, v in counts.items()}
    used = len({s + k for n, a, b, s, _ in packing.best_fit_plan(counts) for k in range(b - a + 1)})
    assert used <= 1.003 * sum(n * c for n, c in counts.items()) / 1024 + 1


def test_pieces_round_trip(spark):
    texts = [*ODD, "same", "same"]
    rows = [(i if i != 3 else None, t, "extra", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(3)
    got = packing.pack_documents(df).collect()
    t = tokenizer()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["input_ids"]) == 4 * r["length"]
    for doc_id, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert np.frombuffer(b"".join(bytes(r["input_ids"]) for r in pieces), "<u4").tolist() == ids
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and [r["start"] for r in pieces] == np.cumsum([0, *(r["length"] for r in pieces)])[:-1].tolist()
        assert all(r["length"] == 1024 for r in pieces[1:]) and (len(pieces) > 1) == (len(ids) > 1024)
    for places in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 1024
    crc = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.digest(df).collect()}
    assert all(crc[r["doc_id"], r["piece"]] == zlib.crc32(bytes(r["input_ids"])) for r in got)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
