"""The corpus pipeline, stage by stage, against plain Python."""

import numpy as np
import public_tokenizers as P
from test_jaccard import brute as jaccard_brute
from test_spans_and_benchmark import contamination_brute, spans_brute
from tokenizers import Tokenizer

import corpus_pipeline
from mosaiq.llm import quality
from mosaiq.llm.common import materialise, read_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    documents, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    net = quality.train(documents, labels)
    kept = {}
    for r in documents.collect():
        c = quality.chunks((r["text"] or "").encode())
        if net.probability(net.pooled(c), np.array([0]), np.array([len(c)]))[0] >= 0.3:
            kept[r["doc_id"]] = r["text"]
    assert 0 < len(kept) < documents.count()
    kept = {d: kept[d] for d, _, c in jaccard_brute(sorted(kept.items())) if c == d}
    kept = {d: t for d, t, _, gone in spans_brute(sorted(kept.items())) if not gone or t.strip()}
    kept = {d: kept[d] for d, _, hit, *_ in contamination_brute(sorted(kept.items()), items) if not hit}
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, SF).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(bytes(r["input_ids"]), "<u4").tolist())
    assert got == {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x in kept.items()}


def test_stages_keep_the_columns(spark):
    docs = read_table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(30), SF)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()


def test_odd_rows_through_all_stages(spark):
    """Nulls, empty and repeated texts, one doc_id on two rows, columns with the operators' own names, an empty table."""
    good = [r for r in quality.score_documents(read_table(spark, SF, "documents").where("length(text) between 300 and 900"), quality.train(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))).orderBy("doc_id").collect() if r["score"] > 0.9][:6]
    rows = [(r["doc_id"] + 10_000_000, r["text"]) for r in good]
    rows += [(20_000_000, None), (20_000_001, ""), (None, rows[0][1]), (None, None), rows[1], (20_000_002, rows[2][1]), (20_000_003, "x" * 50_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_removed int, score double, s string, __t long, n long"
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), 7, 0.5, "s", 1, 2) for i, t in rows], schema).repartition(3)
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(materialise(stage(spark, steps[-1], SF), "odd"))
        assert steps[-1].schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), SF).count() == 0
    found = [sorted(((r["doc_id"], r["text"]) for r in s.collect()), key=repr) for s in steps]
    assert {r["n_removed"] for r in steps[-1].collect()} <= {7} and {r["score"] for r in steps[-1].collect()} <= {0.5}
    assert set(found[1]) <= set(found[0]) and all(x in found[1] for x in rows[:6])
    assert (20_000_002, rows[2][1]) in found[1] and (20_000_002, rows[2][1]) not in found[2]  # the copy with the greater id
    assert found[2].count(rows[1]) == 2  # one document on two rows stays whole
    assert (None, rows[0][1]) in found[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, steps[-1], SF)
    assert packed.select("doc_id").where("piece = 0").count() == len(found[-1])
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
