"""The pipeline against its stages done in plain Python, and the entry module."""

import zlib

import numpy as np

import cases
import corpus_pipeline
from kpiloom.llm import mixing, packing, pii, quality
from kpiloom.llm.tokens import vocabulary
from test_quality import judged
from test_simhash import plain_fingerprint


def test_stages_against_plain_python(spark):
    from tokenizers import Tokenizer

    docs = cases.table(spark, "documents")
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r, k in zip(rows, judged(rows)) if k]
    assert sorted(r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, cases.SF).collect()) == sorted(r["doc_id"] for r in rows)

    fps = [plain_fingerprint(r["text"]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    low = cases.components(len(rows), pairs)
    best = {}
    for k, r in enumerate(rows):
        best[low[k]] = min(best.get(low[k], r["doc_id"]), r["doc_id"])
    rows = [r for k, r in enumerate(rows) if r["doc_id"] == best[low[k]]]

    model = pii.fit(spark.createDataFrame([(r["text"],) for r in rows], "text string"))
    for r in rows:
        r["text"] = pii.redact(r["text"], model)

    masked = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows], "doc_id long, text string, lang string, source string")
    kept = {r["id"] for r in mixing.mix(masked).where("kept").collect()}
    assert 0 < len(kept) < len(rows)
    rows = [r for r in rows if r["doc_id"] in kept]

    whole = Tokenizer.from_file(vocabulary())
    want = []
    for r in rows:
        ids = whole.encode(r["text"], add_special_tokens=False).ids + [0]
        want += [(r["doc_id"], n, zlib.crc32(np.array(ids[s:s + 2048], dtype="<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, cases.SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == sorted(want)
    lengths = [r["length"] for r in got]
    assert len({r["sequence_id"] for r in got}) <= packing.lower_bound({x: lengths.count(x) for x in set(lengths)}, 2048) + 1


def test_stages_return_the_columns_of_documents(spark):
    docs = cases.documents(spark)
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (plain, plain.limit(0), docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, cases.SF)
            assert out.columns == table.columns and dict(out.dtypes) == dict(table.dtypes), name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, cases.SF).collect()
    assert quality.MIN_WORDS == 10


def test_entry_registers_them():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
