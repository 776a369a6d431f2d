"""The corpus pipeline, stage by stage, against plain versions of its decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import secrets, toxicity
from tempora.llm.common import staged, table

from .test_text_operators import brute_lines, brute_links


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_on_the_smallest_table(spark, tiny):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "secret_scan", "packing"]
    docs = table(spark, tiny, "documents")
    model = toxicity.train(docs, table(spark, tiny, "labels"))
    scorer = toxicity.Scorer(model)
    kept = staged(stages["toxicity"](spark, docs, tiny), "t1")
    assert kept.columns == docs.columns
    assert rows(kept) == [(i, t) for i, t in rows(docs) if scorer.score(t) < toxicity.CUTOFF]
    fewer = staged(stages["line_dedup"](spark, kept, tiny), "t2")
    assert fewer.columns == docs.columns and dict(rows(fewer)) == brute_lines(rows(kept), 2)
    single = staged(stages["near_dedup"](spark, fewer, tiny), "t3")
    assert single.columns == docs.columns and [i for i, _ in rows(single)] == [i for i, (_, least) in sorted(brute_links(rows(fewer)).items()) if i == least]
    guesser = secrets.Guesser(secrets.common_words(single))
    clean = staged(stages["secret_scan"](spark, single, tiny), "t4")
    assert clean.columns == docs.columns and rows(clean) == [(i, secrets.redact(t, secrets.find(t, guesser=guesser))) for i, t in rows(single)]
    packed = stages["packing"](spark, clean, tiny).collect()
    assert {p["doc_id"] for p in packed} == {i for i, _ in rows(clean)}
    assert sorted((p["doc_id"], p["start"], p["ids_crc32"]) for p in packed)[0][0] >= 0


def test_stages_take_clashing_columns_odd_rows_and_nothing(spark, tiny, docs, odd):
    names = ["score", "result", "row", "n_lines", "n_removed", "n_runs", "starts", "spans", "cls", "kept", "component_id", "n_shingles", "ids", "open", "key", "lines"]
    given = docs(odd).withColumns({c: F.lit(-7) for c in names})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, tiny)
        got = out.collect()
        if name != "packing":
            assert out.columns == given.columns and all(r[c] == -7 for r in got for c in names)
            assert len(got) == (len(odd) if name in ("line_dedup", "secret_scan") else len(got))
        assert stage(spark, docs([]), tiny).count() == 0


def test_run_is_registered(spark, tiny):
    assert corpus_pipeline.queries()["pipeline"](spark, tiny).count() > 0
