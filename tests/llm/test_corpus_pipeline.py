"""The pipeline's stages on a small corpus with planted cases."""

import corpus_pipeline
from derivia.llm import queries


def corpus(spark, tmp_path):
    text = lambda k, n=120: " ".join(f"w{k}x{i}" for i in range(n))
    passage = " ".join(f"shared{i}" for i in range(60))
    docs = [(i, text(i), "en", f"s{i % 3}", 0) for i in range(30)]
    docs += [(30, text(3), "en", "s0", 0), (31, text(4).replace("w4x7 ", "other "), "en", "s1", 0), (32, f"{text(50)} {passage}", "en", "s2", 0), (33, f"{text(51)} {passage}", "en", "s2", 0)]
    docs += [(34, "too short", "en", "s0", 0), (35, None, None, None, None), (36, " ".join(["a b c"] * 40), "en", "s1", 0)] + [(40 + i, " ".join(f"q{i}y{j}%%%" for j in range(90)), "en", "s1", 0) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(40 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_stages(spark, tmp_path):
    folder, docs = corpus(spark, tmp_path)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "source_mix", "piece_encoding"]
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(34))
    single = corpus_pipeline.near_duplicates(spark, kept, folder)
    assert {r.doc_id for r in single.collect()} == set(range(34)) - {30, 31} and single.schema == kept.schema
    cut = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, single, folder).collect()}
    assert "shared30" in cut[32].text and "shared30" not in cut[33].text and cut[33].n_chars == len(cut[33].text) and len(cut) == 32
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "source", "ids", "n_tokens"} <= set(out.columns) and out.count() > 20


def test_stages_of_shared_and_missing_ids(spark, tmp_path):
    folder, _ = corpus(spark, tmp_path)
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(120))
    rows = [(1, text(1)), (1, text(1)), (2, text(1)), (2, text(2)), (None, text(1)), (None, text(1)), (3, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", None, 7, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, class_id string")
    left = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert left.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(1, text(1)), (2, text(2)), (None, text(1)), (None, text(1)), (3, None), (4, "")], key=repr)
    cut = corpus_pipeline.repeated_passages(spark, docs, folder).collect()
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in cut), key=repr) == sorted([(1, text(1), 7), (1, text(1), 7), (2, "", 0), (2, text(2), 7), (None, text(1), 7), (None, text(1), 7), (3, "", 7), (4, "", 7), (4, "", 7)], key=repr)
    mixed = corpus_pipeline.source_mix(spark, docs, folder).collect()
    assert {r.source for r in mixed} == {None} and all(r.text for r in mixed)
    coded = corpus_pipeline.encoding(spark, docs, folder).collect()
    assert len(coded) == len(rows) and all(r.n_tokens == 0 for r in coded if r.doc_id in (3, 4))


def test_stages_on_nothing(spark, tmp_path):
    folder, docs = corpus(spark, tmp_path)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {"pipeline", *queries.QUERIES} <= set(names) and len([n for n in names if n.startswith("op")]) == 10 and set(entry.oracle_sql()) <= set(names)
