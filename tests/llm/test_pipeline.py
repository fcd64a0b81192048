import corpus_pipeline
from tests.llm.corpus import documents, frame, prose
from tests.llm.test_shingles import jaccard, plain_set
from weirspan.llm import decontaminate, simhash, toxicity


def classes_by_jaccard(texts):
    """The number of classes of texts linked by a similarity of 0.8; all texts without words are one class."""
    sets = [plain_set(t) for t in texts]
    name = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if name[i] != name[j] and (jaccard(sets[i], sets[j]) >= 0.8 or not sets[i] and not sets[j]):
                name = [min(name[i], name[j]) if n in (name[i], name[j]) else n for n in name]
    return len(set(name))


def test_stages_on_a_small_corpus(spark, tmp_path):
    rows = documents() + [(300, prose(5, 30) + " " + prose(500, 25)), (301, "you grumbold snarfing blatherer")]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bad = [(i, "grumbold you " + prose(i, 30)) for i in range(400, 480)]
    extra = spark.createDataFrame([(i, t, "en", "s1", len(t)) for i, t in bad], docs.schema)
    extra.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 1) for i, _ in bad] + [(d, 1, 0) for d, _ in rows[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench = spark.createDataFrame([(1, prose(500, 25)), (2, None)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")

    now, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        steps[name], now = now, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == docs.columns
    after = {name: spark.read.parquet(f"{tmp_path}/{name}") for name, _ in corpus_pipeline.STAGES}
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scores = toxicity.report(steps["toxicity"], labels)
    assert after["toxicity"].count() == scores.where("predicted = 0").count() < steps["toxicity"].count()
    assert after["line_dedup"].count() == steps["line_dedup"].count()
    shared = prose(1, 60)
    assert after["line_dedup"].where(f"text like '%{shared}%'").count() == 1
    left = [r.text for r in steps["near_duplicates"].collect()]
    assert after["near_duplicates"].count() == classes_by_jaccard(left)
    assert after["decontamination"].count() == decontaminate.report(steps["decontamination"], bench).where("not contaminated").count()
    assert after["packing"].select("doc_id").distinct().count() == after["decontamination"].select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == after["packing"].count()


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_near_duplicates_by_fingerprint_and_by_shingles(spark):
    # Repeats weigh in fingerprints only: a and b are alike by these, b and c by their shingles; either way alone keeps two apart.
    line, tails = " ".join(f"often{i}" for i in range(11)), [" ".join(f"{x}{i}" for i in range(40)) for x in ("left", "right")]
    a, b, c = f"{line} " * 300 + tails[0], f"{line} " * 300 + tails[1], f"{line} " * 2 + tails[1]
    apart = lambda x, y: ((simhash.fingerprint(x) ^ simhash.fingerprint(y)) & (1 << 64) - 1).bit_count()
    assert apart(a, b) <= 4 < min(apart(a, c), apart(b, c))
    assert jaccard(plain_set(b), plain_set(c)) >= 0.8 > max(jaccard(plain_set(a), plain_set(x)) for x in (b, c))
    docs = frame(spark, [(3, a), (1, b), (2, c), (4, prose(5, 80)), (None, a), (4, prose(5, 80))]).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == [1, 4]
