import json

from pyspark.sql import functions as F

from tripleloom.sources import readers, writers
from tripleloom.streaming import jobs


def test_text_docs(spark, tmp_path):
    (tmp_path / "b.txt").write_text("second\nline")
    (tmp_path / "a.txt").write_text("first")
    got = [tuple(r) for r in readers.read_text_docs(spark, str(tmp_path), ordered=True).collect()]
    assert got == [("a", "first"), ("b", "second\nline")]


def annotated():
    token = lambda i, w, p, n: {
        "index": i, "word": w, "originalText": w, "lemma": w.lower(), "pos": p, "ner": n,
        "characterOffsetBegin": 0, "characterOffsetEnd": 1,
    }
    return {
        "tokens": [token(1, "Ada", "NNP", "PERSON"), token(2, "visited", "VBD", "O"), token(3, "London", "NNP", "CITY")],
        "basicDependencies": [
            {"governor": 0, "dependent": 2, "dep": "ROOT"}, {"governor": 2, "dependent": 1, "dep": "nsubj"},
            {"governor": 2, "dependent": 3, "dep": "obj"},
        ],
        "entitymentions": [{"text": "Ada", "ner": "PERSON"}],
        "openie": [
            {"subject": "Ada", "relation": "visited", "object": "London", "subjectSpan": [0, 1], "relationSpan": [1, 2], "objectSpan": [2, 3]}
        ],
    }


def test_annotations_to_features(spark, tmp_path):
    from tripleloom.plans import features

    (tmp_path / "doc7.json").write_text(json.dumps([annotated(), annotated() | {"openie": []}]))
    sentences = readers.read_annotations(spark, str(tmp_path)).withColumn("sent", F.monotonically_increasing_id())
    assert sentences.count() == 2
    basic = features.explode_triples(sentences)
    row = basic.first()
    assert basic.count() == 1 and row["doc_id"] == "doc7"
    assert row["dep_path"] == [3, 2, 1] and row["trigger"] == "visited" and row["path"] == "visited"
    assert (row["pair_type"], row["pos_subj"], row["bow_between"]) == ("CITY_PERSON", "NNP", "visited")
    plain = features.plain_features(features.filtered_triples(basic)).first()
    assert plain["relation_feat"]["subject_at_left"] == 1 and plain["object_feat"]["dist_to_rel"] == -1
    assert len(plain["subject_feat"]["pos"]) == 18 and len(plain["subject_feat"]["ner"]) == 23


def test_sinks(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("_id"), F.lit("a b").alias("x"), F.lit('q"t').alias("y")).coalesce(1)
    writers.write_features(df, str(tmp_path / "f"), 10)
    assert readers.read_features(spark, str(tmp_path / "f")).inputFiles().__len__() == 3
    writers.write_tsv(df, str(tmp_path / "t"))
    line = spark.read.text(str(tmp_path / "t")).first()[0]
    assert line.startswith("a b\t") and "_id" not in line
    for model in (1, 2):
        writers.append_report(spark.createDataFrame([(model, 0.5)], "m int, v double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_cluster_dump_round_trip(spark, tmp_path):
    from tripleloom.operators.aggregates import export_cluster_json

    rows = [(0, 'a "q"', "r", "b\\c", 0.5), (0, "a", "r", "d", 0.9), (1, "x", "s", "y", 0.1)]
    df = spark.createDataFrame(rows, "cluster int, subject string, relation string, object string, score double")
    exported = export_cluster_json(df)
    parsed = {r["cluster"]: json.loads(r["json"]) for r in exported.collect()}
    assert parsed[0] == {"data": [["a", "r", "d", 0.9], ['a "q"', "r", "b\\c", 0.5]], "predicates": {"r": 2}}
    writers.write_cluster_json(exported, str(tmp_path / "c"))
    back = readers.read_cluster_json(spark, str(tmp_path / "c")).drop("rank")
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    (tmp_path / "whole.json").write_text(json.dumps({str(k): v for k, v in parsed.items()}, indent=1))
    whole = readers.read_cluster_json(spark, str(tmp_path / "whole.json"), wholetext=True)
    assert whole.count() == 3


def test_names_and_vectors(spark, tmp_path):
    (tmp_path / "names.json").write_text('{"2": {"rel_type": "awards", "qa_examples": [["q", "a"]]}, "5": {"rel_type": "x", "qa_examples": ["q", "a"]}}')
    got = {r["cluster"]: (r["rel_type"], r["qa_examples"]) for r in readers.read_cluster_names(spark, str(tmp_path / "names.json")).collect()}
    assert got == {2: ("awards", '[["q","a"]]'), 5: ("x", '["q","a"]')}
    (tmp_path / "v.vec").write_text("2 3\ncat 1 2 3\ndog 0.5 -1 0 \n")
    vecs = {r["word"]: list(r["vec"]) for r in readers.read_word_vectors(spark, str(tmp_path / "v.vec")).collect()}
    assert vecs == {"cat": [1.0, 2.0, 3.0], "dog": [0.5, -1.0, 0.0]}


def test_pairs_stream_runs_again_without_repeats(spark, tmp_path):
    schema = "doc_id int, pos int, subject string, object string, relation string"
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = spark.createDataFrame([(1, 1, "a", "b", "r1"), (1, 2, "a", "b", "r2")], schema)
    second = spark.createDataFrame([(2, 1, "a", "b", "r3"), (2, 2, "a", "c", "r4")], schema)
    late = spark.createDataFrame([(0, 9, "a", "c", "r5"), (3, 1, "a", "b", "r6")], schema)
    seen = []
    for part in (first, second, late):
        part.write.mode("append").parquet(source)
        jobs.stream_distinct_pairs(spark, source, schema, sink, state, ["doc_id", "pos"])
        pairs = jobs.read_distinct_pairs(spark, sink, ["doc_id", "pos"])
        seen.append(sorted((r["subject"], r["object"], r["relation"]) for r in pairs.collect()))
    # The first in order wins, also when it comes in a later batch.
    assert seen == [[("a", "b", "r1")], [("a", "b", "r1"), ("a", "c", "r4")], [("a", "b", "r1"), ("a", "c", "r5")]]


def test_pairs_snapshot_is_read_as_it_is_and_broken_ones_are_not(spark, tmp_path):
    schema = "doc_id int, pos int, subject string, object string, relation string"
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    order = ["doc_id", "pos"]

    def pairs():
        return sorted((r["subject"], r["object"], r["relation"]) for r in jobs.read_distinct_pairs(spark, sink, order).collect())

    for part in ([(5, 1, "a", "b", "r1")], [(6, 1, "a", "c", "r2"), (4, 1, "a", "b", "r0")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        jobs.stream_distinct_pairs(spark, source, schema, sink, state, order)
        plan = jobs.read_distinct_pairs(spark, sink, order)._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Exchange" not in plan
    whole = [("a", "b", "r0"), ("a", "c", "r2")]
    assert pairs() == whole
    # A snapshot that broke off does not count; its batches are folded in at the read, and again by the next fold.
    last = jobs.finished(spark, f"{sink}/snapshot", "upto")[-1]
    (tmp_path / "out" / "snapshot" / f"upto={last}" / "_SUCCESS").unlink()
    assert pairs() == whole
    jobs.compact_distinct_pairs(spark, sink, order)
    assert jobs.finished(spark, f"{sink}/snapshot", "upto")[-1] == last and pairs() == whole
    # A run without new files changes nothing.
    jobs.stream_distinct_pairs(spark, source, schema, sink, state, order)
    assert pairs() == whole


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"f{i}.txt").write_text(f"text {i}")
    own = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
        docs = readers.read_text_docs(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
        assert sorted(map(tuple, docs.collect())) == sorted((f"f{i}", f"text {i}") for i in range(150))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", own)
