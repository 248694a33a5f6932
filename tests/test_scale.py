"""Plans and results of steps whose cost must follow the input, not the square of it or one machine's memory."""

import math
import random
import time

from pyspark.sql import functions as F

from pyspark.sql import functions as F

from pyspark.sql import DataFrameWriter

from tripleloom.catalog import base
from tripleloom.functions import text, vectors
from tripleloom.operators import classify, joins, qa
from tripleloom.plans import answering, features
from tripleloom.session import CLEANUP, PARTITIONS, cut_lineage
from tripleloom.sources import readers, writers


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def gold_frame(spark):
    rows = [(f"what r{i % 3} item did c{i} order", f"r{i % 3}", i % 4, "train" if i % 2 else "test") for i in range(40)]
    return spark.createDataFrame(rows, "question string, property_decoded string, cluster int, part string")


def test_matched_questions_are_never_broadcast(spark):
    found = answering.predict_by_classifier(cut_lineage(gold_frame(spark), "matched"))
    on_question = [line for line in plan_of(found).splitlines() if "Join [question" in line]
    assert on_question and all("SortMergeJoin" in line for line in on_question)


def test_scores_with_frequent_and_rare_words_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["what", "is", "the"] * 6 + [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    train = [(text(), rng.randint(0, 3)) for _ in range(60)]
    asked = sorted({text() for _ in range(40)} | {"", "zzz", "what what w1 w1 zzz"})
    model = classify.train_counts(spark.createDataFrame(train, "question string, label int"))
    counts, sizes = {}, {}
    for t, label in train:
        sizes[label] = sizes.get(label, 0) + 1
        for w in t.split():
            counts[(label, w)] = counts.get((label, w), 0) + 1
    vocabulary = {w for _, w in counts}
    total = {label: sum(n for (b, _), n in counts.items() if b == label) for label in sizes}

    def score(t, label):
        known = [w for w in t.split() if w in vocabulary]
        prior = math.log(sizes[label] / len(train)) - len(known) * math.log(total[label] + len(vocabulary))
        return prior + sum(math.log(counts.get((label, w), 0) + 1) for w in known)

    frame = spark.createDataFrame([(t,) for t in asked] * 2, "question string")
    for share in (1, 20, 1000):  # no frequent words, some, all
        monkeypatch.setattr(classify, "FREQUENT", share)
        got = {r["question"]: {s["label"]: -s["cost"] for s in r["scores"]} for r in classify.predict_counts(model, frame).collect()}
        assert sorted(got) == asked
        for t in asked:
            assert all(abs(got[t][label] - score(t, label)) < 1e-8 for label in sizes)


def test_annotations_are_compressed_in_bounded_files(spark, tmp_path):
    token = "array(named_struct('index', 1, 'word', 'a', 'originalText', 'a', 'lemma', 'a', 'pos', 'NN', 'ner', 'O'))"
    rows = spark.range(0, 25, 1, 1).selectExpr(f"{token} AS tokens")
    writers.write_annotations(rows, str(tmp_path / "a"), rows_per_file=10)
    files = [p.name for p in (tmp_path / "a").iterdir() if p.name.startswith("part-")]
    assert len(files) == 3 and all(f.endswith(".json.gz") for f in files)
    assert readers.read_annotations(spark, str(tmp_path / "a"), multi_line=False).count() == 25


def test_numbered_names_have_few_candidates(spark, monkeypatch):
    written = []
    monkeypatch.setattr(joins, "cut_lineage", lambda df, name="stage": written.append((name, cut_lineage(df, name))) or written[-1][1])
    names = spark.range(2000).select(F.format_string("customer#%09d", "id").alias("t"))
    found = joins.contained_keys(names, "t", names.withColumnRenamed("t", "k"), "k")
    assert [r for r in found.collect() if r["t"] != r["k"]] == [] and found.count() == 2000
    runs = dict(written)["runs"]
    rarest = runs.groupBy("_g").agg(F.count("*").alias("n"))
    per_name = runs.join(rarest, "_g").groupBy("_id").agg(F.min("n").alias("n"))
    assert per_name.agg(F.max("n")).first()[0] == 1


def test_tokens_are_not_shuffled_to_be_aligned(spark):
    rng = random.Random(3)
    tokens, triples = [], []
    for doc in range(6):
        at, places = 0, []
        for sent in range(rng.randint(1, 6)):
            for idx in range(1, rng.randint(2, 7)):
                word = rng.choice("abcde") * rng.randint(1, 2)
                places.append((doc, sent, idx, word, at, at + len(word)))
                at += len(word) + 1
        for n in range(8):
            row = [doc, f"t{n % 6}"]
            for _ in range(2):
                a = rng.randrange(len(places))
                b = min(len(places) - 1, a + rng.randint(0, 2))
                row += [places[a][3], None, None] if rng.random() < 0.5 else ["", places[a][4], places[b][5]]
            triples.append(tuple(row))
        tokens += places
    expected = {}
    for doc, triple_id, *given in triples:
        for role, (text, begin, end) in enumerate((given[:3], given[3:])):
            own = [t for t in tokens if t[0] == doc]
            if begin is None:
                hits = [(t[1], t[2], t[2]) for t in own if t[3] == text]
            else:
                hits = [(t[1], t[2], u[2]) for t in own for u in own if t[4] == begin and u[5] == end and t[1] == u[1] and t[2] <= u[2]]
            for s, i, j in hits:
                side = expected.setdefault((doc, triple_id), ({}, {}))[role]
                side[s] = tuple(map(min, side.get(s, (i, j)), (i, j)))
    wanted = []
    for key, (subject, obj) in expected.items():
        if both := subject.keys() & obj.keys():
            wanted.append((*key, min(both), *subject[min(both)], *obj[min(both)]))
    names = [f"{r}_{w} {k}" for r in ("subject", "object") for w, k in (("text", "string"), ("begin", "int"), ("end", "int"))]
    dealt = spark.createDataFrame(tokens, "doc_id int, sent int, idx int, word string, begin int, end int").repartition("doc_id")
    found = joins.align_offsets(dealt, spark.createDataFrame(triples, "doc_id int, triple_id string, " + ", ".join(names)))
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and wanted
    assert plan_of(found).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2


def test_texts_are_written_by_all_cores(spark, tmp_path):
    texts = spark.createDataFrame([(f"text {i}",) for i in range(40)], "text string").coalesce(1)
    writers.write_text_docs(texts, str(tmp_path / "t"))
    names = [p.name for p in (tmp_path / "t").glob("part-*")]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) >= spark.sparkContext.defaultParallelism
    assert sorted(r["text"].strip() for r in readers.read_text_docs(spark, str(tmp_path / "t")).collect()) == sorted(f"text {i}" for i in range(40))


def test_text_files_are_whole_and_stand_alone(spark, tmp_path):
    """A file per text with its bytes and a newline, nothing beside them; what was in the folder is replaced."""
    folder = tmp_path / "t x"
    folder.mkdir()
    (folder / "part-old.txt").write_text("old")
    texts = ["", None, "a\n\nb\n", "\u00e4\U0001F600", "same", "same"]
    writers.write_text_docs(spark.createDataFrame([(t,) for t in texts], "text string"), folder.as_uri().replace("%20", " "))
    files = [p for p in folder.iterdir() if p.name != "_SUCCESS" and p.name != "._SUCCESS.crc"]
    assert all(p.name.startswith("part-") and p.name.endswith(".txt") for p in files)
    assert sorted(p.read_bytes() for p in files) == sorted(f"{t or ''}\n".encode() for t in texts)
    assert sorted(r["text"] for r in readers.read_text_docs(spark, str(folder)).collect()) == sorted(f"{t or ''}\n" for t in texts)
    writers.write_text_docs(spark.createDataFrame([], "text string"), str(folder))
    assert readers.read_text_docs(spark, str(folder)).count() == 0


def test_word_vectors_do_not_move_rows_to_a_small_table(spark):
    rng = random.Random(9)
    lists = [[rng.choice("abcdef") for _ in range(rng.randint(0, 4))] for _ in range(50)] + [None, [None, "a"]]
    known = {w: [float(i), 1.0] for i, w in enumerate("abcd")}
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, lemmas array<string>")
    words = spark.createDataFrame(list(known.items()), "word string, vec array<float>").hint("broadcast")
    found = features.word_vector_rows(rows, ["k"], "lemmas", words, 2)
    padded = lambda words_: [known.get(w, [0.0, 0.0]) for w in ((words_ or []) + [None] * 3)[:3]]
    assert {r["k"]: r["w2v"] for r in found.collect()} == {i: padded(w) for i, w in enumerate(lists)}
    assert "hashpartitioning" not in plan_of(found)
    spread = features.word_vector_rows(rows, ["k"], "lemmas", words.hint("merge"), 2)
    assert {r["k"]: r["w2v"] for r in spread.collect()} == {i: padded(w) for i, w in enumerate(lists)}


def test_partitions_of_a_written_table_follow_the_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(base, "TASK_ROWS", 100)
    own, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a: (seen.append(spark.conf.get("spark.sql.shuffle.partitions")), write(self, *a))[1])
    tables = base.Tables(spark, sf)
    expected = sorted(map(tuple, tables.pairs().collect()))
    tables.questions()
    assert seen == [str(-(-tables.lineitem.count() // 100))] and int(seen[0]) > int(own)
    assert spark.conf.get("spark.sql.shuffle.partitions") == own
    assert sorted(map(tuple, tables.pairs().collect())) == expected


def test_plain_keys_skip_the_patterns(spark):
    odd = ["Ab c", " Ab", "Ab\n", "Ab  ", "Ab ", "Äb ", "", " ", "\x0bA\x0c", "A \r\n", "a\u0085", None]
    rows = spark.createDataFrame([(x,) for x in odd], "t string")
    slow = text.strip(F.lower(text.fold_ascii(F.col("t"))))
    got = rows.select(text.norm_key(F.col("t")), slow).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    assert "btrim" in str(text.norm_key(F.col("t")))


def test_runs_of_names_are_read_without_taking_them_apart(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["", "a", "ab\U0001F600c", "x" * 300 + "\U0001F600yz"] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 20))) for _ in range(20)]
    lengths = [0, 1, 2, 4, 16]
    cut = lambda t: {t[i : i + n] for n in lengths for i in range(len(t) - n + 1) if n} | {""}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    runs = lambda: {r["t"]: r["g"] for r in rows.select("t", joins._grams(F.col("t"), F.array(*map(F.lit, lengths))).alias("g")).collect()}
    for longest in (joins.NAME, 0):  # short texts by place, then all by their letters
        monkeypatch.setattr(joins, "NAME", longest)
        found = runs()
        assert {t: set(g) - {""} for t, g in found.items()} == {t: cut(t) - {""} for t in texts}
        assert all(len(g) == len(set(g)) for g in found.values())
    keys = spark.createDataFrame([("\U0001F600y",), ("zz",), ("",)], "k string")
    monkeypatch.undo()
    hits = {(r["t"], r["k"]) for r in joins.contained_keys(rows, "t", keys, "k").collect()}
    assert hits == {(t, k) for t in texts for k in ("\U0001F600y", "zz", "") if k in t}


def test_distinct_structs_are_dealt_by_the_lines(spark, sf, monkeypatch):
    monkeypatch.setattr(base, "TASK_ROWS", 100)
    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a: (seen.append(spark.conf.get("spark.sql.shuffle.partitions")), write(self, *a))[1])
    found = base.CASES["d04_distinct_structs"].run(spark, sf)
    lines = base.Tables(spark, sf)
    assert seen == [str(-(-lines.lineitem.count() // 100))]
    expected = lines.triples().select("subject", "relation", "object", "score").distinct()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = [blocks.apply(i).name() for i in range(blocks.size())]
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_written_tables_leave_no_shuffle_files(spark):
    before, settings = shuffle_files(spark), dict(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsparkSession.conf().getAll()))
    table = cut_lineage(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")), "kept")
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(PARTITIONS) == settings[PARTITIONS]
    assert spark.conf.get(CLEANUP) == settings.get(CLEANUP, "false")
    assert table.agg(F.sum("n")).first()[0] == 5000


def test_questions_are_counted_without_being_sent(spark, monkeypatch):
    """Labels of a list are counted after the shuffle, from the words alone."""
    written = []
    monkeypatch.setattr(classify, "cut_lineage", lambda df, name: written.append(df) or cut_lineage(df, name))
    rows = [("who made it", "1 2 2"), ("who made it", "3"), ("made in", "1"), (None, "1"), ("what", None), ("what", "")]
    model = classify.train_multilabel(spark.createDataFrame(rows, "question string, labels string"))
    counts = {(r["label"], r["token"]): r["c"] for r in written[0].collect()}
    assert counts == {
        **{(1, w): n for w, n in (("who", 1), ("made", 2), ("it", 1), ("in", 1), (None, 2))},
        **{(2, w): 2 for w in ("who", "made", "it", None)}, **{(3, w): 1 for w in ("who", "made", "it", None)},
    }
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("question" in line or "_q#" in line for line in exchanges)
    found = {r["question"]: r["pred"] for r in classify.question_classifier_nb(model, spark.createDataFrame([("in",), ("",), (None,), ("it it",)], "question string")).collect()}
    assert found["in"] == 1 and found["it it"] == 2 and set(found) == {"in", "", None, "it it"}


def test_positional_rows_stay_within_compiled_code(spark, sf):
    """One-hot rows are looked up, and the relation is folded in a projection, not once per preposition in a generator."""
    words = [*(f"w{i}" for i in range(12)), "w3"]
    lists = [[], ["w0"], ["w11", None, "w3", "w4"], ["none", "w2"], None]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, tags array<string>").repartition(2)
    found = rows.select("k", vectors.positional_onehot(F.col("tags"), words).alias("hot"))
    hot = lambda tags: [[int(w == t) for w in words] for t in ((tags or []) + [None] * 3)[:3]]
    assert {r["k"]: r["hot"] for r in found.collect()} == {i: hot(tags) for i, tags in enumerate(lists)}
    assert plan_of(found).count("= w3") == 0
    generators = [line for line in plan_of(base.CASES["t40_assemble_positional"].run(spark, sf)).splitlines() if "Generate explode" in line]
    assert generators and not any("translate(relation" in line for line in generators)


def test_steps_of_answering_are_written_between(spark, monkeypatch):
    """Shuffles of one step are gone before the next one, and nothing is made twice."""
    written = []
    note = lambda df, name="stage": written.append((name, cut_lineage(df, name))) or written[-1][1]
    for module in (joins, qa, answering):
        monkeypatch.setattr(module, "cut_lineage", note)
    triples = spark.createDataFrame([(1, "ada x", "met", "bob"), (1, "eve", "saw", "ada"), (2, "ada", "met", "eve")], "cluster int, subject string, relation string, object string")
    asked = spark.createDataFrame([(1, "ada"), (1, "ada zoe x"), (2, "zoe")], "cluster int, entity string")
    loose = qa.answer_lookup_contains(asked, triples, strict=False)
    assert {(r["entity"], r["subject"]) for r in loose.collect()} == {("ada", "eve"), ("ada zoe x", "eve")}
    assert [name for name, _ in written] == ["keys", "texts", "runs", "found", "exact"]
    written.clear()
    gold = gold_frame(spark).select(
        F.regexp_extract("question", "did (c[0-9]+) ", 1).alias("subject_decoded"), F.col("property_decoded").alias("object_decoded"), "property_decoded", "question", "part", "cluster"
    )
    known = gold.select(F.col("subject_decoded").alias("subject"), F.col("object_decoded").alias("object"), F.lit("met").alias("relation"), "cluster", F.lit(1.0).alias("score"))
    assert answering.question_table(gold.drop("cluster"), known).where("answered").count() > 0
    assert [name for name, _ in written] == ["matched", "asked"]
