import corpus_pipeline as P
from tripleloom.llm import decontaminate, hilbert_pack, quality_crf, secret_scan
from tripleloom.llm.common import table
from test_hilbert_pack import SPEC, verify
from test_simhash_pivots import brute_components, brute_fingerprint


def test_each_stage_against_a_plain_version(spark, sf):
    from tokenizers import Tokenizer

    docs = table(spark, sf, "documents")
    names = docs.columns
    model = quality_crf.fit_quality(docs, table(spark, sf, "labels"), quality_crf.training_rows())
    rows = docs.collect()
    scores = {r.doc_id: r.score for r in quality_crf.op2_quality(spark, sf).collect()}
    expected = {r.doc_id: r.text for r in rows if scores[r.doc_id] >= 0.7}

    stage = P.keep_quality(spark, docs, sf)
    assert stage.columns == names and {r.doc_id: r.text for r in stage.collect()} == expected and model
    prints = {i: brute_fingerprint(t) for i, t in expected.items()}
    roots = brute_components(prints.values())
    first = {}
    for i in sorted(expected):
        first.setdefault(roots[prints[i]], i)
    expected = {i: expected[i] for i in first.values()}
    stage = P.keep_first_of_copies(spark, stage, sf)
    assert stage.columns == names and {r.doc_id: r.text for r in stage.collect()} == expected

    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    find = decontaminate.finder(decontaminate.build_indexes(items))
    leaks = dict(zip(expected, find(list(expected.values()))))
    expected = {i: t for i, t in expected.items() if not leaks[i]}
    stage = P.keep_uncontaminated(spark, stage, sf)
    assert stage.columns == names and {r.doc_id: r.text for r in stage.collect()} == expected

    scan = secret_scan.scanner()
    stage = P.without_secrets(spark, stage, sf)
    cleaned = {r.doc_id: r for r in stage.collect()}
    assert stage.columns == names and cleaned.keys() == expected.keys()
    for i, t in expected.items():
        base, more = scan(t)
        assert cleaned[i].text == t if not base + more else "[SECRET]" in cleaned[i].text and not scan(cleaned[i].text)[0]
        assert cleaned[i].n_chars == len(cleaned[i].text)

    own = Tokenizer.from_str(SPEC)
    ids = {i: own.encode(r.text, add_special_tokens=False).ids + [1] for i, r in cleaned.items()}
    verify(P.packed(spark, stage, sf).collect(), ids, hilbert_pack.CAPACITY)
    verify(P.run(spark, sf).collect(), ids, hilbert_pack.CAPACITY)


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, "e"), (1, "", "en", "s", 0, "e"), (1, "", "en", "s", 0, "e")],
                                "doc_id long, text string, lang string, source string, n_chars long, quality string")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns
        out.collect()
