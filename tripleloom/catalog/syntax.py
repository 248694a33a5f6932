"""Text, syntax and vector projections (T01-T40)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.catalog.base import Tables, case, joined, sql_with
from tripleloom.functions import syntax, text, vectors
from tripleloom.functions.vocab import (
    ENGLISH_STOP,
    NER_TYPES,
    ONTONOTES_NER,
    POS_TAGS,
    PREPOSITIONS,
)
from tripleloom.operators.windows import pack_chunks, unpack_chunks
from tripleloom.plans import features
from tripleloom.plans.features import span

KEY = ["doc_id", "sent", "tpos"]
SP = r"[ \t\n\r\f\v\x{00A0}]"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SP}+|{SP}+$', '', 'g')"


def sql_clean(expr: str) -> str:
    text_ = f"regexp_replace({sql_strip(expr)}, '\\n{{2,}}', chr(10), 'g')"
    for pattern in (r"\[[0-9]+\]", r"\x{00A0}", r"\\''[^s]", r"\([^\n]+\)"):
        text_ = f"regexp_replace({text_}, '{pattern}', ' ', 'g')"
    text_ = sql_strip(f"regexp_replace({text_}, ' {{2,}}', ' ', 'g')")
    return (
        f"list_transform([{text_}], lambda x: CASE WHEN x LIKE '%:' AND contains(x, chr(10)) "
        "THEN regexp_replace(x, '\\n[^\\n]*:$', '') ELSE regexp_replace(x, ':$', '') END)[1]"
    )


def sql_fold(expr: str) -> str:
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        expr = f"replace({expr}, '{a}', '{b}')"
    return f"strip_accents({expr})"


def sql_norm(expr: str) -> str:
    return sql_strip(f"lower({sql_fold(expr)})")


def sql_vocab_hot(words: list[str], expr: str) -> str:
    return (
        f"array_to_string(list_transform([{quoted(words)}], "
        f"lambda v: CASE WHEN list_contains({expr}, v) THEN 1 ELSE 0 END), ',')"
    )


def sql_tags(field: str, prefix: str) -> str:
    return f"list_transform(toks[{prefix}_start+1:{prefix}_end], lambda t: t.{field})"


def sql_types(prefix: str) -> str:
    expr = f"array_to_string({sql_tags('ner', prefix)}, '_')"
    for pattern, value in (
        ("(PERSON_)+PERSON", "PERSON"), ("(ORGANIZATION_)+ORGANIZATION", "ORGANIZATION"),
        ("DURATION", "O"), ("(O_)+O", "O"),
    ):
        expr = f"regexp_replace({expr}, '{pattern}', '{value}', 'g')"
    return expr


GAP = (
    "toks[(CASE WHEN obj_start <= subj_start THEN obj_end ELSE subj_end END) + 1:"
    "(CASE WHEN obj_start <= subj_start THEN subj_start ELSE obj_start END)]"
)
ON_PATH = "FROM spans_v JOIN paths_v USING (doc_id, sent, tpos)"


def spans_sql(value: str, *names: str) -> str:
    return sql_with(f"SELECT doc_id, sent, tpos, {value} FROM spans_v", "spans_v", *names)


# --- text ---------------------------------------------------------------------------------


@case("t01_clean_text", f"SELECT doc_id, {sql_clean('text')} AS clean FROM documents")
def _(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


def _sql_unescape(expr: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


_P_LINE = sql_strip(_sql_unescape("regexp_replace(p, '<[^>]*>', '', 'g')"))
_MARKED = (
    f"regexp_replace(regexp_replace(regexp_replace(html, '{text.HIDDEN_HTML}', '', 'g'), '(?i)<p(?:\\s[^>]*)?>', chr(1) || chr(2), 'g'), "
    f"'{text.BLOCK_TAG}', chr(1), 'g')"
)
_BODY = (
    f"array_to_string(list_transform(list_filter(string_split({_MARKED}, chr(1)), lambda p: starts_with(p, chr(2))), "
    f"lambda p: {_P_LINE.replace('regexp_replace(p,', 'regexp_replace(substr(p, 2),')}), chr(10))"
)


@case(
    "t02_html_paragraphs",
    f"SELECT page_id, {sql_clean('body')} AS body, title FROM (SELECT page_id, {_BODY} AS body, "
    + _sql_unescape("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")
    + " AS title FROM pages) x",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id",
        text.html_paragraphs(F.col("html")).alias("body"),
        text.html_title(F.col("html")).alias("title"),
    )


@case("t03_norm_key", f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def _(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", text.norm_key(F.col("text")).alias("norm"))


@case(
    "t04_pair_key",
    sql_with(
        "SELECT doc_id, pos, subject || ' ::: ' || object AS subj_obj, object || ' ::: ' || subject AS obj_subj FROM triples_v",
        "triples_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return t.triples().select(
        "doc_id", "pos",
        text.pair_key(F.col("subject"), F.col("object")).alias("subj_obj"),
        text.pair_key(F.col("object"), F.col("subject")).alias("obj_subj"),
    )


_Q_TOKENS = "list_filter(string_split_regex({}, '[^0-9a-z'']+'), lambda w: w <> '')"


@case(
    "t05_tokenize_question",
    f"SELECT conv_id, turn, role, array_to_string({_Q_TOKENS.format(sql_norm('text'))}, ' ') AS toks FROM conversations",
)
def _(t: Tables) -> DataFrame:
    return t.conversations.select(
        "conv_id", "turn", "role", joined(text.tokenize_question(F.col("text")), " ").alias("toks")
    )


# --- syntax -------------------------------------------------------------------------------


@case(
    "t06_phrase_head",
    sql_with("SELECT doc_id, sent, tpos, CAST(obj_head AS INT) AS obj_head, CAST(subj_head AS INT) AS subj_head FROM heads_v", "heads_v"),
)
def _(t: Tables) -> DataFrame:
    return t.spans().select(
        *KEY,
        syntax.phrase_head(F.col("gov"), *span("obj")).alias("obj_head"),
        syntax.phrase_head(F.col("gov"), *span("subj")).alias("subj_head"),
    )


@case(
    "t07_pos_of_span",
    spans_sql(
        ", ".join(f"array_to_string({sql_tags('pos', p)}, '_') AS pos_{p}" for p in ("subj", "rel", "obj"))
    ),
)
def _(t: Tables) -> DataFrame:
    return t.spans().select(
        *KEY,
        *[syntax.pos_of_span(F.col("tokens"), *span(p)).alias(f"pos_{p}") for p in ("subj", "rel", "obj")],
    )


_BOW = f"list_filter(list_transform({GAP}, lambda t: lower(t.word)), lambda w: NOT regexp_matches(w, '[0-9]'))"


@case("t08_bow_between", spans_sql(f"array_to_string({_BOW}, ' ') AS bow"))
def _(t: Tables) -> DataFrame:
    return t.spans().select(
        *KEY, syntax.bow_between(F.col("tokens"), span("obj"), span("subj")).alias("bow")
    )


@case(
    "t09_bow_between_nostop",
    spans_sql(f"array_to_string(list_filter({_BOW}, lambda w: w NOT IN ({quoted(ENGLISH_STOP)})), ' ') AS bow"),
)
def _(t: Tables) -> DataFrame:
    return t.spans().select(
        *KEY, syntax.bow_between(F.col("tokens"), span("obj"), span("subj"), ENGLISH_STOP).alias("bow")
    )


@case("t10_pos_between", spans_sql(f"array_to_string(list_transform({GAP}, lambda t: t.pos), '_') AS tags"))
def _(t: Tables) -> DataFrame:
    return t.spans().select(
        *KEY, syntax.pos_between(F.col("tokens"), span("obj"), span("subj")).alias("tags")
    )


def with_path(t: Tables) -> DataFrame:
    gov = F.col("gov")
    return t.spans().withColumn(
        "path",
        syntax.dep_path(
            gov, syntax.phrase_head(gov, *span("obj")), syntax.phrase_head(gov, *span("subj"))
        ),
    )


@case(
    "t11_dep_path",
    sql_with("SELECT doc_id, sent, tpos, array_to_string(path, ',') AS path FROM paths_v", "paths_v"),
)
def _(t: Tables) -> DataFrame:
    return with_path(t).select(*KEY, joined("path").alias("path"))


_SETS = dict(
    near_v="SELECT doc_id, sent, tpos, range(subj_start + 1, subj_end + 1) AS dst, range(obj_start + 1, obj_end + 1) AS src, list_transform(range(1, n_tokens + 1), "
    "lambda i: list_filter(list_concat([toks[i].gov, i - 1, i + 1], list_filter(range(1, n_tokens + 1), lambda j: toks[j].gov = i)), lambda y: y > 0 AND y <= n_tokens)) AS near FROM spans_v",
    levels_v="SELECT doc_id, sent, tpos, src, near, [dst] AS levels, dst AS seen, list_has_any(src, dst) AS done FROM near_v "
    "UNION ALL SELECT doc_id, sent, tpos, src, near, list_append(levels, nxt), list_concat(seen, nxt), list_has_any(src, nxt) OR len(nxt) = 0 FROM (SELECT *, "
    "list_distinct(list_filter(flatten(list_transform(levels[-1], lambda x: near[x])), lambda y: NOT list_contains(seen, y))) AS nxt FROM levels_v WHERE NOT done) x",
    trail_v="SELECT doc_id, sent, tpos, near, levels, len(levels) AS l, [list_min(list_intersect(levels[-1], src))] AS path FROM levels_v WHERE done "
    "UNION ALL SELECT doc_id, sent, tpos, near, levels, l - 1, list_append(path, list_min(list_intersect(levels[l - 1], near[path[-1]]))) FROM trail_v WHERE l > 1 AND path[-1] IS NOT NULL",
)


@case(
    "t12_dep_path_between_sets",
    sql_with(
        "SELECT doc_id, sent, tpos, CASE WHEN path[-1] IS NULL THEN '' ELSE array_to_string(path, ',') END AS path FROM trail_v WHERE l = 1 OR path[-1] IS NULL",
        "spans_v", **_SETS,
    ),
)
def _(t: Tables) -> DataFrame:
    """On the tree plus an edge from each token to the one before it."""
    edges = F.concat(
        F.transform("gov", lambda g, i: F.struct(g.alias("governor"), (i + 1).alias("dependent"))),
        F.transform("gov", lambda _, i: F.struct(i.alias("governor"), (i + 1).alias("dependent"))),
    )
    members = lambda p: F.sequence(F.col(f"{p}_start") + 1, F.col(f"{p}_end"))
    path = syntax.dep_path_between_sets(edges, members("obj"), members("subj"))
    return t.spans().select(*KEY, joined(path).alias("path"))


@case("t13_entity_type", spans_sql(f"{sql_types('obj')} AS obj_type, {sql_types('subj')} AS subj_type"))
def _(t: Tables) -> DataFrame:
    return t.spans().select(
        *KEY, *[syntax.entity_type(F.col("tokens"), *span(p)).alias(f"{p}_type") for p in ("obj", "subj")]
    )


@case("t14_pair_type", spans_sql(f"{sql_types('obj')} || '_' || {sql_types('subj')} AS pair_type"))
def _(t: Tables) -> DataFrame:
    types = [syntax.entity_type(F.col("tokens"), *span(p)) for p in ("obj", "subj")]
    return t.spans().select(*KEY, syntax.pair_type(*types).alias("pair_type"))


_INNER = "list_transform(path[2:len(path)-1], lambda i: toks[i].{})"


@case(
    "t15_words_on_path",
    sql_with(
        f"SELECT doc_id, sent, tpos, array_to_string({_INNER.format('word')}, ' ') AS words {ON_PATH}",
        "spans_v", "paths_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return with_path(t).select(*KEY, syntax.words_on_path(F.col("tokens"), F.col("path")).alias("words"))


_TRIGGER = f"array_to_string(list_filter({_INNER.format('lemma')}, lambda w: w NOT IN ({quoted(ENGLISH_STOP)})), '|')"


@case(
    "t16_trigger",
    sql_with(f"SELECT doc_id, sent, tpos, {_TRIGGER} AS trigger {ON_PATH}", "spans_v", "paths_v"),
)
def _(t: Tables) -> DataFrame:
    return with_path(t).select(*KEY, syntax.trigger(F.col("tokens"), F.col("path")).alias("trigger"))


@case(
    "t17_lemmas_on_path",
    sql_with(
        "SELECT doc_id, sent, tpos, array_to_string(list_transform(list_sort(path[1:len(path)-1]), lambda i: toks[i].lemma), ' ') AS lemmas "
        + ON_PATH,
        "spans_v", "paths_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return with_path(t).select(*KEY, syntax.lemmas_on_path(F.col("tokens"), F.col("path")).alias("lemmas"))


@case(
    "t18_sentence_text",
    sql_with("SELECT doc_id, sent, array_to_string(list_transform(toks, lambda t: t.word), ' ') AS sentence FROM sents_v", "sents_v"),
)
def _(t: Tables) -> DataFrame:
    return t.sentences().select("doc_id", "sent", syntax.sentence_text(F.col("tokens")).alias("sentence"))


BASIC_SQL = (
    "SELECT doc_id, sent, tpos, array_to_string(path, ',') AS dep_path, "
    + ", ".join(f"array_to_string({sql_tags('pos', p)}, '_') AS pos_{p}" for p in ("obj", "subj", "rel"))
    + f", object, subject, relation, {_TRIGGER} AS trigger, array_to_string({_BOW}, ' ') AS bow_between, "
    f"array_to_string(list_transform({GAP}, lambda t: t.pos), '_') AS pos_between, "
    f"{sql_types('obj')} || '_' || {sql_types('subj')} AS pair_type, {sql_types('obj')} AS obj_type, "
    f"{sql_types('subj')} AS subj_type, array_to_string({_INNER.format('word')}, ' ') AS path, "
    f"obj_start, obj_end, subj_start, subj_end, rel_start, rel_end, n_tokens "
    + ON_PATH
    + f" WHERE {sql_types('obj')} || {sql_types('subj')} <> 'OO'"
)
BASIC_COLUMNS = [
    *KEY, "dep_path", "pos_obj", "pos_subj", "pos_rel", "object", "subject", "relation", "trigger",
    "bow_between", "pos_between", "pair_type", "obj_type", "subj_type", "path",
]


@case(
    "t19_explode_triples",
    sql_with(f"SELECT {', '.join(BASIC_COLUMNS)} FROM basic_v", "spans_v", "paths_v", basic_v=BASIC_SQL),
)
def _(t: Tables) -> DataFrame:
    basic = features.explode_triples(t.sentences())
    return basic.withColumn("dep_path", joined("dep_path")).select(*BASIC_COLUMNS)


# --- vectors ------------------------------------------------------------------------------


def sql_hot_tags(prefix: str) -> str:
    return sql_vocab_hot(POS_TAGS, sql_tags("pos", prefix))


def sql_hot_types(prefix: str) -> str:
    return sql_vocab_hot(NER_TYPES, f"string_split({sql_types(prefix)}, '_')[1:4]")


SQL_HOT_PREP = sql_vocab_hot(PREPOSITIONS, f"string_split(lower({sql_fold('relation')}), ' ')")


@case("t20_pos_multihot", spans_sql(", ".join(f"{sql_hot_tags(p)} AS pos_{p}" for p in ("subj", "rel", "obj"))))
def _(t: Tables) -> DataFrame:
    return t.spans().select(
        *KEY,
        *[
            joined(vectors.pos_multihot(syntax.pos_of_span(F.col("tokens"), *span(p)))).alias(f"pos_{p}")
            for p in ("subj", "rel", "obj")
        ],
    )


@case("t21_ner_multihot", spans_sql(", ".join(f"{sql_hot_types(p)} AS ner_{p}" for p in ("subj", "obj"))))
def _(t: Tables) -> DataFrame:
    return t.spans().select(
        *KEY,
        *[
            joined(vectors.ner_multihot(syntax.entity_type(F.col("tokens"), *span(p)))).alias(f"ner_{p}")
            for p in ("subj", "obj")
        ],
    )


@case("t22_prep_multihot", spans_sql(f"{SQL_HOT_PREP} AS prep"))
def _(t: Tables) -> DataFrame:
    return t.spans().select(*KEY, joined(vectors.prep_multihot(F.col("relation"))).alias("prep"))


def sql_onehot(words: list[str], tags: str) -> str:
    rows = ", ".join(
        f"list_transform([{quoted(words)}], lambda v: CASE WHEN {tags}[{i}] = v THEN 1 ELSE 0 END)" for i in (1, 2, 3)
    )
    return f"array_to_string(flatten([{rows}]), ',')"


@case(
    "t23_positional_onehot",
    spans_sql(
        f"{sql_onehot(POS_TAGS, sql_tags('pos', 'obj'))} AS tags, {sql_onehot(ONTONOTES_NER, sql_tags('ner', 'obj'))} AS types"
    ),
)
def _(t: Tables) -> DataFrame:
    field = lambda name: F.transform(syntax.span_of(F.col("tokens"), *span("obj")), lambda x: x[name])
    hot = lambda name, words: joined(F.flatten(vectors.positional_onehot(field(name), words)))
    return t.spans().select(
        *KEY, hot("pos", POS_TAGS).alias("tags"), hot("ner", ONTONOTES_NER).alias("types")
    )


@case(
    "t24_relative_position",
    spans_sql(
        "rel_start - subj_start AS subj_dist, rel_start - obj_start AS obj_dist, "
        "round(subj_start / n_tokens, 6) AS subj_rel, round(obj_start / n_tokens, 6) AS obj_rel, "
        "CASE WHEN subj_start < obj_start THEN 1 ELSE 0 END AS subject_at_left"
    ),
)
def _(t: Tables) -> DataFrame:
    n = F.size("tokens")
    return t.spans().select(
        *KEY,
        (F.col("rel_start") - F.col("subj_start")).alias("subj_dist"),
        (F.col("rel_start") - F.col("obj_start")).alias("obj_dist"),
        F.round(F.col("subj_start") / n, 6).alias("subj_rel"),
        F.round(F.col("obj_start") / n, 6).alias("obj_rel"),
        (F.col("subj_start") < F.col("obj_start")).cast("int").alias("subject_at_left"),
    )


# Every place of the vector counts by its number, so that the places are compared as well.
_EMB_SUM = (
    "round(coalesce(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), "
    "list_sum(list_transform(s.toks, lambda t: CAST(CAST('0x' || substr(md5(t.lemma), 1, 15) AS BIGINT) % 64 + 1 AS DOUBLE)))), 3)"
)
_VECTORED = "FROM plain_v p JOIN sents_v s USING (doc_id, sent) LEFT JOIN embeddings ON p.doc_id = vec_id"
PLAIN_SQL = (
    "SELECT doc_id, sent, tpos, lower(subject) AS subject, lower(relation) AS relation, lower(object) AS object, "
    + ", ".join(f"{sql_vocab_hot(POS_TAGS, f'string_split(pos_{p}, {chr(39)}_{chr(39)})')} AS hot_{p}" for p in ("subj", "rel", "obj"))
    + ", "
    + ", ".join(f"{sql_vocab_hot(NER_TYPES, f'string_split({p}_type, {chr(39)}_{chr(39)})[1:4]')} AS ner_{p}" for p in ("subj", "obj"))
    + f", {SQL_HOT_PREP} AS prep, CASE WHEN subj_start < obj_start THEN '1' ELSE '0' END AS is_left FROM basic_v"
    " WHERE pos_subj <> 'PRP' AND pos_obj <> 'PRP' AND lower(relation) NOT IN ({verbs}) AND length(subject) >= 3 "
    "AND length(relation) >= 3 AND length(object) >= 3 AND NOT (obj_type = 'O' AND subj_type = 'O') "
    "AND NOT regexp_matches(relation, '^[0-9]+$')"
)


def plain_sql() -> str:
    from tripleloom.functions.vocab import LIGHT_VERBS

    return PLAIN_SQL.replace("{verbs}", quoted(LIGHT_VERBS))


def ints(vec, size: int):
    return joined(F.slice(vec, 1, size).cast("array<int>"))


def emb_sum(vec, start: int):
    tail = F.slice(vec, F.lit(start), F.size(vec)).cast("array<double>")
    return weighted_sum(tail)


def weighted_sum(vec):
    return F.round(F.aggregate(F.transform(vec, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3)


@case(
    "t25_assemble_vectors",
    sql_with(
        "SELECT subject, object, relation, doc_id, hot_subj || ',' || ner_subj AS subject_matr, "
        "hot_rel || ',' || prep || ',' || is_left AS relation_matr, hot_obj || ',' || ner_obj AS object_matr, emb FROM "
        f"(SELECT p.*, {_EMB_SUM} AS emb, row_number() OVER (PARTITION BY subject, object ORDER BY p.doc_id, sent, tpos) AS rn "
        f"{_VECTORED}) x WHERE rn = 1",
        "spans_v", "paths_v", basic_v=BASIC_SQL, plain_v=plain_sql(),
    ),
)
def _(t: Tables) -> DataFrame:
    built = features.build_matrices(t.sentences(), t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"))
    return built.select(
        "subject", "object", "relation", "doc_id",
        ints("subject_matr", 41).alias("subject_matr"),
        ints("relation_matr", 60).alias("relation_matr"),
        ints("object_matr", 41).alias("object_matr"),
        emb_sum("relation_matr", 61).alias("emb"),
    )


@case(
    "t26_assemble_single",
    sql_with(
        f"SELECT p.doc_id, sent, tpos, hot_subj || ',' || ner_subj || ',' || hot_rel || ',' || prep || ',' || is_left AS head, "
        f"{_EMB_SUM} AS emb, hot_obj || ',' || ner_obj AS tail, coalesce(len(embedding), 64) + 142 AS width "
        f"{_VECTORED}",
        "spans_v", "paths_v", basic_v=BASIC_SQL, plain_v=plain_sql(),
    ),
)
def _(t: Tables) -> DataFrame:
    plain = features.plain_features(features.filtered_triples(features.explode_triples(t.sentences())))
    vecs = features.assemble_vectors(
        features.join_embeddings(plain, t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"))
    )
    whole = vecs.select(
        *KEY, vectors.single_vector(*[F.col(f"{n}_matr") for n in ("subject", "relation", "object")]).alias("v")
    )
    d = F.size("v") - 142
    middle = F.slice("v", F.lit(102), d).cast("array<double>")
    return whole.select(
        *KEY,
        ints("v", 101).alias("head"),
        weighted_sum(middle).alias("emb"),
        joined(F.slice("v", d + 102, F.lit(41)).cast("array<int>")).alias("tail"),
        F.size("v").cast("bigint").alias("width"),
    )


# A word table: the distinct lemmas in order, numbered, meet the vectors by number.
WORDS_SQL = (
    "SELECT lemma AS word, embedding AS vec FROM (SELECT lemma, row_number() OVER (ORDER BY lemma) - 1 AS id "
    "FROM (SELECT DISTINCT lemma FROM tokens_v) a) b JOIN embeddings ON id = vec_id"
)


def word_table(t: Tables) -> DataFrame:
    from tripleloom.operators.numbering import numbered

    # Numbering reads them several times.
    lemmas = t.stage(
        "lemmas", lambda: t.sentences().select(F.explode(F.transform("tokens", lambda x: x["lemma"])).alias("word")).distinct()
    )
    ids = numbered(lemmas, "word", name="no").select("word", (F.col("no") - 1).alias("vec_id"))
    return ids.join(t.embeddings, "vec_id").select("word", F.col("embedding").alias("vec"))


def object_lemmas(t: Tables) -> DataFrame:
    lemmas = syntax.lemma_pos(F.col("tokens"), *span("obj"), F.col("object"))
    return t.spans().select(*KEY, lemmas.alias("lemmas"))


def sql_word(i: int) -> str:
    return (
        f"LEFT JOIN words_v w{i} ON w{i}.word = toks[obj_start+{i}].lemma AND obj_start + {i} <= obj_end "
    )


def sql_word_sum(i: int) -> str:
    return f"coalesce(round(list_sum(list_transform(w{i}.vec, lambda x: CAST(x AS DOUBLE))), 4), 0.0) AS s{i}"


@case(
    "t27_avg_or_pad_word_vectors",
    sql_with(
        f"SELECT doc_id, sent, tpos, {', '.join(sql_word_sum(i) for i in (1, 2, 3))} FROM spans_v "
        + "".join(sql_word(i) for i in (1, 2, 3)),
        "spans_v", words_v=WORDS_SQL,
    ),
)
def _(t: Tables) -> DataFrame:
    rows = features.word_vector_rows(object_lemmas(t), KEY, "lemmas", word_table(t), 64)
    total = lambda i: F.aggregate(
        F.get("w2v", F.lit(i)).cast("array<double>"), F.lit(0.0), lambda a, x: a + x
    )
    return rows.select(*KEY, *[F.round(total(i), 4).alias(f"s{i + 1}") for i in range(3)])


@case("t28_last_uri_segment", "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS segment FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.last_uri_segment(F.col("url")).alias("segment"))


@case(
    "t29_surface_underscore",
    sql_with("SELECT doc_id, pos, regexp_replace(trim(object), '[ \\t\\n]+', '_', 'g') AS e1 FROM triples_v", "triples_v"),
)
def _(t: Tables) -> DataFrame:
    return t.triples().select("doc_id", "pos", text.surface_underscore(F.col("object")).alias("e1"))


@case(
    "t30_sitelink",
    "SELECT event_id, 'https://en.example.org/wiki/' || event_type || ' ' || json_extract_string(props, '$.k') AS url, "
    "2 AS n_links FROM events",
)
def _(t: Tables) -> DataFrame:
    """Each event as an entity document with two encoded links."""
    number = F.get_json_object("props", "$.k")
    link = lambda lang: F.format_string(
        '"%swiki":{"site":"%swiki","title":"t","url":"https://%s.example.org/wiki/%s%%20%s"}',
        F.lit(lang), F.lit(lang), F.lit(lang), "event_type", number,
    )
    entity = F.concat(F.lit("Q"), F.col("event_id").cast("string"))
    doc = F.concat(
        F.lit('{"entities":{"'), entity, F.lit('":{"sitelinks":{'), link("en"), F.lit(","), link("de"), F.lit("}}}}")
    )
    docs = t.events.select("event_id", entity.alias("entity"), doc.alias("doc"))
    return docs.select(
        "event_id",
        text.sitelink(F.col("doc"), F.col("entity")).alias("url"),
        F.size(text.sitelink(F.col("doc"), F.col("entity"), None)).alias("n_links"),
    )


@case(
    "t31_halve_repetition",
    sql_with(
        "SELECT DISTINCT object, CASE WHEN n % 2 = 0 AND x[1:n // 2] = x[n // 2 + 1:n] THEN array_to_string(x[1:n // 2], ' ') ELSE array_to_string(x, ' ') END AS halved "
        "FROM (SELECT object, x, len(x) AS n FROM (SELECT object, string_split(CASE WHEN pos % 2 = 0 THEN object || ' ' || object ELSE object END, ' ') AS x FROM triples_v) a) b",
        "triples_v",
    ),
)
def _(t: Tables) -> DataFrame:
    doubled = F.when(F.col("pos") % 2 == 0, F.concat_ws(" ", "object", "object")).otherwise(F.col("object"))
    return (
        t.triples()
        .select("object", joined(text.halve_repetition(F.split(doubled, " ")), " ").alias("halved"))
        .distinct()
    )


@case(
    "t32_tag_relation_by_object",
    spans_sql(
        f"relation || CASE WHEN contains({sql_types('obj')}, 'NUMBER') THEN ' date' ELSE '' END || "
        f"CASE WHEN contains({sql_types('obj')}, 'PERSON') THEN ' location' ELSE '' END AS tagged"
    ),
)
def _(t: Tables) -> DataFrame:
    types = syntax.entity_type(F.col("tokens"), *span("obj"))
    return t.spans().select(
        *KEY,
        text.tag_relation_by_object(
            F.col("relation"), F.contains(types, F.lit("NUMBER")), F.contains(types, F.lit("PERSON"))
        ).alias("tagged"),
    )


@case(
    "t33_format_triple",
    sql_with(
        "SELECT doc_id, pos, format('({})-[{}]->({}) <=> |{:.4f}|', subject, relation, object, score) AS triple FROM triples_v",
        "triples_v",
    ),
)
def _(t: Tables) -> DataFrame:
    return t.triples().select(
        "doc_id", "pos",
        text.format_triple(F.col("subject"), F.col("relation"), F.col("object"), F.col("score")).alias("triple"),
    )


_NUMBERED = (
    "SELECT doc_id, text, length(text) AS size, CAST(floor(doc_id / 1024) AS BIGINT) AS shard, "
    "row_number() OVER (PARTITION BY floor(doc_id / 1024) ORDER BY doc_id) AS rn FROM documents"
)
# The greedy fold: a text that does not fit any more opens the next chunk.
_CHUNKS = (
    "SELECT shard, doc_id, text, rn, 0 AS chunk, size AS used FROM numbered_v WHERE rn = 1 UNION ALL "
    "SELECT n.shard, n.doc_id, n.text, n.rn, c.chunk + CASE WHEN c.used + 3 + n.size > 10000 THEN 1 ELSE 0 END, "
    "CASE WHEN c.used + 3 + n.size > 10000 THEN n.size ELSE c.used + 3 + n.size END "
    "FROM chunks_v c JOIN numbered_v n ON n.shard = c.shard AND n.rn = c.rn + 1"
)


@case(
    "t34_pack_chunks",
    sql_with("SELECT shard, chunk, string_agg(text, ' \u241f ' ORDER BY doc_id) AS text FROM chunks_v GROUP BY shard, chunk", numbered_v=_NUMBERED, chunks_v=_CHUNKS),
)
def _(t: Tables) -> DataFrame:
    return pack_chunks(t.documents.select("doc_id", "text"), "doc_id", "text").drop("keys", "sizes")


@case("t35_unpack_chunks", "SELECT doc_id, text AS piece FROM documents")
def _(t: Tables) -> DataFrame:
    packed = pack_chunks(t.documents.select("doc_id", "text"), "doc_id", "text")
    return unpack_chunks(packed, "doc_id")


@case(
    "t36_parse_label",
    sql_with(
        "SELECT subject, object, cluster AS label, 10 + cluster AS n_clusters, cluster % 2 = 0 AS is_partial FROM pairs_v",
        "pairs_v",
    ),
)
def _(t: Tables) -> DataFrame:
    label = F.concat(F.lit("__label__"), F.col("cluster").cast("string"))
    path = F.format_string(
        "models/emb_clusters_%d_partial%s_predicate.bin",
        F.col("cluster") + 10, F.when(F.col("cluster") % 2 == 0, "True").otherwise("False"),
    )
    return t.pairs().select(
        "subject", "object",
        text.parse_label(label).alias("label"),
        text.cluster_count_of_path(path).alias("n_clusters"),
        text.partial_flag_of_path(path).alias("is_partial"),
    )


@case(
    "t37_lemma_pos",
    spans_sql(
        "array_to_string(list_transform(toks[obj_start+1:obj_end], lambda t: t.lemma || '_' || t.pos), ' ') AS tagged, "
        "array_to_string(list_transform(toks[obj_start+1:obj_end], lambda t: t.lemma), ' ') AS lemmas"
    ),
)
def _(t: Tables) -> DataFrame:
    args = (F.col("tokens"), *span("obj"), F.col("object"))
    return t.spans().select(
        *KEY,
        joined(syntax.lemma_pos(*args, tag=True), " ").alias("tagged"),
        joined(syntax.lemma_pos(*args), " ").alias("lemmas"),
    )


@case(
    "t38_tokens_in_span",
    spans_sql(
        "array_to_string(list_transform(list_filter(toks[obj_start+1:obj_end], lambda t: contains(subject || ' ' || relation, t.word)), lambda t: t.word), ' ') AS words"
    ),
)
def _(t: Tables) -> DataFrame:
    phrase = F.concat_ws(" ", "subject", "relation")
    found = syntax.tokens_in_span(F.col("tokens"), *span("obj"), phrase)
    return t.spans().select(*KEY, joined(F.transform(found, lambda x: x["word"]), " ").alias("words"))


@case(
    "t39_normalize_types",
    spans_sql(
        "CASE raw WHEN 'PERSON_PERSON' THEN 'PERSON' WHEN 'ORGANIZATION_ORGANIZATION' THEN 'ORGANIZATION' "
        "WHEN 'ORGANIZATION_ORGANIZATION_ORGANIZATION' THEN 'ORGANIZATION' ELSE raw END AS type"
    ).replace("FROM spans_v", f"FROM (SELECT *, array_to_string({sql_tags('ner', 'subj')}, '_') AS raw FROM spans_v) y"),
)
def _(t: Tables) -> DataFrame:
    tags = F.transform(syntax.span_of(F.col("tokens"), *span("subj")), lambda x: x["ner"])
    return t.spans().select(*KEY, text.normalize_types(F.array_join(tags, "_")).alias("type"))


def sql_row(i: int, field: str, words: list[str], prefix: str) -> str:
    tags = sql_tags(field, prefix)
    return f"list_transform([{quoted(words)}], lambda v: CASE WHEN {tags}[{i}] = v THEN 1 ELSE 0 END)"


def sql_rows(prefix: str) -> str:
    parts = ", ".join(f"{sql_row(i, 'ner', NER_TYPES, prefix)}, {sql_row(i, 'pos', POS_TAGS, prefix)}" for i in (1, 2, 3))
    return f"array_to_string(flatten([{parts}]), ',')"


def sql_vec(prefix: str, i: int) -> str:
    return f"round(coalesce(list_sum(list_transform({prefix}{i}.vec, lambda x: CAST(x AS DOUBLE))), 0), 4) AS {prefix}_{i}"


def sql_vec_join(prefix: str, i: int) -> str:
    return (
        f"LEFT JOIN words_v {prefix}{i} ON {prefix}{i}.word = toks[{prefix}_start+{i}].lemma AND {prefix}_start + {i} <= {prefix}_end "
    )


_BOTH = [(p, i) for p in ("obj", "rel") for i in (1, 2, 3)]


@case(
    "t40_assemble_positional",
    sql_with(
        f"SELECT doc_id, sent, tpos, {sql_rows('obj')} AS object_rows, {sql_rows('rel')} AS relation_rows, "
        + f"{SQL_HOT_PREP} AS prep, "
        + ", ".join(sql_vec(p, i) for p, i in _BOTH)
        + ", 3 * (41 + 64 + 41) AS relation_size, rel_start - obj_start AS dist, round(obj_start / n_tokens, 4) AS place FROM spans_v "
        + "".join(sql_vec_join(p, i) for p, i in _BOTH),
        "spans_v", words_v=WORDS_SQL,
    ),
)
def _(t: Tables) -> DataFrame:
    """Rows of the object, also in the older form with distance and relative start, and of the relation, each from its own tokens."""
    words = t.stage("words", lambda: word_table(t))
    tokens = F.col("tokens")
    field = lambda name, p: F.transform(syntax.span_of(tokens, *span(p)), lambda x: x[name])
    phrases = (("obj", "object"), ("rel", "relation"))
    # One-row generators keep the steps that follow from computing their input again.
    once = lambda df, keep, *made: df.select(*keep, F.explode(F.array(F.struct(*made))).alias("_r")).select(*keep, "_r.*")
    rows = once(
        t.spans(), KEY, "relation",
        *[field(name, p).alias(f"{name}_{p}") for name in ("ner", "pos") for p in ("obj", "rel")],
        (F.col("rel_start") - F.col("obj_start")).alias("dist"),
        (F.col("obj_start") / F.size("tokens")).alias("place"),
        *[syntax.lemma_pos(tokens, *span(p), F.col(phrase)).alias(f"lemmas_{p}") for p, phrase in phrases],
    )
    for p, _phrase in phrases:
        carried = [x for x in rows.columns if x != f"lemmas_{p}"]
        rows = features.word_vector_rows(rows, carried, f"lemmas_{p}", words, 64).withColumnRenamed("w2v", f"w2v_{p}")
    # A generator would fold the relation once per preposition, a projection folds it once.
    both = once(
        rows.withColumn("prep", vectors.prep_multihot(F.col("relation"))), [*KEY, "w2v_obj", "w2v_rel", "dist", "place", "prep"],
        *[
            vectors.positional_onehot(F.col(f"{name}_{p}"), types).alias(f"{name}_{p}")
            for name, types in (("ner", NER_TYPES), ("pos", POS_TAGS)) for p in ("obj", "rel")
        ],
    )
    c = lambda name, p: F.col(f"{name}_{p}")
    built = once(
        both, KEY,
        vectors.positional_argument(c("ner", "obj"), c("pos", "obj")).alias("argument"),
        vectors.positional_relation(c("ner", "rel"), c("pos", "rel"), c("w2v", "rel"), F.col("prep")).alias("rel"),
        vectors.positional_with_distance(c("ner", "obj"), c("pos", "obj"), c("w2v", "obj"), F.col("dist"), F.col("place")).alias("obj"),
    )
    row = lambda p, i: F.get(p, F.lit(i - 1))
    total = lambda p, i: F.aggregate(F.slice(row(p, i), 42, 64).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    plain = lambda rows: joined(F.flatten(rows).cast("array<int>"))
    return built.select(
        *KEY,
        plain(F.col("argument")).alias("object_rows"),
        plain(F.transform("rel", lambda r: F.slice(r, 1, 41))).alias("relation_rows"),
        joined(F.slice(row("rel", 3), 106, 41).cast("array<int>")).alias("prep"),
        *[F.round(total(p, i), 4).alias(f"{p}_{i}") for p, i in _BOTH],
        F.size(F.flatten("rel")).alias("relation_size"),
        F.element_at(row("obj", 1), -2).cast("int").alias("dist"),
        F.round(F.element_at(row("obj", 3), -1).cast("double"), 4).alias("place"),
    )
