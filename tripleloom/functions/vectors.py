"""Sparse and dense feature vectors as array expressions.

Vocabularies are small and fixed, so a vector is written out as one expression
per position. That stays inside generated code, which a lambda would leave.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.functions.text import fold_ascii
from tripleloom.functions.vocab import NER_TYPES, POS_TAGS, PREPOSITIONS
from tripleloom.operators.numbering import hash_int


def multi_hot(present: Column, vocabulary: list[str]) -> Column:
    return F.array(*[F.array_contains(present, v).cast("int") for v in vocabulary])


def pos_multihot(tags: Column) -> Column:
    return multi_hot(F.split(tags, "_"), POS_TAGS)


def ner_multihot(types: Column, max_len: int = 4) -> Column:
    return multi_hot(F.slice(F.split(types, "_"), 1, max_len), NER_TYPES)


def prep_multihot(words: Column) -> Column:
    return multi_hot(F.split(F.lower(fold_ascii(words)), " "), PREPOSITIONS)


def positional_onehot(tags: Column, vocabulary: list[str], n: int = 3) -> Column:
    """``n`` one-hot rows, zero rows where the sequence is shorter.

    The row of a word is looked up among constant rows: a comparison per place and word makes code too long to be compiled.
    A word that the vocabulary holds twice is hot in both places.
    """
    row = lambda hot: F.array(*[F.lit(int(v == hot)) for v in vocabulary])
    rows = F.create_map(*[x for v in dict.fromkeys(vocabulary) for x in (F.lit(v), row(v))])
    return F.array(*[F.coalesce(F.try_element_at(rows, F.get(tags, F.lit(i))), row(None)) for i in range(n)])


def argument_vector(pos: Column, ner: Column) -> Column:
    return F.concat(pos, ner).cast("array<float>")


def relation_vector(pos: Column, prep: Column, left: Column, embedding: Column) -> Column:
    return F.concat(
        F.concat(pos, prep, F.array(left)).cast("array<float>"), embedding.cast("array<float>")
    )


def hashed_vector(words: Column, dim: int) -> Column:
    """Counts of words in hashed places: the stand-in for a text without a given vector."""
    places = F.transform(words, lambda w: hash_int(w) % dim)
    # The places are bound once, as an element of their own: inside the counting lambda they would be hashed again for every place.
    counted = F.transform(
        F.array(places),
        lambda found: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.size(F.filter(found, lambda p: p == i)).cast("float"),
        ),
    )
    return F.get(counted, F.lit(0))


def single_vector(subject: Column, relation: Column, obj: Column) -> Column:
    return F.concat(subject, relation, obj)


def positional_argument(ner: Column, pos: Column) -> Column:
    """Rows of (entity type, tag) for the first tokens of an argument."""
    return F.zip_with(ner, pos, lambda a, b: F.concat(a, b).cast("array<float>"))


def positional_relation(ner: Column, pos: Column, words: Column, prep: Column) -> Column:
    """Rows of (entity type, tag, word vector, prepositions) for a relation."""
    head = F.zip_with(ner, pos, lambda a, b: F.concat(a, b).cast("array<float>"))
    tail = F.transform(words, lambda w: F.concat(w.cast("array<float>"), prep.cast("array<float>")))
    return F.zip_with(head, tail, lambda a, b: F.concat(a, b))


def positional_with_distance(ner, pos, words, dist: Column, rel_pos: Column) -> Column:
    """Older row form: the distance to the relation and the relative start close each row."""
    head = F.zip_with(ner, pos, lambda a, b: F.concat(a, b).cast("array<float>"))
    tail = F.transform(
        words,
        lambda w: F.concat(w.cast("array<float>"), F.array(dist.cast("float"), rel_pos.cast("float"))),
    )
    return F.zip_with(head, tail, lambda a, b: F.concat(a, b))
