"""Features of one sentence, computed from its arrays inside the row: no explode, no shuffle.

Spans are ``[start, end)`` with 0-based bounds; heads, governors and paths are
1-based token indexes and 0 is the artificial root.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.functions.vocab import ENGLISH_STOP, PUNCTUATION


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body (or a lambda in
    it) refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span_of(tokens: Column, start: Column, end: Column) -> Column:
    return F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0)))


def gap_between(tokens: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Tokens strictly between two spans, whatever their order."""
    a_first = (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] <= b[1]))
    left_end = F.when(a_first, a[1]).otherwise(b[1])
    right_start = F.when(a_first, b[0]).otherwise(a[0])
    return span_of(tokens, left_end, right_start)


def governors(dependencies: Column) -> Column:
    """Governor of every token, in token order."""
    places = F.arrays_zip(dependencies["dependent"].alias("dependent"), dependencies["governor"].alias("governor"))
    return F.sort_array(places)["governor"]


def phrase_head(gov: Column, start: Column, end: Column) -> Column:
    """First token of the span governed from outside it, else the last one. Most spans are one token, or their first one is it."""
    is_outside = lambda i: (F.get(gov, i - 1) < start + 1) | (F.get(gov, i - 1) > end)
    outside = F.filter(F.sequence(start + 1, end), is_outside)
    return (
        F.when(start + 1 == end, end)
        .when((start + 1 < end) & is_outside(start + 1), start + 1)
        .otherwise(F.coalesce(F.get(outside, F.lit(0)), end))
    )


def _is_word_tag(tag: Column) -> Column:
    return ~F.contains(F.lit(PUNCTUATION), tag)


def pos_of_span(tokens: Column, start: Column, end: Column) -> Column:
    tags = F.transform(span_of(tokens, start, end), lambda t: t["pos"])
    return F.array_join(F.filter(tags, _is_word_tag), "_")


def pos_between(tokens: Column, a, b) -> Column:
    tags = F.transform(gap_between(tokens, a, b), lambda t: t["pos"])
    return F.array_join(F.filter(tags, _is_word_tag), "_")


def _strip_punctuation(word: Column) -> Column:
    """One mark after the other is stripped, in their order; most words have none at their ends and are passed through."""
    stripped = reduce(lambda w, c: F.btrim(w, F.lit(c)), PUNCTUATION, word)
    return F.when(F.btrim(word, F.lit(PUNCTUATION)) == word, word).otherwise(stripped)


def bow_between(tokens: Column, a, b, stop: list[str] | None = None) -> Column:
    """Lower-case words between two spans without digits (and without stop words)."""
    words = F.transform(
        gap_between(tokens, a, b), lambda t: F.lower(_strip_punctuation(t["originalText"]))
    )
    keep = F.filter(words, lambda w: (w != "") & ~w.rlike("[0-9]"))
    if stop is not None:
        keep = F.filter(keep, lambda w: ~w.isin(*stop))
    return F.array_join(keep, " ")


FEW = 8


def steps(rounds: Column, begin: Column, step: Callable[[Column, Column], Column], done: Callable[[Column], Column]) -> Column:
    """The state after one step per element of ``rounds``; a state that is done after a few steps is not carried through the rest."""
    some = F.aggregate(F.slice(rounds, F.lit(1), F.lit(FEW)), begin, step)
    rest = F.slice(rounds, F.lit(FEW + 1), F.greatest(F.size(rounds) - FEW, F.lit(0)))
    return bind(some, lambda state: F.when(done(state), state).otherwise(F.aggregate(rest, state, step)))


def root_path(gov: Column, start: Column) -> Column:
    """Token indexes from a token up to its topmost governor."""
    begin = lambda first: F.struct(
        F.when(first > 0, F.array(first)).otherwise(F.array().cast("array<int>")).alias("path"),
        F.coalesce(F.get(gov, first - 1), F.lit(0)).alias("up"),
    )
    at_top = lambda acc: acc["up"] == 0
    climb = lambda acc, _: F.when(at_top(acc), acc).otherwise(
        F.struct(
            F.array_append(acc["path"], acc["up"]).alias("path"),
            F.coalesce(F.get(gov, acc["up"] - 1), F.lit(0)).alias("up"),
        )
    )
    return bind(start, lambda first: steps(gov, begin(first), climb, at_top)["path"])


def join_root_paths(left: Column, right: Column) -> Column:
    """Path between two tokens from their two root paths; empty when they never meet."""

    def cut(pair: Column) -> Column:
        up_to = F.array_position(pair["l"], pair["meet"]).cast("int")
        down_to = (F.array_position(pair["r"], pair["meet"]) - 1).cast("int")
        return F.when(pair["meet"].isNull(), F.array().cast("array<int>")).otherwise(
            F.concat(
                F.slice(pair["l"], F.lit(1), up_to),
                F.reverse(F.slice(pair["r"], F.lit(1), down_to)),
            )
        )

    def meet(pair: Column) -> Column:
        shared = F.filter(pair["l"], lambda x: F.array_contains(pair["r"], x))
        found = F.struct(
            pair["l"].alias("l"), pair["r"].alias("r"), F.get(shared, F.lit(0)).alias("meet")
        )
        return bind(found, cut)

    return bind(F.struct(left.alias("l"), right.alias("r")), meet)


def dep_path(gov: Column, start: Column, end: Column) -> Column:
    """Shortest path in the dependency tree between two tokens, both included."""
    return join_root_paths(root_path(gov, start), root_path(gov, end))


ARCS = "array<struct<u:int,v:int>>"


def dep_path_between_sets(edges: Column, sources: Column, targets: Column) -> Column:
    """Shortest path between two token sets in a graph with several governors.

    ``edges`` is ``array<struct<governor, dependent>>`` and undirected; tokens count from 1. The search goes level by level from
    the targets until it meets a source, as an expression of the row: it visits the edges once per level, and keeps of every
    level the few that lead to the next one, on which the path goes back. Of several shortest paths the smallest is taken. Without a path, and for null sets, the result is empty.
    """
    none = F.array().cast("array<int>")
    linked = F.filter(F.coalesce(edges, F.array().cast("array<struct<governor:int,dependent:int>>")), lambda e: (e["governor"] > 0) & (e["dependent"] > 0))
    arcs = lambda e: F.concat(*[F.arrays_zip(e[u], e[v]).cast(ARCS) for u, v in (("governor", "dependent"), ("dependent", "governor"))])
    given = F.struct(
        bind(linked, arcs).alias("arcs"), F.coalesce(sources.cast("array<int>"), none).alias("src"),
        F.coalesce(targets.cast("array<int>"), none).alias("dst"),
    )
    return bind(given, _level_search)


def _level_search(row: Column) -> Column:
    arcs, src, dst = row["arcs"], row["src"], row["dst"]
    begin = F.struct(
        F.array_distinct(F.filter(dst, lambda x: x > 0)).alias("front"), F.array_distinct(F.filter(dst, lambda x: x > 0)).alias("seen"),
        F.array().cast(f"array<{ARCS}>").alias("levels"), F.lit(False).alias("done"),
    )
    is_done = lambda state: state["done"]

    def step(state: Column, _: Column) -> Column:
        leaving = F.filter(arcs, lambda e: F.array_contains(state["front"], e["u"]) & ~F.array_contains(state["seen"], e["v"]))

        def moved(found: Column) -> Column:
            front = F.array_distinct(found["v"])
            return F.struct(
                front.alias("front"), F.concat(state["seen"], front).alias("seen"), F.array_append(state["levels"], found).alias("levels"),
                ((F.size(found) == 0) | F.arrays_overlap(front, src)).alias("done"),
            )

        return F.when(is_done(state), state).otherwise(bind(leaving, moved))

    def back(state: Column) -> Column:
        start = F.array_min(F.array_intersect(state["front"], src))
        nearer = lambda path, level: F.filter(level, lambda e: e["v"] == F.element_at(path, -1))["u"]
        longer = lambda path, level: F.array_append(path, F.array_min(nearer(path, level)))
        return F.when(start.isNotNull(), F.aggregate(F.reverse(state["levels"]), F.array(start), longer))

    # Every level but the last reaches a new token, an end of some arc.
    found = bind(steps(F.concat(arcs, F.array(F.lit(None).cast("struct<u:int,v:int>"))), begin, step, is_done), back)
    both = F.array_min(F.array_intersect(src, dst))
    return F.when(both.isNotNull(), F.array(both)).otherwise(F.coalesce(found, F.array().cast("array<int>")))


def inner_path(path: Column) -> Column:
    return F.slice(path, F.lit(2), F.greatest(F.size(path) - 2, F.lit(0)))


def words_on_path(tokens: Column, path: Column) -> Column:
    return F.array_join(
        F.transform(inner_path(path), lambda i: F.get(tokens, i - 1)["word"]), " "
    )


def trigger(tokens: Column, path: Column, stop: list[str] = ENGLISH_STOP) -> Column:
    lemmas = F.transform(inner_path(path), lambda i: F.get(tokens, i - 1)["lemma"])
    return F.array_join(F.filter(lemmas, lambda w: ~w.isin(*stop)), "|")


def lemmas_on_path(tokens: Column, path: Column) -> Column:
    """Lower-case lemmas of the path without its right end, in sentence order."""
    nodes = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
    ordered = F.sort_array(F.array_distinct(nodes))
    return F.array_join(F.transform(ordered, lambda i: F.lower(F.get(tokens, i - 1)["lemma"])), " ")


def entity_type(tokens: Column, start: Column, end: Column) -> Column:
    """Entity tags of a span joined by ``_`` with repeats collapsed, durations untyped."""
    tags = F.array_join(F.transform(span_of(tokens, start, end), lambda t: t["ner"]), "_")
    return collapse_types(tags)


def collapse_types(tags: Column) -> Column:
    # The replacements, in this order.
    for pattern, value in (
        ("(PERSON_)+PERSON", "PERSON"),
        ("(ORGANIZATION_)+ORGANIZATION", "ORGANIZATION"),
        ("DURATION", "O"),
        ("(O_)+O", "O"),
    ):
        tags = F.regexp_replace(tags, pattern, value)
    return tags


def pair_type(a: Column, b: Column) -> Column:
    return F.concat_ws("_", a, b)


def sentence_text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["word"]), " ")


def tokens_in_span(tokens: Column, start: Column, end: Column, phrase: Column) -> Column:
    """Tokens of a span that occur (as text) in the phrase."""
    return F.filter(
        span_of(tokens, start, end), lambda t: F.contains(phrase, t["originalText"])
    )


def lemma_pos(tokens: Column, start: Column, end: Column, phrase: Column, tag: bool = False) -> Column:
    """Lower-case lemmas of a phrase, with ``_tag`` appended on request."""
    kept = tokens_in_span(tokens, start, end, phrase)
    if tag:
        return F.transform(kept, lambda t: F.concat_ws("_", F.lower(t["lemma"]), t["pos"]))
    return F.transform(kept, lambda t: F.lower(t["lemma"]))
