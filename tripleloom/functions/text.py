"""Text scalars. Everything is a Catalyst expression; regular expressions use explicit classes."""

from __future__ import annotations

import unicodedata
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom import schemas

# Names of character references and what they stand for, from the standard library's HTML5 table.
NAMED_REFERENCES = {f"&{name}": text for name, text in html5.items() if name.endswith(";")}

# Comments, scripts, styles and the two marks used below.
HIDDEN_HTML = r"(?is)<!--.*?-->|<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>|[\x01\x02]"
BLOCK_TAG = (
    r"(?i)</?(?:p|address|article|aside|blockquote|body|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form"
    r"|h[1-6]|header|hr|html|li|main|menu|nav|ol|pre|search|section|table|ul)(?:[\s/][^>]*)?>"
)

SPACE = r"[ \t\n\r\f\x0B\u00A0]"


def strip(col: Column, space: str = SPACE) -> Column:
    return F.regexp_replace(col, f"^{space}+|{space}+$", "")


def clean_text(col: Column) -> Column:
    """Encyclopedia text without citation marks, parentheses and blank lines."""
    text = F.regexp_replace(strip(col), r"\n{2,}", "\n")
    for pattern in (r"\[[0-9]+\]", r"\u00A0", r"\\'[^s]", r"\([^\n]+\)"):
        text = F.regexp_replace(text, pattern, " ")
    text = strip(F.regexp_replace(text, r" {2,}", " "))
    has_line_break = F.contains(text, F.lit("\n"))
    return F.when(
        text.endswith(":") & has_line_break, F.regexp_replace(text, r"\n[^\n]*:$", "")
    ).otherwise(F.regexp_replace(text, r":$", ""))


def unescape_html(col: Column) -> Column:
    """All named and numeric character references; those of the ampersand last."""
    pairs = "\u0001".join(f"{name}\u0002{to}" for name, to in sorted(NAMED_REFERENCES.items()))
    named = F.str_to_map(F.lit(pairs), F.lit("\u0001"), F.lit("\u0002"))

    def code_point(ref: Column) -> Column:
        body = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+);", 1)
        as_hex = F.when(ref.rlike("^&#[xX]"), body).otherwise(
            F.hex(body.try_cast("bigint"))
        )
        return F.decode(F.unhex(F.lpad(as_hex, 8, "0")), "UTF-32")

    refs = F.array_distinct(
        F.regexp_extract_all(col, F.lit(r"(&(?:#[xX]?[0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});)"), 1)
    )
    decoded = F.transform(
        refs,
        lambda ref: F.struct(
            ref.alias("ref"),
            F.when(ref.startswith("&#"), code_point(ref)).otherwise(F.try_element_at(named, ref)).alias("to"),
        ),
    )
    # A decoded ampersand may stand before the name of another reference, which is then text.
    ordered = F.concat(
        F.filter(decoded, lambda d: d["to"] != "&"), F.filter(decoded, lambda d: d["to"] == "&")
    )
    text = F.aggregate(ordered, col, lambda acc, d: F.replace(acc, d["ref"], d["to"]))
    return F.when(F.contains(col, F.lit("&")), text).otherwise(col)


def html_paragraphs(html: Column) -> Column:
    """Cleaned text of all paragraphs of a page, one per line.

    A paragraph ends at its end tag, at the next block element or at the end of the page.
    """
    shown = F.regexp_replace(html, HIDDEN_HTML, "")
    marked = F.regexp_replace(shown, r"(?i)<p(?:\s[^>]*)?>", "\u0001\u0002")
    marked = F.regexp_replace(marked, BLOCK_TAG, "\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p.startswith("\u0002"))
    lines = F.transform(
        parts, lambda p: strip(unescape_html(F.regexp_replace(F.substr(p, F.lit(2)), r"<[^>]*>", "")))
    )
    return clean_text(F.array_join(lines, "\n"))


def html_title(html: Column) -> Column:
    """Heading of the page: the marked one, else the first first-level heading."""
    marked = F.regexp_extract(html, r'(?is)<[^>]*id="firstHeading"[^>]*>(.*?)</', 1)
    plain = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    raw = F.when(marked != "", marked).otherwise(plain)
    return unescape_html(F.regexp_replace(raw, r"<[^>]*>", ""))


def _fold_table() -> tuple[str, str]:
    """Latin letters with a canonical one-letter ASCII base, by rule from Unicode itself.

    Combining marks come last, beyond the replacements, and so are deleted.
    """
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = unicodedata.normalize("NFKD", char)
        base = "".join(c for c in base if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != char:
            source.append(char)
            target.append(base)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


# Letters without a canonical decomposition.
MULTI_FOLD = [
    ("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th"),
    ("ø", "o"), ("Ø", "O"), ("đ", "d"), ("Đ", "D"), ("ł", "l"), ("Ł", "L"), ("ð", "d"), ("ı", "i"),
    ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--"), ("\u00a0", " "),
]
FOLD_FROM, FOLD_TO = _fold_table()


def fold_ascii(col: Column) -> Column:
    """Latin letters to ASCII; other scripts stay as they are. Plain ASCII is passed through."""
    text = F.translate(col, FOLD_FROM, FOLD_TO)
    folded = reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), MULTI_FOLD, text
    )
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(folded)


def norm_key(col: Column) -> Column:
    """Join key of a surface form: folded, lower case, outer white space off. Most texts are plain ASCII without any, and are
    only lower-cased; two marks above the blank at the ends tell so without trimming.
    """
    marked = (col >= "!") & (F.substr(col, F.lit(-1), F.lit(1)) >= "!")
    plain = (F.octet_length(col) == F.length(col)) & (marked | (F.btrim(col, F.lit(" \t\n\r\f\x0B")) == col))
    return F.when(plain, F.lower(col)).otherwise(strip(F.lower(fold_ascii(col))))


def pair_key(left: Column, right: Column) -> Column:
    return F.concat_ws(" ::: ", left, right)


def tokenize_question(col: Column) -> Column:
    return F.regexp_extract_all(norm_key(col), F.lit("[0-9a-z']+"), F.lit(0))


def last_uri_segment(col: Column) -> Column:
    return F.substring_index(col, "/", -1)


def surface_underscore(col: Column) -> Column:
    return F.regexp_replace(strip(col), f"{SPACE}+", "_")


def sitelink(json: Column, entity: Column, lang: str | None = "en") -> Column:
    """Percent-decoded page URL of an entity, or the map of all of them for ``lang=None``."""
    links = F.try_element_at(F.from_json(json, schemas.SITELINKS)["entities"], entity)["sitelinks"]
    if lang is not None:
        url = F.try_element_at(links, F.lit(f"{lang}wiki"))["url"]
        return F.when(url != "", F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))))
    kept = F.map_filter(links, lambda _, link: F.coalesce(link["url"], F.lit("")) != "")
    return F.transform_values(
        kept, lambda _, link: F.try_url_decode(F.replace(link["url"], F.lit("+"), F.lit("%2B")))
    )


def halve_repetition(tokens: Column) -> Column:
    """``x y x y`` becomes ``x y``; anything else is unchanged."""
    half = F.floor(F.size(tokens) / 2).cast("int")
    first = F.slice(tokens, F.lit(1), half)
    rest = F.slice(tokens, half + 1, F.size(tokens))
    return F.when((F.size(tokens) > 0) & (first == rest), first).otherwise(tokens)


def tag_relation_by_object(relation: Column, is_date: Column, is_location: Column) -> Column:
    return F.concat(
        relation,
        F.when(is_date, " date").otherwise(""),
        F.when(is_location, " location").otherwise(""),
    )


def format_triple(subject: Column, relation: Column, obj: Column, prob: Column) -> Column:
    return F.format_string("(%s)-[%s]->(%s) <=> |%.4f|", subject, relation, obj, prob)


def parse_label(col: Column) -> Column:
    return F.regexp_extract(col, r"__label__(-?[0-9]+)", 1).try_cast("int")


def cluster_count_of_path(col: Column) -> Column:
    return F.regexp_extract(col, r"_clusters_([0-9]+)_", 1).try_cast("int")


def partial_flag_of_path(col: Column) -> Column:
    return F.regexp_extract(col, r"_partial(True|False)", 1).try_cast("boolean")


def normalize_types(col: Column) -> Column:
    """Whole-value replacement of doubled and tripled type names."""
    # The replacements of the export.
    return (
        F.when(col == "PERSON_PERSON", "PERSON")
        .when(
            col.isin("ORGANIZATION_ORGANIZATION", "ORGANIZATION_ORGANIZATION_ORGANIZATION"),
            "ORGANIZATION",
        )
        .otherwise(col)
    )
