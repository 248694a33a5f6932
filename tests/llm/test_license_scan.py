import math
import random
import re

from tripleloom.llm import license_scan as L


def brute(text, templates):
    """Names with a stretch of at most 2 c shingles that holds four fifths of a template's shingles."""
    words = re.findall(L.WORD, text.lower())
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    out = set()
    for name, t in templates:
        own = re.findall(L.WORD, t.lower())
        own = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        c = 1 << max(0, len(own) - 1).bit_length()
        if any(len(own & set(grams[s : s + 2 * c])) >= math.ceil(0.8 * len(own) - 1e-9) for s in range(len(grams))):
            out.add(name)
    return out


def test_bound():
    assert L.collision_bound() > 0.999


def test_against_brute_force():
    rng = random.Random(4)
    templates = L.usable([("a", "one two three four five"), ("b", " ".join(f"w{i}" for i in range(30))),
                          ("c", " ".join(f"v{i}" for i in range(9))), ("d", " ".join(f"u{i}" for i in range(100)))])
    scanner = L.Scanner(templates)
    texts = []
    for _ in range(200):
        words = [rng.choice("pqrst") for _ in range(rng.randint(0, 80))]
        own = re.findall(L.WORD, rng.choice(templates)[1])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = "x"
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + own + words[at:]))
    missed = extra = 0
    for text, found in zip(texts, scanner.scan(texts)):
        names, truth = {m[0] for m in found}, brute(text, templates)
        missed += len(truth - names)
        extra += len(names - truth)
    assert extra == 0 and missed <= 1


def test_query_against_brute_force(spark, sf):
    templates = L.default_templates()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {}
    for r in L.op7_licenses(spark, sf).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    for i, text in docs.items():
        truth, mine = brute(text, templates), found.get(i, set())
        # Overlapping matches of lower containment give way to the best one.
        assert mine <= truth and bool(mine) == bool(truth)


def test_long_templates_clashes_nulls_and_empty(spark):
    mit = dict((n, t) for n, t in L.default_templates() if n == "MIT" and len(t) > 99)["MIT"]
    rows = [(1, "intro " * 300 + mit.upper()), (2, None), (2, ""), (None, "Released under the MIT License."), (None, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("license", df.text)
    out = sorted((str(r.doc_id), r.license, r.containment) for r in L.scan_licenses(df).collect())
    assert out == [("1", "MIT", 1.0), ("None", "MIT", 1.0), ("None", "MIT", 1.0)]
    assert L.scan_licenses(df.limit(0)).count() == 0 and L.scan_licenses(df, []).count() == 0


def test_families_bodies_and_lines():
    templates = L.default_templates()
    assert len({n for n, _ in templates}) >= 30
    scanner = L.Scanner(templates)
    rng = random.Random(8)
    texts, wanted = [], []
    for name, body in templates:
        for edits in (0, 1):
            words = re.findall(L.WORD, body)
            if edits and len(words) > 40:
                words[rng.randrange(len(words))] = "other"
            texts.append(" ".join([*(f"a{i}" for i in range(rng.randint(0, 90))), *words, "z", "end"]))
            wanted.append(name)
    found = [{m[0] for m in ms} for ms in scanner.scan(texts)]
    for text, names, name in zip(texts, found, wanted):
        assert names <= brute(text, templates)
        # A text that holds another family's template whole may go to that longer one.
        assert names and (name in names or name in brute(text, templates))
    assert sum(n in f for n, f in zip(wanted, found)) >= 0.97 * len(wanted)
    lines = {
        "This project is licensed under the MIT License": "MIT", "# SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "Licensed under the GNU Affero General Public License v3.0 or later": "AGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999": "LGPL-2.1", "a licence unlike all of them, in plain words": None,
    }
    assert [[m[0] for m in ms] for ms in scanner.scan(list(lines))] == [[n] if n else [] for n in lines.values()]
