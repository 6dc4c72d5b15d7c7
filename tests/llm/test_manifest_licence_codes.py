"""Merkle manifests, licence scans and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import common, licence, merkle, vectorcodes

DIR = "/root/testdata/sf0.001"


def fixture(spark, tmp_path, table, df):
    df.coalesce(2).write.parquet(str(tmp_path / f"{table}.parquet"))
    return str(tmp_path)


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Levels of one tree, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + 8])) for i in range(0, len(low), 8)])
    return levels


def brute_manifest(rows):
    first = lambda x: (x is not None, x)
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((first(r["doc_id"]), leaf_of(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: climb([h for _, h, _ in sorted(groups[g], key=lambda x: x[:2])]) for g in langs}
    upper = climb([trees[g][-1][0] for g in langs]) if langs else []
    out = []
    for u, g in enumerate(langs):
        for i, (_, h, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            acc, proof = leaf_of(r["doc_id"], r["source"], r["lang"], r["n_chars"], text), ""
            for levels, at in ((trees[g], i), (upper, u)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    proof += "".join(run[: at % 8] + run[at % 8 + 1 :])
                    acc = sha("".join(run[: at % 8]) + acc + "".join(run[at % 8 + 1 :]))
                    at //= 8
            out.append((r["doc_id"], h, trees[g][-1][0], upper[-1][0], sha(proof), acc, acc == upper[-1][0]))
    return out


def key(row):
    return tuple(str(x) for x in row)


def manifest_rows(spark, folder):
    return sorted((tuple(r) for r in merkle.op11_merkle(spark, folder).collect()), key=key)


def test_manifest_of_the_given_table(spark):
    rows = common.load(spark, DIR, "documents").collect()
    got = manifest_rows(spark, DIR)
    assert got == sorted(brute_manifest(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeated ids, equal rows, more languages than a run has, a language of one row, a clashing column."""
    rng = random.Random(4)
    langs = [None, "", "en", "é", "zh", *[f"l{i}" for i in range(9)]]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "Ab", "X" * 3000, "Éa"]), rng.choice(langs[:5]), rng.choice([None, "web"]), rng.choice([None, 3]), 1) for _ in range(300)]
    rows += [(7, "Same", "en", "web", 4, 1)] * 70 + [(i, "One", lang, "web", 3, 1) for i, lang in enumerate(langs[5:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest int")
    assert manifest_rows(spark, fixture(spark, tmp_path, "documents", df)) == sorted(brute_manifest(df.collect()), key=key)


def test_manifest_of_few_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n in (0, 1, 8, 9, 65):
        df = spark.createDataFrame([(i, f"Text {i}", "en", "web", 6) for i in range(n)], schema)
        assert manifest_rows(spark, fixture(spark, tmp_path / str(n), "documents", df)) == sorted(brute_manifest(df.collect()), key=key)


# --- Licences


def brute_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_places(text):
    w = brute_words(text)
    return sorted((i, label) for phrase, label in licence.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())


def check_licences(spark, folder, rows):
    got = sorted((tuple(r) for r in licence.op12_licences(spark, folder).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=key)
    want = []
    for doc_id, text in rows:
        p = brute_places(text)
        want.append((doc_id, len(brute_words(text)), len(p), p[0][0] if p else None, p[-1][0] if p else None, ",".join(sorted({x for _, x in p}))))
    assert got == sorted(want, key=key)


def test_licences_of_the_given_table(spark):
    check_licences(spark, DIR, [(r["doc_id"], r["text"]) for r in common.load(spark, DIR, "documents").collect()])


def test_licences_of_odd_texts(spark, tmp_path):
    rng = random.Random(5)
    parts = ["MIT", "license", "mit License", "apache", "general public", "licence", "é", "\n", "--", "_", " ", "中", "GNU", "x" * 50, "\x7f", "\x00", "ſ"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(400)]
    rows += [(None, "mit license"), (1, None), (1, None), (2, ""), (3, "mit license " * 50_000), (4, "mit"), (5, "license")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, scan int")
    check_licences(spark, fixture(spark, tmp_path, "documents", df), rows)
    empty = fixture(spark, tmp_path / "none", "documents", df.limit(0))
    assert licence.op12_licences(spark, empty).count() == 0


def test_expressions():
    of = lambda s, known=True: (lambda v: v and (sorted(v.labels), round(v.restriction, 3), v.text))(licence.parse(s.encode(), 0, known))
    assert of("MIT") == (["mit"], 0.1, "MIT")
    assert of(": MIT OR Apache-2.0 and GPL-3.0-only") == (["apache", "gpl", "mit"], 0.1, "MIT OR Apache-2.0 AND GPL-3.0-only")
    assert of("(MIT or Apache-2.0) AND GPL-3.0-only") == (["apache", "gpl", "mit"], 0.7, "(MIT OR Apache-2.0) AND GPL-3.0-only")
    assert of("GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT") == (["gpl", "mit"], 0.5, "GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT")
    assert of("MIT AND") == of("MIT") == of("(MIT") == of("MIT)") == of("MIT and or BSD-3-Clause")
    assert of("MIT license applies") == of("MIT")
    assert of("") is None and of("AND MIT") is None and of("the Apache License", False) is None
    assert of("Foo-1.0") == (["foo-1.0"], 0.6, "Foo-1.0") and of("Foo-1.0", False) is None
    assert of("LGPL-2.1+ or MPL-2.0. More")[0] == ["lgpl", "mpl"]
    assert of("(" * 5000 + "MIT" + ")" * 5000) == of("MIT")


names = st.sampled_from(["MIT", "GPL-2.0-only", "Apache-2.0", "MPL-2.0", "LGPL-2.1-only"])
trees = st.recursive(names, lambda x: st.tuples(x, st.sampled_from(["AND", "OR"]), x), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(trees)
def test_expressions_of_any_tree(tree):
    """Every node in parentheses, against a recursive evaluation; the canonical text reads back as the same."""

    def write(t):
        return t if isinstance(t, str) else f"({write(t[0])} {t[1]} {write(t[2])})"

    def worth(t):
        return licence.RESTRICTION[licence.family(t)] if isinstance(t, str) else (max if t[1] == "AND" else min)(worth(t[0]), worth(t[2]))

    value = licence.parse(write(tree).encode())
    assert value.restriction == worth(tree)
    again = licence.parse(value.text.encode())
    assert (again.labels, again.restriction, again.text) == (value.labels, value.restriction, value.text)


def test_labels_of_the_method(spark, tmp_path):
    texts = {
        1: "// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\ncode", 2: "GNU Lesser General Public License", 3: "Licensed under CC BY-NC 4.0.", 4: "plain text", 5: "Released under MIT.\nspdx-license-identifier: Apache-2.0 WITH LLVM-exception",
        6: "All rights reserved. Licensed under the Apache License, Version 2.0.", 7: "x " * 3000 + "spdx license identifier = \"0BSD\"",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"], r["expressions"]) for r in licence.op12_licences(spark, fixture(spark, tmp_path, "documents", df)).collect()}
    assert got == {
        1: ("gpl,mit", 0.9, "MIT OR GPL-2.0-only"), 2: ("gpl,lgpl", 0.3, ""), 3: ("cc-by-nc", 0.15, ""), 4: ("", 0.0, ""), 5: ("apache,mit", 0.85, "MIT; Apache-2.0 WITH LLVM-exception"), 6: ("apache,proprietary", 0.0, ""), 7: ("0bsd", 1.0, "0BSD"),
    }


# --- Vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept.sort(key=lambda x: (x[0] is None, x[0], x[1]))
    vectors = [v + [0] * (width - len(v)) for _, v, _ in kept]
    each = width // parts
    books = [[v[p * each : (p + 1) * each] for v in vectors[:entries]] for p in range(parts)]

    def assign(p):
        out = []
        for v in vectors:
            x = v[p * each : (p + 1) * each]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])))
        return out

    for _ in range(rounds):
        for p in range(parts):
            best = assign(p)
            for k in range(len(books[p])):
                mine = [v[p * each : (p + 1) * each] for v, (_, b) in zip(vectors, best) if b == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [assign(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{final[p][n][1]:02x}" for p in range(parts)), sum(final[p][n][0] for p in range(parts)), label) for n, (i, _, label) in enumerate(kept)]
    return [(i, code, error, sum(e for _, _, e, x in out if x == label), digest) for i, code, error, label in out]


def codes(spark, folder):
    return sorted((tuple(r) for r in vectorcodes.op13_vector_codes(spark, folder).collect()), key=key)


def test_codes_of_the_given_table(spark):
    rows = [tuple(r) for r in common.load(spark, DIR, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert codes(spark, DIR) == sorted(brute_codes(rows), key=key)


def test_codes_of_odd_vectors(spark, tmp_path):
    """Nulls, NaN, infinity, repeated ids and vectors, hot vectors, null labels, lengths that differ, a clashing column."""
    rng = random.Random(6)
    f32 = lambda x: float(np.float32(x))
    some = [[f32(rng.gauss(0, 1)) for _ in range(35)] for _ in range(150)]
    rows = [(i, v, rng.choice([None, 0, 1])) for i, v in enumerate(some)] + [(1000 + i, some[3], None) for i in range(120)]
    rows += [(None, some[0], 2), (5, some[9], 2), (5, some[9], 2), (-1, None, 2), (-2, [None] * 35, 2), (-3, [math.nan] * 35, 1), (-4, [math.inf] * 35, 1), (-5, [], 7), (-6, some[1][:20], 7)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, part string")
    assert codes(spark, fixture(spark, tmp_path, "embeddings", df)) == sorted(brute_codes(rows), key=key)
    none = spark.createDataFrame([(1, None, 1, "x")], df.schema)
    assert codes(spark, fixture(spark, tmp_path / "none", "embeddings", none)) == []
    assert codes(spark, fixture(spark, tmp_path / "zero", "embeddings", df.limit(0))) == []
    few = spark.createDataFrame([(3, [], 1, "x"), (2, [], None, "x")], df.schema)
    assert codes(spark, fixture(spark, tmp_path / "few", "embeddings", few)) == sorted(brute_codes([(3, [], 1), (2, [], None)]), key=key)


def test_even_join(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("k"))
    told = rows.groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("most"))
    got = vectorcodes.joined_evenly(rows, told, ["k"], "w", 5000, "id", ["most"])
    assert got.count() == 5000 and got.where("most <> if(k = 1, 2499, k)  or most is null").count() == 0
