"""Licence scan: an Aho-Corasick automaton over a text's words finds notice phrases and identifier tags; behind a tag a
shunting-yard parser reads and evaluates a licence expression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common

BLOCK = 1 << 20

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of notices and the labels they add. Inside a longer phrase of these a shorter one does not count.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "bsd 2 clause license": "bsd",
    "bsd 3 clause license": "bsd",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "free and unencumbered software released into the public domain": "unlicense",
    "public domain": "public-domain",
    "cc0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "all rights reserved": "proprietary",
}
#: Tags that an expression follows: behind the first kind any identifier counts, behind the second only known ones.
TAGS = {"spdx license identifier": True, "license expression": True, "licensed under": False, "released under": False, "distributed under": False, "available under": False}
#: How much each family of licences forbids, from 0 (nothing) to 1 (all).
RESTRICTION = {
    "cc0": 0.0, "unlicense": 0.0, "public-domain": 0.0, "0bsd": 0.0, "wtfpl": 0.0,
    "mit": 0.1, "isc": 0.1, "bsd": 0.1, "zlib": 0.1, "bsl": 0.1, "apache": 0.15, "cc-by": 0.15, "artistic": 0.2,
    "mpl": 0.4, "epl": 0.4, "lgpl": 0.45, "cc-by-sa": 0.5,
    "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.85, "cc-by-nc": 0.85, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 0.95, "proprietary": 1.0,
}
#: Of an unknown identifier; and what an exception (with) takes off a share-alike licence.
UNKNOWN, EXCEPTION = 0.6, 0.2
SHARE_ALIKE = {"mpl", "epl", "lgpl", "gpl", "agpl", "cc-by-sa"}


def family(identifier: str) -> str:
    """Apache-2.0: apache; GPL-3.0-or-later: gpl; BSD-3-Clause: bsd. Unknown ones stand for themselves."""
    low = identifier.lower().rstrip("+")
    short = re.split(r"-v?\d|-only$|-or-later$", low, maxsplit=1)[0]
    return low if low in RESTRICTION else short if short in RESTRICTION else low


@dataclass(frozen=True)
class Value:
    """What an expression comes to: labels it names, what it forbids, its canonical text and how tightly that binds."""

    labels: frozenset[str]
    restriction: float
    text: str
    bind: int = 3


#: Operators by how tightly they bind.
_BIND = {"OR": 0, "AND": 1, "WITH": 2}


def _apply(op: str, a: Value, b: Value) -> Value:
    """or: the freer of two may be chosen; and: both hold; with: an exception (the right side's text) loosens."""
    wrap = lambda v: v.text if v.bind >= _BIND[op] else f"({v.text})"
    text = f"{wrap(a)} {op} {wrap(b)}"
    if op == "WITH":
        loose = max(0.0, a.restriction - EXCEPTION) if a.labels & SHARE_ALIKE else a.restriction
        return Value(a.labels, loose, text, 2)
    return Value(a.labels | b.labels, (min if op == "OR" else max)(a.restriction, b.restriction), text, _BIND[op])


_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9.+:\-]+)")
_LEAD = re.compile(rb"[ \t]*[:=]?[ \t]*[\"']?")


def parse(line: bytes, start: int = 0, any_identifier: bool = True) -> Value | None:
    """The value of the licence expression that begins at a byte, by two stacks; None where there is none. It ends at
    the first token that can't go on with it, at the latest with the line. A dangling operator counts for nothing, an
    open parenthesis closes at the end. with binds tighter than and, and tighter than or."""
    values: list[Value] = []
    operators: list[str] = []

    def reduce() -> None:
        op, b, a = operators.pop(), values.pop(), values.pop()
        values.append(_apply(op, a, b))

    at, operand_next = _LEAD.match(line, start).end(), True
    ended = False
    while not ended and (m := _TOKEN.match(line, at)):
        token = m[1].decode("ascii")
        if operand_next and token == "(":
            operators.append("(")
        elif operand_next:
            name = token.rstrip(".:")
            known = family(name)
            exception = bool(operators) and operators[-1] == "WITH"
            if not name or token == ")" or name.upper() in _BIND or not (any_identifier or exception or known in RESTRICTION):
                break
            values.append(Value(frozenset() if exception else frozenset([known]), 0.0 if exception else RESTRICTION.get(known, UNKNOWN), name))
            operand_next = False
            ended = name != token and not token.endswith("+")
        elif token == ")":
            if "(" not in operators:
                break
            while operators[-1] != "(":
                reduce()
            operators.pop()
        elif (op := token.upper()) in _BIND:
            if op == "WITH" and values[-1].bind < 2:  # only a licence takes an exception
                break
            while operators and operators[-1] != "(" and _BIND[operators[-1]] >= _BIND[op]:
                reduce()
            operators.append(op)
            operand_next = True
        else:
            break
        at = m.end()
    while operand_next and operators:  # what still waits for an operand
        operand_next = operators.pop() == "("
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            reduce()
    return values[-1] if values else None


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", TAGS)):
        for phrase, what in phrases.items():
            kinds.setdefault(phrase, []).append((kind, what))
    for phrase, what in kinds.items():
        out.add_word(f" {phrase} ", (len(phrase), phrase.count(" ") + 1, what))
    out.make_automaton()
    return out


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


class Words:
    """The texts of a block as words with one space before and behind each; a text begins with a space of its own, so
    two spaces part texts. `source` is the byte each place comes from, `owner` the text."""

    def __init__(self, col: pa.Array) -> None:
        self.data, self.offs = common.utf8(col)
        n = len(self.offs) - 1
        low = _SMALL[self.data]
        inside = np.zeros(len(low) + 2 * n, bool)
        text = np.repeat(np.arange(n), np.diff(self.offs))
        place = np.arange(len(low)) + 2 * text + 1
        inside[place] = _WORD[low]
        wide = np.full(len(inside), 32, np.uint8)
        wide[place] = np.where(_WORD[low], low, 32)
        source = np.full(len(inside), -1, np.int64)
        source[place] = np.arange(len(low))
        edge = self.offs[:-1] + 2 * np.arange(n)
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        keep[edge] = True
        at = np.nonzero(keep)[0]
        self.source = source[at]
        self.text = wide[at].tobytes().decode("latin-1")
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        starts = np.nonzero((inside & ~before)[at])[0]
        self.starts = starts
        first = np.searchsorted(at, edge)
        self.first_word = np.searchsorted(starts, np.append(first, len(at)))
        self.first = first

    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)


KIND = "struct<n_words: long, places: array<struct<label: string, word: long>>, found: array<struct<label: string, restriction: double>>, expressions: array<string>>"


def _scan_block(col: pa.Array) -> list[tuple]:
    w = Words(col)
    n = len(w.offs) - 1
    places: list[list] = [[] for _ in range(n)]
    spans: list[list] = [[] for _ in range(n)]
    found: list[list] = [[] for _ in range(n)]
    expressions: list[list] = [[] for _ in range(n)]
    for end, (length, words, kinds) in _automaton().iter(w.text):
        start = end - length  # of the first word: the phrase has a space before and behind
        k = int(np.searchsorted(w.first, start, "right")) - 1
        word = int(np.searchsorted(w.starts, start)) - int(w.first_word[k])
        for kind, what in kinds:
            if kind == "base":
                places[k].append({"label": what, "word": word})
            elif kind == "notice":
                spans[k].append((word, -(word + words), what))
            else:
                raw = w.data[w.offs[k] : w.offs[k + 1]]
                value = parse(_rest_of_line(raw, int(w.source[end - 1] + 1 - w.offs[k])), 0, what)
                if value:
                    expressions[k].append(value.text)
                    found[k] += [{"label": x, "restriction": value.restriction} for x in sorted(value.labels)]
    for k in range(n):
        far = -1
        for start, minus_end, label in sorted(spans[k]):
            if -minus_end > far:  # else inside an earlier, longer one
                far = -minus_end
                found[k].append({"label": label, "restriction": RESTRICTION[label]})
        places[k].sort(key=lambda x: (x["word"], x["label"]))
    return list(zip(w.n_words().tolist(), places, found, expressions))


def _rest_of_line(raw: np.ndarray, start: int) -> bytes:
    """Bytes up to the line's end, looked for in growing steps, so a long text is not copied for each tag."""
    step = 256
    while True:
        part = raw[start : start + step].tobytes()
        cut = part.find(b"\n")
        if cut >= 0 or start + step >= len(raw):
            return part[:cut] if cut >= 0 else part
        step *= 4


def scan(rows: DataFrame, text: str = "text", name: str = "scan") -> DataFrame:
    """rows with a struct column: n_words, places of the base phrases (label, word), what the method found (label and
    what it forbids) and the canonical expressions. Null text is empty. Rows stay where they are."""
    if name in rows.columns:
        raise ValueError(f"there is a column {name} already")
    @F.pandas_udf(KIND)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["t"])
            out = [x for block in common.blocks(iter([batch]), "t", BLOCK) for x in _scan_block(block.column(0))]
            yield pd.DataFrame(out, columns=["n_words", "places", "found", "expressions"])

    return rows.withColumn(name, run(F.col(text)))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, places and labels of every document of the table, with its labels by notices and expressions, and score: how
    freely its own notices let it be used, 1 less what the strictest of them forbids; 0 without any notice, as then
    nothing is allowed. Null and empty texts have no words; repeated rows get a row each; null ids stay."""
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scan(docs).drop("text")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, own = F.col("scan.places.label"), F.col("scan.found.label")
    forbids = F.array_max(F.concat(F.col("scan.found.restriction"), F.transform(base, lambda x: F.create_map(*[F.lit(y) for p in BASE.values() for y in (p, RESTRICTION[p])])[x])))
    return rows.select(
        "doc_id", "scan.n_words", F.size(base).cast("long").alias("n_base"), F.array_min("scan.places.word").alias("first_word"), F.array_max("scan.places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), F.coalesce(F.round(1 - forbids, 6), F.lit(0.0)).alias("score"),
        F.size(F.col("scan.expressions")).cast("long").alias("n_expressions"), F.array_join("scan.expressions", "; ").alias("expressions"),
    )
