"""Operators with one right answer, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import bpe, common, linededup, mixing, ngramjoin, ogg, sharding, sketch
from palimpsest.llm.components import components

DIR = "/root/testdata/sf0.001"


def documents(spark):
    return {r["doc_id"]: r["text"] for r in common.load(spark, DIR, "documents").collect()}


# --- BPE


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_library(spark, reference):
    texts = documents(spark)
    for r in bpe.op9_bpe(spark, DIR).collect():
        ids = reference.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_texts(spark, reference):
    rng = random.Random(1)
    parts = [*"ab'sS t\n\r\t ²½é中🙂<|>  \x1c_-", "<|endoftext|>", "'ll", "  ", "aɐ"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(50)))) for i in range(400)] + [(400, None), (401, ""), (None, "x" * 20_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    v = bpe.default_vocabulary()
    for (_, text), r in zip(rows, bpe.decode(bpe.encode(df, v), v).collect()):
        ids = reference.encode(text or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == (text or "")
    assert bpe.encode(df.limit(0), v).count() == 0


def test_merges_both_ways(reference):
    rng = random.Random(9)
    merges = bpe.Merges(bpe.default_vocabulary())
    for _ in range(3000):
        word = "".join(rng.choice("aaeinrst onll thé中") for _ in range(rng.randrange(1, 60))).replace(" ", "")
        if word:
            start = [merges.start[b] for b in word.encode()]
            assert merges._short(list(start)) == merges._long(list(start))
    assert merges("tokenization") == reference.encode("tokenization", add_special_tokens=False).ids


def test_other_ways_to_split_raise(spark):
    import json

    spec = json.loads(bpe.default_vocabulary())
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError):
            bpe.encode(spark.createDataFrame([("a",)], "text string"), json.dumps(spec | change))


# --- Ogg


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200_000), st.integers(1, 4), st.sampled_from([1, 255, 510, 576, 70_000]))
def test_ogg_round_trip(payload, streams, packet):
    found, good, bad = ogg.demux(ogg.mux(payload, streams, packet))
    assert ogg.samples(found) == payload and not bad and good and not any(s.lost for s in found) and all(s.ended for s in found)


def test_ogg_checksum_bit_by_bit():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        return crc

    assert all(ogg.checksum(x) == slow(x) for x in (b"", b"OggS", bytes(range(256))))


def test_ogg_damage_and_times():
    data = bytearray(ogg.mux(bytes(range(256)) * 900, 2))
    found, good, _ = ogg.demux(bytes(data))
    times = ogg.timestamps(found[0])
    assert times[0] == (0.0, 576 / 8000) and times[-1][1] == sum(map(len, found[0].packets[1:])) / 8000
    data[len(data) // 2] ^= 1
    hurt, fewer, bad = ogg.demux(bytes(data))
    assert fewer == good - 1 and bad == 1 and sum(s.lost for s in hurt) == 1
    whole = {p for s in found for p in s.packets}
    assert all(p in whole for s in hurt for p in s.packets)
    assert ogg.demux(b"") == ([], 0, 0) and ogg.demux(b"OggS")[2] == 1


def test_ogg_query(spark):
    texts = documents(spark)
    for r in ogg.op2_ogg(spark, DIR).collect():
        want = ogg.pad(texts[r["doc_id"]])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))


# --- sharding


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_feistel_is_a_permutation(n, key):
    f = sharding.Feistel(n, key)
    p = f.place(np.arange(n))
    assert sorted(p.tolist()) == list(range(n)) and f.row(p).tolist() == list(range(n))


def test_shards(spark):
    rows = [(k if k % 7 else None, None if k % 5 == 0 else "x" * k) for k in range(100)] + [(3, "same"), (3, "same")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(r["size"] >= 1 for r in got) and len(got) == 102
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    again = sharding.shard(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


# --- sketches


def test_edited_texts_and_sketches(spark):
    rows = [(k * k % 97, "w%d " % (k % 13) * (k % 40)) for k in range(60)] + [(500, None), (501, ""), (502, "é" * 10)]
    rows = list({k: t for k, t in rows}.items())
    got = {r["doc_id"]: r for r in sketch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(((k, t or "") for k, t in rows), reverse=True)
    for i, (k, t) in enumerate(order):
        nxt, cut = order[(i + 1) % len(order)][1], len(t) // 3
        assert got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert got[k]["n_chars"] == len(t) and 0 <= got[k]["near_next"] <= 1
        if t == nxt:
            assert got[k]["near_next"] == 1.0
    assert len({got[k]["fingerprint"] for k, t in order if t == ""}) == 1
    assert sketch.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sketch.fingerprints(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x")], "doc_id long, text string")).count() == 3


def test_sketch_estimates_containment(spark):
    words = [f"w{k}" for k in range(4000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:400]))], "a string, b string")
    df = sketch.with_sketch(sketch.with_sketch(df, "a", "sa"), "b", "sb")
    a, b = df.select("sa", "sb").first()
    assert set(b) <= set(a) and abs(len(a) / 3996 - 0.25) < 0.03


# --- line dedup


def slow_chunks(text):
    """(place, bytes, counts) of a text's chunks, cut line by line by the rule as the docstring tells it."""
    lines = text.encode().split(b"\n")
    of = lambda b: int(common.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    words = [len(re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in lines]
    h = [of(x) for x in lines]
    least = (1 << 64) - 1
    rolled = [h[0]] + [int(common.mix(np.array([(h[k] * 31 + h[k - 1]) & least], np.uint64))[0]) for k in range(1, len(h))]
    out, start = [], 0
    for k in range(len(lines)):
        ends = k == len(lines) - 1 or words[k] >= 50 or words[k + 1] >= 50
        if not ends and k > 0:
            ends = rolled[k] < rolled[k - 1] and rolled[k] <= rolled[k + 1]
        if ends:
            total = sum(words[start : k + 1])
            out.append((len(out), b"\n".join(lines[start : k + 1]), (k + 1 - start >= 2 and total > 0) or total >= 50))
            start = k + 1
    return out


def test_cuts_line_by_line():
    rng = random.Random(8)
    for _ in range(300):
        text = "\n".join(" ".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 2, 5, 49, 50, 70]))) for _ in range(rng.randrange(1, 25)))
        c = linededup.Chunks(pa.array([text, "other\nlines"]))
        raw = c.data.tobytes()
        assert [(int(s), raw[a:b], bool(ok)) for s, a, b, ok, o in zip(c.seq, c.start, c.end, c.counting(), c.owner) if o == 0] == slow_chunks(text)


def brute_lines(rows):
    first, out = {}, set()
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for s, chunk, counts in slow_chunks(t):
            if counts:
                first.setdefault(chunk, (i, s))
    for i, t in rows:
        if t is None:
            out.add((i, None, 0))
            continue
        chunks = slow_chunks(t)
        kept = [chunk for s, chunk, counts in chunks if not counts or first[chunk] == (i, s)]
        n = len(chunks) - len(kept)
        out.add((i, b"\n".join(kept).decode() if n else t, n))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 3, 8, 60]))) for _ in range(40)]
    rows = []
    for i in range(150):
        mine = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(40)
            mine += lines[a : a + rng.randrange(1, 6)] if rng.random() < 0.5 else [f"u{i} {rng.randrange(99)}"]
        rows.append((i, "\n".join(mine)))
    rows += [(900, None), (901, ""), (902, "\n\n\n"), (903, "é" * 10 + "\n" + "x y " * 100), (904, "é" * 10 + "\n" + "x y " * 100)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, seqs string")
    got = {(r["doc_id"], r["text"], r["removed_chunks"]) for r in linededup.dedup(df).collect()}
    assert got == brute_lines(rows)
    assert linededup.dedup(df.limit(0)).count() == 0


def test_long_passage_is_found_wherever_it_stands(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"own {k}\n{passage}\nend {k}") for k in range(5)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"own {k}\nend {k}" for k in range(1, 5))


def test_passage_of_lines_is_found_between_any_neighbours(spark):
    """Passages of 2 to 6 lines of under 50 words each, 60 words or more in all; every line of the later ones goes."""
    rows, want = [], {}
    for m in range(2, 7):
        for p in range(8):
            size = -(-60 // m) if m > 2 else 40
            passage = [" ".join(f"w{m}x{p}x{k}x{j}" for j in range(size)) for k in range(m)]
            for k in range(3):
                i = len(rows)
                own = [f"own {i} {j}" for j in range(6)]
                rows.append((i, "\n".join([*own[:3], *passage, *own[3:]])))
                want[i] = rows[-1][1] if k == 0 else "\n".join(own)
    # A line of over 50 words in the middle does not part the rest of a passage.
    passage = [" ".join(f"{side}{j}" for j in range(n)) for side, n in (("left", 30), ("middle", 60), ("right", 30))]
    for k in range(2):
        i = len(rows)
        rows.append((i, "\n".join([f"own {i}", *passage, f"end {i}"])))
        want[i] = rows[-1][1] if k == 0 else f"own {i}\nend {i}"
    same = " ".join(f"r{j}" for j in range(30))
    rows.append((len(rows), "\n".join([same] * 4)))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i] for i in want} == want
    assert got[len(want)].startswith(same)


# --- n-gram join


def brute_links(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {(i, len(s), least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize("points, one_task", [(4096, 500_000), (3, 0)])
def test_ngram_join(spark, monkeypatch, points, one_task):
    """In one subtree, and in many small ones that are joined in pairs."""
    monkeypatch.setattr(ngramjoin, "POINTS", points)
    monkeypatch.setattr(ngramjoin, "components", lambda edges: components(edges, one_task=one_task))
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 40, 80]))] for _ in range(40)]
    rows = []
    for i in range(250):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w) if rng.random() < 0.9 else " \n".join(w).upper()))
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "a"), (604, "A"), (605, "x " * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, sid string")
    assert {tuple(r) for r in ngramjoin.join(df).collect()} == brute_links(rows)


def test_ngram_join_of_nothing(spark):
    assert ngramjoin.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(7, "a b c d e f")] * 3 + [(None, "a b c d e f")], "doc_id long, text string")
    assert [r["component_id"] for r in ngramjoin.join(same).collect()] == [7] * 4


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_regular_words_are_not_taken_for_one(spark):
    """Polynomial hashes modulo 2**64 are equal for these two words; nothing links them."""
    word = thue_morse(1024)
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, " ".join([word] * 5)), (4, " ".join([word.translate(str.maketrans("ab", "ba"))] * 5))]
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_large_group_of_near_copies(spark):
    """An original and copies that mostly are too far from each other, so only the original joins them."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for k in rng.sample(range(len(w)), 0 if i == 150 else rng.choice([1, 2, 2, 3, 4])):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([f"p{i}x{k}" for k in range(30)] + base[:40])) for i in range(50)]
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in got} == brute_links(rows)


@pytest.mark.parametrize("more", [8, 1])
def test_only_sets_without_partner_stay_out(spark, monkeypatch, more):
    monkeypatch.setattr(ngramjoin, "MORE", more)
    rows = [(r["doc_id"], r["text"]) for r in common.load(spark, DIR, "documents").collect()]
    df = spark.createDataFrame(rows, "__id long, __text string")
    kept = {r["sid"] for r in ngramjoin.suspects(df).collect()}
    sets = {i: common.shingle_sets(pa.array([t]))[0] for i, t in rows}
    for a in sets:
        for b in sets:
            if a < b and ngramjoin.linked(sets[a], sets[b]) and ngramjoin.identity(sets[a]) != ngramjoin.identity(sets[b]):
                assert {ngramjoin.identity(sets[a])[0], ngramjoin.identity(sets[b])[0]} <= kept


def test_tree_misses_no_link():
    rng = random.Random(2)
    base = [[f"w{rng.randrange(2000)}" for _ in range(rng.choice([8, 30, 60]))] for _ in range(30)]
    texts = []
    for _ in range(400):
        w = list(rng.choice(base))
        w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(w))
    points = ngramjoin.Points(list(range(400)), list(range(400)), texts)
    order = np.array(rng.sample(range(400), 400))
    tree, other = ngramjoin.RTree(points, order[:150]), ngramjoin.RTree(points, order[150:])
    links = ngramjoin.tree_links(tree, tree) + ngramjoin.tree_links(other, other) + ngramjoin.tree_links(tree, other)
    assert len(links) + len(set(points.label.tolist())) == 400
    want = {i: c for i, _, c in brute_links(list(enumerate(texts)))}
    assert len(set(want.values())) == len(set(points.label.tolist()))
    assert all((points.label[i] == points.label[j]) == (want[i] == want[j]) for i in range(400) for j in range(i))


def test_span_hashes():
    data = np.frombuffer(b"abcdefgh" * 20, np.uint8)
    starts, ends = np.array([0, 8, 0, 1, 3, 0, 0, 5]), np.array([8, 16, 160, 9, 3, 48, 49, 5])
    h = common.span_hashes(data, starts, ends)
    assert h[0] == h[1] and h[4] == h[7] and len(set(h.tolist())) == 6


# --- mixing


def test_fit_meets_marginals():
    rng = np.random.default_rng(0)
    keys = [(a, b, c) for a in "xyz" for b in "pq" for c in "mn"]
    tokens = rng.integers(1, 1000, len(keys)).astype(float)
    targets = [{"x": 0.2, "y": 0.5, "z": 0.3}, {"p": 0.6, "q": 0.4}, {"m": 0.5, "n": 0.5}]
    share = mixing.fit_on_driver(keys, tokens, targets, 60)
    for d, target in enumerate(targets):
        for v, aim in target.items():
            assert abs(sum(s for k, s in zip(keys, share) if k[d] == v) - aim) < 1e-6
    p = mixing.probabilities(share, tokens, 0.5 * tokens.sum())
    assert (p <= 1).all() and abs((p * tokens).sum() - 0.5 * tokens.sum()) < 1e-6
    assert (mixing.probabilities(share, tokens, 2 * tokens.sum()) == 1).all()


def test_mix_edges_and_both_ways(spark):
    rows = [(k, "w " * (k % 9), ["a", "b", None][k % 3], "en" if k % 2 else None) for k in range(60)] + [(None, None, "a", "en")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    one = {(r["doc_id"], round(r["probability"], 9)) for r in mixing.mix(df, iterations=4).collect()}
    two = {(r["doc_id"], round(r["probability"], 9)) for r in mixing.mix(df, iterations=4, on_driver=0).collect()}
    assert one == two and len(one) == 61
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r["keep"] for r in mixing.mix(df.withColumn("text", df["text"].substr(1, 0))).collect()} == {True}
    wide = df.withColumnsRenamed({}).selectExpr("*", "1 as topic", "'x' as share")
    kept = {r["doc_id"] for r in mixing.mix(df, iterations=4).collect() if r["keep"]}
    assert mixing.sample(wide, iterations=4).columns == wide.columns and {r["doc_id"] for r in mixing.sample(wide, iterations=4).collect()} == kept


def test_mix_to_given_targets(spark):
    """Expected tokens meet the targets of all three dimensions, where no chance is capped."""
    rng = random.Random(4)
    rows = [(k, " ".join(["x"] * rng.randrange(1, 60) + ["seldom"] * (k % 10 == 0)), rng.choice("ab"), rng.choice(["en", "fr"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.mix(df, {"source": {"a": 3, "b": 1}, "lang": {"en": 0.4, "fr": 0.6}, "topic": {"seldom": 0.1, "other": 0.9}}, budget=0.3).collect()
    assert {r["topic"] for r in got} == {"seldom", "other"} and max(r["probability"] for r in got) < 1
    total = sum(r["n_tokens"] * r["probability"] for r in got)
    for d, value, share in (("source", "a", 0.75), ("lang", "fr", 0.6), ("topic", "seldom", 0.1)):
        assert abs(sum(r["n_tokens"] * r["probability"] for r in got if r[d] == value) / total - share) < 1e-6
    assert abs(total / sum(r["n_tokens"] for r in got) - 0.3) < 1e-6


@pytest.mark.parametrize("targets", [{"source": {"a": 1}}, {"source": {"zzz": 1}}, {"source": {"a": 1}, "lang": {"fr": 1}}, {"lang": {"en": 3, "unknown": 1, "de": 1}}])
def test_mix_with_missing_targets_both_ways(spark, targets):
    """A value without target is not sampled, on the driver and as frames; targets that nothing meets keep nothing."""
    rows = [(k, "w " * (1 + k % 9), ["a", "b", None][k % 3], "en" if k % 2 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    one, two = ({r["doc_id"]: (round(r["probability"], 6), round(r["share"], 6)) for r in mixing.mix(df, targets, iterations=4, on_driver=n).collect()} for n in (1000, 0))
    assert one == two
    for k, _, source, lang in rows:
        missing = any((value or "unknown") not in targets.get(d, {value or "unknown": 1}) for d, value in (("source", source), ("lang", lang)))
        assert (one[k][0] == 0) == (missing or targets.get("source") == {"zzz": 1})


def test_topics_in_other_scripts(spark):
    rows = [(k, "мандарины растут " * (k % 2) + f"слово{k}", "s", "ru") for k in range(40)] + [(100 + k, f"x{k}", "s", "en") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["topic"] for r in mixing.mix(df, iterations=2).collect()}
    assert got[1] == "мандарины" and got[0] == "слово" or got[0] == "other"


def test_topics_by_definition(spark):
    rows = [(r["doc_id"], r["text"], "s", "l") for r in common.load(spark, DIR, "documents").collect()]
    words = {i: re.findall("[a-z\x80-\U0010ffff]{5,}", t or "") for i, t, _, _ in rows}
    seen = {}
    for i, w in words.items():
        for x in set(w):
            seen[x] = seen.get(x, 0) + 1
    top = sorted((-n, x) for x, n in seen.items() if n >= 2 and n * 10 <= len(rows))[: mixing.TOPICS]
    weight = {x: np.log(len(rows) / -n) for n, x in top}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert {x for x, _ in mixing.topic_words(df)} == set(weight)
    for r in mixing.mix(df, iterations=1).collect():
        score = sorted((-round(words[r["doc_id"]].count(x) * weight[x], 9), x) for x in set(words[r["doc_id"]]) & set(weight))
        assert r["topic"] == (score[0][1] if score else "other")


def test_memory_goes_back_after_a_task_has_ended(monkeypatch):
    """What a task held is free when memory is given back, not only afterwards."""
    import weakref

    class Table:
        pass

    seen, freed = [], []

    def run(batches):
        table = Table()
        seen.append(weakref.ref(table))
        yield from common.blocks(batches, "t")

    monkeypatch.setattr(common, "give_back", lambda: freed.append(seen[0]() is None))
    assert len(list(common.released(run)(iter([pa.RecordBatch.from_pydict({"t": ["a", "b"]})])))) == 1
    assert freed[-1]
