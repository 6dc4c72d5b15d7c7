"""BPE encoding and decoding through a table of distinct words.

Spark splits all texts into pre-tokens ("words") and counts them; the most
frequent TABLE_WORDS distinct words are encoded once each into a table of
bounded size, which is broadcast and joined back to the words' places by
position. Words beyond the table are seldom; a block of texts has a table of
its own for them, in which each is encoded once. Decoding joins ids to a table
of pieces, bounded by the vocabulary. No text and no word occurrence is dealt
out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

#: Byte-level pre-tokens ("words"), as the public vocabulary's pattern has them.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of the broadcast table, and the longest ones in it (characters).
TABLE_WORDS, TABLE_LONGEST = 150_000, 64
#: Words beyond the table that a task remembers between blocks, and words of a block.
REMEMBERED_WORDS = 100_000
BLOCK_WORDS = 50_000
#: Bytes of a word whose pairs are looked through for each merge; longer words keep them in a heap.
SHORT = 48
#: Text that is counted at once.
COUNT_BYTES = 4 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others for code points from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def piece_table(vocabulary: str) -> list[bytes]:
    """The bytes of each id."""
    spec = json.loads(vocabulary)
    alphabet = byte_alphabet()
    special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    pieces = {i: bytes(alphabet[c] for c in p) for p, i in spec["model"]["vocab"].items() if i not in special}
    pieces |= special
    return [pieces.get(i, b"") for i in range(max(pieces) + 1)]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Splitter:
    """Splits a text into words whose concatenation it is; special tokens stand alone and end what is before them."""

    def __init__(self, vocabulary: str) -> None:
        import regex

        self.words = regex.compile(WORD_PATTERN).findall
        # The same pattern with its classes spelled out below U+0250, where the plain module can do it, which is faster.
        letters, numbers, spaces = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
        narrow = WORD_PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        self.narrow = re.compile(narrow.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")).findall
        self.wide = re.compile("[\u0250-\U0010ffff]").search
        names = sorted((t["content"] for t in json.loads(vocabulary)["added_tokens"]), key=len, reverse=True)
        self.names = set(names)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        words = self.words if self.wide(text) else self.narrow
        if self.special and any(n in text for n in self.names):
            out = []
            for part in self.special(text):
                out += [part] if part in self.names else words(part)
            return out
        return words(text)


class Merges:
    """Byte-pair merges of a vocabulary, applied to one word at a time."""

    def __init__(self, vocabulary: str) -> None:
        spec = json.loads(vocabulary)
        supported(spec)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.start = {alphabet[c]: vocab[c] for c in alphabet if c in vocab}
        self.size = max(vocab.values()) + 1
        #: For two ids, left * size + right, the merge's rank; the id that a rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault(vocab[left] * self.size + vocab[right], rank)
            self.made.append(vocab[left + right])
        self.whole = {bytes(alphabet[c] for c in p): i for p, i in vocab.items() if all(c in alphabet for c in p)} if spec["model"].get("ignore_merges") else {}

    def __call__(self, word: str) -> list[int]:
        """Ids of a word: of all neighbours the pair that was merged first in training is joined, the leftmost first,
        until none is left."""
        raw = word.encode()
        if raw in self.whole:
            return [self.whole[raw]]
        ids = [self.start[b] for b in raw if b in self.start]
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get, size, never = self.ranks.get, self.size, len(self.made)
        ranks = [get(a * size + b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < never:
            k = ranks.index(least)
            ids[k : k + 2] = [self.made[least]]
            del ranks[k]
            if k:
                ranks[k - 1] = get(ids[k - 1] * size + ids[k], never)
            if k < len(ranks):
                ranks[k] = get(ids[k] * size + ids[k + 1], never)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, ranks, size = len(ids), self.ranks, self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := ranks.get(ids[k] * size + ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != left or nxt >= n or ids[nxt] != right:
                continue  # one of the two has been joined meanwhile
            made = self.made[rank]
            ids[k], ids[nxt] = made, -1
            end = after[k] = after[nxt]
            if end < n:
                before[end] = k
                if (r := ranks.get(made * size + ids[end])) is not None:
                    heapq.heappush(heap, (r, k, made, ids[end]))
            if (prev := before[k]) >= 0 and (r := ranks.get(ids[prev] * size + made)) is not None:
                heapq.heappush(heap, (r, prev, ids[prev], made))
        return [i for i in ids if i >= 0]


def supported(spec: dict) -> None:
    """Raises ValueError unless words are split by the byte-level pattern and nothing else changes texts or ids."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError("only byte-level BPE vocabularies without normalizer are supported")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
        raise ValueError("added tokens that strip or need word bounds are not supported")


def word_table(df: DataFrame, vocabulary: str, text: str = "text", most: int = TABLE_WORDS) -> pa.Table:
    """word, ids of the `most` most frequent words of TABLE_LONGEST characters at most (ties: the first in order), each
    encoded once. The bounds keep the table under some 20 MB whatever the corpus."""
    packed = zlib.compress(vocabulary.encode())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(zlib.decompress(packed).decode())
        for block in common.blocks(batches, "__text", COUNT_BYTES):
            seen: Counter = Counter()
            for t in block.column(0).to_pylist():
                seen.update(split(t))
            words = [w for w in seen if len(w) <= TABLE_LONGEST]
            for start in range(0, len(words), 100_000):
                some = words[start : start + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[w] for w in some], pa.int64())], names=["word", "n"])

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = zlib.decompress(packed).decode()
        special, merges = {t["content"]: [t["id"]] for t in json.loads(spec)["added_tokens"]}, Merges(spec)
        for batch in batches:
            ids = [special.get(w) or merges(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    rows = df.select(F.col(f"`{text}`").alias("__text")).where("__text is not null")
    found = rows.mapInArrow(common.released(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = common.written(found.orderBy(F.desc("n"), "word").limit(most).select("word"), "words")
    return top.repartition(16).mapInArrow(common.released(encode_words), "word string, ids array<int>").toArrow()


class WordTable(dict):
    """Distinct words and their places; `ids` has the ids of all places one after another.

    It begins with the broadcast table. A word beyond is encoded when it is first looked up; `trim` forgets those
    words once there are more than its bound.
    """

    def __init__(self, vocabulary: str, table: pa.Table) -> None:
        self.special = {t["content"]: [t["id"]] for t in json.loads(vocabulary)["added_tokens"]}
        self.encode = Merges(vocabulary)
        words, lists = table.column("word").to_pylist(), table.column("ids").combine_chunks()
        super().__init__(zip(words, range(len(words))))
        offs = np.asarray(lists.offsets, np.int64) if len(words) else np.zeros(1, np.int64)
        self.known = len(words)
        self.known_ids = np.asarray(lists.values, np.int32)[offs[0] : offs[-1]] if len(words) else np.zeros(0, np.int32)
        self.known_ends = offs[1:] - offs[0]
        self.ids, self.ends = array("i"), array("q")

    def __missing__(self, word: str) -> int:
        found = self.special.get(word) or self.encode(word)
        self.ids.extend(found)
        self.ends.append(len(self.ids))
        place = self[word] = len(self)
        return place

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each place's end."""
        ids = np.concatenate([self.known_ids, np.array(self.ids, np.int32)])
        return ids, np.concatenate([self.known_ends, np.array(self.ends, np.int64) + len(self.known_ids)])

    def trim(self, most: int = REMEMBERED_WORDS) -> None:
        if len(self) - self.known >= most:
            for word in list(self)[self.known :]:
                del self[word]
            self.ids, self.ends = array("i"), array("q")


def spread(values: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs values[at[k]:at[k]+length[k]], one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(at - (ends - length), length)] if total else values[:0]


def encode_block(lists: list[list[str]], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block of texts (lists of words), and the offsets of each text's."""
    table.trim()
    offs = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    place = np.fromiter(map(table.__getitem__, chain.from_iterable(lists)), np.int64, int(offs[-1]))
    ids, ends = table.columns()
    length = np.diff(ends, prepend=0)
    taken = length[place]
    out = spread(ids, (ends - length)[place], taken)
    return out, np.concatenate([[0], np.cumsum(taken)])[offs]


class Pieces:
    """The id-to-piece table as one byte array and offsets."""

    def __init__(self, pieces: list[bytes]) -> None:
        pieces = [*pieces, b""]  # the last stands for ids outside the vocabulary
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.length) - self.length

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[ids]
        return spread(self.data, self.at[ids], length), np.concatenate([[0], np.cumsum(length)])


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all but text) and `ids` array<int>, the text's token ids.

    Null or empty text: no ids. Repeated rows are encoded alike. A kept column named like `ids` is replaced. The words
    are counted, and their table made, when this is called. Vocabularies that split otherwise raise ValueError.
    """
    supported(json.loads(vocabulary))
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, ids)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    sink = pa.BufferOutputStream()
    found = word_table(df, vocabulary, text)
    with pa.ipc.new_stream(sink, found.schema) as out:
        out.write_table(found)
    sent = df.sparkSession.sparkContext.broadcast((zlib.compress(vocabulary.encode()), zlib.compress(sink.getvalue().to_pybytes(), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, known = (zlib.decompress(x) for x in sent.value)
        spec, known = spec.decode(), pa.ipc.open_stream(known).read_all()
        split, table = Splitter(spec), WordTable(spec, known)
        for batch in common.blocks(batches, "__text"):
            start, lists, n = 0, [], 0
            for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist(), 1):
                lists.append(split(t))
                n += len(lists[-1])
                if n >= BLOCK_WORDS or k == batch.num_rows:
                    flat, offs = encode_block(lists, table)
                    out = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, k - start).columns[:-1], out], names=[*keep, ids])
                    start, lists, n = k, [], 0

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text")).mapInArrow(common.released(run), schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded", digest: str | None = None) -> DataFrame:
    """All columns and `text`, the pieces of `ids` joined as UTF-8 (bytes that are not: U+FFFD). With digest, also a column
    of that name: SHA-256 of the ids as little-endian unsigned 32-bit numbers, in hexadecimal.

    Null or empty ids: an empty text. Ids outside the vocabulary have no piece.
    """
    keep = [c for c in df.columns if c not in (text, digest)]
    where = keep.index(ids)
    more = [text] if digest is None else [text, digest]
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(c, T.StringType(), False) for c in more)])
    packed = zlib.compress(vocabulary.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(piece_table(zlib.decompress(packed).decode()))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                block = batch.slice(start, 512)
                lists = pa.compute.fill_null(block.column(where), pa.scalar([], block.column(where).type))
                offs = np.asarray(lists.offsets, np.int64)
                flat = np.asarray(lists.values, np.int64)[offs[0] : offs[-1]]
                flat = np.where((flat >= 0) & (flat < len(pieces.length) - 1), flat, -1)
                data, at = pieces.join(flat)
                ends = at[offs - offs[0]]
                raw = data.tobytes()
                out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
                columns = [*block.columns, pa.array(out, pa.string())]
                if digest is not None:
                    little = np.asarray(lists.values, np.int32)[offs[0] : offs[-1]].astype("<u4").tobytes()
                    ends = 4 * (offs - offs[0])
                    columns.append(pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *more])

    return df.mapInArrow(common.released(run), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = default_vocabulary()
    rows = decode(encode(docs, vocabulary), vocabulary, digest="ids_sha256")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
