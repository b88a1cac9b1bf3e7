"""Best-fit packing by minimum bin slack over lengths.

Pieces of equal length are interchangeable, so that packing needs only their histogram: at most as many counts as a
sequence has tokens. For each bin the longest length left is taken, and a bitset subset-sum over the lengths left
finds the fullest combination beside it. The combination is removed as often as the counts allow, and the search goes
on: each combination uses up a length at least, so their number does not grow with the data. Pieces then find their
place by their rank among pieces of their length.

Nulls: a null text is an empty one, of one token (the end). A null id stays null. Empty tables give an empty result;
repeated rows are packed each. Other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import buckets_for, held, ranked, stored, trim

CAPACITY, END = 4096, 1
#: Words whose ids a worker remembers, and bytes of these words and ids, twice at most. Forgotten words are tokenized anew.
WORDS, REMEMBERED = 200_000, 1 << 23
#: Bytes tokenized at a time.
CHUNK = 1 << 20
#: Words, and bytes of words, handed to the tokenizer at a time: what it keeps of a text is many times the text.
HANDED, HANDED_BYTES = 4096, 1 << 16


#: Marks that may end a word: where they follow a letter, the tokenizer parts them from it.
MARKS = b'.,;:!?*#$%&|)"'
#: Words of small letters alone, with those of Latin-1: normalizer and splitter leave them whole.
_plain = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it is visible, else the next from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


def handfuls(words: Iterable[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w)
        if len(part) == HANDED or size >= HANDED_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


class WordTokenizer:
    """Ids of whole texts, word by word, each word once: this tokenizer drops white space and joins nothing across it.

    It also lower-cases, so that A-Z may be lower-cased before (not where combining marks may follow, which bind to the
    letter's case, or where a special token's name may stand), and parts marks from a letter before them, so that a word with marks is the word and the marks.
    Words of plain letters go to the merges at once, past normalizer and splitter; the rest is left to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.last = np.zeros(self.whole.get_vocab_size(), bool)  # ids that end a word
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0  # bytes in new

    def keep(self, word: bytes, ids: bytes) -> None:
        self.new[word] = ids
        self.size += len(word) + len(ids)

    def encode(self, words: list[bytes]) -> list[bytes]:
        found = self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode_plain(self, words: list[bytes]) -> list[bytes]:
        line = b" ".join(words)
        text = line.decode() if line.isascii() else " ".join(w.decode("latin-1").translate(self.letters) for w in words)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.nonzero(self.last[ids])[0] + 1)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, words: set[bytes]) -> None:
        if len(self.new) > WORDS or self.size > REMEMBERED:
            self.old, self.new, self.size = self.new, {}, 0
        plain, odd, marked = set(), set(), []
        for w in words:
            if w in self.new:
                continue
            if w in self.old:
                self.keep(w, self.old[w])
                continue
            base = w.rstrip(MARKS)
            parts = [w]
            if base and len(base) < len(w) and 97 <= base[-1] <= 122:
                parts = [base, w[len(base) :]]
                marked.append((w, *parts))
            for x in parts:
                if x not in self.new:
                    (plain if _plain(x) else odd).add(x)
        for some, encode in ((plain, self.encode_plain), (odd, self.encode)):
            for part in handfuls(some):
                for w, ids in zip(part, encode(part), strict=True):
                    self.keep(w, ids)
        for w, base, marks in marked:
            self.keep(w, self.new[base] + self.new[marks])

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Of each text (UTF-8), its ids as little-endian 32-bit integers."""
        split = [(t if b"\xcc" in t or b"\xcd" in t or b"<|" in t else t.lower()).split() for t in texts]
        self.learn(set().union(*split))
        of = self.new.__getitem__
        return [b"".join(map(of, words)) for words in split]


def tokenizer_of(path: str) -> WordTokenizer:
    return held(("tokenizer", path), lambda: WordTokenizer(path))


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids as little-endian 32-bit integers]) of each piece of each row."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_of(path)
        for b in batches:
            texts, at = b.column(1), 0
            while at < b.num_rows:
                some, size = [], 0
                while at + len(some) < b.num_rows and size < CHUNK:
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1])
                own, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, line in enumerate(tokens.ids(some)):
                    line += last
                    for k, a in enumerate(range(0, len(line), 4 * capacity)):
                        part = line[a : a + 4 * capacity]
                        own.append(at + i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                columns = [b.column(0).take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                at += len(some)
            trim()

    return base.mapInArrow(cut, f"id {base.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def fullest(counts: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Of lengths (descending) with counts, the multiset with the greatest sum up to room. Bit s of a set: sum s can be reached."""
    every, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, n in counts:
        n, k = min(n, room // length), 1
        while n > 0:
            k = min(k, n)
            steps.append((reach, length, k))
            reach |= reach << (k * length) & every
            n, k = n - k, 2 * k
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, {}
    for before, length, k in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + k
            total -= k * length
    return out


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, with how many sequences have each."""
    left, out = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        top = max(left)
        rest = {**left, top: left[top] - 1}
        found = fullest([(k, rest[k]) for k in sorted(rest, reverse=True) if rest[k] and k <= capacity - top], capacity - top)
        found[top] = found.get(top, 0) + 1
        times = min(left[k] // m for k, m in found.items())
        out.append((found, times))
        for k, m in found.items():
            left[k] -= times * m
            if not left[k]:
                del left[k]
    return out


def pack(parts: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. `parts` is read more than once: write it first."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places, sequence, given = [], 0, {}
    for found, times in patterns(histogram, capacity):
        offset = 0
        for length in sorted(found, reverse=True):
            m, first = found[length], given.get(length, 0)
            places.append((length, first, first + times * m, m, sequence, offset))
            given[length], offset = first + times * m, offset + m * length
        sequence += times
    table = spark.createDataFrame(places, "p_length long, first long, beyond long, many long, sequence long, at long")  # bounded as the histogram is
    order = [F.col("id"), F.col("piece"), F.col("ids_crc32")]
    rows = ranked(parts, ["length"], order, F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets_for(sum(histogram.values())))))
    met = rows.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
    within = F.col("rank") - F.col("first")
    return met.select(*parts.columns, (F.col("sequence") + F.floor(within / F.col("many"))).cast("long").alias("sequence_id"), (F.col("at") + within % F.col("many") * F.col("length")).cast("long").alias("offset"))


def packed(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(stored(pieces(docs, path, capacity=capacity, end=end, with_ids=with_ids, id_col=id_col, text_col=text_col), "pieces"), capacity=capacity)
