import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing, queries
from tests.llm.helpers import documents, frame


def test_fullest_is_the_best_sum():
    rng = random.Random(0)
    for _ in range(200):
        items = sorted({rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}.items(), reverse=True)
        room = rng.randint(0, 80)
        sums = {0}
        for length, n in items:
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        found = packing.fullest(items, room)
        assert sum(k * n for k, n in found.items()) == max(sums) and all(n <= dict(items)[k] for k, n in found.items())


def test_patterns_use_every_piece_once():
    rng = random.Random(1)
    h = {rng.randint(1, 4096): rng.randint(1, 50) for _ in range(300)}
    used = defaultdict(int)
    for found, times in packing.patterns(h):
        assert sum(k * m for k, m in found.items()) <= 4096
        for k, m in found.items():
            used[k] += m * times
    assert used == h
    free: list[int] = []  # first fit, longest first
    for k in sorted(h, reverse=True):
        for _ in range(h[k]):
            at = next((i for i, f in enumerate(free) if f >= k), None)
            if at is None:
                free.append(4096 - k)
            else:
                free[at] -= k
    assert sum(t for _, t in packing.patterns(h)) <= len(free) * 1.005


def whole(rows):
    """Checks places, returns pieces by document in order."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins)


ODD = ["a<|endoftext|>b 'S it's don't.' x|>. <|endoftext|>. O'RE, <|EndOfText|>", "\r\nnaïve é \u0301x\x0b\x1c y H\u0331 E\u0301 ÀÉÎ ÿß×÷ ñ.", "Hi!!! wh*** é.., a.b.c, 1234. 5,6 __x__ x_ ...", "İ Σας ΟΔΟΣ ﬁ ǅ 한글 \u1100\u1161 \u00a0\u2003z \x85q", "&&&. the,,, \U0001d518\U0001d52b. \ud7ff ½ x² z) (z \"q\""]


def test_pieces_as_by_the_tokenizer(spark):
    rows = [*documents(), (7777, "a<|endoftext|>b 'S it's\r\nnaïve é ́x\x0b\x1c y", None, None, 0, 0, "s", "k", "f", "p")]
    got = packing.packed(frame(spark, rows), queries.word_tokenizer()).collect()
    whole(got)
    t = Tokenizer.from_file(queries.word_tokenizer())
    want = []
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096].tobytes()
            want.append((-1 if r[0] is None else r[0], k, a, len(part) // 4, zlib.crc32(part), part))
    assert sorted(want) == sorted((-1 if r["id"] is None else r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in got)
    assert packing.packed(frame(spark, []), queries.word_tokenizer()).count() == 0


def test_few_sequences(spark):
    got = queries.op6_pack(spark, "/root/testdata/sf0.001").collect()
    assert whole(got) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 20)
    t = packing.WordTokenizer(queries.word_tokenizer())
    plain = Tokenizer.from_file(queries.word_tokenizer())
    for r in documents()[9:40]:
        assert t.ids([r[1].encode()])[0] == np.array(plain.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()


GROWTH = """
import re, sys
from pyspark.sql import functions
from tessera.llm import packing, queries

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

t, width = packing.WordTokenizer(queries.word_tokenizer()), int(sys.argv[1])
letter, most, before = "abcdefghijklmnop", 0, held()
word = lambda i: "".join(letter[i >> k & 15] for k in range(0, 20, 4)) * width  # noqa: E731
for at in range(0, int(sys.argv[2]), 10_000):
    t.ids([" ".join(map(word, range(at, at + 10_000))).encode()])
    most = max(most, held() - before)
print(most)
"""


def test_memory_for_unlike_words_is_bounded():
    for width, n in ((1, 600_000), (20, 100_000)):  # many short words; long ones
        ran = subprocess.run([sys.executable, "-c", GROWTH, str(width), str(n)], capture_output=True, text=True, timeout=300, check=True)
        assert float(ran.stdout) < 75
