import random
import re

import numpy as np

from tessera.llm import license_scan as L
from tests.llm.helpers import documents, frame


def test_finds_templates_whole_and_changed(spark):
    rng = random.Random(0)
    fill = lambda n: " ".join(rng.choice(["the", "of", "lorem", "ipsum", "software", "copy", "dolor"]) for _ in range(n))
    rows, want = list(documents()), {}
    for i, (name, text) in enumerate(L.TEMPLATES.items()):
        pre = "é𝔘 " + fill(rng.randint(0, 60)) + ".\n"
        rows.append((8000 + i, pre + text + "\n" + fill(40), None, None, 0, 0, "s", "k", "f", "p"))
        want[8000 + i] = (name, len(pre), len(pre + text.rstrip(".,")))
    mit = L.TEMPLATES["MIT/grant"].replace("free of charge", "wholly free of any charge").replace("merge, publish", "PUBLISH")
    rows.append((9000, fill(30) + "\n// " + mit.replace(" ", "\n * ", 3), None, None, 0, 0, "s", "k", "f", "p"))
    rows.append((9001, "Permission is hereby granted, free of charge, to nobody", None, None, 0, 0, "s", "k", "f", "p"))
    got = {}
    for r in L.scan(frame(spark, rows)).collect():
        got.setdefault(r["id"], []).extend(tuple(m) for m in r["matches"])
    for k, (name, a, b) in want.items():
        assert [(m[0], m[1], m[2], m[3]) for m in got[k]] == [(name, a, b, 1.0)], (k, got[k])
    assert [m[0] for m in got[9000]] == ["MIT/grant"] and 0.9 < got[9000][0][3] < 1 and got[9001] == []
    assert all(not m for k, m in got.items() if k is None or k < 8000)
    assert L.scan(frame(spark, [])).count() == 0


def test_shared_runs_share_a_fingerprint():
    index, rng = L.Index(L.TEMPLATES), np.random.default_rng(0)
    for t, ids in enumerate(index.texts):
        n = L.W + L.K - 1
        for _ in range(10):
            a = int(rng.integers(0, len(ids) - n + 1))
            text = np.concatenate([rng.integers(0, 50, 20), ids[a : a + n], rng.integers(0, 50, 20)])
            assert (t, 20 - a) in set(zip(*[x.tolist() for x in index.candidates(text)], strict=True))


def lcs(text, ids, diagonal):
    """Cells of a whole table; matches only within the band."""
    best = np.zeros((len(text) + 1, len(ids) + 1), int)
    for i in range(len(text)):
        for j in range(len(ids)):
            inside = abs(j - i - diagonal) <= L.BAND and text[i] == ids[j]
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if inside else 0)
    return best[-1, -1]


def test_alignment_is_the_longest_common_subsequence_in_the_band():
    index, rng = L.Index({"x": " ".join(f"w{i % 7}" for i in range(20))}), np.random.default_rng(1)
    for _ in range(50):
        ids, diagonals = rng.integers(0, 8, 22), np.array([-3, 0, 4])
        got = index.align(0, diagonals, ids)
        assert [n for n, _, _ in got] == [lcs(index.texts[0], ids, d) for d in diagonals]
        for (n, a, b), d in zip(got, diagonals, strict=True):
            assert n == 0 or lcs(index.texts[0][:], np.where((np.arange(22) >= a) & (np.arange(22) < b), ids, 0), d) == n


def brute(text, least=L.LEAST_COVERAGE):
    """Without fingerprints: the greatest match over all templates and all stretches of words, taken out, and again."""
    index = L.Index(L.TEMPLATES)
    spans = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())]
    ids = np.array([index.word.get(text[a:b].lower().encode(), 0) for a, b in spans])
    out = []
    while True:
        found = []
        for t, words in enumerate(index.texts):
            for n, a, b in index.align(t, np.arange(-len(words), len(ids)), ids).tolist():
                if n >= least * len(words) - 1e-9 and (ids[a:b] >= 0).all():
                    found.append((-n, -n / len(words), t, a, b))
        if not found:
            return sorted(out)
        for n, share, t, a, b in sorted(found):
            if (ids[a:b] >= 0).all():
                ids[a:b] = -1
                out.append((spans[a][0], spans[b - 1][1], index.names[t], -share))


def test_matches_as_over_all_diagonals():
    rng, index = random.Random(5), L.Index(L.TEMPLATES)
    names = [k for k, v in L.TEMPLATES.items() if len(v) < 90]
    for _ in range(12):
        parts = []
        for _ in range(rng.randint(1, 5)):
            notice = L.TEMPLATES[rng.choice(names)]
            parts += [notice] * rng.randint(1, 4) + [rng.choice(["", "lorem é ipsum", "under the terms"])]
        text = "\n".join(parts)
        assert sorted((a, b, k, s) for k, a, b, s in index.matches(text.encode(), L.LEAST_COVERAGE)) == brute(text), text


def test_every_one_of_repeated_notices_is_found():
    index, line = L.Index(L.TEMPLATES), "Released under the MIT License.\n"
    for n in (1, 2, 3, 4, 5, 17, 50_000):
        got = index.matches((line * n).encode(), L.LEAST_COVERAGE)
        assert got == [("MIT/short", i * len(line), i * len(line) + len(line) - 2, 1.0) for i in range(n)]
