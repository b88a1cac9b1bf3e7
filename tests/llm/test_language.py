import random
import zlib

import numpy as np

from tessera.llm import language, queries
from tests.llm.helpers import documents, frame


def test_automaton_holds_exactly_the_substrings():
    rng = random.Random(0)
    s = [rng.randint(0, 2) for _ in range(60)]
    t = language.suffix_automaton(s, 4)

    def accepts(w):
        state = 0
        for c in w:
            state = t[state, c]
            if not state:
                return False
        return True

    held = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(3000):
        w = tuple(rng.randint(0, 3) for _ in range(rng.randint(1, 8)))
        assert accepts(w) == (w in held)


def test_phrases_as_by_brute_force():
    rng = random.Random(1)
    say = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"x": [say("abcd ", 300)], "y": [say("cdef ", 300)]}
    model = language.Model(samples)
    texts = [say("abcdefg ", n) + "a" for n in (1, 7, 90, 511, 512, 513, 1500)]
    parts = [model.symbols(t) for t in texts]
    got = model.phrases(parts)
    for k, name in enumerate(model.names):
        line = " ".join(map(str, [v for w in samples[name] for v in [*model.symbols(w.lower()).tolist(), model.size - 1]]))
        for i, p in enumerate(parts):
            n = 0
            for at in range(0, len(p), language.SEGMENT):
                seg, j = p[at : at + language.SEGMENT].tolist(), 0
                while j < len(seg):
                    end = j
                    while end < len(seg) and f" {' '.join(map(str, seg[j : end + 1]))} " in f" {line} ":
                        end += 1
                    j = max(end, j + 1) if end > j else j + 1
                    n += 1
            assert got[i, k] == n


def test_words_of_no_language(spark):
    df = frame(spark)
    got = language.identify(df, language.trained(df)).collect()
    assert len(got) == len(documents())
    for r in got:
        has = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has) and 0 <= r["lang_score"] <= 1
    assert language.trained(frame(spark, [])) == {}
    clash = frame(spark, documents()[:5]).withColumnRenamed("key", "lang_pred").withColumnRenamed("fp", "lang_score")
    got = language.identify(clash, {})
    assert got.columns == [*[c for c in clash.columns if not c.startswith("lang_")], "lang_pred", "lang_score"]
    assert [(r["lang_pred"], r["lang_score"]) for r in got.collect()] == [("und", 0.0)] * 5


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op4_language(spark, d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]) >= 0.98
