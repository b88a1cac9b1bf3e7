"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled text. A document is cut greedily into
the longest phrases that occur in the sample; the language that needs the fewest phrases per symbol wins (ties: the
one with more labelled texts, then the least name). Text is lower-cased; letters are symbols, and whatever lies between letters is one space.

Documents are parsed whole, in segments of `SEGMENT` symbols side by side: a step takes one symbol of every segment
through the automaton's transition table at once. A segment's start begins a new phrase, for all languages alike.

The sample: of each language, windows of `WINDOW` characters of the labelled texts of least hash, each text once, up
to `SAMPLE_CHARS` (1.2 million over all languages). Letters beyond the 250 most frequent in the sample share a symbol.

Nulls: a null text, or one without a letter, is `und` with score 0, as is everything if no label was learned. A null
id never trains and is not held out. Empty tables give an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, trim

SAMPLE_CHARS, ALL_CHARS, WINDOW = 48_000, 250_000, 512
#: Languages are a fixed vocabulary; more are refused.
MAX_LANGUAGES = 500
SEGMENT, BLOCK = 512, 1 << 20
LETTERS = 250
#: Texts that are read at a time.
AT_ONCE = 1024
UNKNOWN = "und"


def suffix_automaton(symbols: list[int], size: int) -> np.ndarray:
    """Transitions [state, symbol] of the automaton of all substrings; 0, the root, where there is none."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        now = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    out = np.zeros((len(nxt), size), np.int32)
    for s, moves in enumerate(nxt):
        for c, t in moves.items():
            out[s, c] = t
    return out


class Model:
    """Automata by language, over one alphabet: 0 a space, then letters, then any other letter, then the break of samples."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = list(samples)  # the order settles ties
        lowered = {k: [w.lower() for w in v] for k, v in samples.items()}
        seen = Counter(c for v in lowered.values() for w in v for c in w if c.isalpha())
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]]
        self.other, self.size = len(letters) + 1, len(letters) + 3
        self.code = np.zeros(0x110000, np.uint8)
        self.code[[i for i in range(0x110000) if chr(i).isalpha()]] = self.other
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.tables = []
        for k in self.names:
            line = [x for w in lowered[k] for x in [*self.symbols(w).tolist(), self.size - 1]]
            made = np.vstack([suffix_automaton(line, self.size), np.zeros((1, self.size), np.int32)])
            made[0, made[0] == 0] = len(made) - 1  # a symbol that the sample lacks is a phrase of its own
            self.tables.append(made.ravel() * np.int32(self.size))  # states as places in the table

    def symbols(self, text: str) -> np.ndarray:
        x = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = x > 0
        keep[1:] |= x[:-1] > 0  # one space after each run of letters
        return x[keep]

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases [document, language] of symbol arrays."""
        sizes = np.array([len(p) for p in parts])
        flat, per = np.concatenate(parts), -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(parts)), per)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        begin = np.repeat(np.cumsum(sizes) - sizes, per) + within * SEGMENT
        length = np.minimum(np.repeat(sizes, per) - within * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        steps = np.searchsorted(-length, -np.arange(SEGMENT), side="left")  # segments longer than t
        at = np.zeros((SEGMENT, len(owner)), np.int32)
        for t in range(SEGMENT):
            at[t, : steps[t]] = flat[begin[: steps[t]] + t]
        out = np.zeros((len(parts), len(self.names)), np.int64)
        for k, table in enumerate(self.tables):
            start, state, count = table[: self.size], np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int32)
            for t in range(SEGMENT):
                n = steps[t]
                if not n:
                    break
                to = table.take(state[:n] + at[t, :n])
                miss = to == 0
                count[:n] += miss
                state[:n] = np.where(miss, start.take(at[t, :n]), to)
            out[:, k] = np.bincount(owner, weights=count + (state != 0), minlength=len(parts))
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        held, where, size = [], [], 0

        def settle() -> None:
            if not held:
                return
            rate = self.phrases(held) / np.array([len(p) for p in held])[:, None]
            order = np.sort(rate, axis=1)
            for i, k, r in zip(where, rate.argmin(1), order, strict=True):
                names[i] = self.names[k]
                scores[i] = 1.0 - r[0] / r[1] if len(r) > 1 else 1.0

        for i, t in enumerate(texts):
            s = self.symbols(t) if t and self.names else np.zeros(0, np.uint8)
            if not s.any():
                continue
            held.append(s)
            where.append(i)
            size += len(s)
            if size >= BLOCK:
                settle()
                held, where, size = [], [], 0
        settle()
        return names, scores


def model_of(samples: dict[str, list[str]]) -> Model:
    """Built once in each worker."""
    return held(hashlib.sha256(repr(samples).encode("utf-8", "surrogatepass")).digest(), lambda: Model(samples))


def sample(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """Windows by language. The counts set for each language the hash below which about four times as many texts lie as are used."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    windows = max(1, min(SAMPLE_CHARS, ALL_CHARS // len(counts)) // WINDOW)
    top = 1 << 40
    below = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(top, 4 * windows * top // n + 1))])
    drawn = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 24)).filter(F.col("h") < F.element_at(below, F.col("lang")))
    room = F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1
    got = drawn.select("lang", "h", F.substring("text", F.pmod(F.xxhash64("h"), room).cast("int") + 1, F.lit(WINDOW)).alias("w")).distinct().collect()
    out: dict[str, list[str]] = {k: [] for k in sorted(counts, key=lambda k: (-counts[k], k))}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"], r["w"])):
        if len(out[r["lang"]]) < windows:
            out[r["lang"]].append(r["w"])
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score; all columns pass through, but for ones of these two names, which are replaced."""
    docs = docs.drop(*{"lang_pred", "lang_score"} - {text_col})
    at = docs.columns.index(text_col)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(samples)
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(k, AT_ONCE)
                names, scores = model.judge(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores)], [*b.schema.names, "lang_pred", "lang_score"])
            trim()

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return docs.mapInArrow(judged, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, *, id_col: str = "doc_id") -> dict[str, list[str]]:
    return sample(docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)))
