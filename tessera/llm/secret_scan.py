"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (an OR of ANDs that every match must
satisfy). The index has a posting (trigram, document id) for each trigram of the rules that a document holds; the
postings of each AND are intersected, and only documents that satisfy a rule's query are verified by its expression.
Rules without mandatory trigrams scan every document.

Everything on the data is DataFrame operations. Spans are counted in code points, ends exclusive.

Nulls: a null text is empty; ids are not read. Empty tables give an empty result; repeated rows are each scanned.
Columns of the input are kept, but for one of the output's name, which is replaced; the names _secret_* are taken.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few, forget, stored

#: Strings of an exact part, and ANDs of a query, that are followed; beyond, a query gets weaker, never wrong.
MOST_STRINGS, MOST_ANDS = 64, 64
#: Matches that are added up at a time, and code points of a chunk of text.
BLOCK, CHUNK = 64, 1024

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (Java and Python syntax alike); of those whose `group` is under `least` long, none."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The first three are the base kinds, in their order.
RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("live_key", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]


def _and(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x, y in product(a, b))
    return out if len(out) <= MOST_ANDS else (a if len(a) <= len(b) else b)


def _of_strings(strings: frozenset[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return ANY
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _node(op, arg) -> tuple[frozenset[str] | None, Query]:
    """The exact strings of a node if they are few, else None; and a query that its matches satisfy."""
    if op is C.LITERAL:
        return frozenset([chr(arg).lower()]), ANY
    if op is C.AT:
        return frozenset([""]), ANY
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in arg):
        chars = {chr(c).lower() for k, v in arg for c in ([v] if k is C.LITERAL else range(v[0], v[1] + 1))}
        return (frozenset(chars) if len(chars) <= 8 else None), ANY
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_STRINGS:
            return frozenset().union(*(e for e, _ in parts)), ANY
        queries = [q if e is None else _of_strings(e) for e, q in parts]
        union = frozenset().union(*queries)
        return None, (ANY if frozenset() in union or len(union) > MOST_ANDS else union)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = arg
        exact, query = _sequence(body)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, ANY
        if low == 0:
            return None, ANY
        if exact is not None and low == high and len(exact) ** low <= MOST_STRINGS:
            return frozenset("".join(x) for x in product(exact, repeat=low)), ANY
        return None, (query if exact is None else _of_strings(exact))
    return None, ANY


def _sequence(items) -> tuple[frozenset[str] | None, Query]:
    run, query, whole = frozenset([""]), ANY, True
    for op, arg in items:
        exact, q = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, exact))
            continue
        whole = False
        query = _and(query, _of_strings(run))
        if exact is None:
            query, run = _and(query, q), frozenset([""])
        else:
            run = exact
    return (run, ANY) if whole else (None, _and(query, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """The OR of ANDs of lower-case trigrams that every text with a match satisfies; ANY if there is none."""
    exact, query = _sequence(parser.parse(pattern))
    query = query if exact is None else _of_strings(exact)
    return frozenset(a for a in query if not any(b < a for b in query))  # an AND that asks for more than another adds nothing


def build_index(docs: DataFrame, trigrams: list[str], text_col: str) -> DataFrame:
    """Postings (trigram, id), written to the shared folder; an id is a hash of the text, equal ones only make candidates. Trigrams that no rule asks for are left out."""
    low = docs.select(F.xxhash64(text_col).alias("id"), F.lower(F.col(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return stored(low.select("id", F.explode(held).alias("trigram")), "trigrams")


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(id, rules): the bits of the rules whose query the id's postings satisfy."""
    spark, terms = index.sparkSession, []
    for rule, query in enumerate(queries):
        for at, need in enumerate(sorted(map(sorted, query))):
            terms += [(t, rule, at, 1 << k, (1 << len(need)) - 1) for k, t in enumerate(need)]
    term = spark.createDataFrame(terms, "trigram string, rule int, at int, bit long, need long")  # as many rows as the rules have trigrams
    met = index.join(F.broadcast(term), "trigram").groupBy("id", "rule", "at").agg(F.bit_or("bit").alias("has"), F.first("need").alias("need"))
    return met.filter("has = need").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def _let(value: Column, use) -> Column:
    """use(value), value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, add, zero: Column) -> Column:
    """The values added up to each one, in time linear in their number: within blocks, and over the blocks before."""

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))

        def joined(bs: Column) -> Column:
            inside = lambda b, before: F.transform(F.sequence(F.lit(1), F.size(b)), lambda j: F.aggregate(F.slice(b, F.lit(1), j), before, add))
            rows = lambda sums: F.flatten(F.transform(bs, lambda b, i: _let(F.aggregate(F.slice(sums, F.lit(1), i), zero, add), lambda before: inside(b, before))))
            return _let(F.transform(bs, lambda b: F.aggregate(b, zero, add)), rows)

        return F.when(F.size(v) > 0, _let(blocks, joined)).otherwise(F.slice(v, F.lit(1), F.lit(0)))

    return _let(values, of)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Start, order and end of each match that counts. The text is cut at the matches: gaps and matches alternate."""
    pattern = F.lit(rule.pattern)
    lengths = lambda group: F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.char_length)
    pairs = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.char_length).alias("gap"), lengths(0).alias("all"), lengths(rule.group).alias("part"))

    def made(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda x: x["gap"] + F.coalesce(x["all"], F.lit(0))), lambda a, b: a + b, F.lit(0))
        every = F.zip_with(pairs, ends, lambda x, end: F.struct((end - x["all"]).alias("start"), F.lit(order).alias("ord"), end.alias("end"), x["part"].alias("part")))
        return F.transform(F.filter(every, lambda x: x["part"] >= rule.least), lambda x: F.struct(x["start"], x["ord"], x["end"]))

    return _let(pairs, made)


def scan(docs: DataFrame, rules: list[Rule] = RULES, *, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with column `out` (one of that name is replaced): array of (start, ord, end) by start, then rule (ord, its place in rules)."""
    queries = [trigram_query(r.pattern) for r in rules]
    sought = sorted({t for q in queries if q != ANY for a in q for t in a})
    open_ = sum(1 << i for i, q in enumerate(queries) if q == ANY)
    none = F.expr("cast(array() as array<struct<start: int, ord: int, end: int>>)")
    met = docs
    if sought:
        index = build_index(docs, sought, text_col)
        found = stored(candidates(index, [frozenset() if q == ANY else q for q in queries]).select(F.col("id").alias("_secret_id"), F.col("rules").alias("_secret_rules")), "candidates")
        forget(index)
        met = docs.join(few(found), F.xxhash64(text_col) == F.col("_secret_id"), "left")
        mask = F.coalesce("_secret_rules", F.lit(0)).bitwiseOR(F.lit(open_))
    else:
        mask = F.lit(open_)
    met = met.withColumn("_secret_mask", mask.cast("long"))
    text = F.col(text_col)
    each = []
    for i, r in enumerate(rules):
        due = F.col("_secret_mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        each.append(F.when(due & text.rlike(r.pattern), _spans(text, r, i)).otherwise(none))
    return met.withColumn(out, F.array_sort(F.concat(*each))).drop("_secret_mask", "_secret_id", "_secret_rules")


def redacted(docs: DataFrame, rules: list[Rule] = RULES, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each span (overlapping ones together) replaced by a mark; rows without one stay as they are.

    The text is cut once into chunks, from which the parts between the spans are taken and joined.
    """
    met = scan(docs, rules, text_col=text_col, out="_secret_spans")
    text = F.col(text_col)

    def between(chunks: Column, a: Column, b: Column) -> Column:
        part = lambda c: F.substring(F.element_at(chunks, c + 1), F.greatest(a - c * CHUNK, F.lit(0)) + 1, F.least(b, (c + 1) * CHUNK) - F.greatest(a, c * CHUNK))
        of = lambda x: F.floor(x / CHUNK).cast("int")
        return F.when(a < b, F.array_join(F.transform(F.sequence(of(a), of(b - 1)), part), "")).otherwise("")

    def marked(spans: Column) -> Column:
        """spans: start, and the greatest end so far."""
        before = F.transform(spans, lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.element_at(spans, i)["end"]).alias("end"), x["start"].alias("start")))
        gaps = F.filter(before, lambda x: x["start"] >= x["end"])
        last = F.element_at(spans, -1)["end"]
        joined = lambda chunks: F.array_join(F.concat(F.transform(gaps, lambda x: between(chunks, x["end"], x["start"])), F.array(between(chunks, last, F.char_length(text)))), mark)
        return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), joined)

    ends = running(F.transform("_secret_spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    reach = F.zip_with("_secret_spans", ends, lambda x, end: F.struct(x["start"].alias("start"), end.alias("end")))
    return met.withColumn(text_col, F.when(F.size("_secret_spans") > 0, _let(reach, marked)).otherwise(text)).drop("_secret_spans")
