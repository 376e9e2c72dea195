"""Secret scans through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean trigram query: clauses that must all hold, each a choice of trigram sets. The
index holds postings (trigram, text digest) for the trigrams that some rule asks for, over case-folded texts. Postings of a
text meet in one bit word per 62 trigrams (merged inside tasks before the shuffle), the queries are tested on these words, and
only candidates run a rule's expression. Rules without mandatory trigrams run on every text.

Defined cases: null and empty texts have no spans; copies share postings, but every row is verified and reported by itself;
spans of different rules may overlap; other columns are carried along whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

_parser = re._parser  # the standard library's own view of an expression
MOST_STRINGS = 64
WORD_BITS = 62


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have at least ``least`` characters; failing matches are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


# The base kinds as the contract of op2 names them.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs of 24 or more: the same spans as longer runs of any length kept from 24 on
)
# Public token formats that the scan adds.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36),
)
RULES = BASE + ADDED

Query = list[list[frozenset[str]]]


def _strings(node: tuple) -> list[str] | None:
    """All case-folded strings that ``node`` can match, or None if they are too many."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return [chr(value).lower()]
    if op == "IN":
        found: set[str] = set()
        for kind, what in value:
            if str(kind) == "LITERAL":
                found.add(chr(what).lower())
            elif str(kind) == "RANGE" and what[1] - what[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None
        return sorted(found) if len(found) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence(value[3])
    if op == "BRANCH":
        parts = [_sequence(p) for p in value[1]]
        return None if None in parts else sorted({s for p in parts for s in p})
    if op == "MAX_REPEAT" and value[1] == 1:
        inner = _sequence(value[2])
        return None if inner is None else inner + [""] * (value[0] == 0)
    return None


def _sequence(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = ["".join(p) for p in product(out, more)]
    return out


def trigram_query(pattern: str) -> Query:
    """Clauses of alternatives of trigrams that every match must contain; empty if there are none."""
    clauses: Query = []

    def close(run: list[str]) -> None:
        if min(map(len, run)) >= 3:
            ways = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted((w for w in ways if not any(o < w for o in ways)), key=sorted))  # a < b: b is implied

    def walk(nodes) -> None:
        run = [""]
        for node in nodes:
            more = _strings(node)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = ["".join(p) for p in product(run, more)]
                continue
            close(run)
            run = more if more is not None else [""]
            if more is None and str(node[0]) == "SUBPATTERN":
                walk(node[1][3])
            elif more is None and str(node[0]) == "MAX_REPEAT" and node[1][0] >= 1:
                walk(node[1][2])
        close(run)

    walk(_parser.parse(pattern))
    return clauses


def _digest() -> Column:
    return F.unhex(F.md5("text"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: one (_trigram, _text) row per trigram of the list and text that holds it."""
    folded = docs.select(_digest().alias("_text"), F.lower("text").alias("_folded")).filter(F.length("_folded") >= 3)
    present = F.array_compact(F.array(*(F.when(F.contains("_folded", F.lit(t)), F.lit(t)) for t in trigrams)))
    return folded.select(F.explode(present).alias("_trigram"), "_text")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_text, _rules): for each text with a fulfilled trigram query, the bits of the rules that may match."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    terms = sorted({t for q in queries.values() for clause in q for way in clause for t in way})
    place = {t: divmod(i, WORD_BITS) for i, t in enumerate(terms)}
    known = F.create_map(*(F.lit(x) for t in terms for x in (t, place[t][0]))), F.create_map(*(F.lit(x) for t in terms for x in (t, 1 << place[t][1])))
    words = range((len(terms) + WORD_BITS - 1) // WORD_BITS)
    bits = index.select("_text", known[0][F.col("_trigram")].alias("_word"), known[1][F.col("_trigram")].cast("long").alias("_bit"))
    met = bits.groupBy("_text").agg(*(F.bit_or(F.when(F.col("_word") == w, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in words))

    def holds(way: frozenset[str]) -> Column:
        test = F.lit(True)
        for w in words:
            mask = sum(1 << place[t][1] for t in way if place[t][0] == w)
            if mask:
                test &= F.col(f"_w{w}").bitwiseAND(F.lit(mask).cast("long")) == mask
        return test

    found = F.lit(0)
    for i, query in queries.items():
        every = F.lit(True)
        for clause in query:
            some = F.lit(False)
            for way in clause:
                some |= holds(way)
            every &= some
        found = found + F.when(every, 1 << i).otherwise(0)
    return met.select("_text", found.alias("_rules")).filter(F.col("_rules") != 0)


def _spans(rule: Rule, order: int) -> Column:
    """Spans of one rule as (start, order, end, kind), in code points: what stands between the matches gives the places."""
    parts, whole = F.split("text", rule.pattern, -1), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.char_length(x["part"])
        end = begin + F.char_length(x["whole"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        grown = F.when(F.char_length(x["piece"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("pos"), grown.alias("out"))

    zipped = F.zip_with(F.slice(parts, 1, F.size(whole)), F.zip_with(whole, group, lambda w, g: F.struct(w.alias("whole"), g.alias("piece"))),
                        lambda p, m: F.struct(p.alias("part"), m["whole"].alias("whole"), m["piece"].alias("piece")))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (_row, text, spans): the whole input row as a struct, its text (null: empty), and all spans (start, kind_order,
    end, kind) by start and rule order."""
    texts = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    terms = sorted({t for r in rules for clause in trigram_query(r.pattern) for way in clause for t in way})
    hits = candidates(postings(docs.select("text"), terms), rules)
    joined = texts.withColumn("_digest", _digest()).join(hits, F.col("_digest") == F.col("_text"), "left")
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")
    found = []
    for i, rule in enumerate(rules):
        may = F.col("_rules").bitwiseAND(1 << i) != 0 if trigram_query(rule.pattern) else F.col("text").rlike(rule.pattern)
        found.append(F.when(may, _spans(rule, i)).otherwise(none))
    return joined.select("_row", "text", F.array_sort(F.concat(*found)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, and all spans as text."""
    found = scan(docs.select("doc_id", "text")).select("_row.doc_id", "spans")
    many = lambda i: F.size(F.filter("spans", lambda s: s["kind_order"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind_order"] < len(BASE))
    return found.select("doc_id", *(many(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)), F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` (``n_chars`` follows where it exists); all rows stay."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        clear = F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], clear).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.char_length("text"))))
    found = scan(docs, rules).select("_row", F.when(F.size("spans") > 0, clean).alias("_clean"))
    own = {"text": F.coalesce("_clean", "_row.text"), "n_chars": F.coalesce(F.char_length("_clean").cast(dict(docs.dtypes).get("n_chars", "long")), "_row.n_chars")}
    return found.select(*((own[c] if c in own else F.col("_row").getField(c)).alias(c) for c in docs.columns))
