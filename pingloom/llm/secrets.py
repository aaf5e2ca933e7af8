"""Secret scan through a trigram inverted index.

From each rule's regular expression a Boolean query over lower-cased trigrams is derived: a conjunction of clauses, each a choice of
strings whose trigrams must all occur. Every run of rows gets an inverted index (trigram -> rows) of the trigrams that any rule asks
for; postings are united and intersected, and only the rows that remain are searched with the expression itself. A rule with no
mandatory trigram (a bare character class) is searched in every row.

The index is built and used inside the task that reads the rows, as search engines do with index segments: no text is shuffled, no
posting leaves its task, and a lost executor costs one task.

Defined cases: a null text is read as empty; an empty text has no span; rows repeat as they came; an empty table gives an empty
result; other columns, whatever their names, are ignored or kept as asked.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingloom.llm.common import fresh, map_texts, texts_of

MAX_STRINGS = 64  # a choice of more strings than this ends the current run of literals

Clause = frozenset  # of strings, one of which must occur
Query = tuple  # of clauses, all of which must hold


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = bool
    base: bool = False


# The base rules in listed order, then the rules only the method adds.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, True),
    Rule("hex", r"[0-9a-f]{24,}", bool, True),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?ai:bearer)\x20[A-Za-z0-9._~+/-]{20,}"),
)


def fold(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _strings(op, arg) -> frozenset | None:
    """The exact strings (ASCII-lower-cased) one parsed item can match; None if they are too many."""
    if op is sre.LITERAL:
        return frozenset([fold(chr(arg))])
    if op is sre.IN:
        out: set[str] = set()
        for kind, v in arg:
            if kind is sre.LITERAL:
                out.add(fold(chr(v)))
            elif kind is sre.RANGE and v[1] - v[0] < MAX_STRINGS:
                out |= {fold(chr(x)) for x in range(v[0], v[1] + 1)}
            else:
                return None
        return frozenset(out) if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        return None if None in parts else frozenset().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 2:
        inner = _sequence(arg[2])
        if inner is None:
            return None
        out, power = (set() if arg[0] else {""}), {""}
        for n in range(1, int(arg[1]) + 1):
            power = {a + b for a in power for b in inner}
            out |= power if n >= arg[0] else set()
        return frozenset(out)
    if op is sre.AT:
        return frozenset([""])
    return None


def _sequence(items) -> frozenset | None:
    runs = frozenset([""])
    for op, arg in items:
        more = _strings(op, arg)
        if more is None or len(runs) * len(more) > MAX_STRINGS:
            return None
        runs = frozenset(a + b for a in runs for b in more)
    return runs


def _clauses(items) -> list[Clause]:
    out, runs = [], frozenset([""])

    def flush():
        nonlocal runs
        out.append(runs)
        runs = frozenset([""])

    for op, arg in items:
        more = _strings(op, arg)
        if more is not None and len(runs) * len(more) <= MAX_STRINGS:
            runs = frozenset(a + b for a in runs for b in more)
            continue
        flush()
        if more is not None:
            runs = more
        elif op is sre.SUBPATTERN:
            out += _clauses(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            out += _clauses(arg[2])
    flush()
    return out


def trigram_query(pattern: str) -> Query:
    """Clauses that every match of ``pattern`` satisfies; strings of under three characters constrain nothing. () means: scan fully."""
    return tuple(c for c in dict.fromkeys(_clauses(parser.parse(pattern))) if c and all(len(s) >= 3 and s.isascii() for s in c))


def trigrams(s: str) -> list[str]:
    return [s[i:i + 3] for i in range(len(s) - 2)]


class Index:
    """Inverted index of one run of rows over the trigrams that the queries use."""

    def __init__(self, queries: list[Query]):
        self.grams = sorted({g for q in queries for clause in q for s in clause for g in trigrams(s)})
        self.wanted = np.zeros(1 << 24, bool)
        self.codes = {g: (ord(g[0]) << 16) | (ord(g[1]) << 8) | ord(g[2]) for g in self.grams}
        self.wanted[list(self.codes.values())] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def build(self, texts: pa.Array) -> None:
        self.rows = len(texts)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        self.postings: dict[int, np.ndarray] = {}
        if data is None or offsets[-1] - offsets[0] < 3:
            return
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
        low = self.lower[raw].astype(np.uint32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(self.wanted[codes])
        row = np.searchsorted(offsets, at + offsets[0], "right") - 1
        inside = at + offsets[0] + 3 <= offsets[row + 1]
        pairs = np.unique(codes[at[inside]].astype(np.int64) * (self.rows + 1) + row[inside])
        code, row = np.divmod(pairs, self.rows + 1)
        edges = np.flatnonzero(np.diff(code)) + 1
        for c, r in zip(code[np.r_[0, edges]].tolist() if len(code) else [], np.split(row, edges), strict=False):
            self.postings[c] = r

    def find(self, query: Query) -> np.ndarray:
        rows = np.arange(self.rows)
        for clause in query:
            either = np.zeros(0, np.int64)
            for s in clause:
                hit = rows
                for g in trigrams(s):
                    hit = np.intersect1d(hit, self.postings.get(self.codes[g], either[:0]), assume_unique=True)
                either = np.union1d(either, hit)
            rows = either
        return rows


_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def scanner(rules: tuple[Rule, ...]) -> Callable[[pa.Array], list[list[tuple[int, int, int]]]]:
    """A function from texts to the spans (rule number, start, end) of each, by start and then rule."""
    state: dict[str, object] = {}

    def scan(texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        if not state:  # built where the tasks run: the table of wanted trigrams is 16 MB
            state["queries"] = [trigram_query(r.pattern) for r in rules]
            state["index"] = Index(state["queries"])
            state["compiled"] = [re.compile(r.pattern) for r in rules]
        index: Index = state["index"]
        index.build(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        plain = texts.to_pylist()
        for k, (rule, query, rx) in enumerate(zip(rules, state["queries"], state["compiled"], strict=True)):
            for i in index.find(query).tolist():
                out[i] += [(k, *m.span()) for m in rx.finditer(plain[i]) if rule.accept(m)]
        for spans in out:
            spans.sort(key=lambda s: (s[1], s[0]))
        return out

    return scan


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns ``keep`` (default: all) and ``spans``: array of (kind = rule number, start, end) in code points, end exclusive."""
    kept = docs.columns if keep is None else keep
    (spans,) = fresh(docs.columns, "spans")
    scan = scanner(rules)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        found = scan(texts_of(part.column(text)))
        return [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in found], _ARROW)]

    wanted = [*kept, *(c for c in [text] if c not in kept)]
    return map_texts(docs.select(*wanted), text, [T.StructField(spans, T.ArrayType(_SPAN))], work, kept)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: counts of base spans by kind, a digest of the base spans, all spans."""
    found = find(docs, "text", ["doc_id"], rules)
    spans = found.columns[-1]
    base = [k for k, r in enumerate(rules) if r.base]
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def listed(chosen):
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")

    def count(k):
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{rules[k].kind}") for k in base]
    only_base = F.filter(spans, lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(listed(only_base), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans"))
