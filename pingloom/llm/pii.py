"""Personal data by weak supervision.

Labelers (shape, checksum or range, gazetteer, words around) vote on candidate spans. Expectation-maximisation over the counted vote
patterns of all candidates estimates how reliable each labeler is; the posteriors train a logistic span classifier on hashed features,
and the classifier decides which candidates beyond the base patterns are personal data.

Defined cases: a null text is read as empty; an empty text has no span; rows repeat as they came, each with its own result; an empty
table gives an empty result; other columns, whatever their names, are ignored by ``report`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingloom.llm.common import fresh, map_texts, slices, texts_of
from pingloom.plans.stages import materialize

# The base kinds in listed order, then the kinds that only the method finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "localphone", "ssn", "account", "address", "person")

# Word lists of the gazetteer and context labelers.
GIVEN = frozenset("james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah anna maria peter hans klaus pierre jean marie juan carlos carmen luis".split())
STREETS = frozenset("street st road rd avenue ave lane ln drive dr boulevard blvd court ct way square".split())
CUES = frozenset("mail email e-mail phone tel telephone call fax mobile cell contact reach card credit visa mastercard account iban ssn social security ip host address lives born name mr mrs ms dr signed".split())
COUNTER = frozenset("isbn issn version release order invoice part item page chapter section figure table model serial eq equation lot build".split())

MAX_TRAIN = 20_000  # kinds of candidates the span classifier is fitted on, smallest hash first
BUCKETS = 256

_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCALPHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ADDRESS = re.compile(r"(?<![0-9])[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?=([A-Za-z]{2,9}))\1(?![A-Za-z])")
_PERSON = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr)\.\x20|\b(?:[Nn]ame is|[Ss]igned by|[Cc]ontact)\x20)([A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20}){1,2})(?![a-z])")
_WORD = re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their @ signs: linear in the text's length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def _part_ok(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) < 4 and int(p or 0) <= 255


def numbers(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans of the kinds made of digits, spans of their shape that fail the check)."""
    good, bad = [], []
    for m in _IP.finditer(text):
        (good if all(map(_part_ok, m[0].split("."))) else bad).append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            (good if luhn(digits) else bad).append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        n = sum(map(str.isdigit, m[0]))
        (good if 8 <= n <= 15 else bad).append((3, *m.span()))
    return good, bad


def _near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48):start])]
    return before[-4:], [w.lower() for w in _WORD.findall(text[end:end + 32])][:3]


def _votes(text: str, kind: int, start: int, end: int, shape: int, valid: int, gazetteer: int) -> tuple[str, list[int]]:
    before, after = _near(text, start, end)
    around = {*before, *after}
    cue = 1 if around & CUES else 0
    counter = -1 if around & COUNTER else 0
    glued = -1 if (text[start - 1:start].isalnum() or text[end:end + 1].isalnum()) else 0
    votes = "".join("-0+"[v + 1] for v in (shape, valid, gazetteer, cue, counter, glued))
    words = [f"b:{w}" for w in before[-2:]] + [f"a:{w}" for w in after[:1]]
    span = text[start:end]
    traits = [f"kind:{kind}", f"len:{min(len(span), 40) // 4}", f"digits:{min(sum(map(str.isdigit, span)), 24) // 3}", f"cue:{cue}", f"counter:{counter}", f"glued:{glued}", f"shape:{kind}:{shape}", f"valid:{valid}", f"gaz:{gazetteer}", *words]
    return votes, sorted({int.from_bytes(hashlib.blake2b(t.encode(), digest_size=4).digest()) % BUCKETS for t in traits})


def candidates(text: str) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """(kind, start, end, is base, votes, features) in the order of kind and start."""
    found: list[tuple[int, int, int, bool, int, int, int]] = []
    if "@" in text:
        found += [(0, a, b, True, 1, 1, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        good, bad = numbers(text)
        found += [(k, a, b, True, 1, 1, 0) for k, a, b in good]
        found += [(6, a, b, False, 1, -1, 0) for k, a, b in bad if k == 2]
        found += [(4, *m.span(), False, 1, 0, 0) for m in _LOCALPHONE.finditer(text)]
        found += [(5, *m.span(), False, 1, 0 if m[0][:3] not in ("000", "666") and m[0][0] != "9" else -1, 0) for m in _SSN.finditer(text)]
        found += [(7, *m.span(), False, 0, 0, 1 if m[1].lower() in STREETS else -1) for m in _ADDRESS.finditer(text)]
    if "." in text or "is " in text or "ontact " in text or "by " in text:
        for m in _PERSON.finditer(text):
            known = any(w.lower() in GIVEN for w in m[1].split())
            found.append((8, m.start(1), m.end(1), False, 1 if text[m.start()] in "MD" else 0, 0, 1 if known else 0))
    return [(k, a, b, base, *_votes(text, k, a, b, s, v, g)) for k, a, b, base, s, v, g in sorted(found)]


_SPAN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("votes", T.StringType()), T.StructField("features", T.ArrayType(T.IntegerType()))])
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))


def em(counts: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Posterior of being personal data for each vote pattern, from the pattern counts alone (two-class, abstaining labelers)."""
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    votes = np.array([["-0+".index(c) for c in k] for k in keys])
    p = np.clip(0.5 + 0.2 * (votes - 1).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = float(np.clip((n * p).sum() / n.sum(), 0.05, 0.95))
        odds = np.full(len(keys), math.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            for v in range(3):
                hit = votes[:, j] == v
                # a labeler says more than chance in its own direction: pseudo-counts keep the classes from swapping
                yes, no = (8.0, 2.0) if v == 2 else (2.0, 8.0) if v == 0 else (5.0, 5.0)
                a = ((n * p)[hit].sum() + yes) / ((n * p).sum() + 15)
                b = ((n * (1 - p))[hit].sum() + no) / ((n * (1 - p)).sum() + 15)
                odds[hit] += math.log(a / b)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def fit(rows: list[tuple[list[int], float, int]], epochs: int = 30) -> np.ndarray:
    """Logistic weights (the last is the bias) by gradient descent on (features, soft label, number of such rows)."""
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    lengths = np.array([len(f) for f, _, _ in rows])
    idx = np.concatenate([np.array(f, int) for f, _, _ in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    y, many = np.array([v for _, v, _ in rows]), np.array([n for _, _, n in rows], float)
    hits = np.maximum(np.bincount(idx, many[row], BUCKETS), 1)
    for _ in range(epochs * 10):
        z = np.bincount(row, w[idx], len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * many
        w[:-1] -= 0.5 * (np.bincount(idx, g[row], BUCKETS) / (hits + 10) + 1e-3 * w[:-1])
        w[-1] -= 0.5 * g.sum() / many.sum()
    return w


def accepted(cands: list[tuple], w: list[float]) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, is base): base spans stay; others if the classifier agrees and nothing accepted before overlaps them.

    The others are tried in the order of kind and start. A kind's own spans rise and don't overlap, so a sweep beside the spans
    accepted until then, merged, finds overlaps: linear in the number of candidates for each kind.
    """
    out = sorted(c[:4] for c in cands if c[3])
    taken = _merged([(c[1], c[2]) for c in out])
    wanted = [c[:4] for c in cands if not c[3] and w[-1] + sum(w[f] for f in c[5]) >= 0]
    for _, spans in groupby(sorted(wanted), key=lambda c: c[0]):
        new, at, done = [], 0, -1
        for span in spans:
            while at < len(taken) and taken[at][1] <= span[1]:
                at += 1
            if span[1] >= done and not (at < len(taken) and taken[at][0] < span[2]):
                new.append(span)
                done = span[2]
        out += new
        taken = _merged([*taken, *((c[1], c[2]) for c in new)])
    return sorted(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as rising spans that don't overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def learn(found: DataFrame, cands: str, max_train: int = MAX_TRAIN) -> list[float]:
    """Weights of the span classifier. The vote patterns of all candidates are counted (at most 3^6 rows reach the driver); the
    classifier is fitted to their posteriors on the at most ``max_train`` distinct kinds of candidates (equal votes and features) of
    smallest hash, each with the number of candidates like it as its weight, so that copies of one take one place."""
    each = found.select(F.explode(cands).alias("c")).select("c.*")
    alike = materialize(each.groupBy("votes", "features").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("votes", "features")))
    counts = {r["votes"]: r["n"] for r in alike.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    posterior = em(counts)
    # about twice the wanted number by hash first, so that what tasks send to be sorted doesn't grow with their number
    share = min(1.0, 2 * max_train / max(1, alike.count()))
    sample = alike.where(F.pmod("h", F.lit(1 << 31)) < share * (1 << 31)).orderBy("h", "votes", "features").limit(max_train).collect()
    return fit([(r["features"], posterior[r["votes"]], r["n"]) for r in sample]).tolist()


_NAMES = ("kind", "start", "end", "base", "votes", "features")


def proposed(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the candidates of each document."""
    (cands,) = fresh(docs.columns, "cands")

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([[dict(zip(_NAMES, c, strict=True)) for c in candidates(t)] for t in texts_of(part.column(text)).to_pylist()], _ARROW)]

    return map_texts(docs.select(*dict.fromkeys([*keep, text])), text, [T.StructField(cands, T.ArrayType(_SPAN))], work, keep)


def find(docs: DataFrame, text: str, keep: list[str], max_train: int = MAX_TRAIN) -> DataFrame:
    """Columns ``keep`` and ``spans``: array of (kind, start, end, base), base spans and the accepted others, in order.

    One pass over the texts writes the candidates, small beside the texts; what follows reads only those.
    """
    found = materialize(proposed(docs, text, keep))
    cands = found.columns[-1]
    w = learn(found, cands, max_train)
    (spans,) = fresh(found.columns, "spans")
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            rows = [accepted([tuple(c[n] for n in _NAMES) for c in row], w) for row in batch.column(cands).to_pylist()]
            out = pa.array([[dict(zip(_NAMES, x, strict=False)) for x in row] for row in rows], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), out], names=[*keep, spans])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(spans, T.ArrayType(T.StructType(_SPAN.fields[:4])))])
    return found.mapInArrow(run, schema)


def listed(spans: str, only_base: bool = False):
    """``kind:start:end`` of the spans, comma-joined (they are in listed order already)."""
    chosen = F.filter(spans, lambda s: s["base"]) if only_base else F.col(spans)
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, a digest of the base spans, all spans."""
    found = find(docs, "text", ["doc_id"])
    spans = found.columns[-1]
    def count(k):
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == k))).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(spans, True), 256).alias("base_sha256"), listed(spans).alias("spans"))


def redact(docs: DataFrame, text: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; all rows and columns stay, a null text stays null.

    The texts are read twice, to learn and to replace, and not written in between.
    """
    found = materialize(proposed(docs, text, []))
    w = learn(found, found.columns[-1], max_train)
    marks, columns = [f"<{k.upper()}>" for k in KINDS], docs.columns

    def replaced(t: str | None) -> str | None:
        out, done = [], 0
        for kind, a, b, _ in sorted(accepted(candidates(t), w), key=lambda s: (s[1], -s[2])) if t else ():
            if a >= done:
                out += [t[done:a], marks[kind]]
            done = max(done, b)
        return "".join(out) + t[done:] if out else t

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                new = pa.array(map(replaced, part.column(text).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([new if c == text else part.column(c) for c in columns], names=columns)

    return docs.mapInArrow(run, docs.schema)
