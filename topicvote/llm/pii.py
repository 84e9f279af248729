"""Personal data by weak supervision.

Base spans follow fixed patterns: email, ip, card and phone. Wider patterns propose more: numbers
in the forms of local phones, national ids and bank accounts, names after a title, and what the
fixed patterns find but reject. For every proposal, base spans too, six labelers vote private (1),
not private (-1) or nothing (0): the strict pattern, a checksum, a gazetteer, the words before
that speak for it, those that speak against it, and its borders.

Votes of all documents are counted by (kind, votes); expectation-maximisation on these counts
estimates each labeler's reliability and each kind's share of private spans, and so a probability
for every combination. A final span classifier (naive Bayes over the shape of the span, the words
around it and its kind) is trained on all proposals with these probabilities as soft labels. Its
features are hashed to ``FEATURE_SLOTS`` places, so counts and model have a fixed size.

A proposal that the classifier accepts is a span if it overlaps neither a base span nor an
accepted one before it. Base spans always stay. Null texts are empty.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicvote.llm.common import column, map_rows
from topicvote.session import materialise, ship_package

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "tel", "natid", "account", "name")
LABELERS = 6
ROUNDS = 30
SMOOTH = 1.0
FEATURE_SLOTS = 1 << 12
CONTEXT = 40
ACCEPT = 0.5

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WIDE = (
    ("tel", re.compile(r"(?<![0-9A-Za-z])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")),
    ("natid", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("account", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![0-9A-Za-z])")),
)
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?")
BEFORE = re.compile(
    r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|account|iban|ssn|social security|ip|host|"
    r"address|name|dear|write to|reach)\b"
)
AGAINST = re.compile(
    r"(?i)\b(?:version|release|isbn|issn|order|sku|part|model|serial|section|chapter|page|figure|ratio|sum|total|"
    r"equals|build|commit)\b"
)
TOP_LEVEL = frozenset("com org net edu gov io de fr es uk eu info biz example invalid test".split())
ISSUERS = ("4", "5", "34", "37", "6", "2", "30", "35", "36")


def digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(span: str) -> bool:
    code = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping emails: what stands before each @ is found backwards, so a long
    run of letters is read once."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def passes(kind: str, span: str) -> bool:
    """The conditions of a base kind beyond its pattern."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    number = digits(span)
    if kind == "card":
        return 14 <= len(number) <= 19 and luhn(number)
    return kind != "phone" or 10 <= len(number) <= 15


def proposals(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, base): all base spans and what else may be one, in text order."""
    found: list[tuple[int, int, int, bool]] = []
    if "@" in text:
        found += [(a, b, 0, True) for a, b in emails(text)]
    if DIGIT.search(text):
        for kind, pattern, least in ((1, IP, 0), (2, CARD, 12), (3, PHONE, 0)):
            for m in pattern.finditer(text):
                a, b = m.span()
                if b - a >= least:
                    base = passes(KINDS[kind], m[0])
                    if base or (kind != 2 or 12 <= len(digits(m[0])) <= 19):
                        found.append((a, b, kind, base))
        for kind, pattern in WIDE:
            found += [(*m.span(), KINDS.index(kind), False) for m in pattern.finditer(text)]
    found += [(*m.span(), KINDS.index("name"), False) for m in NAME.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def votes(text: str, start: int, end: int, kind: int, base: bool) -> tuple[int, ...]:
    span, name = text[start:end], KINDS[kind]
    before = text[max(0, start - CONTEXT) : start]
    strict = 1 if base else -1 if name in BASE else 0
    number = digits(span)
    check = 0
    if name == "card":
        check = 1 if luhn(number) else -1
    elif name == "account":
        check = 1 if mod97(span) else -1
    elif name == "natid":
        check = -1 if number[:3] in ("000", "666") or number[0] == "9" or number[3:5] == "00" else 1
    elif name == "ip":
        check = 1 if passes("ip", span) else -1
    gazetteer = 0
    if name == "email":
        gazetteer = 1 if span.rsplit(".", 1)[-1].lower() in TOP_LEVEL else -1
    elif name == "card":
        gazetteer = 1 if number.startswith(ISSUERS) else -1
    elif name in ("phone", "tel"):
        gazetteer = -1 if len(set(number)) <= 2 else 1
    elif name == "ip":
        gazetteer = -1 if span.startswith(("0.", "127.")) else 0
    edge = text[start - 1 : start] + text[end : end + 1]
    return (
        strict,
        check,
        gazetteer,
        1 if BEFORE.search(before) else 0,
        -1 if AGAINST.search(before) else 0,
        -1 if any(c.isalnum() or c in "._-/=" for c in edge) else 1,
    )


def features(text: str, start: int, end: int, kind: int) -> list[int]:
    """Places of a proposal's features, each with its kind."""
    span = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", span))))
    words = text[max(0, start - CONTEXT) : start].lower().split()[-2:] + text[end : end + CONTEXT].lower().split()[:1]
    named = [f"shape {shape[:24]}", f"size {len(span) // 4}", *(f"word {w}" for w in words)]
    named.append(f"edge {text[start - 1 : start].isspace()} {text[end : end + 1].isspace()}")
    return [zlib.crc32(f"{kind} {n}".encode()) % FEATURE_SLOTS for n in named]


@dataclass
class Model:
    """Log odds of each kind and each feature's place."""

    prior: dict[int, float] = field(default_factory=dict)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)

    def accepts(self, kind: int, places: list[int]) -> bool:
        odds = self.prior.get(kind, -1.0) + sum(self.weights.get((kind, p), 0.0) for p in places)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) >= ACCEPT


def reliabilities(counts: dict[tuple[int, tuple[int, ...]], int]) -> dict[tuple[int, tuple[int, ...]], float]:
    """The probability that a proposal is private, for each (kind, votes), by expectation-
    maximisation on their counts. A labeler's votes depend on the truth only; it starts from the
    majority of votes."""
    private = {k: 0.5 + 0.4 * max(-1, min(1, sum(k[1]))) for k in counts}
    for _ in range(ROUNDS):
        share: dict[int, list[float]] = {}
        tables = [{(v, y): SMOOTH for v in (-1, 0, 1) for y in (0, 1)} for _ in range(LABELERS)]
        for key, n in counts.items():
            kind, voted = key
            both = share.setdefault(kind, [SMOOTH, SMOOTH])
            for y, p in ((1, private[key]), (0, 1 - private[key])):
                both[y] += n * p
                for table, v in zip(tables, voted, strict=True):
                    table[v, y] += n * p
        sums = [{y: sum(t[v, y] for v in (-1, 0, 1)) for y in (0, 1)} for t in tables]
        for key in counts:
            kind, voted = key
            odds = math.log(share[kind][1] / share[kind][0])
            for table, total, v in zip(tables, sums, voted, strict=True):
                odds += math.log(table[v, 1] / total[1]) - math.log(table[v, 0] / total[0])
            private[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return private


def fit(docs: DataFrame, text_column: str = "text") -> Model:
    """The model from all proposals of all documents: one pass over the texts, one row for each
    combination of kind, votes and feature after summing."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            kinds, voted, places = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                for start, end, kind, base in proposals(text):
                    cast = ",".join(map(str, votes(text, start, end, kind, base)))
                    for place in (-1, *features(text, start, end, kind)):  # -1 counts the proposal
                        kinds.append(kind)
                        voted.append(cast)
                        places.append(place)
            arrays = [pa.array(kinds, pa.int32()), pa.array(voted, pa.string()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "votes", "place"])

    rows = docs.select(column(docs, text_column).alias("text"))
    found = rows.mapInArrow(run, "kind int, votes string, place int")
    counted = found.groupBy("kind", "votes", "place").agg(F.count(F.lit(1)).alias("n"))
    counted = materialise(counted, "votes")
    whole = counted.filter("place = -1").collect()
    cast = {(r["kind"], tuple(map(int, r["votes"].split(",")))): r["n"] for r in whole}
    private = reliabilities(cast)
    rows = [(k, ",".join(map(str, v)), p) for (k, v), p in private.items()]
    table = docs.sparkSession.createDataFrame(rows, "kind int, votes string, p double")
    soft = counted.filter("place >= 0").join(F.broadcast(table), ["kind", "votes"])
    sums = soft.groupBy("kind", "place").agg(
        F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")
    )
    places = sums.collect()
    model, yes, no = Model(), {}, {}
    for (kind, voted), n in cast.items():
        p = private[kind, voted]
        yes[kind], no[kind] = yes.get(kind, SMOOTH) + n * p, no.get(kind, SMOOTH) + n * (1 - p)
    for kind in yes:
        model.prior[kind] = math.log(yes[kind] / no[kind])
    for r in places:
        k = r["kind"]
        seen, unseen = (r["yes"] + SMOOTH) / (yes[k] + 2 * SMOOTH), (r["no"] + SMOOTH) / (no[k] + 2 * SMOOTH)
        model.weights[k, r["place"]] = math.log(seen) - math.log(unseen)
    return model


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text: (start, kind, end), by start and then kind."""
    proposed = proposals(text)
    base = [(a, k, b) for a, b, k, fixed in proposed if fixed]
    taken, added, end_of_last = sorted((a, b) for a, _, b in base), [], 0
    at = 0
    for a, b, kind, fixed in proposed:
        if fixed:
            continue
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        clear = a >= end_of_last and (at == len(taken) or taken[at][0] >= b)
        if clear and model.accepts(kind, features(text, a, b, kind)):
            added.append((a, kind, b))
            end_of_last = b
    return base, sorted(base + added)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


SPANS = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def spans(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ``SPANS`` of every row: counts and digest of the base spans, all spans as
    kind:start:end in code points."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *[part.split()[0] for part in SPANS.split(", ")]]

    def row(text):
        base, every = find(text or "", shared.value)
        kinds = [k for _, k, _ in base]
        counts = [kinds.count(k) for k in range(len(BASE))]
        return *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every)

    def run(batch):
        found = [row(t.as_py()) for t in batch.column("text")]
        columns = [batch.column("doc_id"), *[pa.array(v) for v in zip(*found, strict=True)]]
        yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(column(docs, id_column).alias("doc_id"), column(docs, text_column).alias("text"))
    return map_rows(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SPANS}")


def masked(text: str, model: Model) -> str:
    """The text with every span replaced by its kind in square brackets; overlapping spans are
    replaced together, by the kind of the first."""
    out, last = [], 0
    for a, kind, b in find(text, model)[1]:
        if a >= last:
            out += [text[last:a], f"[{KINDS[kind].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask(docs: DataFrame, model: Model, text_column: str = "text", size_column: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with masked texts; null texts stay null. ``size_column``, if it is one
    of the columns, gets the new length in code points."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def run(batch):
        texts = [t.as_py() for t in batch.column(place)]
        new = pa.array([None if t is None else masked(t, shared.value) for t in texts], batch.schema[place].type)
        yield batch.set_column(place, batch.schema[place], new)

    out = map_rows(docs, run, docs.schema)
    if size_column in docs.columns:
        size = F.length(column(out, text_column)).cast(docs.schema[size_column].dataType)
        out = out.withColumn(size_column, F.coalesce(size, column(out, size_column)))
    return out
