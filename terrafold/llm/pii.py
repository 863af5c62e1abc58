"""Personal data by weak supervision: labelers vote on candidate spans, EM estimates how reliable they are, and a span
classifier learnt from the result decides.

Base spans match strict patterns and always stay. Candidates are spans of looser patterns. Labelers say yes, no or
nothing: strict form, structure (checksum, ranges, digit counts), gazetteers (name endings, issuers, country codes),
words before the span, and whether the span stands by itself. All documents' votes are counted by Spark in a table whose
size is bounded by the number of vote patterns and span shapes; EM and the classifier (naive Bayes over the span's
shape, trained with EM's probabilities) work on that table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.shared import ship_package, written
from terrafold.llm.textbytes import slices

KINDS = ("email", "ip", "card", "phone")
LABELERS = 5
#: A candidate is added from this probability on.
SURE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never begins inside a run of digits unless it could also begin where the run does, so asking for the run's
# beginning changes nothing but the time that long runs take.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Gazetteers: fixed values. Endings of domains, first digits of card issuers, country codes of telephone numbers.
_ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be ch at pl se no dk fi pt ie eu us ca mx br ar cl in cn jp kr au nz za ru".split())
_ISSUERS = ("4", "34", "35", "36", "37", "38", "51", "52", "53", "54", "55", "60", "62", "64", "65", "22", "23", "24", "25", "26", "27")
_COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "353", "358", "420")
#: Words before a span that speak for its kind.
_CUES = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|courriel|correo|kontakt|write to|address)\W*(?:\w+\W+){0,2}$"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|addr|address|from|adresse)\W*(?:\w+\W+){0,2}$"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|credit|carte|karte|tarjeta|cc)\W*(?:\w+\W+){0,2}$"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|téléphone|teléfono|whatsapp)\W*(?:\w+\W+){0,2}$"),
}

_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}){1,4}")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?|00[1-9][0-9 ]{0,3})?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time: each @ has one run before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Start and end, in code points, of strict matches by kind."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                cards.append(m.span())
    phones = []
    if "+" in text:
        phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return {"email": _emails(text) if "@" in text else [], "ip": ips, "card": cards, "phone": phones}


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int, bool]]:
    """kind, start, end and strictness: base spans, and looser ones that touch none of them of any kind."""
    out = [(k, s, e, True) for k, kind in enumerate(KINDS) for s, e in base[kind]]
    taken = _union([(s, e) for _, s, e, _ in out])
    loose = []
    if "at" in text and ("(at)" in text or "[at]" in text or "{at}" in text):
        loose.append((0, _LOOSE_EMAIL))
    for k, pattern in (*loose, (2, _LOOSE_CARD), (3, _LOOSE_PHONE)):
        free = _apart([m.span() for m in pattern.finditer(text)], taken)
        out += [(k, s, e, False) for s, e in free]
        if free:
            taken = _union([*taken, *free])
    return out


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those spans that overlap none of taken; both are in order and without overlaps, so one sweep over the two does."""
    out, k = [], 0
    for s, e in spans:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k == len(taken) or taken[k][0] >= e:
            out.append((s, e))
    return out


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, int]:
    """A vote pattern (base 3: 0 no, 1 nothing, 2 yes, one digit for each labeler) and a shape of the span."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    if name == "email":
        ending = re.split(r"[.\])}]", span)[-1].strip().lower()
        structure, listed = 2 if ".." not in span and not span.startswith(".") else 0, 2 if ending in _ENDINGS else 1
    elif name == "ip":
        parts = span.split(".")
        structure, listed = 2 if all(p == "0" or not p.startswith("0") for p in parts) else 0, 0 if parts[0] == "0" else 1
    elif name == "card":
        structure, listed = 2 if luhn(digits) else 0, 2 if digits.startswith(_ISSUERS) else 0
    else:
        structure = 2 if 10 <= len(digits) <= 13 else 1
        listed = 2 if strict and digits.startswith(_COUNTRIES) else 1
    cue = 2 if _CUES[name].search(text[max(0, start - 40) : start]) else 1
    before, after = text[start - 1 : start], text[end : end + 1]
    alone = 0 if (before.isalnum() or after.isalnum()) else 2
    pattern = 0
    for v in (2 if strict else 1, structure, listed, cue, alone):
        pattern = pattern * 3 + v
    gaps = (1 if " " in span else 0) + (2 if "-" in span else 0) + (4 if "(" in span or "[" in span or "{" in span else 0)
    edge = (1 if before in ("", " ", "\n", "\t") else 0) + (2 if after in ("", " ", "\n", "\t", ".", ",") else 0)
    return pattern, (min(len(digits), 20) * 8 + gaps) * 4 + edge


_FOUND = "doc_id long, base string, n array<long>, kind array<int>, start array<long>, end array<long>, pattern array<int>, shape array<int>"


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """For every row: base spans as kind:start:end, how many by kind, and all candidates with votes and shapes."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                out: list[list] = [[] for _ in range(7)]
                for value in part.column("text").to_pylist():
                    value = value or ""
                    base = base_spans(value)
                    found = candidates(value, base)
                    seen = [votes(value, *c) for c in found]
                    row = [",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k]), [len(base[k]) for k in KINDS], *([c[k] for c in found] for k in range(3)), *([v[k] for v in seen] for k in range(2))]
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=[x.split()[0] for x in _FOUND.split(", ")])

    return rows.mapInArrow(run, _FOUND)


def reliabilities(pattern: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns of one kind: the probability of each pattern being personal data, and how often
    each labeler, when it votes, says yes on other spans and on personal data (2 x labelers).

    A labeler that says nothing is no evidence. Rates lean a little to labelers being right, so that yes stays yes.
    """
    digits = np.stack([pattern // 3 ** (LABELERS - 1 - k) % 3 for k in range(LABELERS)], 1)
    yes, no = digits == 2, digits == 0
    p = np.clip(0.5 + 0.15 * (digits - 1).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = np.clip((p * n).sum() / n.sum(), 0.05, 0.95)
        rate = np.zeros((2, LABELERS))
        for c, (w, lean) in enumerate((((1 - p) * n, (1.0, 3.0)), (p * n, (3.0, 1.0)))):
            said = (w[:, None] * yes).sum(0), (w[:, None] * no).sum(0)
            rate[c] = (said[0] + lean[0]) / (said[0] + said[1] + sum(lean))
        odds = np.log(prior / (1 - prior)) + (yes * np.log(rate[1] / rate[0])).sum(1) + (no * np.log((1 - rate[1]) / (1 - rate[0]))).sum(1)
        p = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return p, rate


def classifier(kind: np.ndarray, pattern: np.ndarray, shape: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each counted (kind, pattern, shape): the probability of being personal data, by a naive Bayes classifier over
    kind, digits, gaps and edges that EM's probabilities train, joined with EM's own."""
    out = np.zeros(len(kind))
    for k in np.unique(kind):
        own = np.flatnonzero(kind == k)
        patterns, inverse = np.unique(pattern[own], return_inverse=True)
        p, _ = reliabilities(patterns, np.bincount(inverse, n[own]))
        p = p[inverse]
        logit = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
        shapes = logit.copy()
        total = np.array([((1 - p) * n[own]).sum(), (p * n[own]).sum()]) + 1
        for feature in (shape[own] // 32, shape[own] // 4 % 8, shape[own] % 4):
            counts = np.stack([np.bincount(feature, (1 - p) * n[own], 32), np.bincount(feature, p * n[own], 32)]) + 0.5
            rate = counts / total[:, None]
            shapes += np.clip(np.log(rate[1] / rate[0]), -3, 3)[feature]
        out[own] = 1 / (1 + np.exp(-np.clip(shapes, -500, 500)))
    return out


def personal_data(docs: DataFrame, text: str = "text", sure: float = SURE) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    spans holds kind:start:end of base spans and of added candidates, by kind and start, comma-joined. Null texts
    count as empty; repeated rows each; an empty table gives no rows; further columns are ignored.
    """
    found = written(find(docs, text), "pii")
    each = found.select(F.explode(F.arrays_zip("kind", "pattern", "shape")).alias("c")).groupBy("c.kind", "c.pattern", "c.shape").count()
    table = each.toArrow()  # bounded by kinds, patterns and shapes
    kind, pattern, shape, n = (table[k].to_numpy() for k in ("kind", "pattern", "shape", "count"))
    scores = dict(zip(zip(kind.tolist(), pattern.tolist(), shape.tolist(), strict=True), classifier(kind, pattern, shape, n).tolist(), strict=True)) if len(kind) else {}
    held = found.sparkSession.sparkContext.broadcast(scores)
    strict = 2 * 3 ** (LABELERS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            spans, sums, added = [], [], []
            for k in range(batch.num_rows):
                kept = []
                for c in zip(*(rows[x][k] for x in ("kind", "start", "end", "pattern", "shape")), strict=True):
                    if c[3] >= strict or held.value[c[0], c[3], c[4]] >= sure:
                        kept.append(c[:3])
                spans.append(",".join(f"{KINDS[c[0]]}:{c[1]}:{c[2]}" for c in sorted(kept)))
                sums.append(hashlib.sha256(rows["base"][k].encode()).hexdigest())
                added.append(len(kept) - sum(rows["n"][k]))
            counts = [pa.array([x[j] for x in rows["n"]], pa.int64()) for j in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
