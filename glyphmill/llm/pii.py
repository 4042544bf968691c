"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Base kinds (email, ip, card, phone) stand as soon as their own check holds.  Further kinds (iban, ssn, short_card,
local_phone) need a score of ``ACCEPT``: a start value for the pattern, more for a checksum, more for a context word
close by, and they never overlap a base span.  Everything is local to a row, so there is no shuffle at all.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphmill.llm.base import read, ship, text_slices

#: The base patterns, in the order in which kinds are listed.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match starts where a run of digits does, which gives the same spans as the bare pattern without searching a long run again from each digit.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")

#: Further kinds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SHORT_CARD = re.compile(r"(?<![0-9-])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{2,5}\)?[\x20/-][0-9]{3,}(?:[\x20-][0-9]{2,})*(?![0-9.-])")
MORE_KINDS = ("iban", "ssn", "short_card", "local_phone")
KINDS = (*BASE_KINDS, *MORE_KINDS)
#: Lengths of the registered countries' IBANs and of those in use elsewhere.
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO FK GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA MG ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in countries.split()}
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "fax"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social", "security"),
    "short_card": ("card", "amex", "visa", "karte", "carte", "tarjeta"),
    "local_phone": ("phone", "tel", "call", "mobile", "telefon", "fax"),
}
#: Score of the pattern alone, and of the pattern with its checksum.
START = {"email": 0.9, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "ssn": 0.3, "short_card": 0.0, "local_phone": 0.3}
CHECKED = {"card": 0.8, "iban": 0.8, "short_card": 0.3}
BONUS = 0.35
NEAR = 40
ACCEPT = 0.6
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ibans(text: str) -> list[tuple[int, int]]:
    """Matches that mod-97 confirms, by start: cut to the country's length, then, between these, others as far as they hold up to a space.

    What follows a number may look like a part of it, and what comes before one like its beginning: after a match
    the search goes on at its end, after a failure behind its first character.
    """
    found: list[tuple[int, int]] = []
    for registered in (True, False):
        before = _union(found)
        match = IBAN.search(text)
        while match:
            start, end = match.span()
            at, size = start + 1, IBAN_LENGTHS.get(text[start:start + 2])
            while registered == (size is not None) and end > start:
                code = text[start:end].replace(" ", "")
                if len(code) < (size or 15):
                    break
                if size in (None, len(code)) and mod97(code) and _free(before, start, end):
                    found.append((start, end))
                    at = end
                    break
                end = text.rfind(" ", start, end)
            match = IBAN.search(text, at)
    return sorted(found)


def _union(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that any of ``spans`` takes, sorted and disjoint."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _free(union: tuple[list[int], list[int]], start: int, end: int) -> bool:
    starts, ends = union
    at = bisect_right(ends, start)
    return at == len(starts) or end <= starts[at]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from one @ to the next: a match starts where the run of allowed characters before it does."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return found


def _score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    words = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR):start] + " " + text[end:end + NEAR // 2])}
    near = BONUS if words & set(CONTEXT[kind]) else 0.0
    return min(1.0, (CHECKED[kind] if checked else START[kind]) + near)


def find_spans(text: str) -> list[Span]:
    """Base spans in order of kind and start, then the further ones likewise."""
    base = base_spans(text)
    out = [Span(k, a, b, _score(text, k, a, b, k in CHECKED)) for k, a, b in base]
    taken = [(a, b) for _, a, b in base]
    more = {
        "iban": [(*span, True) for span in _ibans(text)],
        "ssn": [(*m.span(), False) for m in SSN.finditer(text)],
        "short_card": [(*m.span(), luhn(_DIGITS.sub("", m.group()))) for m in SHORT_CARD.finditer(text)],
        "local_phone": [(*m.span(), False) for m in LOCAL_PHONE.finditer(text) if 7 <= len(_DIGITS.sub("", m.group())) <= 12],
    }
    for kind, matches in more.items():  # matches of one kind do not overlap each other
        places = _union(taken)
        for start, end, checked in matches:
            if (checked or kind not in CHECKED) and _free(places, start, end):
                score = _score(text, kind, start, end, checked)
                if score >= ACCEPT:
                    taken.append((start, end))
                    out.append(Span(kind, start, end, score))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced once, by the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at:s.start], f"<{s.kind.upper()}>"]
            at = s.end
        else:
            at = max(at, s.end)
    return "".join(out) + text[at:]


FIELDS = ("doc_id {id}, spans array<struct<kind:string,start:int,end:int,score:double>>, base string, text string")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans, base (kind:start:end of base spans, comma-joined), text with spans replaced (null without ``with_text``).

    Offsets are code points, end exclusive.  A null text counts as empty and has no spans; null ids and repeated rows are
    rows like others.  No rows give no rows; other columns are not looked at.
    """
    ship(docs.sparkSession)
    schema = FIELDS.format(id=docs.schema[id_col].dataType.simpleString())
    digit = re.compile("[0-9@]")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for part in text_slices(batch, 1):
                texts = part.column(1).to_pylist()
                spans = [find_spans(t) if digit.search(t) else [] for t in texts]
                base = [",".join(f"{s.kind}:{s.start}:{s.end}" for s in x if s.kind in BASE_KINDS) for x in spans]
                clean = [redacted(t, x) for t, x in zip(texts, spans)] if with_text else [None] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([[s._asdict() for s in x] for x in spans], kind), pa.array(base, pa.string()), pa.array(clean, pa.string())],
                    names=["doc_id", "spans", "base", "text"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(work, schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the number of spans of each further kind and the score of each span of ``spans``, in two digits."""
    found = scan(read(spark, sf_dir, "documents"), with_text=False)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    scores = F.transform("spans", lambda s: F.format_number(s["score"], 2))
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2("base", 256).alias("base_sha256"), F.array_join(written, ",").alias("spans"),
        *[count(k) for k in MORE_KINDS], F.array_join(scores, ",").alias("scores"))
