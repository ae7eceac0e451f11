"""Personal data: regular expressions propose, checksums confirm, context adjusts the score."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import map_arrow

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
BASE = 4
#: A span of the kinds beyond the base counts from this score.
THRESHOLD = 0.5
#: Score before context, and the words nearby that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.3}
RAISES = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
LOWERS = {
    "email": ("noreply", "no-reply"),
    "ip": ("version", "release"),
    "card": ("order", "isbn", "serial"),
    "phone": (),
    "iban": (),
    "local_phone": ("order", "isbn", "serial", "version"),
}
#: Characters on each side in which context words count.
NEAR = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_IBAN_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
#: Characters of an IBAN by country, spaces not counted.
IBAN_LENGTH = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
        28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the local part cannot hold one."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four dotted numbers each; a longer dotted run holds several matches, one after the other."""
    out = []
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, at = run.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def _digit_spans(pattern: re.Pattern, text: str, least: int, most: int, check=None) -> list[tuple[int, int]]:
    out = []
    for m in pattern.finditer(text):
        if m.end() - m.start() < least:
            continue
        digits = _NOT_DIGIT.sub("", m.group())
        if least <= len(digits) <= most and (check is None or check(digits)):
            out.append(m.span())
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Each ends at its country's length, or at the last end of a word in reach if the country is not known."""
    out, m = [], _IBAN.search(text)
    while m:
        ends = [e.end() for e in _IBAN_END.finditer(text, m.start() + 4, m.end() + 1) if e.end() <= m.end()]
        wanted = IBAN_LENGTH.get(text[m.start() : m.start() + 2])
        if wanted:
            ends = [e for e in ends if e - m.start() - text.count(" ", m.start(), e) == wanted]
        else:
            ends = [e for e in ends if e - m.start() - text.count(" ", m.start(), e) >= 15][-1:]
        at = m.start() + 1
        if ends and mod97(text[m.start() : ends[0]].replace(" ", "")):
            at = ends[0]
            out.append((m.start(), at))
        m = _IBAN.search(text, at)
    return out


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's prior, raised or lowered by whole words within NEAR characters."""
    near = set(_WORD.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    s = PRIOR[kind] + 0.3 * any(w in near for w in RAISES[kind]) - 0.3 * any(w in near for w in LOWERS[kind])
    return round(min(1.0, max(0.0, s)), 2)


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    """Spans (start, kind, end, score) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = [(0, emails(text)), (1, addresses(text)), (2, _digit_spans(_CARD, text, 14, 19, luhn))]
    found.append((3, _digit_spans(_PHONE, text, 10, 15) if "+" in text else []))
    found.append((4, ibans(text)))
    found.append((5, [m.span() for m in _LOCAL_PHONE.finditer(text)]))
    scored = [(s, k, e, score(KINDS[k], text, s, e)) for k, spans in found for s, e in spans]
    return sorted(x for x in scored if x[1] < BASE or x[3] >= THRESHOLD)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end, score), of every row of ``docs(doc_id, text)``.

    Base kinds are email, ip, card (Luhn) and phone: each match that passes its check stays,
    whatever its score.  IBANs (mod 97) and national phone numbers are added where their
    score, adjusted by words nearby, reaches THRESHOLD.  Kinds may overlap.  Null and empty
    texts have no spans; repeated rows return repeatedly; whole texts are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], ["doc_id", "spans"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")
