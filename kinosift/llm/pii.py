"""Operator 4: personal data.

Regular expressions propose spans, validators (address parts, Luhn, mod 97, digit counts) confirm them, and
context words near a span adjust its score.  Proposals run in time linear in the text: repeats are
possessive and addresses are grown from their @ sign, so long runs of digits or letters cost nothing extra.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinosift.llm.runtime import id_and_text, ship, slices

BASE_KINDS = ("email", "ip", "card", "phone")
#: The method's own kinds follow the base kinds in the order of equal starts.
KINDS = (*BASE_KINDS, "iban", "national_id", "local_phone")
_ORDER = {kind: at for at, kind in enumerate(KINDS)}
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_SOME = re.compile(r"[0-9@]").search
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The longest run that can hold an account number, at every place where one can start.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NEAR_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")

#: Characters of an account number by country; of other countries every end is tried, the longest first.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}

#: Characters on either side of a span in which context words count.
NEARBY = 40
#: Score before and gain from a context word, by kind; spans of the method's own kinds need THRESHOLD.
SCORES = {"email": (0.8, 0.1), "ip": (0.6, 0.2), "card": (0.9, 0.1), "phone": (0.7, 0.2), "iban": (0.9, 0.1), "national_id": (0.4, 0.4), "local_phone": (0.4, 0.3)}
THRESHOLD = 0.6
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account"),
    "national_id": ("ssn", "social security", "national id", "tax id"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number leaves 1 by 97 after its first four characters are moved to its end."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield Span("email", start, done)
        at = text.find("@", max(at + 1, done))


def _base(text: str) -> list[Span]:
    found = list(_emails(text))
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match[0].split(".")):
            found.append(Span("ip", *match.span()))
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(Span("card", *match.span()))
    for match in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum("0" <= c <= "9" for c in match[0]) <= 15:
            found.append(Span("phone", *match.span()))
    return found


def _ibans(text: str):
    done = 0
    for match in _IBAN.finditer(text):
        start, run = match.start(), match[1]
        if start < done:
            continue
        length, n, ends = IBAN_LENGTHS.get(run[:2]), 0, []
        for at, c in enumerate(run, start + 1):
            n += c != " "
            if c != " " and (n == length if length else n >= 15) and text[at : at + 1] not in _ALNUM:
                ends.append(at)
        for end in reversed(ends):
            if mod97(text[start:end].replace(" ", "")):
                done = end
                yield Span("iban", start, end)
                break


def _more(text: str) -> list[list[Span]]:
    """The method's own kinds, the stronger first."""
    patterns = (("national_id", _NATIONAL), ("local_phone", _NEAR_PHONE))
    return [list(_ibans(text)), *([Span(kind, *m.span()) for m in pattern.finditer(text)] for kind, pattern in patterns)]


def _score(text: str, span: Span) -> float:
    near = (text[max(0, span.start - NEARBY) : span.start] + " " + text[span.end : span.end + NEARBY]).lower()
    score, gain = SCORES[span.kind]
    hit = any(re.search(rf"\b{re.escape(word)}", near) for word in CONTEXT[span.kind])
    return round(score + gain * hit, 6)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; ends are exclusive, positions count code points."""
    if not _SOME(text):
        return []
    spans = [(s.kind, s.start, s.end, _score(text, s)) for s in _base(text)]
    starts, ends = _covered(spans)
    for kind in _more(text):
        added = []
        for extra in kind:  # in order, none over another of its kind
            at = bisect.bisect_left(starts, extra.end) - 1  # the last stretch taken that begins before its end
            if (at < 0 or ends[at] <= extra.start) and (score := _score(text, extra)) >= THRESHOLD:
                added.append((extra.kind, extra.start, extra.end, score))
        if added:
            spans += added
            starts, ends = _covered(spans)
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]]))


def _covered(spans: list[tuple]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, apart from each other and in order."""
    starts, ends = [], []
    for start, end in sorted(s[1:3] for s in spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def mask(text: str) -> str:
    """The text with each span replaced by its kind in square brackets; spans that overlap become one."""
    out, done = [], 0
    for kind, start, end, _ in find(text):
        if start >= done or not out:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text


def spans_of(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and spans.

    Null texts count as empty and have no spans; null doc_ids and repeated rows are kept; other columns
    are ignored.
    """
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([find(t) for t in batch.column(1).to_pylist()], kind)], names=["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, spans {SPANS}")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data masked in the text; null texts stay null and all columns stay."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches, at):
            texts = [t if t is None else mask(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as one string."""
    of = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("spans", of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return spans.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
