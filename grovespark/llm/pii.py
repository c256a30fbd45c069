"""Personal data in texts: patterns propose, checksums confirm, words nearby move the score.

The four base kinds (email, ip, card, phone) are always reported when they pass their own tests.
Further kinds start from a score of their pattern, gain by a checksum and by context words within
CONTEXT_CHARS, and are reported from THRESHOLD on.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import bounded_batches, own, table

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "secret", "ssn", "local_phone")
KINDS = BASE_KINDS + MORE_KINDS
THRESHOLD = 0.6
CONTEXT_CHARS = 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a later start in one run of digits can match only where the first one does, so each run is tried once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"(?i)(?<![A-Za-z0-9])(?:password|passwd|secret|token|api[_-]?key)\x20{0,2}[=:]\x20{0,2}[\"']?([A-Za-z0-9+/_-]{8,}+)")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

#: Characters of an IBAN by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_CONTEXT = {
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "secret": re.compile(r"(?i)(?:password|passwd|secret|token|key|credential)"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|taxpayer)\b"),
    "local_phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|téléphone|teléfono)\b"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@functools.lru_cache(maxsize=1000)
def _iban_rest(country: str) -> re.Pattern:
    """What follows country and check digits: as many characters as the country's numbers have, or a whole run of 11 to 30."""
    many = str(IBAN_LENGTHS[country] - 4) if country in IBAN_LENGTHS else "11,30"
    return re.compile(rf"(?:\x20?[A-Z0-9]){{{many}}}(?![A-Za-z0-9])")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap, from each @: linear even in long runs of letters."""
    done = run = 0
    at = text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at + 1)):
            start, stop = at, max(done, run)
            while start > stop and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        run = at + 1
        at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four base kinds; positions are code points, the end is exclusive."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _near(kind: str, text: str, start: int, end: int) -> bool:
    return bool(_CONTEXT[kind].search(text[max(0, start - CONTEXT_CHARS) : start]) or _CONTEXT[kind].search(text[end : end + CONTEXT_CHARS]))


def more_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the further kinds whose score reaches THRESHOLD and that touch no base span."""
    found = []
    if re.search("[0-9]", text):
        for m in _IBAN.finditer(text):
            if rest := _iban_rest(m[1]).match(text, m.end()):
                found.append(("iban", m.start(), rest.end(), 0.2 + 0.5 * mod97(text[m.start() : rest.end()])))
        found += [("secret", *m.span(), 0.9) for m in _KEY.finditer(text)]
        found += [("secret", *m.span(1), 0.7) for m in _ASSIGNED.finditer(text) if re.search("[0-9]", m[1])]
        for m in _SSN.finditer(text):
            area, group, serial = m[0].split("-")
            issued = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
            found.append(("ssn", *m.span(), 0.3 + 0.1 * issued))
        found += [("local_phone", *m.span(), 0.4) for m in _LOCAL_PHONE.finditer(text)]
    ordered = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in ordered], list(itertools.accumulate((b for _, b in ordered), max))
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []  # of out, ascending; they never overlap
    for kind, start, end, score in found:
        if score + 0.25 * _near(kind, text, start, end) < THRESHOLD:
            continue
        before, at = bisect.bisect_left(starts, end), bisect.bisect_left(taken, (end, 0))
        if not (before and reach[before - 1] > start) and not (at and taken[at - 1][1] > start):
            taken.insert(at, (start, end))
            out.append((kind, start, end))
    return out


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind as listed. A null text has none."""
    key = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = base_spans(text or "")
    return sorted(base, key=key), sorted(base + more_spans(text or "", base), key=key)


def detect(docs: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text): counts of the base kinds, spans as arrays of (kind, start, end)."""
    bounded_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [find(x) for x in batch.column("text").to_pylist()]
            as_rows = lambda k: pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in x[k]] for x in both], span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_rows(0), as_rows(1)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def masked(text: str | None) -> str | None:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if text is None:
        return None
    out, done = [], 0
    for kind, start, end in find(text)[1]:
        if start >= done:
            out += [text[done:start], f"<{kind}>"]
        done = max(done, end)
    return "".join(out) + text[done:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text and n_chars counted anew where it was given; nulls stay null, other columns as they are."""
    bounded_batches(docs.sparkSession)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([masked(x) for x in batch.to_pylist()], pa.string())

    rewrite = F.arrow_udf(run, "string")
    out = docs.withColumn("text", rewrite("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*own(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return detect(table(spark, sf_dir, "documents")).select("doc_id", *map(count, BASE_KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
