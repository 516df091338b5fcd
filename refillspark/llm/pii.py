"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

The base kinds (email, ip, card, phone) are spans whenever their own rule holds. The further kinds
become spans only if their score, moved by context words near the span, reaches the threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "ssn", "local_phone", "secret")
_ORDER = {kind: i for i, kind in enumerate(BASE + FURTHER)}

# A look-behind keeps a search from trying every place within one run of characters: the leftmost
# match of a run begins at its first character, so the result is that of the plain pattern.
_EMAIL_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _EMAIL_DOMAIN)
_EMAIL_HERE = re.compile(r"[A-Za-z0-9._%+-]++" + _EMAIL_DOMAIN)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9_]{20,64}(?![A-Za-z0-9_])")

_PATTERNS = {"iban": _IBAN, "ssn": _SSN, "local_phone": _LOCAL_PHONE, "secret": _SECRET}
_CONTEXT = {
    "iban": frozenset({"iban", "bank", "account", "konto", "compte", "cuenta"}),
    "ssn": frozenset({"ssn", "social", "security"}),
    "local_phone": frozenset({"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"}),
    "secret": frozenset({"token", "secret", "password", "passwd", "key", "api_key", "apikey"}),
}
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Rules:
    """Scores of the further kinds: as proposed, what a checksum and a context word add, and the threshold."""

    proposed: float = 0.3
    checked: float = 0.4
    in_context: float = 0.4
    threshold: float = 0.6
    window: int = 40  # characters at each side in which context words count


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    end = 0
    while at >= 0:
        # What follows a match at once may begin the next one, in the middle of a run.
        found = _EMAIL_HERE.match(text, end) if end else None
        found = found or _EMAIL.search(text, end)
        if not found:
            return
        yield found.span()
        end = found.end()
        at = text.find("@", end)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by start, then kind; code points, end exclusive."""
    spans = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m.group())) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]]))


def _joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def further_spans(text: str, base: list[tuple[str, int, int]], rules: Rules) -> list[tuple[str, int, int, float]]:
    """Spans of the further kinds that reach the threshold and touch no span of the base or of a kind before.

    Matches of a kind and the spans taken so far are both in order: one pass goes along both.
    """
    taken = _joined((s, e) for _, s, e in base)
    out: list[tuple[str, int, int, float]] = []
    for kind, pattern in _PATTERNS.items():
        at, own = 0, []
        for m in pattern.finditer(text):
            start, end = m.span()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at < len(taken) and taken[at][0] < end:
                continue
            near = text[max(0, start - rules.window) : start] + " " + text[end : end + rules.window]
            score = rules.proposed
            if kind == "iban":
                score += rules.checked if mod97(m.group()) else -1
            if _CONTEXT[kind] & {w.lower() for w in _WORD.findall(near)}:
                score += rules.in_context
            if score >= rules.threshold:
                own.append((kind, start, end, score))
        if own:
            taken = _joined([*taken, *(s[1:3] for s in own)])
            out += own
    return out


def all_spans(text: str, rules: Rules) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    more = [s[:3] for s in further_spans(text, base, rules)]
    return base, sorted(base + more, key=lambda s: (s[1], _ORDER[s[0]]))


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_personal_data(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), slice_bytes: int = 4 << 20
) -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every whole text.

    Counts and digest are of the base kinds; ``spans`` has those of the further kinds too.
    Null and empty texts have no spans (the digest is that of the empty string); repeated rows
    and null ids give a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            counts: dict[str, list[int]] = {kind: [] for kind in BASE}
            digests, spans = [], []
            for text in pc.fill_null(batch.column("text"), "").to_pylist():
                base, every = all_spans(text, rules)
                for kind in BASE:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_said(base).encode()).hexdigest())
                spans.append(_said(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = f"id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_arrow(rows, run, shape).withColumnRenamed("id", id_col)


def mask_personal_data(
    docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", rules: Rules = Rules(), slice_bytes: int = 4 << 20
) -> DataFrame:
    """The rows of ``docs`` with each span replaced by its kind in angle brackets, without a shuffle.

    Overlapping spans become one mask, named after the first. ``length_col``, where the table has
    it, gets the new length in code points (null where the text is null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, slice_bytes):
            masked: list[str | None] = []
            for text in batch.column(text_col).to_pylist():
                if text is None:
                    masked.append(None)
                    continue
                out, end = [], 0
                for kind, start, stop in all_spans(text, rules)[1]:
                    if start >= end:
                        out += [text[end:start], f"<{kind}>"]
                    end = max(end, stop)
                masked.append("".join(out) + text[end:])
            at = batch.schema.get_field_index(text_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(masked, batch.schema.field(at).type))
            yield batch

    out = map_arrow(docs, run, docs.schema)
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.char_length(F.col(text_col)).cast(kind))
    return out
