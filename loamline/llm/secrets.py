"""Secret scans: base patterns plus sliding-window entropy over candidate strings.

For every candidate string (a maximal run of token characters) and every
character class, a window slides over the run; the window's Shannon entropy is
kept by adding and removing one character's count at a time. Windows that reach
the class's threshold are merged into spans. An allow-list suppresses
candidates that are known not to be secrets; it never touches base matches.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.base import bounded, byte_slices, text_or_empty

#: The base kinds in the order of the contract, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: Longer hexadecimal runs only; shorter ones fail the length test whatever they are.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SLICE_BYTES = 4_000_000


@dataclass(frozen=True)
class CharClass:
    """A window of ``window`` characters of the class is suspicious from ``bits`` of entropy on."""

    kind: str
    run: str
    window: int
    bits: float
    mixed: str  # every pattern here must occur in the window's run


CLASSES = (
    CharClass("entropy_hex", r"[0-9A-Fa-f]{20,}", 20, 3.0, r"(?=.*[0-9])(?=.*[A-Fa-f])"),
    CharClass("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.7, r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
)

#: Strings that look random and are not secrets.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i).*(?:example|sample|dummy|placeholder|changeme).*",
    r"(?i).*(?:abcdefgh|0123456789|qwerty).*",
)


def entropy_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``run`` whose entropy is at least ``bits``."""
    if len(run) < window:
        return []
    clog = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    most = (log2(window) - bits) * window + 1e-9  # entropy = log2(window) - total / window
    for i, ch in enumerate(run):
        if i >= window:
            gone = run[i - window]
            c = counts[gone]
            total += clog[c - 1] - clog[c]
            counts[gone] = c - 1
        c = counts.get(ch, 0)
        total += clog[c + 1] - clog[c]
        counts[ch] = c + 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, index of kind, end)`` of the base matches, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


class _Covered:
    """Whether a span lies inside one of some spans."""

    def __init__(self, spans: Sequence[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.furthest = list(accumulate((e for _, e in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return i > 0 and self.furthest[i - 1] >= end


def entropy_spans(text: str, base: Sequence[tuple[int, int, int]], classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW) -> list[tuple[int, int, int]]:
    """Spans that the entropy method adds: none inside a base span or an earlier class's span."""
    in_base = _Covered([(s, e) for s, _, e in base])
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(re.fullmatch(a, run) for a in allow):
            continue
        found: list[tuple[int, int]] = []  # in this candidate, by earlier classes
        for c in classes:
            in_earlier, now = _Covered(found), []
            for part in re.finditer(c.run, run):
                if not re.match(c.mixed, part[0]):
                    continue
                for s, e in entropy_windows(part[0], c.window, c.bits):
                    s, e = m.start() + part.start() + s, m.start() + part.start() + e
                    if not in_base(s, e) and not in_earlier(s, e):
                        now.append((s, e))
            found += now
            out += [(s, KINDS.index(c.kind), e) for s, e in now]
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, each sorted by start, then kind."""
    base = base_spans(text)
    return base, sorted([*base, *entropy_spans(text, base)])


def render(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base_spans, spans``: strings ``kind:start:end`` joined by commas, code points.

    One row for each row of ``docs``, in one pass without a shuffle. Null texts
    count as empty and have no spans; repeated rows are each scanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in byte_slices(b, 1, SLICE_BYTES)):
            found = [tuple(map(render, scan(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], names=["doc_id", "base_spans", "spans"])

    source = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, base_spans string, spans string")


def redact_text(text: str, mark: str = "[secret]") -> str:
    """``text`` with every span replaced by ``mark``; overlapping spans count as one."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in scan(text)[1]:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced by ``mark``; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for part in byte_slices(b, b.schema.get_field_index(text_col), SLICE_BYTES)):
            i = b.schema.get_field_index(text_col)
            texts = pa.array([t if t is None else redact_text(t, mark) for t in b.column(i).to_pylist()], b.schema.field(i).type)
            yield b.set_column(i, b.schema.field(i), texts)

    return bounded(docs).mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_secrets``."""
    count = lambda kind: F.size(F.regexp_extract_all("base_spans", F.lit(f"{kind}:"), F.lit(0))).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def sha256_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
