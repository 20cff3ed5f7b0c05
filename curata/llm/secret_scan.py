"""Secret scan: three base patterns and a battery of randomness tests.

Base spans (kinds ``assign``, ``access``, ``hex``) are leftmost, non-overlapping matches per
kind; matches that are too short are dropped after matching.

The method adds spans of kind ``random``: runs of 16 or more base64 characters.  The encoding
(hex, base32, base62, base64) is the smallest alphabet that holds the run.  Under the
hypothesis "drawn uniformly from this alphabet" three p-values are computed: a
chi-squared test of uniformity (with the exact multinomial variance, as runs are short), a
runs test above/below the middle of the alphabet and a lag-1 serial correlation test.  Three
times the smallest of them is the run's randomness.

Runs made of letters in the case pattern of words are the null group (ordinary text); runs of
digits only are numbers and play no part.  A run of digits and letters or of mixed case is reported when its randomness is high against the null
runs of at most its length: per length band, its empirical p-value must pass
Benjamini-Hochberg at ``fdr``, and the uniform hypothesis must not be rejected at ``alpha``.
Only runs that could be reported are tested: one that overlaps a base span is none, and the rate is over the others.
The counts behind this cover all documents (a histogram of lengths and randomness,
built by Spark; the driver gets bands x bins rows).  The battery's reach: runs under 16 characters and base64 text cut by other
characters are not tested.

Defined results: null and empty texts have no span; texts are read whole; positions
are code points, end exclusive; repeated rows are scanned each; an empty table gives no rows
and no ``random`` limit (nothing is added); other columns play no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import in_turn

KINDS = ("assign", "access", "hex", "random")
BANDS = (16, 20, 24, 32, 48, 64)         # least lengths
BINS = 200                              # of the randomness, on a log scale down to 1e-20
ROWS = 256                              # texts that lie in memory as Python objects at a time
SPAN = "array<struct<kind:string,start:int,end:int>>"

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# for one class of characters "24 or more" finds what "a run, dropped if shorter" finds
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
_WORDLIKE = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)\Z")

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {     # in order of size
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567",
    "base62": _UPPER + _UPPER.lower() + _DIGITS, "base64": _UPPER + _UPPER.lower() + _DIGITS + "+/", "base64url": _UPPER + _UPPER.lower() + _DIGITS + "-_",
}
_INDEX = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(run: str) -> str | None:
    used = set(run)
    return next((name for name, own in _SETS.items() if used <= own), None)


def randomness(run: str) -> float:
    """Three times the smallest p-value of the battery (at most 1); 0 without an encoding."""
    name = encoding(run)
    if name is None:
        return 0.0
    n, size = len(run), len(ALPHABETS[name])
    at = [_INDEX[name][c] for c in run]
    counts: dict[int, int] = {}
    for i in at:
        counts[i] = counts.get(i, 0) + 1
    chi = sum(c * c for c in counts.values()) * size / n - n
    p_uniform = _upper_tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))
    high = [i >= size / 2 for i in at]
    up = sum(high)
    down = n - up
    if up and down:
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        p_runs = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)          # all on one side of the middle
    centre = sum(at) / n
    spread = sum((i - centre) ** 2 for i in at)
    lag = sum((a - centre) * (b - centre) for a, b in zip(at, at[1:]))
    p_serial = 2 * _upper_tail(abs(lag / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    return min(1.0, 3 * min(p_uniform, p_runs, p_serial))


def band(length: int) -> int:
    return max(b for b, least in enumerate(BANDS) if length >= least)


def level(p: float) -> int:
    """Bin of a randomness: 0 for 1e-20 and less, BINS - 1 for 1."""
    return 0 if p <= 1e-20 else min(BINS - 1, int((math.log10(p) + 20) / 20 * BINS))


def runs_of(text: str) -> Iterator[tuple[int, int, str]]:
    return ((m.start(), m.end(), m[0]) for m in _RUN.finditer(text) if not m[0].isdigit())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """The runs that may be reported: not like words, clear of the base spans."""
    return ((s, e, run) for s, e, run in runs_of(text) if not _WORDLIKE.match(run) and not any(s < b and a < e for a, _, b in base))


def all_spans(text: str | None, limits: list[int]) -> list[dict]:
    """Base spans and the runs whose randomness reaches the limit of their band; in order of start and kind."""
    if not text:
        return []
    found = base_spans(text)
    found += [(s, 3, e) for s, e, run in (candidates(text, found) if limits else ()) if level(randomness(run)) >= limits[band(e - s)]]
    return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found)]


def random_limits(docs: DataFrame, text_col: str = "text", fdr: float = 0.05, alpha: float = 1e-3) -> list[int]:
    """Per length band the least randomness bin that is reported (BINS: none), from all documents."""

    def measure(batches):
        for batch in batches:
            seen: dict[tuple, int] = {}
            for text in in_turn(batch.column(0), ROWS):
                runs = list(runs_of(text)) if text else []
                words = [(s, e, run) for s, e, run in runs if _WORDLIKE.match(run)]
                own = candidates(text, base_spans(text)) if len(words) < len(runs) else ()
                for word, (s, e, run) in [(True, x) for x in words] + [(False, x) for x in own]:
                    key = (band(e - s), level(randomness(run)), word)
                    seen[key] = seen.get(key, 0) + 1
            columns = list(zip(*((*k, n) for k, n in seen.items()))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.bool_(), pa.int64()))], ["band", "level", "word", "n"])

    table = (docs.select(F.col(text_col).alias("t")).mapInArrow(measure, "band int, level int, word boolean, n long")
             .groupBy("band", "level", "word").agg(F.sum("n").alias("n")).collect())     # at most bands x bins x 2 rows
    return limits_from({(r.band, r.level, r.word): r.n for r in table}, fdr, alpha)


def limits_from(table: dict[tuple[int, int, bool], int], fdr: float, alpha: float) -> list[int]:
    """Benjamini-Hochberg per band; the null group of a band are the word-like runs of its length or less."""
    limits = []
    for b in range(len(BANDS)):
        null = [sum(table.get((a, v, True), 0) for a in range(b + 1)) for v in range(BINS)]
        own = [table.get((b, v, False), 0) for v in range(BINS)]
        total_null, total = sum(null), sum(own)
        limit, above_null, above = BINS, 0, 0
        for v in range(BINS - 1, level(alpha) - 1, -1):
            above_null, above = above_null + null[v], above + own[v]
            if total and (1 + above_null) / (1 + total_null) <= fdr * above / total:
                limit = v
        limits.append(limit)
    return limits


def span_column(text: Column, limits: list[int]) -> Column:
    """array<struct<kind, start, end>> of each text."""

    @F.pandas_udf(SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([all_spans(t, limits) for t in texts])

    return spans(text)


def redacted_column(text: Column, limits: list[int], mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones together) replaced by ``mark``; null stays null."""

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for s in all_spans(text, limits):
            if s["start"] >= at:
                out += [text[at:s["start"]], mark]
            at = max(at, s["end"])
        return "".join([*out, text[at:]]) if out else text

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        parts = [pa.array([clean(t) for t in texts.slice(at, ROWS).to_pylist()], pa.string()) for at in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return redact(text)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, limits: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every document."""
    limits = random_limits(docs, text_col) if limits is None else limits
    return docs.select(F.col(id_col).alias("doc_id"), span_column(F.col(text_col), limits).alias("spans"))


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All documents, their secrets replaced by a mark; a column ``n_chars`` follows the text."""
    limits = random_limits(docs, text_col)
    clean = docs.withColumn(text_col, redacted_column(F.col(text_col), limits))
    return clean.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
