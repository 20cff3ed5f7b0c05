"""Scalar string functions on columns.

All are built-in Spark expressions (JVM side, inside whole-stage codegen where
Spark supports it); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four admission sections and their headings, as the reference names them.
SECTIONS = (
    ("CHIEF_COMPLAINT", "chief complaint:"),
    ("PRESENT_ILLNESS", "present illness:"),
    ("MEDICAL_HISTORY", "medical history:"),
    ("BRIEF_HOSPITAL_COURSE", "brief hospital course"),
)
# Headings written back when the sections are reassembled.
REASSEMBLED_HEADINGS = ("CHIEF COMPLAINT: ", "PRESENT ILLNESS: ", "MEDICAL HISTORY: ", "HOSPITAL_COURSE: ")
# Fixed value: the metric key inside a result cell.
RESULT_METRIC = "torchmetrics.auroc"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_label_list(c: Column | str, element: str = "string") -> Column:
    """F1: a list literal such as "['A', \"B'x\"]" or "[0.0, 1.0]" -> array; malformed -> null.

    Spark's JSON reader accepts single-quoted strings, so Python list literals of
    strings and numbers parse without evaluating code.
    """
    return F.from_json(_c(c), f"array<{element}>", {"allowSingleQuotes": "true"})


def render_label_list(c: Column | str) -> Column:
    """Inverse of F1 for string lists: a JSON array, which is a list literal too (quotes, backslashes and
    line breaks are escaped)."""
    return F.to_json(_c(c))


def parse_result_cell(c: Column | str, metric: str = RESULT_METRIC) -> Column:
    """F2: "[{'torchmetrics.auroc': 0.83}]" -> 0.83; only for strings starting with '['."""
    x = _c(c)
    parsed = F.from_json(x, "array<map<string,double>>", {"allowSingleQuotes": "true"})
    return F.when(x.startswith("["), F.element_at(F.element_at(parsed, 1), F.lit(metric)))


def section_pattern(heading: str) -> str:
    """F3 pattern: text after the heading up to a blank line followed by a `...:` heading
    that holds no bracket, digit, dot, pipe, backslash or line break."""
    return "(?is)" + heading + "(.+?)\n\n[^(\\\\|\\d.)\n]+?:"


def clean_text(c: Column | str) -> Column:
    """line breaks -> blank, strip surrounding white space, null -> ''."""
    x = F.regexp_replace(_c(c), "\n", " ")
    return F.coalesce(F.regexp_replace(x, "^\\s+|\\s+$", ""), F.lit(""))


def extract_section(text: Column | str, heading: str) -> Column:
    """one section of a note, cleaned; '' when the heading is absent."""
    return clean_text(F.regexp_extract(_c(text), section_pattern(heading), 1))


def file_stem(name: Column | str) -> Column:
    """file name without its last extension ('x.csv_fold_1_train.csv' -> 'x.csv_fold_1_train')."""
    return F.regexp_extract(_c(name), "^(.*)\\.[^.]*$", 1)


def key_split(stem: Column | str) -> Column:
    """last '_' token of a key = split name."""
    return F.element_at(F.split(_c(stem), "_"), -1)


def key_task(stem: Column | str) -> Column:
    """all but the last '_' token of a key = task name."""
    return F.regexp_extract(_c(stem), "^(.*)_[^_]*$", 1)


def sequence_key(seq: Column | str, position: Column | int) -> Column:
    """F8: aliases of the sequence up to `position` (0-based), joined by '_'."""
    p = F.lit(position) if isinstance(position, int) else position
    return F.array_join(F.slice(_c(seq), F.lit(1), p + 1), "_")


def run_stamp(ts: Column | str) -> Column:
    """yyyyMMdd-HHmmss."""
    return F.date_format(_c(ts), "yyyyMMdd-HHmmss")


def words(text: Column | str) -> Column:
    """Lower-cased white-space tokens with empty strings removed."""
    return F.filter(F.split(F.lower(_c(text)), "\\s+"), lambda t: t != "")
