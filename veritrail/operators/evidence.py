"""Chunks to atomic, quotable statements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What kinds of lines look like, in the order in which they are tried.
KINDS = (
    ("heading", re.compile(r"^\s{0,3}#{1,6}\s")),
    ("question", re.compile(r"^\s*\*\*(?P<text>[^*\n]{3,160}\?)\*\*\s*$")),
    ("rule", re.compile(r"^\s*\|?[\s:|-]+\|[\s:|-]*$")),
    ("row", re.compile(r"^\s*\|(?P<text>.+)\|\s*$")),
    ("bullet", re.compile(r"^\s*(?:[-*+]|\d{1,3}[.)])\s+(?P<text>.*)$", re.DOTALL)),
)
MARKS = re.compile(r"(\*{1,3}|_{1,3}|`+)")
LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
SENTENCE = re.compile(r"""(?<![A-Z]\.)(?<=[.!?])(?<!\d\.)\s+(?=["'(\[]?[A-Z0-9])""")
FRONT = re.compile(r"^---\s*$")

UNIT = "struct<text string, prompt string, is_list_item boolean>"


def clean(line: str) -> str:
    return re.sub(r"\s{2,}", " ", LINK.sub(r"\1", MARKS.sub("", line))).strip()


def sentences(text: str) -> list[str]:
    return [s.strip() for s in SENTENCE.split(text) if s.strip()] or [text]


def labelled(text: str) -> Iterator[tuple[str, str]]:
    """Each line's kind and content, without a leading block between two ``---``."""
    lines = text.splitlines()
    if lines and FRONT.match(lines[0]):
        ends = [k for k, line in enumerate(lines[1:], 1) if FRONT.match(line)]
        lines = lines[ends[0] + 1 :] if ends else lines
    for raw in lines:
        line = raw.rstrip()
        kind, found = next(((k, m) for k, rx in KINDS if (m := rx.match(line))), ("prose", None))
        if not line:
            kind = "blank"
        content = found["text"] if found and "text" in found.groupdict() else line
        if kind in ("bullet", "prose") and not (content := clean(content)):
            kind = "blank"
        yield kind, content


def evidence_units(text: str) -> list[dict]:
    """Statements in order: paragraphs and bullets by sentence, table rows as ``first: others``.

    A bold question on a line of its own is not a statement but the prompt of the next
    one.  The row above a table's rule is a header and dropped.
    """
    units: list[dict] = []
    block: list[str] = []
    bullet, prompt, header = False, None, None

    def close() -> None:
        nonlocal prompt, bullet
        whole = " ".join(block).strip()
        block.clear()
        if whole:
            first, prompt = prompt, None
            for k, s in enumerate(sentences(whole)):
                units.append({"text": s, "prompt": None if k else first, "is_list_item": bullet})
        bullet = False

    for kind, content in labelled(text):
        if kind != "prose":
            close()
        if kind == "question":
            prompt = content.strip()
        elif kind == "rule":
            if header is not None:
                del units[header]
            header = None
        elif kind == "row":
            cells = [c for c in map(clean, content.split("|")) if c]
            if cells:
                units.append({"text": f"{cells[0]}: {'; '.join(cells[1:])}" if cells[1:] else cells[0], "prompt": None, "is_list_item": False})
                header = len(units) - 1
        elif kind in ("bullet", "prose"):
            bullet = bullet or kind == "bullet"
            block.append(content)
            header = None
    close()
    return units


def with_evidence_units(df: DataFrame, text: str = "text", output: str = "units") -> DataFrame:
    """Add the statements of each text; a null text has none."""

    @F.arrow_udf(f"array<{UNIT}>")
    def split(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("text", pa.string()), ("prompt", pa.string()), ("is_list_item", pa.bool_())]))
        return pa.array([evidence_units(t) if t else [] for t in column.to_pylist()], kind)

    return df.withColumn(output, split(F.col(text)))
