"""Splitting notes into passages: row to many rows, each document by itself.

A note is measured once: running sums of token costs over its text. Everything else is a search in them: a section, a
paragraph, a sentence or a piece of one is a stretch of the text, and what it costs is a difference of two sums. A
passage repeats its section's headings, costs at most ``MOST`` and aims at ``TARGET``. Nothing of a note is lost:
headings that don't fit as a prefix are content, and an empty section is carried by a descendant or stands alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: sizes in estimated tokens (most, aimed at, least content beside a prefix), letters a token, and the patterns of tokens, headings, fences and sentence ends.
MOST, TARGET, FLOOR = 220, 150, 40
LETTERS = 6
#: Notes whose passages are in a task's memory at once.
NOTES_AT_ONCE = 128
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_STOP = re.compile(r"[.!?][ \t]+|\n")

Span = tuple[int, int]


class Measured:
    """A text and the running sums of its tokens' costs. Long runs of letters and digits count as several tokens, so a cut can fall into them."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [at for m in _TOKEN.finditer(text) for at in range(m.start(), m.end(), LETTERS)]

    def cost(self, span: Span) -> int:
        return bisect_left(self.starts, span[1]) - bisect_left(self.starts, span[0])

    def trimmed(self, span: Span) -> Span:
        a, b = span
        piece = self.text[a:b]
        return a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())

    def pieces(self, span: Span, budget: int) -> Iterator[Span]:
        """The stretch, cut after every ``budget`` tokens."""
        first, last = bisect_left(self.starts, span[0]), bisect_left(self.starts, span[1])
        at = [span[0], *self.starts[first + budget : last : budget], span[1]]
        yield from zip(at, at[1:], strict=False)

    def units(self, span: Span, budget: int) -> Iterator[Span]:
        """The stretch if it fits, else its sentences and lines, and the pieces of those that don't fit."""
        if self.cost(span) <= budget:
            yield span
            return
        ends = [span[0], *(m.end() for m in _STOP.finditer(self.text, *span)), span[1]]
        for sentence in zip(ends, ends[1:], strict=False):
            sentence = self.trimmed(sentence)
            if sentence[0] < sentence[1]:
                yield from [sentence] if self.cost(sentence) <= budget else self.pieces(sentence, budget)


def tokens_in(text: str) -> int:
    return len(Measured(text).starts)


def outline(text: str) -> list[tuple[list[tuple[int, str, Span]], list[Span]]]:
    """For each section its open headings (level, title, line), its own last, and its paragraphs; the first section has no heading.

    Headings open sections, unless inside a fence or indented by four.
    """
    out: list[tuple[list, list[Span]]] = [([], [])]
    fence, at, paragraph = "", 0, None
    for line in text.split("\n"):
        here, at = at, at + len(line) + 1
        mark = _FENCE.match(line)
        head = None if mark or fence or line.startswith("    ") else _HEADING.match(line)
        if mark and (not fence or (mark[1][0] == fence[0] and len(mark[1]) >= len(fence))):
            fence = "" if fence else mark[1]
        if head or not line.strip():
            paragraph = None
        elif paragraph is None:
            paragraph = len(out[-1][1])
            out[-1][1].append((here, here + len(line)))
        else:
            out[-1][1][paragraph] = (out[-1][1][paragraph][0], here + len(line))
        if head:
            above = [h for h in out[-1][0] if h[0] < len(head[1])]
            out.append(([*above, (len(head[1]), head[2].strip(), (here, here + len(line)))], []))
    return out


def packs(costs: list[int], budget: int, target: int) -> list[range]:
    """Units next to each other that make up a passage: each is filled until it reaches the target or the next one doesn't fit."""
    sums, out, start = [0, *accumulate(costs)], [], 0
    while start < len(costs):
        aimed = bisect_left(sums, sums[start] + target, start + 1)
        fits = bisect_right(sums, sums[start] + budget, start + 1) - 1
        end = max(min(aimed, fits, len(costs)), start + 1)
        out.append(range(start, end))
        start = end
    return out


def passages(body: str) -> list[tuple[list[str], str]]:
    """(headings, passage) in order."""
    text = Measured(body.replace("\r\n", "\n"))
    sections, out = outline(text.text), []
    for i, (heads, paragraphs) in enumerate(sections):
        lines = [h[2] for h in heads]
        spent = [0, *accumulate(text.cost(x) for x in reversed(lines))]
        kept = bisect_right(spent, MOST - FLOOR) - 1  # the innermost headings that leave room enough
        prefix = [text.text[a:b] for a, b in lines[len(lines) - kept :]]
        budget = max(FLOOR, MOST - spent[kept])
        units = [u for x in [*lines[: len(lines) - kept], *map(text.trimmed, paragraphs)] for u in text.units(x, budget)]
        bodies = ["\n\n".join(text.text[a:b] for a, b in units[p.start : p.stop]) for p in packs([text.cost(u) for u in units], budget, min(TARGET, budget))]
        carried = i + 1 < len(sections) and len(sections[i + 1][0]) > len(heads)
        if not bodies and prefix and not carried:
            bodies = [""]
        out += [([h[1] for h in heads], "\n\n".join(x for x in ("\n".join(prefix), b) if x)) for b in bodies]
    return out


def split_passages(docs: DataFrame, keep: list[str], body_col: str) -> DataFrame:
    """The kept columns, ordinal, headings, body, est_tokens: one row a passage."""
    rows = docs.select(F.struct(*keep).alias("rec"), F.col(body_col).alias("body"))
    made = "rec", "ordinal", "headings", "body", "est_tokens"
    schema = rows.select("rec", F.lit(0).alias("ordinal"), F.array(F.lit("")).alias("headings"), "body", F.lit(0).alias("est_tokens")).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, NOTES_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, NOTES_AT_ONCE)):
            found = [(i, k, h, b) for i, body in enumerate(batch.column(1).to_pylist()) for k, (h, b) in enumerate(passages(body or ""))]
            which, ordinal, headings, bodies = zip(*found, strict=True) if found else ((), (), (), ())
            columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(ordinal, pa.int32()), pa.array(headings, pa.list_(pa.string())), pa.array(bodies, pa.string()), pa.array(map(tokens_in, bodies), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=made)

    return rows.mapInArrow(cut, schema).select("rec.*", *made[1:])
