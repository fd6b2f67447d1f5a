"""Chunks of bounded size from a note's headings, with exact offsets into the note.

A heading's body (and the text before the first heading) is one segment.  Drawers, keyword and comment
lines go, source blocks stay.  What exceeds the maximum splits at paragraphs, then lines, sentences, words, and
at last at code points; pieces are packed up to the target, small tails merged, and a chunk that starts in
mid-prose repeats the end of the one before.  Packing is a fold over a segment's pieces, so it runs in the
Arrow pass that reads the note; no shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from weftline.config import Settings

Counter = Callable[[str], int]
CHUNK_SCHEMA = (
    "note_uuid string, note_path string, note_title string, heading_path string, heading_text string, heading_id string, heading_level int, "
    "heading_index int, chunk_in_heading int, ordinal int, char_start int, char_end int, text string, embed_text string"
)
_COLUMNS = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
_WORD = re.compile(r"\w+|[^\w\s]")
# The org syntax that segments are cleaned and cut by.
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_DRAWER = re.compile(r"^[ \t]*:([A-Za-z0-9_-]+):[ \t]*$")
_END = re.compile(r"^[ \t]*:END:[ \t]*$", re.IGNORECASE)
_BLOCK = re.compile(r"^[ \t]*#\+begin_", re.IGNORECASE)
_BLOCK_END = re.compile(r"^[ \t]*#\+end_", re.IGNORECASE)
_SETTING = re.compile(r"^[ \t]*#\+\S")
_COMMENT = re.compile(r"^[ \t]*#(?:[ \t].*)?$")
_STRUCTURED = re.compile(r"[ \t]*(?:[-+*]\s|\d+[.)]\s|\|)")


def word_counter(text: str) -> int:
    """Words and single marks: needs no vocabulary file."""
    return sum(1 for _ in _WORD.finditer(text))


class Measure:
    """Token counts of a text's substrings.  Words are found once and counted by their places; other counters read
    the substring."""

    def __init__(self, text: str, count: Counter | Measure):
        self.text, self.count = text, count
        if isinstance(count, Measure):
            self.count, self.starts, self.ends = count.count, count.starts, count.ends
        elif count is word_counter:
            found = list(_WORD.finditer(text))
            self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        else:
            self.starts = self.ends = []

    def between(self, start: int, end: int) -> int:
        if self.count is not word_counter:
            return self.count(self.text[start:end])
        return max(0, bisect.bisect_left(self.starts, end) - bisect.bisect_right(self.ends, start)) if end > start else 0


def counter(name: str) -> Counter:
    """'words', or the path of a rank file for byte-pair tokens."""
    if name == "words":
        return word_counter
    import base64

    import tiktoken

    with open(name, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


class Cleaned:
    """A segment without the lines that carry no prose, and the way back to the note's offsets."""

    def __init__(self, body: str, base: int):
        kept: list[str] = []
        self.at, self.origin = [], []  # cleaned offset and original offset where each kept stretch starts
        size, place, state, joined = 0, base, "", False
        for line in body.splitlines(keepends=True):
            state, keep = _keep(line.rstrip("\n"), state)
            if keep:
                if not joined:
                    self.at.append(size)
                    self.origin.append(place)
                kept.append(line)
                size += len(line)
            joined = keep
            place += len(line)
        self.text, self.end = "".join(kept), place

    def offset(self, index: int) -> int:
        """Original offset of a cleaned index; the text's end maps to the segment's end."""
        if index >= len(self.text):
            return self.end
        k = bisect.bisect_right(self.at, index) - 1
        return self.origin[k] + index - self.at[k]


def _keep(line: str, state: str) -> tuple[str, bool]:
    """(state after the line, keep it); state is '', 'block' or 'drawer'."""
    if state == "block":
        return ("" if _BLOCK_END.match(line) else state), True
    if state == "drawer":
        return ("" if _END.match(line) else state), False
    if _BLOCK.match(line):
        return "block", True
    if _DRAWER.match(line) and not _END.match(line):
        return "drawer", False
    return "", not (_SETTING.match(line) or _COMMENT.match(line))


def without_drawers(text: str) -> str:
    """The note as it is shown to a judge: drawers dropped, all else kept."""
    out, inside = [], False
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\n")
        if inside:
            inside = not _END.match(bare)
        elif _DRAWER.match(bare) and not _END.match(bare):
            inside = True
        else:
            out.append(line)
    return "".join(out)


def _cuts(text: str, kind: str) -> list[int]:
    """Ends of the pieces that a separator leaves, each with its separator."""
    if kind == "sentence":
        ends = [m.end() for m in _SENTENCE_END.finditer(text)]
    else:
        mark = {"para": "\n\n", "line": "\n", "word": " "}[kind]
        ends = [m.end() for m in re.finditer(re.escape(mark), text)]
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


_TIERS = ("para", "line", "sentence", "word")


def pieces(text: str, count: Counter | Measure, limit: int) -> list[tuple[int, int, str]]:
    """(start, end, what the left edge is) of pieces of at most ``limit`` tokens."""
    size = Measure(text, count)
    out: list[tuple[int, int, str]] = []
    todo = [(0, len(text), "start", 0)]
    while todo:
        start, end, edge, tier = todo.pop()
        if size.between(start, end) <= limit:
            out.append((start, end, edge))
            continue
        while tier < len(_TIERS):
            ends = _cuts(text[start:end], _TIERS[tier])
            if len(ends) > 1:
                break
            tier += 1
        if tier == len(_TIERS):
            out += _hard(start, end, edge, size, limit)
            continue
        kind, at, own = _TIERS[tier], start, []
        for e in ends:
            own.append((at, start + e, edge if at == start else kind, tier + 1))
            at = start + e
        todo += reversed(own)
    return out


def _hard(start: int, end: int, edge: str, size: Measure, limit: int) -> list[tuple[int, int, str]]:
    """Longest runs of code points within the limit, one code point at least: doubled until too long, then bisected."""
    out = []
    while start < end:
        low, reach = start + 1, 2
        while start + reach < end and size.between(start, start + reach) <= limit:
            low, reach = start + reach, 2 * reach
        high = min(end, start + reach)
        while low < high:
            middle = (low + high + 1) // 2
            if size.between(start, middle) <= limit:
                low = middle
            else:
                high = middle - 1
        out.append((start, low, edge))
        start, edge = low, "hard"
    return out


def pack(parts: list[tuple[int, int, str]], text: str, count: Counter | Measure, target: int, limit: int) -> list[tuple[int, int, str]]:
    """Neighbours joined up to the target, or up to the limit while still under the target."""
    size = Measure(text, count)
    out: list[tuple[int, int, str]] = []
    for start, end, edge in parts:
        if out:
            first, last, lead = out[-1]
            joined = size.between(first, end)
            if joined <= target or (joined <= limit and size.between(first, last) < target):
                out[-1] = (first, end, lead)
                continue
        out.append((start, end, edge))
    return out


def merge_small(chunks: list[tuple[int, int, str]], text: str, count: Counter | Measure, least: int) -> list[tuple[int, int, str]]:
    """A small chunk joins the one before it; a small first one joins the one after it."""
    size = Measure(text, count)
    out: list[tuple[int, int, str]] = []
    for start, end, edge in chunks:
        if out and size.between(start, end) < least:
            out[-1] = (out[-1][0], end, out[-1][2])
        else:
            out.append((start, end, edge))
    if len(out) > 1 and size.between(out[0][0], out[0][1]) < least:
        out[:2] = [(out[0][0], out[1][1], out[0][2])]
    return out


def _overlap(start: int, size: Measure, tokens: int) -> int:
    """How far back ``tokens`` tokens reach: doubled until too far, then bisected."""
    high, reach = start, 8
    while reach < start and size.between(start - reach, start) <= tokens:
        high, reach = start - reach, 2 * reach
    low = max(0, start - reach)
    while low < high:
        middle = (low + high) // 2
        if size.between(middle, start) <= tokens:
            high = middle
        else:
            low = middle + 1
    return low


def crumbs(title: str, heading: dict | None) -> str:
    parts = [title] if heading is None else [title, *heading["ancestor_path"], heading["text"]]
    return " > ".join(p for p in parts if p)


def segments(note: dict) -> list[tuple[dict | None, int, int]]:
    """(heading, start, end) of what stands before the first heading and below each heading's line."""
    text, heads = note["text"], list(note["headings"])
    out: list[tuple[dict | None, int, int]] = [(None, 0, heads[0]["char_start"] if heads else len(text))]
    for h in heads:
        line_end = text.find("\n", h["char_start"], h["char_end"])
        out.append((h, line_end + 1 if line_end >= 0 else h["char_end"], h["char_end"]))
    return out


def chunk(note: dict, settings: Settings, count: Counter) -> list[dict]:
    """Chunks of one parsed note, numbered through the note and within each heading."""
    text = note["text"]
    out: list[dict] = []
    for heading, start, end in segments(note):
        clean = Cleaned(text[start:end], start)
        if not clean.text.strip():
            continue
        size = Measure(clean.text, count)
        spans = pack(pieces(clean.text, size, settings.chunk_max_tokens), clean.text, size, settings.chunk_target_tokens, settings.chunk_max_tokens)
        spans = merge_small(spans, clean.text, size, settings.chunk_min_tokens)
        path = crumbs(note["title"], heading)
        for number, (a, b, edge) in enumerate(spans):
            line = clean.text.rfind("\n", 0, a) + 1
            if number and settings.chunk_overlap_tokens > 0 and edge in ("sentence", "word") and not _STRUCTURED.match(clean.text, line):
                a = _overlap(a, size, settings.chunk_overlap_tokens)
            body, own = clean.text[a:b], heading or {}
            out.append(
                {
                    "note_uuid": note["note_id"],
                    "note_path": note["path"],
                    "note_title": note["title"],
                    "heading_path": path,
                    "heading_text": own.get("text"),
                    "heading_id": own.get("id"),
                    "heading_level": own.get("level"),
                    "heading_index": own.get("index", 0),
                    "chunk_in_heading": number,
                    "ordinal": len(out),
                    "char_start": clean.offset(a),
                    "char_end": clean.offset(b),
                    "text": body.strip("\n"),
                    "embed_text": f"{path}\n\n{body.strip()}",
                }
            )
    return out


_NOTE = ("path", "note_id", "title", "headings", "text")


def segments_of(notes: DataFrame) -> DataFrame:
    """Parsed notes -> path, heading_index (0 before the first heading), body_start, body_end, crumbs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(note["path"], h["index"] if h else 0, a, b, crumbs(note["title"], h)) for note in batch.to_dict("records") for h, a, b in segments(note)]
            yield pd.DataFrame(rows, columns=["path", "heading_index", "body_start", "body_end", "crumbs"])

    return notes.select(*_NOTE).mapInPandas(run, "path string, heading_index int, body_start int, body_end int, crumbs string")


def split_texts(texts: DataFrame, kinds: tuple[str, ...] = _TIERS) -> DataFrame:
    """(doc_id, text) -> doc_id, text, separator and the pieces that each separator leaves, which add up to the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"], batch["text"], strict=True):
                for kind in kinds:
                    ends = _cuts(text, kind)
                    rows.append((i, text, kind, [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True) if b > a]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "separator", "pieces"])

    return texts.select("doc_id", "text").where("text is not null").mapInPandas(run, "doc_id long, text string, separator string, pieces array<string>")


def chunk_notes(notes: DataFrame, settings: Settings) -> DataFrame:
    """Parsed notes -> chunks; a note without prose has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(settings.tokenizer)
        for batch in batches:
            rows = [c for note in batch.to_dict("records") for c in chunk(note, settings, count)]
            out = pd.DataFrame(rows, columns=_COLUMNS)
            yield out.astype({"heading_level": "Int32"})

    return notes.select(*_NOTE).mapInPandas(run, CHUNK_SCHEMA)
