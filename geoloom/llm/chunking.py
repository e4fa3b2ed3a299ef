"""Splitting oversized texts at natural boundaries, without any worker holding a whole file.

A text (a table cell or a file) is cut into ranges. A worker looks for the first place at or after each end of its range
where pre-tokens always part, however far that is, so that ranges meet without a gap and their tokens are those of the
whole; it reads a halo on both sides for the patterns of boundaries, tokenizes what lies between, and emits a boundary
table: each place to cut with its token count, and the place 200 tokens before it. The tables of a text are read in
order with running sums, and pieces are laid out as they go by, holding no more than a piece and a range. Texts of
pieces are taken by offset. The pieces do not depend on the size of the ranges.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.tokens import VOCABULARY, tokenizer
from geoloom.util import materialise, scratch, spread

LIMIT, OVERLAP = 4000, 200
RANGE_CHARS, HALO_CHARS = 65_536, 256
TASK_BYTES = 64 << 20  # of files per task
LOOSE = 32  # tokens that the overlap may grow by to start at a word
EDGE = OVERLAP + LOOSE + 1  # tokens at a range's ends that are handed on, for overlaps that start in the range before
SPARSE, DENSE = 1_000, 200  # tokens without a better boundary beyond which words, and tokens, are kept as places to cut
MARGIN = 8  # a piece tokenized by itself may differ by a token or two at its ends
TOKEN, WORD, SENTENCE, PARAGRAPH, CLAIM, SECTION = range(6)

# Headings of the sections of a patent.
HEADINGS = (
    "ABSTRACT", "DESCRIPTION", "CLAIMS", "BACKGROUND", "SUMMARY", "DRAWINGS", "ZUSAMMENFASSUNG", "BESCHREIBUNG", "ANSPRÜCHE", "PATENTANSPRÜCHE",
    "ABRÉGÉ", "REVENDICATIONS", "RESUMEN", "DESCRIPCIÓN", "REIVINDICACIONES", "摘要", "说明书", "权利要求书", "発明の詳細な説明", "特許請求の範囲", "要約",
)
_SECTION = re.compile(r"^[ \t]*(?:" + "|".join(HEADINGS) + r")[ \t]*:?[ \t]*$|^#{1,6} ", re.M)
_CLAIM = re.compile(r"^[ \t]*\d{1,4}[ \t]?\. ", re.M)
_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*(?=\S)|^[ \t]*\[\d+\]", re.M)
_LINE = re.compile(r"\n(?=\S)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+(?=\S)|(?<=[。！？])(?=\S)")
_RUN = re.compile(r"[^\W_]+")
_BROKEN = re.compile("[\udc80-\udcff]")
_PART = re.compile(r"(?<=\S)(?=\s)|(?<=[^\W_])(?=[^\w\s']|_)")


def part_point(text: str, at: int) -> int:
    """The first place from `at` where a pre-token certainly ends, or -1."""
    m = _PART.search(text, at)
    return m.start() if m else -1


def _held(strength: np.ndarray, least: int, gap: int) -> np.ndarray:
    """Tokens of at least `least`, where none of a better kind stands within `gap` tokens or the range ends: whatever
    the range, no such place is missing where a piece could need one."""
    better = np.flatnonzero(strength > least)
    edges = np.concatenate(([-1], better, [len(strength)]))
    wide = np.diff(edges) > gap
    wide[[0, -1]] = True
    inner = np.repeat(wide, np.diff(edges))[: len(strength)]
    return np.flatnonzero((strength == least) & inner)


def _before(cut: np.ndarray, token: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Where the overlap before each cut starts, as a position in `token` (sorted): at the last word at least `OVERLAP`
    tokens before if that is near, else at the last clean token; -1 where there is none."""
    out = np.full(len(cut), -1)
    at = cut - OVERLAP
    for least in (0, WORD):
        some = np.flatnonzero(strength >= least)
        if len(some):
            k = np.searchsorted(token[some], at, "right") - 1
            found = some[np.maximum(k, 0)]
            fits = (k >= 0) & ((least == 0) | (at - token[found] <= LOOSE))
            out = np.where(fits, found, out)
    return out


def boundary_table(text: str, start: int, stop: int, path: str, *, in_bytes: bool = False, first: bool = True, more: bool = False, alone: int = -1) -> dict:
    """Boundaries of text[start:stop], offsets in characters or bytes from `start`; see the module's text. What stands
    around is only looked at by the patterns. A text known to be whole is only counted if it has at most `alone`
    tokens."""
    body = text[start:stop]
    starts = tokenizer(path).byte_starts(body)
    n = len(starts) - 1
    none: list = []
    if n <= alone:
        return {
            "chars": len(body), "tokens": n, "cut_char": none, "cut_token": none, "strength": none, "back_char": none, "back_token": none,
            "head_char": none, "head_strength": none, "tail_char": none, "tail_strength": none, "most_run": 0,
        }
    raw = np.frombuffer(body.encode("utf-8", "replace"), np.uint8)
    is_char = (raw & 0xC0) != 0x80
    # Characters before each byte; a token may start inside a character, which then counts as before it.
    chars = np.concatenate(([0], np.cumsum(is_char)))
    clean = np.concatenate((is_char, [True]))[starts]
    at = chars[starts]  # character at which each token starts
    strength = np.where(clean[:-1], TOKEN, -1).astype(np.int8)

    def mark(places: Iterator[int], kind: int) -> None:
        """A place counts at the first token that starts at or after it; a space before a word belongs to its token,
        so such a place is one character on."""
        where = np.fromiter(places, np.int64) - start
        where = where[(where >= 0) & (where < len(body))]
        k = np.searchsorted(at[:-1], where)
        where, k = where[k < n], k[k < n]
        k = k[(np.abs(at[k] - where) <= 1) & (strength[k] >= 0)]
        strength[k] = np.maximum(strength[k], kind)

    mark((m.start() for m in re.finditer(r"(?<=\S)\s", text)), WORD)
    mark((m.end() for m in _SENTENCE.finditer(text)), SENTENCE)
    mark((m.end() - 1 for m in _SENTENCE.finditer(text)), SENTENCE)
    mark((m.end() for m in _LINE.finditer(text)), SENTENCE)
    mark((m.end() if m.group().startswith("\n") else m.start() for m in _PARAGRAPH.finditer(text)), PARAGRAPH)
    mark((m.start() for m in _CLAIM.finditer(text)), CLAIM)
    mark((m.start() for m in _SECTION.finditer(text)), SECTION)

    # Ranges meet where no run of letters and digits stands, so each run is in one range.
    runs = [(m.start(), m.end()) for m in _RUN.finditer(body) if m.end() - m.start() > 250]
    most = max((int(np.searchsorted(at[:-1], b) - np.searchsorted(at[:-1], a)) for a, b in runs), default=0)
    kinds = np.minimum(strength, SENTENCE)
    kept = np.sort(np.concatenate((np.flatnonzero(strength >= SENTENCE), _held(kinds, WORD, SPARSE), _held(kinds, TOKEN, DENSE))))
    back = _before(kept, np.arange(n), strength)
    if not first:
        back[kept < EDGE] = -1
    place = starts if in_bytes else at
    head, tail = (slice(0, 0) if first else slice(0, EDGE)), (slice(max(0, n - EDGE), n) if more else slice(0, 0))
    return {
        "chars": len(raw) if in_bytes else len(body), "tokens": n, "cut_char": place[kept], "cut_token": kept, "strength": strength[kept].astype(np.int32),
        "back_char": np.where(back >= 0, place[np.maximum(back, 0)], -1), "back_token": back,
        "head_char": place[:-1][head], "head_strength": strength[head].astype(np.int32), "tail_char": place[:-1][tail], "tail_strength": strength[tail].astype(np.int32), "most_run": most,
    }


_TABLE = (
    "chars bigint, tokens bigint, cut_char array<bigint>, cut_token array<bigint>, strength array<int>, back_char array<bigint>, "
    "back_token array<bigint>, head_char array<bigint>, head_strength array<int>, tail_char array<bigint>, tail_strength array<int>, most_run bigint, "
    "first_char array<bigint>, end_char array<bigint>, n_tokens array<bigint>, cut_strength array<int>"
)
_ROWS = ("cut_char", "cut_token", "strength", "back_char", "back_token", "head_char", "head_strength", "tail_char", "tail_strength")


class Layout:
    """Lays out the pieces of one text while its boundary tables go by."""

    def __init__(self, limit: int):
        self.limit = limit
        self.char = self.tok = self.longest = self.s_char = self.s_tok = 0
        self.cuts = np.zeros((0, 5), np.int64)  # character, token, strength, and character and token of the overlap
        self.edge = np.zeros((0, 3), np.int64)  # the last tokens: character, token, strength

    def add(self, r) -> list[tuple[int, int, int, int]]:
        """The pieces (first, end, tokens, strength of the cut) that are certain once table `r` is known."""
        k = np.asarray(r.cut_token, np.int64)
        bc, bt = np.asarray(r.back_char, np.int64), np.asarray(r.back_token, np.int64)
        new = np.stack((np.asarray(r.cut_char, np.int64) + self.char, k + self.tok, np.asarray(r.strength, np.int64), np.where(bt >= 0, bc + self.char, -1), np.where(bt >= 0, bt + self.tok, -1)), 1)
        head = self._tokens(r.head_char, r.head_strength, self.tok)
        near = np.concatenate((self.edge, head))
        early = np.flatnonzero((k < EDGE) & (bt < 0)) if len(head) else np.zeros(0, np.int64)
        b = _before(new[early, 1], near[:, 1], near[:, 2])
        new[early[b >= 0], 3:] = near[b[b >= 0], :2]
        tail = self._tokens(r.tail_char, r.tail_strength, self.tok + r.tokens - len(r.tail_char))
        self.edge = np.concatenate((self.edge, tail))[-EDGE:]
        self.cuts = np.concatenate((self.cuts, new))
        self.longest = max(self.longest, r.most_run)
        self.char, self.tok = self.char + r.chars, self.tok + r.tokens
        pieces, room = [], self.limit - MARGIN
        while self.tok > self.limit and self.tok - self.s_tok > room:
            low, high = np.searchsorted(self.cuts[:, 1], [self.s_tok + OVERLAP + 1, self.s_tok + room + 1])
            window = self.cuts[low:high]
            window = window[window[:, 4] > self.s_tok]
            if len(window):
                late = window[window[:, 1] > self.s_tok + room // 2]
                window = late if len(late) else window
                best = window[window[:, 2] == window[:, 2].max()][-1]  # the latest of the strongest kind
                pieces.append((self.s_char, int(best[0]), int(best[1] - self.s_tok), int(best[2])))
                self.s_char, self.s_tok = int(best[3]), int(best[4])
            else:  # characters of many tokens only: the last place there is, without an overlap
                best = self.cuts[max(0, int(np.searchsorted(self.cuts[:, 1], self.s_tok + room, "right")) - 1)]
                if best[1] <= self.s_tok:
                    break
                pieces.append((self.s_char, int(best[0]), int(best[1] - self.s_tok), int(best[2])))
                self.s_char, self.s_tok = int(best[0]), int(best[1])
        self.cuts = self.cuts[self.cuts[:, 1] > self.s_tok]
        return pieces

    def _tokens(self, char, strength, token: int) -> np.ndarray:
        return np.stack((np.asarray(char, np.int64) + self.char, np.arange(len(char)) + token, np.asarray(strength, np.int64)), 1)

    def end(self) -> list[tuple[int, int, int, int]]:
        """The last piece; nothing for a text within the limit."""
        return [(self.s_char, self.char, self.tok - self.s_tok, SECTION)] if self.tok > self.limit else []


def _laid_out(table: dict, limit: int) -> dict:
    """The table of a text in one range with the pieces in place of the boundaries, which nobody else needs."""
    layout = Layout(limit)
    pieces = layout.add(SimpleNamespace(**table)) + layout.end()
    first, end, tokens, strength = zip(*pieces)
    return table | dict.fromkeys(_ROWS, []) | {"first_char": first, "end_char": end, "n_tokens": tokens, "cut_strength": strength}


def _stitched(tables: DataFrame, limit: int) -> DataFrame:
    """Pieces of each key from its ranges' tables, read in order; texts within the limit are left out."""
    names = ["key", "piece", "last", "first_char", "end_char", "n_tokens", "strength", "text_tokens", "longest_run"]

    def stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, layout, count = None, None, 0

        def rows(pieces: list, last: bool) -> list[tuple]:
            return [(key, count + i, last, *p, layout.tok, layout.longest) for i, p in enumerate(pieces)]

        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples():
                if layout is None or r.key != key:
                    out += rows(layout.end(), True) if layout else []
                    key, layout, count = r.key, Layout(limit), 0
                if r.first_char is not None:  # laid out already
                    layout.tok, layout.longest = r.tokens, r.most_run
                    done = list(zip(r.first_char, r.end_char, r.n_tokens, r.cut_strength))
                    out += rows(done[:-1], False)
                    count = len(done) - 1
                    out += rows(done[-1:], True)
                    layout = None
                    continue
                new = rows(layout.add(r), False)
                out, count = out + new, count + len(new)
            if out:
                yield pd.DataFrame(out, columns=names)
        if layout and (out := rows(layout.end(), True)):
            yield pd.DataFrame(out, columns=names)

    ordered = tables.repartition("key").sortWithinPartitions("key", "range_no")
    return ordered.mapInPandas(stitch, f"key {tables.schema['key'].dataType.simpleString()}, {_PIECES}")


_PIECES = "piece int, last boolean, first_char bigint, end_char bigint, n_tokens bigint, strength int, text_tokens bigint, longest_run bigint"


def piece_table(docs: DataFrame, *, limit: int = LIMIT, path: str = VOCABULARY, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Pieces by offset of `docs` (key, text) of more than `limit` tokens; keys must be unique.

    Columns: key, piece (from 0), last (whether it is the text's last), first_char, end_char, n_tokens, strength of the
    cut at the end, text_tokens and longest_run (tokens of the longest unbroken run of letters and digits, counted for
    runs over 250 characters; both of all the text in the row with `last`, else of what was read by then). Texts of at
    most `limit` bytes cannot have more tokens and are not tokenized. Null and empty texts give no row.
    """
    key = docs.schema["key"].dataType.simpleString()
    pieces_ = dict.fromkeys(("first_char", "end_char", "n_tokens", "cut_strength"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text in zip(batch["key"], batch["text"]):
                out, start = [], 0
                while start >= 0:
                    stop = part_point(text, start + range_chars) if start + range_chars < len(text) else -1
                    end = stop if stop >= 0 else len(text)
                    first, left = start == 0, max(0, start - HALO_CHARS)
                    alone = limit if first and stop < 0 else -1
                    table = boundary_table(text[left : end + HALO_CHARS], start - left, end - left, path, first=first, more=stop >= 0, alone=alone)
                    if first and stop < 0 and table["tokens"] > limit:
                        table = _laid_out(table, limit)
                    if table["tokens"] > alone:
                        out.append({"key": k, "range_no": len(out)} | pieces_ | table)
                    start = stop
                if out:
                    yield pd.DataFrame(out)

    big = spread(docs.where(F.octet_length("text") > limit).select("key", "text"))
    return _stitched(big.mapInPandas(run, f"key {key}, range_no int, {_TABLE}"), limit)


def split_documents(docs: DataFrame, id_col: str, text: str, **options) -> DataFrame:
    """The pieces of all texts over the limit, with their texts: id_col, piece, last, first_char, end_char,
    n_tokens, strength, piece_text. Consecutive pieces share the 200 tokens before a cut (rounded up to a word)."""
    source = docs.select(F.col(id_col).alias("key"), F.col(text).alias("text"))
    pieces = materialise(piece_table(source, **options))
    joined = source.join(pieces, "key")
    return joined.select(
        F.col("key").alias(id_col), "piece", "last", "first_char", "end_char", "n_tokens", "strength",
        F.substring("text", F.col("first_char") + 1, F.col("end_char") - F.col("first_char")).alias("piece_text"),
    )


def _text_at(name: str, first: int, end: int) -> str:
    """Bytes first..end of a file as text; a byte that is no UTF-8 becomes a sign of one byte, so offsets hold."""
    with open(name, "rb") as f:
        f.seek(first)
        return _BROKEN.sub("\x1a", f.read(end - first).decode("utf-8", "surrogateescape"))


def _file_point(name: str, at: int, size: int, step: int) -> int:
    """The first byte from `at` where pre-tokens part; the file is read on, `step` bytes at a time, until one is found."""
    begin, reach = max(0, at - 4), at
    while reach < size:
        reach = min(size, reach + step)
        with open(name, "rb") as f:
            f.seek(begin)
            data = f.read(reach - begin)
        lead = 0  # the range may begin inside a character
        while lead < 4 and lead < len(data) and data[lead] & 0xC0 == 0x80 and begin:
            lead += 1
        tail = len(data)
        if reach < size:  # a character cut off at the end waits for the next step
            while tail > lead and data[tail - 1] & 0xC0 == 0x80:
                tail -= 1
            tail -= tail > lead and data[tail - 1] >= 0xC0
        text = data[lead:tail].decode("utf-8", "surrogateescape")
        after = len(data[lead : max(lead, at - begin)].decode("utf-8", "ignore"))
        if (k := part_point(text, after)) >= 0:
            return begin + lead + len(text[:k].encode("utf-8", "surrogateescape"))
        step *= 2
    return size


def split_files(files: DataFrame, *, limit: int = LIMIT, path: str = VOCABULARY, range_bytes: int = 4 << 20) -> DataFrame:
    """The pieces of UTF-8 files named in the column `path`, which all executors must be able to read.

    Workers seek to their range and read it with the halo, then seek to their pieces; none reads a whole file, unless
    it is one run without a place where pre-tokens part. Output: path, piece, last, first_byte, end_byte, n_tokens,
    strength, text_tokens, longest_run (as in `piece_table`), piece_text. Files of at most `limit` tokens and empty
    files give no row, a missing file raises, bytes that are no UTF-8 come out as replacement characters.
    """

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                n = os.path.getsize(name)
                if n <= limit:
                    continue
                k = range(-(-n // range_bytes))
                yield pd.DataFrame({"path": [name] * len(k), "range_no": pd.Series(k, dtype="int32"), "n": pd.Series([n] * len(k), dtype="int64")})

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                at = r.range_no * range_bytes
                start = _file_point(r.path, at, r.n, HALO_CHARS) if r.range_no else 0
                stop = _file_point(r.path, at + range_bytes, r.n, HALO_CHARS) if at + range_bytes < r.n else r.n
                if start >= stop:
                    continue  # all of the range belongs to a run that began before it
                left = _text_at(r.path, max(0, start - HALO_CHARS), start)
                body, right = _text_at(r.path, start, stop), _text_at(r.path, stop, min(r.n, stop + HALO_CHARS))
                table = boundary_table(left + body + right, len(left), len(left) + len(body), path, in_bytes=True, first=start == 0, more=stop < r.n)
                if start == 0 and stop == r.n:
                    if table["tokens"] <= limit:
                        continue
                    table = _laid_out(table, limit)
                yield pd.DataFrame([{"key": r.path, "range_no": r.range_no} | dict.fromkeys(("first_char", "end_char", "n_tokens", "cut_strength")) | table])

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for r in batch.itertuples():
                with open(r.key, "rb") as f:
                    f.seek(r.first_char)
                    texts.append(f.read(r.end_char - r.first_char).decode("utf-8", "replace"))
            batch["piece_text"] = texts
            yield batch.rename(columns={"key": "path", "first_char": "first_byte", "end_char": "end_byte"})

    listed = files.select("path").distinct().mapInPandas(spans, "path string, range_no int, n bigint")
    # The names are small but what they stand for is not, so the number of tasks follows from the ranges.
    listed = materialise(listed)
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, listed.count() * range_bytes // TASK_BYTES)
    found = listed.repartition(tasks, "path", "range_no").mapInPandas(tables, f"key string, range_no int, {_TABLE}")
    pieces = _stitched(found, limit)
    out = f"path string, {_PIECES}, piece_text string".replace("_char", "_byte")
    return pieces.repartition(tasks, "key", "piece").mapInPandas(take, out)


def write_files(docs: DataFrame, id_col: str, text: str, least: int = LIMIT) -> DataFrame:
    """Writes each text of more than `least` bytes to a file of its own in the shared folder: (id_col, path). The folder
    must be mounted on all executors; a task that runs again writes the same files."""
    folder = scratch(docs.sparkSession, "texts").removeprefix("file:")
    if ":" in folder.split("/", 1)[0]:
        raise ValueError(f"{folder} is no mounted folder")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = [f"{folder}/{key}.txt" for key in batch[id_col]]
            for name, body in zip(paths, batch[text]):
                part = f"{name}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(body.encode("utf-8", "replace"))
                os.replace(part, name)
            yield pd.DataFrame({id_col: batch[id_col], "path": paths})

    big = spread(docs.where(F.octet_length(text) > least).select(id_col, text))
    return materialise(big.mapInPandas(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, path string"))
