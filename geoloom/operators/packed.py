"""Several values packed in one field: one row per value, with its position.

The work is done on Arrow buffers: the value buffer of a whole batch is classified at once, quote parity and escape
parity come from prefix sums, separators outside quotes become child offsets, the children's bytes are copied by these
offsets into a new value buffer, and they are flattened with their parents' ordinals. Only fields with unbalanced or
nested quotes, and values with escapes or inner quotes, go through a scalar reader of the same rules.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE_SIGNS = " -.&+'()"
QUOTE, OPEN, CLOSE, ESCAPE = '"', "“", "”", "\\"
_VALUE, _SEP, _QUOTE, _OPEN, _CLOSE, _ESC = range(6)


def _kind(ch: str) -> int:
    if ch == QUOTE:
        return _QUOTE
    if ch == OPEN:
        return _OPEN
    if ch == CLOSE:
        return _CLOSE
    if ch == ESCAPE:
        return _ESC
    # A combining mark belongs to its letter.
    return _VALUE if ch in VALUE_SIGNS or unicodedata.category(ch)[0] in "LNM" else _SEP


def may_hold_several(value: Column) -> Column:
    """False only for fields without any separating character; runs in the JVM."""
    return value.rlike(r"[^\p{L}\p{N}\p{M} \-.&+'()]")


def read_packed(text: str) -> list[str]:
    """The rules, character by character: the values of one field in order, empty ones dropped."""
    pieces: list[tuple[str, bool]] = []  # the characters of the value so far, and whether they are quote marks
    items: list[str] = []

    def close() -> None:
        kept = pieces[:]
        while kept and kept[0] == (" ", False):
            kept.pop(0)
        while kept and kept[-1] == (" ", False):
            kept.pop()
        if len(kept) >= 2 and kept[0] == (OPEN, True) and kept[-1] == (CLOSE, True):
            kept = kept[1:-1]
        item = "".join(QUOTE if mark else c for c, mark in kept).strip(" ")
        if item:
            items.append(item)
        pieces.clear()

    i, n = 0, len(text)
    while i < n:
        ch = text[i]
        if ch == ESCAPE:
            if i + 1 < n:
                pieces.append((text[i + 1], False))
            i += 2
            continue
        if ch in (QUOTE, OPEN):
            j, inner = i + 1, []
            while j < n:
                if text[j] == ESCAPE and j + 1 < n:
                    inner.append(text[j + 1])
                    j += 2
                elif ch == QUOTE and text[j : j + 2] == QUOTE * 2:
                    inner.append(QUOTE)
                    j += 2
                elif text[j] == (QUOTE if ch == QUOTE else CLOSE):
                    break
                else:
                    inner.append(text[j])
                    j += 1
            if j < n:
                pieces += [(OPEN, True), *((c, False) for c in inner), (CLOSE, True)]
                i = j + 1
                continue
            close()  # a quote that is never closed separates like any other sign
            i += 1
            continue
        if _kind(ch) == _VALUE:
            pieces.append((ch, False))
        else:
            close()
        i += 1
    close()
    return items


def _batch_items(values: pa.Array) -> pa.ListArray:
    """The list of values of each field of a batch (null fields give empty lists)."""
    rows = len(values)
    values = pa.concat_arrays([values.cast(pa.large_string())]).fill_null("")
    span = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + rows + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[span[0] : span[-1]]
    joined = data.tobytes().decode("utf-8")
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(cp)
    # Where each character starts in the value buffer, and where each field ends in characters.
    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    end = np.searchsorted(byte, span[1:] - span[0])
    begin = np.concatenate(([0], end[:-1])) if rows else end
    length = end - begin
    if not n:
        return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.string()))
    seen, back = np.unique(cp, return_inverse=True)
    kind = np.array([_kind(chr(c)) for c in seen], np.int8)[back]
    row = np.repeat(np.arange(rows), length)
    at = np.arange(n)

    # A character is escaped when an odd run of backslashes of its own field stands before it.
    is_esc = kind == _ESC
    last_plain = np.maximum.accumulate(np.where(~is_esc, at, -1))
    floor = np.maximum(last_plain, begin[row] - 1)
    run = np.where(is_esc, at - floor, 0)
    before = np.concatenate(([0], run[:-1]))
    before[begin[length > 0]] = 0
    escaped = before % 2 == 1

    def since_row(flag: np.ndarray) -> np.ndarray:
        total = np.cumsum(flag)
        return total - np.concatenate(([0], total))[begin[row]]

    quote, opens, closes = ((kind == k) & ~escaped for k in (_QUOTE, _OPEN, _CLOSE))
    quotes = since_row(quote)
    curly = since_row(opens.astype(np.int64) - closes)
    in_straight = (quotes % 2 == 1) & ~quote
    in_curly = (curly == 1) & ~opens
    odd = np.zeros(rows, bool)
    for bad in (quote & (curly != 0), (opens | closes) & (quotes % 2 == 1), (curly < 0) | (curly > 1)):
        odd[row[bad]] = True
    filled = length > 0
    odd[filled] |= (quotes[end[filled] - 1] % 2 == 1) | (curly[end[filled] - 1] != 0)

    cut = (kind == _SEP) & ~escaped & ~in_straight & ~in_curly & ~odd[row]
    # One piece per separator plus one per field, in order.
    where = np.flatnonzero(cut)
    stop = np.concatenate((where, end))
    owner = np.concatenate((row[where], np.arange(rows)))
    order = np.lexsort((stop, owner))
    stop, owner = stop[order], owner[order]
    start = np.empty_like(stop)
    start[1:] = stop[:-1] + 1
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    start[first] = begin[owner[first]]

    blank = (cp == 32) & ~escaped
    next_full = np.concatenate((np.minimum.accumulate(np.where(~blank, at, n)[::-1])[::-1], [n]))
    prev_full = np.concatenate(([-1], np.maximum.accumulate(np.where(~blank, at, -1))))
    left = np.minimum(next_full[np.minimum(start, n)], stop)
    right = np.maximum(prev_full[stop] + 1, left)
    full = (right > left) & ~odd[owner]
    left, right, owner_full = left[full], right[full], owner[full]

    marks = np.concatenate(([0], np.cumsum(quote | opens | closes)))
    special = marks[right] - marks[left]
    slashes = np.concatenate(([0], np.cumsum(is_esc)))
    slow = (slashes[right] - slashes[left]) > 0
    closed = np.where(quote[left], quote[right - 1], opens[left] & closes[right - 1])
    slow |= (special > 0) & ~((special == 2) & closed)
    simple = (special == 2) & ~slow
    # Within quotes, blanks at the ends go too.
    left, right = left + simple, right - simple
    left = np.minimum(next_full[left], right)
    right = np.maximum(prev_full[right] + 1, left)
    plain = ~slow & (right > left)
    child, owners = _copied(data, byte[left[plain]], byte[right[plain]]), owner_full[plain]
    extra = [(owner_full[k], left[k], item) for k in np.flatnonzero(slow) for item in read_packed(joined[left[k] : right[k]])[:1]]
    extra += [(r, k, item) for r in np.flatnonzero(odd) for k, item in enumerate(read_packed(joined[begin[r] : end[r]]))]
    if extra:
        place = np.concatenate((left[plain], np.array([k for _, k, _ in extra], np.int64)))
        owners = np.concatenate((owners, np.array([r for r, _, _ in extra], np.int64)))
        order = np.lexsort((place, owners))
        owners = owners[order]
        child = pa.concat_arrays([child, pa.array([item for _, _, item in extra], pa.string())]).take(pa.array(order))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), child)


def _copied(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.StringArray:
    """The byte ranges start..stop of a value buffer as strings of their own."""
    size = stop - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    picked = data[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(picked))


def split_packed(df: DataFrame, value: str, *, item: str = "item", pos: str = "pos", least: int = 1) -> DataFrame:
    """One row per value packed in the string column `value`; the other columns are repeated.

    `pos` (int) counts a field's values from 1 after empty ones are dropped. Fields with fewer than `least` values
    give no row, so null, empty and separator-only fields never do. Repeated input rows give repeated output rows.
    New column names must not be taken: a clash raises ValueError.
    """
    others = [c for c in df.columns if c != value]
    if clash := {item, pos} & set(others) or (item == pos and {item}):
        raise ValueError(f"column names already taken: {sorted(clash)}")
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(pos, T.IntegerType()), T.StructField(item, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _batch_items(batch.column(batch.schema.get_field_index(value)))
            offsets = np.asarray(lists.offsets)
            counts = np.diff(offsets)
            kept = np.flatnonzero(counts >= least)
            size = counts[kept]
            parents = np.repeat(kept, size)
            ordinal = np.arange(len(parents)) - np.repeat(np.cumsum(size) - size, size)
            columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(parents)) for c in others]
            children = lists.values.take(pa.array(offsets[parents] + ordinal))
            yield pa.RecordBatch.from_arrays([*columns, pa.array((ordinal + 1).astype(np.int32)), children], names=[*others, pos, item])

    return df.select(*others, value).mapInArrow(run, schema)


def packed_tags(places: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(id, tag_key, pos, item) of the tag fields named in `keys` that hold at least two values, each place once."""
    wanted = F.map_filter("tags", lambda k, v: k.isin(*keys) & may_hold_several(v))
    fields = places.select("id", F.explode(wanted).alias("tag_key", "value")).distinct()
    return split_packed(fields, "value", least=2).select("id", "tag_key", "pos", "item")
