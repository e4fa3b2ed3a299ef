"""Matching entities of two tables without a shared key, each match with a confidence.

Every record is a bag of weighted terms over all its attributes: words, letter triples and letter pairs of its names,
and grid cells of its place at several sizes. Places are the documents of an inverted index, cut by its coarsest grid
cells; stops are the queries. A name within the slips that `allowed_edits` grants shares at least so many letter pairs
that one of the rarest of its list must be among them, so only the lists of the rarest pairs are read and no such name
is lost (a required number of terms, pruned exactly, whatever the length of the lists). What comes out is scored by
BM25 over all terms, each stop keeps its best three places and each place its best stop, a pair must be the best of
both, and an edit check of the names follows. The confidence is a logistic function of score and score gap; it is
fitted on what stops find first against what they find once their first is withheld, since a stop has one place.
Stops without usable coordinates are queries by name alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geo import EARTH_M
from geoloom.llm.canon import allowed_edits, edit_distance, tokens_of
from geoloom.util import materialise, spread

CELL_DEG = 0.01  # the coarsest grid; a place stands in every cell that its circle touches
LEVELS_M = (500.0, 250.0, 125.0, 60.0)  # sizes of the grid cells that are terms of a place
PART_ROWS = 4_096  # rows of one side that a task holds of one cell; what a cell has beyond is dealt to parts
BLOCK_ROWS = 16_384  # rows of a task
SLICE = 1 << 21  # list entries and pairs looked at at a time
KEEP = 3  # places a stop keeps
DF_BITS = 16
AREA_DEG = 0.1  # a scope's area: the squares in which it has stops, and their neighbours
SURE_NAME = 0.9  # name similarity that counts without a place
K1, B = 1.2, 0.75
GRAM = 4  # letters of the runs by which names without a place are looked up
SAMPLE_ROWS = 20_000  # bound of the sample that the logistic function is fitted on
LEAST_SAMPLE = 20  # with fewer of either class the fixed curve below is used
PRIOR = (8.0, 2.0, 2.0, -6.0)  # weights of name similarity, score and gap, and the intercept

# Short forms in names of stops and streets.
SHORT = {
    "av": "avenue", "ave": "avenue", "aven": "avenue", "bd": "boulevard", "blvd": "boulevard", "boul": "boulevard", "bvd": "boulevard", "ct": "court", "crt": "court",
    "dr": "drive", "drv": "drive", "ln": "lane", "la": "lane", "pkwy": "parkway", "pky": "parkway", "pwy": "parkway", "rd": "road", "sq": "square",
    "str": "street", "st": "street", "ter": "terrace", "terr": "terrace", "tce": "terrace", "pl": "place", "hwy": "highway",
    "n": "north", "s": "south", "e": "east", "w": "west", "nth": "north", "sth": "south", "no": "north", "so": "south",
    "hosp": "hospital", "hsp": "hospital", "uni": "university", "univ": "university", "cen": "central", "cent": "central", "ctr": "center", "cntrl": "central", "ctl": "central",
    "stn": "station", "sta": "station", "mus": "museum", "lib": "library", "libr": "library", "stad": "stadium", "term": "terminal", "trm": "terminal", "tml": "terminal",
    "int": "interchange", "intchg": "interchange", "intch": "interchange", "interch": "interchange", "xchg": "interchange", "jct": "junction", "jn": "junction", "jnc": "junction", "junc": "junction",
    "mkt": "market", "hl": "hall", "twn": "town", "hbr": "harbour", "harbor": "harbour", "and": "&", "at": "&",
}
# Words that say what kind of thing a stop is, or number a part of it.
NOISE = {"station", "stop", "bus", "tram", "train", "rail", "metro", "halt", "platform", "track", "bay", "stand", "gleis", "quay", "entrance", "nb", "sb", "eb", "wb"}
DIRECTIONS = {"north", "south", "east", "west"}


@lru_cache(maxsize=100_000)
def _is_noise(word: str) -> bool:
    """Noise words, the longer ones with a slip."""
    return word in NOISE or (len(word) >= 5 and any(abs(len(word) - len(x)) <= 1 and word[0] == x[0] and edit_distance([word], [x])[0] <= 1 for x in NOISE if len(x) >= 5))


def core_words(text: str) -> tuple[str, ...]:
    """The telling words of one spelling of a name, in order."""
    text = re.sub(r"#\s*\w+", " ", text)
    text = re.sub(r"(?i)\b(platform|track|bay|stand|gleis|quay|entrance)\s+\w{1,3}\s*$", " ", text)
    words = [SHORT.get(w, w) for w in tokens_of(text.replace(",", " "))]
    kept = [w for w in words if not _is_noise(w) and w != "&" and not (w.isdigit() and len(w) < 6)]
    return tuple(kept or [w for w in words if w != "&"])


def variants(name: str | None, localities: frozenset[str] = frozenset()) -> list[tuple[str, ...]]:
    """The ways a name may be meant: without what is in brackets, and of each comma the sides that are no locality.

    Streets of a crossing are looked at one by one; where no side of a comma is known, the street may be meant whole or
    by any one side. A name writes its towns alike at all its streets, so all streets are read the same way.
    """
    if not name or not name.strip():
        return []
    bare = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name)
    streets: list[list[str]] = []
    for street in re.split(r"[&/|@+]|\b(?:and|at)\b", bare, flags=re.I):
        sides = [x for x in street.split(",") if x.strip()]
        told = [x for x in sides if " ".join(tokens_of(x)) not in localities]
        streets.append([" ".join(told)] if len(told) < len(sides) and told else [street.replace(",", " "), *(sides if len(sides) > 1 else [])])
    ways = [[o[k] if k < len(o) else o[-1] for o in streets] for k in range(max(map(len, streets)))]
    return [v for v in dict.fromkeys(core_words(" & ".join(w)) for w in ways) if v]


def name_terms(forms: list[tuple[str, ...]]) -> Counter:
    out: Counter = Counter()
    for form in forms:
        for w in form:
            out[f"w:{w}"] = 1
            padded = f" {w} "
            for i in range(len(padded) - 2):
                out[f"t:{padded[i : i + 3]}"] = 1
    return out


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << DF_BITS) - 1)


class Index:
    """Document frequencies of hashed terms: a fixed-size table whatever the corpus."""

    def __init__(self, counts: np.ndarray, docs: int, mean_terms: float):
        self.idf = np.log(1 + (docs - np.minimum(counts, docs) + 0.5) / (counts + 0.5))
        self.mean = max(mean_terms, 1.0)

    def weights(self, terms: Counter) -> dict[str, float]:
        """Upper bounds of the terms' scores; letter triples count a quarter of words."""
        return {t: float(self.idf[bucket_of(t)]) * (K1 + 1) * (1.0 if t[0] == "w" else 0.25) for t in terms}

    def share(self, query: dict[str, float], doc: Counter) -> float:
        """BM25 of the document as a share of what the query can reach."""
        size = K1 * (1 - B + B * len(doc) / self.mean)
        best = sum(query.values()) or 1.0
        # A document is its own best match: the length norm is taken relative to one of the query's length.
        own = K1 * (1 - B + B * len(query) / self.mean)
        got = sum(w for t, w in query.items() if t in doc)
        return min(1.0, got / best * (1 + own) / (1 + size)) if size > own else got / best


def _featured(df: DataFrame, localities: frozenset[str]) -> DataFrame:
    """`df` (rid, name, ...) with `forms` (the variants, words by blanks, variants by |) and the buckets of its terms;
    records without a telling name are left out. The keys of stops become strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = [variants(n, localities) for n in batch["name"]]
            batch["forms"] = ["|".join(" ".join(f) for f in fs) for fs in forms]
            batch["buckets"] = [sorted({bucket_of(t) for t in name_terms(fs)}) for fs in forms]
            if (batch["forms"] != "").any():
                yield batch[batch["forms"] != ""]

    if "scope" in df.columns:
        df = df.withColumn("rid", _text_key(F.col("rid")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, forms string, buckets array<int>")


def _index(docs: DataFrame) -> Index:
    """Frequencies over all documents, added up per task before they are sent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << DF_BITS, np.int64)
        n = terms = 0
        for batch in batches:
            for buckets in batch["buckets"]:
                counts[np.asarray(buckets, np.int64)] += 1
                n, terms = n + 1, terms + len(buckets)
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": np.concatenate((used, [-1, -2])), "n": np.concatenate((counts[used], [n, terms]))})

    rows = docs.select("buckets").mapInPandas(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most 65,538 rows
    counts, total = np.zeros(1 << DF_BITS, np.int64), {-1: 0, -2: 0}
    for r in rows:
        if r.bucket < 0:
            total[r.bucket] = r.n
        else:
            counts[r.bucket] = r.n
    return Index(counts, total[-1], total[-2] / max(1, total[-1]))


def _torn(pairs: list[tuple[list[str], list[str]]]) -> np.ndarray:
    """Of pairs of equally many words, those with a word that slips cannot make of its counterpart."""
    where = [k for k, (u, _) in enumerate(pairs) for _ in u]
    one, two = [w for u, _ in pairs for w in u], [w for _, v in pairs for w in v]
    out = np.zeros(len(pairs), bool)
    for k, n, a, b in zip(where, edit_distance(one, two).tolist(), one, two):
        out[k] |= n > allowed_edits(min(len(a), len(b)))
    return out


def name_similarity(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """1 for the same telling words in any order, less by the share of letters that differ; 0 beyond what slips
    explain or where directions contradict. Each side is a list of variants; the best combination counts."""
    owner, x, y = [], [], []
    for k, (p, q) in enumerate(zip(a, b)):
        for u in p:
            for v in q:
                owner.append(k), x.append(u), y.append(v)
    out = np.zeros(len(a))
    if not owner:
        return out
    words = [(u.split(), v.split()) for u, v in zip(x, y)]
    d = np.minimum(
        edit_distance([u.replace(" ", "") for u in x], [v.replace(" ", "") for v in y]),
        edit_distance(["".join(sorted(u)) for u, _ in words], ["".join(sorted(v)) for _, v in words]),
    )
    # With several slips, word must agree with word: "Lane" and "Road" are no slips of one another.
    several = [p for p, (n, (u, v)) in enumerate(zip(d.tolist(), words)) if n >= 3 and len(u) == len(v)]
    torn = _torn([words[p] for p in several]) & _torn([(sorted(words[p][0]), sorted(words[p][1])) for p in several])
    apart = {p for p, t in zip(several, torn) if t}
    for p, (k, n, (u, v)) in enumerate(zip(owner, d.tolist(), words)):
        if p in apart:
            continue
        size = max(sum(map(len, u)), sum(map(len, v)))
        du, dv = DIRECTIONS & set(u), DIRECTIONS & set(v)
        if n > allowed_edits(min(sum(map(len, u)), sum(map(len, v)))) or (du != dv and ((du and dv) or n > 2)):
            continue
        out[k] = max(out[k], 1 - n / max(size, 1))
    return out


def letter_pairs(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list no, code, size) of the distinct letter pairs of each form, without its blanks: list 2i holds form i with its
    words in order, list 2i + 1 with its words sorted, and their codes differ; `size` is the letters of each list."""
    texts = []
    for f in forms:
        words = f.split(" ")
        texts += ["".join(words), "".join(sorted(words))]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    cp = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), size + 2)
    inner = owner[1:] == owner[:-1]
    at = owner[:-1][inner]
    code = ((cp[:-1] << 22) | (cp[1:] << 1))[inner] | (at & 1)
    order = np.lexsort((code, at))
    at, code = at[order], code[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
    return at[new], code[new], size


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of all positions start..start+count of each range."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]


def _slices(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions whose counts add up to about `most` each."""
    total, at = np.cumsum(count), 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


class Lists:
    """Inverted lists of letter pairs over (cell, name) documents; a document of a name is a form in one word order."""

    def __init__(self, cells: np.ndarray, names: np.ndarray, forms: list[list[str]]):
        counts = np.array([len(f) for f in forms], np.int64)
        first = np.cumsum(counts) - counts
        at, code, size = letter_pairs([x for f in forms for x in f])
        begin = np.searchsorted(at, np.arange(len(size) + 1))
        # Lists of each (cell, name): two for each of its forms.
        self.row, lists = _ranges(2 * first[names], 2 * counts[names])
        owner, where = _ranges(begin[lists], begin[lists + 1] - begin[lists])
        self.doc, self.code, self.cell = owner, code[where], cells[self.row][owner]
        self.size, self.terms = size[lists], begin[lists + 1] - begin[lists]
        self.kind = lists & 1


def name_pairs(a_cells: np.ndarray, a_names: np.ndarray, a_forms: list[list[str]], b_cells: np.ndarray, b_names: np.ndarray, b_forms: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of (cell, name) rows of one cell whose names may be within the slips allowed.

    A slip changes at most three letter pairs, so of the D distinct pairs of a query with k slips at least D - 3k are in
    the other list, and one of its D - (D - 3k) + 1 rarest must be. Where D - 3k is not above 0 (names of one or two
    letters, or of few different ones) all lists of a fitting length are looked at.
    """
    none = np.zeros(0, np.int64)
    if not len(a_cells) or not len(b_cells):
        return none, none
    a, b = Lists(a_cells, a_names, a_forms), Lists(b_cells, b_names, b_forms)
    codes, coded = np.unique(np.concatenate((a.code, b.code)), return_inverse=True)
    top = len(codes)
    a_key, b_key = a.cell * top + coded[: len(a.code)], b.cell * top + coded[len(a.code) :]
    order = np.argsort(a_key, kind="stable")
    posting_key, posting_doc = a_key[order], a.doc[order]
    slips = np.array([allowed_edits(n) for n in range(int(b.size.max(initial=0)) + 1)])[b.size]
    need = b.terms - 3 * slips
    low, high = np.searchsorted(posting_key, b_key), np.searchsorted(posting_key, b_key, "right")
    # The rarest terms of each query first; those up to terms - need + 1 are read.
    rare = np.lexsort((high - low, b.doc))
    begin = np.cumsum(b.terms) - b.terms
    place = np.arange(len(rare)) - begin[b.doc[rare]]
    read = rare[(place <= 3 * slips[b.doc[rare]]) & (need[b.doc[rare]] > 0)]
    doc_key = np.sort(a.doc * np.int64(top) + coded[: len(a.code)])
    found: list[np.ndarray] = []
    rows = np.int64(len(a_cells))

    def admit(q: np.ndarray, d: np.ndarray) -> None:
        """Pairs of lists that are of a fitting length and share what is needed, as pairs of rows."""
        fits = np.abs(b.size[q] - a.size[d]) <= slips[q]
        q, d = q[fits], d[fits]
        for s, e in _slices(b.terms[q], SLICE):
            owner, where = _ranges(begin[q[s:e]], b.terms[q[s:e]])
            key = d[s:e][owner] * np.int64(top) + coded[len(a.code) :][where]
            at = np.minimum(np.searchsorted(doc_key, key), len(doc_key) - 1)
            shared = np.bincount(owner, doc_key[at] == key, e - s)
            ok = shared >= need[q[s:e]]
            found.append(np.unique(b.row[q[s:e][ok]] * rows + a.row[d[s:e][ok]]))

    for s, e in _slices(high[read] - low[read], SLICE):
        part = read[s:e]
        owner, where = _ranges(low[part], high[part] - low[part])
        seen = np.unique(b.doc[part[owner]] * np.int64(len(a.row)) + posting_doc[where])
        admit(seen // len(a.row), seen % len(a.row))
    few = np.flatnonzero(need <= 0)
    if len(few):
        by_cell = np.lexsort((a.kind, a_cells[a.row]))
        group = a_cells[a.row][by_cell] * 2 + a.kind[by_cell]
        mine = b_cells[b.row[few]] * 2 + b.kind[few]
        lo, hi = np.searchsorted(group, mine), np.searchsorted(group, mine, "right")
        for s, e in _slices(hi - lo, SLICE):
            owner, where = _ranges(lo[s:e], hi[s:e] - lo[s:e])
            admit(few[s:e][owner], by_cell[where])
    pairs = np.unique(np.concatenate(found)) if found else none
    return pairs % rows, pairs // rows


def place_share(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    """Share of the grid-cell terms that a place and a stop have in common; a stop asks for the nine cells around it."""
    metre = EARTH_M * math.pi / 180
    shrink = np.maximum(0.05, np.cos(np.radians((np.floor(lat_b / CELL_DEG) + 0.5) * CELL_DEG)))
    out = np.zeros(len(lat_a))
    for size in LEVELS_M:
        cell = lambda v: np.floor(v * metre / size)
        out += (np.abs(cell(lat_a) - cell(lat_b)) <= 1) & (np.abs(cell(lon_a * shrink) - cell(lon_b * shrink)) <= 1)
    return out / len(LEVELS_M)


def distance_m(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat_a), np.radians(lat_b)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1)))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, count, order, ids): rows by equal keys; `ids` is the group of each row, in the order of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    start = np.flatnonzero(new)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(new) - 1
    return start, np.diff(np.append(start, len(order))), order, ids


def _first(rank: list[np.ndarray], keys: list[np.ndarray], most: int) -> np.ndarray:
    """Whether each row is among the `most` first of its group by `rank`."""
    order = np.lexsort((*rank[::-1], *keys[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    start = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    out = np.zeros(len(order), bool)
    out[order] = place < most
    return out


_FOUND = "dist double, name_sim double, score double"


def _retrieve(p: pd.DataFrame, q: pd.DataFrame, index: Index, max_m: float) -> pd.DataFrame:
    """The best `KEEP` places of each stop and the best stop of each place and scope within the task's parts of cells."""
    empty = pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("a", object), ("b", object), ("scope", object), ("dist", float), ("name_sim", float), ("score", float))})
    if not len(p) or not len(q):
        return empty
    parts = np.unique(np.concatenate((p["part"], q["part"])))
    part_a, part_b = np.searchsorted(parts, p["part"]), np.searchsorted(parts, q["part"])
    text_a, name_a = np.unique(p["forms"].to_numpy(str), return_inverse=True)
    text_b, name_b = np.unique(q["forms"].to_numpy(str), return_inverse=True)
    forms_a, forms_b = [t.split("|") for t in text_a], [t.split("|") for t in text_b]
    # Names, not records, are looked up: records of one name and cell share its lists.
    start_a, count_a, order_a, _ = _groups(part_a, name_a)
    start_b, count_b, order_b, _ = _groups(part_b, name_b)
    one_a, one_b = order_a[start_a], order_b[start_b]
    ia, ib = name_pairs(part_a[one_a], name_a[one_a], forms_a, part_b[one_b], name_b[one_b], forms_b)
    if not len(ia):
        return empty
    both, which = np.unique(name_b[one_b][ib] * np.int64(len(text_a)) + name_a[one_a][ia], return_inverse=True)
    na, nb = (both % len(text_a)).tolist(), (both // len(text_a)).tolist()
    sim = name_similarity([forms_a[k] for k in na], [forms_b[k] for k in nb])
    terms: dict[str, tuple[dict[str, float], Counter]] = {}

    def known(text: str) -> tuple[dict[str, float], Counter]:
        if text not in terms:
            counted = name_terms([tuple(f.split()) for f in text.split("|")])
            terms[text] = (index.weights(counted), counted)
        return terms[text]

    share = np.zeros(len(both))
    for k, (x, y) in enumerate(zip(na, nb)):
        u, v = known(text_a[x]), known(text_b[y])
        share[k] = max(index.share(v[0], u[1]), index.share(u[0], v[1]))
    # Records of the names that go together, a slice of the pairs at a time, and of each slice only the best.
    lat_a, lon_a, lat_b, lon_b = (d[c].to_numpy(float) for d in (p, q) for c in ("lat", "lon"))
    ra = np.unique(p["a"].to_numpy(), return_inverse=True)[1]
    rb = np.unique(q["b"].to_numpy(str), return_inverse=True)[1]
    scope = np.unique(q["scope"].fillna("").to_numpy(str), return_inverse=True)[1] * 2 + q["scope"].isna().to_numpy()
    kept = np.zeros((6, 0))
    for s, e in _slices(count_a[ia] * count_b[ib], SLICE):
        at, k = _ranges(np.zeros(e - s, np.int64), count_a[ia[s:e]] * count_b[ib[s:e]])
        i = order_a[start_a[ia[s:e]][at] + k // count_b[ib[s:e]][at]]
        j = order_b[start_b[ib[s:e]][at] + k % count_b[ib[s:e]][at]]
        dist = distance_m(lat_a[i], lon_a[i], lat_b[j], lon_b[j])
        near = dist <= max_m
        i, j, dist, w = i[near], j[near], dist[near], which[s:e][at][near]
        score = 0.5 * np.maximum(share[w], sim[w]) + 0.5 * place_share(lat_a[i], lon_a[i], lat_b[j], lon_b[j])
        score = np.round(score, 9)
        kept = np.concatenate((kept, np.stack((i, j, dist, sim[w], score, share[w]))), 1)
        i, j = kept[0].astype(np.int64), kept[1].astype(np.int64)
        rank = [-kept[4], -kept[3], kept[2]]
        kept = kept[:, _first([*rank, ra[i]], [rb[j]], KEEP) | _first([*rank, rb[j]], [ra[i], scope[j]], 1)]
    if not kept.shape[1]:
        return empty
    i, j = kept[0].astype(np.int64), kept[1].astype(np.int64)
    return pd.DataFrame({"a": p["a"].to_numpy()[i], "b": q["b"].to_numpy()[j], "scope": q["scope"].to_numpy()[j], "dist": kept[2], "name_sim": kept[3], "score": kept[4]})


def _names_alike(pairs: DataFrame) -> DataFrame:
    """`pairs` of names (forms_a, forms_b) with their similarity, those below `SURE_NAME` left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["name_sim"] = name_similarity([f.split("|") for f in batch["forms_a"]], [f.split("|") for f in batch["forms_b"]])
            if (batch["name_sim"] >= SURE_NAME).any():
                yield batch[batch["name_sim"] >= SURE_NAME]

    return pairs.mapInPandas(run, "forms_a string, forms_b string, name_sim double")


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (last: intercept) by Newton steps with a small ridge."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def calibrated(sample: pd.DataFrame) -> np.ndarray:
    """Weights of name similarity, score and gap, and the intercept, from rows with k = 1 (taken as true) and k = 2."""
    y = (sample["k"] == 1).to_numpy(float)
    if min(y.sum(), (1 - y).sum()) < LEAST_SAMPLE:
        return np.array(PRIOR)
    return fit_logistic(sample[["name_sim", "score", "gap"]].to_numpy(float), y)


def _text_key(key: Column) -> Column:
    """A key of any type as a string."""
    return F.to_json(F.struct(key.alias("key")))


def _grams(names: DataFrame, name: str) -> DataFrame:
    """(name, form, kind, letters, whole, runs) of distinct names (`forms`): hashes of the whole and of the runs of `GRAM`
    letters of each form, once with its words in order (kind 0) and once sorted (kind 1)."""
    pad = " " * (GRAM - 1)
    glued = F.array(F.struct(F.lit(0).alias("kind"), F.replace("text", F.lit(" "), F.lit("")).alias("text")), F.struct(F.lit(1).alias("kind"), F.array_join(F.array_sort(F.split("text", " ")), "").alias("text")))
    forms = names.select(F.xxhash64("forms").alias(name), F.explode(F.split("forms", r"\|")).alias("text")).select(name, F.explode(glued).alias("f"))
    forms = forms.select(name, F.xxhash64("f").alias("form"), "f.kind", F.char_length("f.text").alias("letters"), F.concat(F.lit(pad), "f.text", F.lit(pad)).alias("text"))
    runs = F.transform(F.sequence(F.lit(1), F.col("letters") + (GRAM - 1)), lambda i: F.xxhash64("kind", F.substring("text", i, F.lit(GRAM))))
    return forms.select(name, "form", "kind", "letters", F.xxhash64("kind", "text").alias("whole"), F.array_distinct(runs).alias("runs"))


def _length_term(kind: Column, letters: Column) -> Column:
    return F.xxhash64(F.lit("length"), kind, letters)


def _names_near(a: DataFrame, b: DataFrame) -> DataFrame:
    """(forms_a, forms_b, name_sim) of distinct names with at least `SURE_NAME` in common.

    So much in common leaves at most k slips, and a slip changes at most `GRAM` + 1 runs of letters: one of the
    (GRAM + 1) k + 1 rarest runs of a name is in its counterpart, whose length differs by at most k. With k = 0 the
    whole is looked up. Names of fewer different runs are compared with all of fitting length.
    """
    lists, asked = _grams(a, "na"), _grams(b, "nb")
    k = F.floor(F.col("letters") * (1 - SURE_NAME) / SURE_NAME + 1e-9).cast("int")
    asked = materialise(asked.withColumn("k", k))
    enough = F.size("runs") > (GRAM + 1) * F.col("k")
    terms = asked.where(enough).select("nb", "form", "letters", "k", F.explode(F.when(F.col("k") > 0, F.col("runs")).otherwise(F.array("whole"))).alias("term"))
    lengths = F.transform(F.sequence(F.greatest(F.lit(1), F.col("letters") - F.col("k")), F.col("letters") + F.col("k")), lambda n: _length_term(F.col("kind"), n))
    few = asked.where(~enough).select("nb", "letters", "k", F.explode(lengths).alias("term"))
    wanted = terms.select("term").unionByName(few.select("term")).distinct()
    lists = lists.select("na", F.col("letters").alias("size"), F.explode(F.concat("runs", F.array("whole", _length_term(F.col("kind"), F.col("letters"))))).alias("term"))
    lists = materialise(lists.join(wanted, "term", "left_semi"))
    sizes = lists.groupBy("term").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("nb", "form").orderBy(F.coalesce("n", F.lit(0)), "term"))
    rare = terms.join(sizes, "term", "left").withColumn("place", place).where(F.col("place") <= (GRAM + 1) * F.col("k") + 1)
    pairs = rare.select("nb", "letters", "k", "term").unionByName(few).join(lists, "term").where(F.abs(F.col("size") - F.col("letters")) <= F.col("k")).select("na", "nb").distinct()
    named = lambda x, key, out: x.select(F.xxhash64("forms").alias(key), F.col("forms").alias(out))
    return _names_alike(pairs.join(named(b, "nb", "forms_b"), "nb").join(named(a, "na", "forms_a"), "na").select("forms_a", "forms_b"))


def _by_name(a: DataFrame, b: DataFrame, spot: Column) -> DataFrame:
    """(a, b, scope, name_sim, n) for stops without coordinates; see `match_entities`. `n` counts the places of that
    name in the square."""
    lost = b.where(~spot)
    alone = materialise(lost.groupBy("scope", "forms").agg(F.count("*").alias("n"), F.min("rid").alias("b")).where("n = 1").drop("n"))
    alike = materialise(_names_near(a.where(spot).select("forms").distinct(), alone.select("forms").distinct()))
    wide = lambda c: F.floor(F.col(c) / AREA_DEG).cast("long")
    around = F.explode(F.array(*[F.struct((wide("lat") + i).alias("cy"), (wide("lon") + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("at")
    there = a.where(spot).groupBy(F.col("forms").alias("forms_a"), wide("lat").alias("cy"), wide("lon").alias("cx")).agg(F.min("rid").alias("a"), F.count("*").alias("n"))
    wanted = alone.select("scope", "b", F.col("forms").alias("forms_b")).join(alike, "forms_b").join(there, "forms_a")
    areas = b.where(spot).join(alone.select("scope").distinct(), "scope", "left_semi").select("scope", around).select("scope", "at.cy", "at.cx").distinct()
    return wanted.join(areas, ["scope", "cy", "cx"]).select("a", "b", "scope", "name_sim", "n")


def match_entities(places: DataFrame, stops: DataFrame, *, localities: list[str] | None = None, max_m: float = 500.0, threshold: float = 0.5) -> DataFrame:
    """(a, b, confidence, score, dist) for `places` (key, name, lat, lon) and `stops` (key, scope, name, lat, lon).

    `localities` are names of towns that may be written beside a stop's name (a list that a task can hold).
    A place matches at most one stop of each scope and a stop at most one place. Records without a telling name match
    nothing. Coordinates that are null, NaN or (0, 0) are not used: such a stop is matched by a name that is its own
    within its scope, to a place of that name in or beside a square of 0.1 degrees in which its scope has other stops,
    and clearly of no other. A stop is also looked for with its coordinates swapped, unless that is within 0.02 degrees
    of where it stands. Exact copies (name and coordinates, for stops also the scope) are matched as one; the place
    with the smallest key stands for its copies, each copy of a stop gets the match. Repeated keys count once. Ties go
    to the greater name similarity, then the smaller distance, then the smaller key. Columns besides these are ignored.
    Empty tables give an empty result.
    """
    known = frozenset(" ".join(tokens_of(x)) for x in localities or [])
    named = "name is not null and trim(name) != ''"
    spot = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    a = places.where(named).groupBy("name", "lat", "lon").agg(F.min("key").alias("rid"))
    copies = stops.where(named).select("key", "scope", "name", "lat", "lon").distinct()
    firsts = copies.groupBy("scope", "name", "lat", "lon").agg(F.min("key").alias("rid"))
    a = materialise(_featured(spread(a.select("rid", "name", "lat", "lon")), known))
    b = materialise(_featured(spread(firsts.select("rid", "scope", "name", "lat", "lon")), known).drop("buckets"))
    index = _index(a)

    # Cells: a place stands in all that its circle touches, a stop in its own and in that of swapped coordinates.
    reach = F.lit(max_m * 1.01 / EARTH_M * 180 / math.pi)
    row = lambda lat: F.floor(lat / CELL_DEG).cast("long")
    # Within a row of cells the columns are of equal width in metres.
    shrink = lambda r: F.greatest(F.lit(0.05), F.cos(F.radians((r + 0.5) * CELL_DEG)))
    column = lambda lon, r: F.floor(lon * shrink(r) / CELL_DEG).cast("long")
    wide = lambda r: reach / F.greatest(F.lit(0.05), F.cos(F.radians(F.least(F.lit(90.0), F.abs("lat") + reach))))
    touched = F.flatten(F.transform(
        F.sequence(row(F.col("lat") - reach), row(F.col("lat") + reach)),
        lambda r: F.transform(F.sequence(column(F.col("lon") - wide(r), r), column(F.col("lon") + wide(r), r)), lambda c: F.struct(r.alias("y"), c.alias("x"))),
    ))
    pa = a.where(spot).where("abs(lat) <= 90").select(F.col("rid").alias("a"), "forms", "lat", "lon", F.explode(touched).alias("cell"))
    swap = F.when(F.abs(F.col("lat") - F.col("lon")) > 0.02, F.array(F.struct("lat", "lon"), F.struct(F.col("lon").alias("lat"), F.col("lat").alias("lon")))).otherwise(F.array(F.struct("lat", "lon")))
    sb = b.where(spot).select(F.col("rid").alias("b"), "scope", "forms", F.explode(swap).alias("at")).select("b", "scope", "forms", "at.lat", "at.lon").where("abs(lat) <= 90")
    sb = sb.select("*", F.struct(row(F.col("lat")).alias("y"), column(F.col("lon"), row(F.col("lat"))).alias("x")).alias("cell"))
    # Cells of both sides are counted before anything moves; the rows of a crowded cell are dealt to parts by hash, and
    # each part of one side meets each of the other in one task. At most one cell in `PART_ROWS` rows is crowded.
    in_a, in_b = (materialise(x.groupBy("cell").agg(F.count("*").alias("n"))) for x in (pa, sb))
    total = sum(x.agg(F.sum("n")).first()[0] or 0 for x in (in_a, in_b))
    blocks = max(1, math.ceil(total / BLOCK_ROWS))
    parts = lambda x, name: x.where(F.col("n") > PART_ROWS).select("cell", F.ceil(F.col("n") / PART_ROWS).cast("int").alias(name))
    crowded = materialise(parts(in_a, "cn").join(parts(in_b, "cm"), "cell", "full"))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(F.col(n), F.lit(1))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    block = F.pmod(F.xxhash64("cell", "i", "j"), F.lit(blocks)).alias("block")
    pa = pa.join(crowded, "cell", "left").select("*", dealt("a", "cn").alias("i"), each("cm").alias("j")).select(block, F.xxhash64("cell", "i", "j").alias("part"), "a", "forms", "lat", "lon")
    sb = sb.join(crowded, "cell", "left").select("*", dealt("b", "cm").alias("j"), each("cn").alias("i")).select(block, F.xxhash64("cell", "i", "j").alias("part"), "b", "scope", "forms", "lat", "lon")
    key = places.schema["key"].dataType.simpleString()
    found = pa.groupBy("block").cogroup(sb.groupBy("block")).applyInPandas(lambda p, q: _retrieve(p, q, index, max_m), f"a {key}, b string, scope string, {_FOUND}")
    found = materialise(found)

    # The first places of each stop, and the first stop of each place within a scope.
    rank = [F.desc("score"), F.desc("name_sim"), F.asc("dist")]
    of_stop = W.partitionBy("b").orderBy(*rank, "a")
    tops = found.withColumns({"k": F.row_number().over(of_stop), "gap": F.col("score") - F.coalesce(F.lead("score").over(of_stop), F.lit(0.0))}).where("k <= 2")
    best_a = found.withColumn("j", F.row_number().over(W.partitionBy("a", "scope").orderBy(*rank, "b"))).where("j = 1").select("a", "b", F.lit(True).alias("mutual"))
    tops = materialise(tops.join(best_a, ["a", "b"], "left"))
    mutual = tops.where("k = 1 and mutual")

    # Calibration on a sample of one rate: what stops find first, against what they find with that withheld.
    first, second = tops.agg(F.count_if((F.col("k") == 1) & F.col("mutual")), F.count_if(F.col("k") == 2)).first()
    rate = min(1.0, SAMPLE_ROWS / max(1, first + second))
    sample = tops.where((F.col("k") == 2) | F.col("mutual")).where(F.pmod(F.xxhash64(F.lit("sample"), "a", "b"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    w = calibrated(sample.select("name_sim", "score", "gap", "k").toPandas())
    logit = F.lit(float(w[3])) + F.col("name_sim") * float(w[0]) + F.col("score") * float(w[1]) + F.col("gap") * float(w[2])
    near_match = mutual.where("name_sim > 0").withColumn("confidence", 1 / (1 + F.exp(-logit))).where(F.col("confidence") >= threshold)
    near_match = materialise(near_match.select("a", "b", "scope", "confidence", "score", "dist"))

    # Without usable coordinates: the place must clearly be the best of the stop and not be taken in its scope.
    named_pairs = materialise(_by_name(a, b, spot))
    by_stop, by_place = W.partitionBy("b").orderBy(F.desc("name_sim"), "a"), W.partitionBy("a", "scope").orderBy(F.desc("name_sim"), "b")
    best = named_pairs.withColumns({"k": F.row_number().over(by_stop), "next": F.lead("name_sim").over(by_stop), "j": F.row_number().over(by_place)})
    best = best.where("k = 1 and j = 1 and n = 1").where(F.col("name_sim") - F.coalesce("next", F.lit(0.0)) >= 0.1)
    by_name = best.join(near_match.select("a", "scope"), ["a", "scope"], "left_anti").select(
        "a", "b", (F.col("name_sim") * 0.6).alias("confidence"), (F.col("name_sim") * 0.5).alias("score"), F.lit(None).cast("double").alias("dist")
    )
    matched = near_match.drop("scope").unionByName(by_name.where(F.col("confidence") >= threshold))
    back = copies.join(firsts, copies["scope"].eqNullSafe(firsts["scope"]) & (copies["name"] == firsts["name"]) & copies["lat"].eqNullSafe(firsts["lat"]) & copies["lon"].eqNullSafe(firsts["lon"]))
    back = back.select(copies["key"].alias("stop"), _text_key(firsts["rid"]).alias("b"))
    return matched.join(back, "b").select("a", F.col("stop").alias("b"), "confidence", "score", "dist")
