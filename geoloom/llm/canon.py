"""Mapping freely typed values to a canonical list.

A value is read as normalised tokens. A multi-pattern automaton over all canonical names and aliases finds embedded
mentions; the longest non-overlapping one wins if what remains of the value is only filler. Everything else goes to a
token-set similarity: the smallest edit distance between value and entry over their token orders, measured without
spaces so that split and glued words count as one slip, accepted only if the words that tell entries apart agree.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTRIES = 200_000

# Words that stand around the names of towns and firms without being part of them (legal forms, parts of a
# town, courtesies), as phrases of normalised tokens; the default of the parameter `filler`.
FILLER = (
    "the", "inc", "ltd co", "llc", "gmbh", "express", "city", "city of", "town of", "greater", "downtown", "old town",
    "lower ward", "upper ward", "east division", "west division", "north division", "south division", "public",
    "private limited", "c o", "care of", "tm",
)
# Abbreviations and spelling variants in names of places and organisations.
SHORT = {
    "mt": "mount", "mnt": "mount", "mtn": "mountain", "st": "saint", "ste": "saint", "ft": "fort", "pt": "port", "prt": "port",
    "n": "north", "no": "north", "nth": "north", "s": "south", "so": "south", "sth": "south", "e": "east", "w": "west",
    "upr": "upper", "up": "upper", "lr": "lower", "lwr": "lower", "lk": "lake", "nw": "new", "hbr": "harbor", "harbour": "harbor",
    "hts": "heights", "hgts": "heights", "ht": "heights", "jn": "junction", "jct": "junction", "jctn": "junction", "spgs": "springs",
    "sprs": "springs", "spg": "springs", "fls": "falls", "vly": "valley", "co": "company", "cmpny": "company", "mkt": "market",
    "mrkt": "market", "dept": "department", "dpt": "department", "dist": "district", "sch": "school", "auth": "authority",
    "trans": "transit", "tr": "transit", "corp": "corporation", "assn": "association", "assoc": "association", "ltd": "limited", "pwr": "power",
    "bd": "board", "brd": "board", "wtr": "water", "hsg": "housing", "rx": "pharmacy", "pharm": "pharmacy", "phcy": "pharmacy", "bks": "books", "cof": "coffee",
    "kit": "kitchen", "ktchn": "kitchen", "fl": "fuel", "and": "&", "bros": "brothers", "rwy": "rail", "rlwy": "rail", "pk": "parks", "pks": "parks",
}
_LOOKALIKE = str.maketrans("0135", "oles")


def tokens_of(text: str) -> list[str]:
    """Normalised tokens: compatibility forms, no accents, case or punctuation; a part after a comma goes first."""
    text = "".join(" " if unicodedata.category(ch) == "So" else ch for ch in text)
    text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch)).casefold()
    head, comma, tail = text.partition(",")
    if comma and tail.strip() and "," not in tail:
        text = f"{tail} {head}"
    text = re.sub(r"[&+]", " & ", re.sub(r"['’`]", "", text))
    words = re.findall(r"&|[^\W_]+", text)
    words = [w.translate(_LOOKALIKE) if re.search(r"\d", w) and re.search(r"[^\W\d]", w) else w for w in words]
    if len(words) > 1 and all(len(w) == 1 for w in words):
        words = ["".join(words)]
    return words


def expand(words: list[str]) -> list[str]:
    return [SHORT.get(w, w) for w in words]


def fold(text: str) -> str:
    """Letters that look alike become one."""
    return text.replace("rn", "m").replace("vv", "w")


def _phrases(words: list[str], filler: frozenset[str]) -> list[str]:
    """`words` without filler phrases and bare numbers (none if nothing else is there)."""
    kept, i = [], 0
    while i < len(words):
        for size in (2, 1):
            if len(words) >= i + size and " ".join(words[i : i + size]) in filler:
                i += size
                break
        else:
            if not words[i].isdigit():
                kept.append(words[i])
            i += 1
    return kept


def edit_distance(a: list[str], b: list[str]) -> np.ndarray:
    """Edits (insert, delete, replace, swap neighbours) between the strings at each position, all pairs at once."""
    n = len(a)
    if not n:
        return np.zeros(0, np.int16)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    wa, wb = max(1, la.max()), max(1, lb.max())
    ca = np.array(a, dtype=f"U{wa}").view(np.uint32).reshape(n, wa).T
    cb = np.array(b, dtype=f"U{wb}").view(np.uint32).reshape(n, wb).T
    out = np.where(la == 0, lb, 0).astype(np.int16)
    before: np.ndarray | None = None
    prev = np.repeat(np.arange(wb + 1, dtype=np.int16)[:, None], n, 1)
    for i in range(1, wa + 1):
        cur = np.empty_like(prev)
        cur[0] = i
        change = prev[:-1] + (ca[i - 1] != cb)
        skip = prev[1:] + 1
        best = np.minimum(change, skip)
        if i > 1 and wb > 1:
            swap = (ca[i - 1] == cb[:-1]) & (ca[i - 2] == cb[1:])
            best[1:] = np.where(swap, np.minimum(best[1:], before[:-2] + 1), best[1:])
        for j in range(1, wb + 1):
            np.minimum(best[j - 1], cur[j - 1] + 1, out=cur[j])
        done = la == i
        if done.any():
            out[done] = cur[lb[done], np.flatnonzero(done)]
        before, prev = prev, cur
    return out


class Canon:
    """The entries of one key, ready for matching."""

    def __init__(self, entries: list[tuple[int, str, list[str]]], filler: tuple[str, ...] = FILLER):
        import ahocorasick

        self.filler = frozenset(filler) | {fold(x) for x in filler}

        words = Counter(w for _, name, _ in entries for w in set(expand(tokens_of(name))))
        self.generic = {w for w, n in words.items() if n >= max(3, len(entries) // 100)}
        self.exact: dict[str, int] = {}
        self.forms: list[tuple[str, tuple[str, ...], int]] = []  # squashed, words, entry
        automaton = ahocorasick.Automaton()
        for value_id, name, aliases in sorted(entries):
            for text in (name, *(aliases or [])):
                if not text or not (w := expand(tokens_of(text))):
                    continue
                key = " ".join(fold(x) for x in w)
                if self.exact.setdefault(key, value_id) == value_id:
                    automaton.add_word(f" {key} ", key)
                self.forms.append(("".join(w), tuple(w), value_id))
        self.automaton = automaton
        if len(automaton):
            automaton.make_automaton()
        # By length, so that the forms of a fitting length are one range.
        self.forms.sort(key=lambda f: (len(f[0]), f))
        self.size = np.array([len(f[0]) for f in self.forms], np.int64)
        self.limit = np.array([allowed_edits(n) for n in self.size.tolist()], np.int64)
        grams: dict[str, list[int]] = defaultdict(list)
        for k, (plain, _, _) in enumerate(self.forms):
            for g in letter_pairs(plain):
                grams[g].append(k)
        self.grams = {g: np.array(v) for g, v in grams.items()}
        self.alike = np.array([f[0].count("rn") + f[0].count("vv") for f in self.forms], np.int64)
        self.letters = np.stack([letter_counts(f[0]) for f in self.forms]) if self.forms else np.zeros((0, LETTERS), np.int16)

    def near(self, words: tuple[str, ...]) -> np.ndarray:
        """Forms that may be within the edits allowed of `words`, none of which is lost.

        Of P letter pairs at least P - 3 e - w are shared over e edits (one pair is lost per seam of the w words), so if
        that is above 0 one of the others' number plus one rarest pairs is; an edit changes at most two letters' counts.
        """
        text = "".join(words)
        most = allowed_edits(len(text) + 4)
        lo, hi = np.searchsorted(self.size, [len(text) - most, len(text) + most + 1])
        pairs = letter_pairs(text)
        least = len(pairs) - 3 * most - len(words)
        if least > 0:
            lists = sorted((self.grams[g] for g in pairs if g in self.grams), key=len)
            lists = lists[: max(0, 3 * most + len(words) + 1 - (len(pairs) - len(lists)))]
            near = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
            near = near[(near >= lo) & (near < hi)]
        else:
            near = np.arange(lo, hi)
        near = near[np.abs(self.size[near] - len(text)) <= self.limit[near]]
        # Look-alike letters are compared as one, each of which may stand for two.
        slack = 2 * self.limit[near] + 3 * (text.count("rn") + text.count("vv") + self.alike[near])
        return near[np.abs(self.letters[near] - letter_counts(text)).sum(1) <= slack]

    def mention(self, words: list[str]) -> int | None:
        """The entry of the longest non-overlapping mention if the rest of the value is filler."""
        if not len(self.automaton):
            return None
        text = f" {' '.join(fold(w) for w in words)} "
        found = sorted(((end - len(key) - 1, end, key) for end, key in self.automaton.iter(text)), key=lambda m: (m[0] - m[1], m[0]))
        taken: list[tuple[int, int, str]] = []
        for m in found:
            if all(m[1] <= t[0] + 1 or m[0] >= t[1] - 1 for t in taken):
                taken.append(m)
        if not taken:
            return None
        rest = text
        for start, end, _ in sorted(taken, reverse=True):
            rest = rest[: start + 1] + rest[end:]
        ids = {self.exact[key] for _, _, key in taken}
        return ids.pop() if len(ids) == 1 and not _phrases(rest.split(), self.filler) else None


LETTERS = 32  # classes that letters are counted in


def letter_pairs(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)}


def letter_counts(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % LETTERS, minlength=LETTERS).astype(np.int16)


def allowed_edits(size: int) -> int:
    return 1 if size < 6 else 2 if size < 10 else 3 if size < 16 else 4


def match_values(values: list[str], canon: Canon) -> list[tuple[int, float, str]]:
    """(entry or -1, similarity, how) of each value; ties go to the smaller entry id."""
    out: list[tuple[int, float, str]] = [(-1, 0.0, "none")] * len(values)
    left: list[tuple[int, list[str]]] = []
    for k, value in enumerate(values):
        raw = tokens_of(value or "")
        words = expand(raw)
        for option in (words, raw, ["".join(raw)]):
            if (hit := canon.exact.get(" ".join(fold(w) for w in option))) is not None:
                out[k] = (hit, 1.0, "same")
                break
        else:
            if (hit := canon.mention(words)) is not None:
                out[k] = (hit, 1.0, "mention")
            elif words:
                left.append((k, raw))
    if not left or not canon.forms:
        return out
    limits = canon.limit
    pair_k, pair_f, pair_w = [], [], []
    for k, raw in left:
        for words in {tuple(raw), tuple(expand(raw)), tuple(_phrases(expand(_phrases(raw, canon.filler)), canon.filler))}:
            for f in canon.near(words).tolist():
                pair_k.append(k), pair_f.append(f), pair_w.append(words)
    forms = [canon.forms[f] for f in pair_f]
    d = np.minimum.reduce([
        edit_distance(["".join(w) for w in pair_w], [f[0] for f in forms]),
        edit_distance([fold("".join(w)) for w in pair_w], [fold(f[0]) for f in forms]),
        edit_distance(["".join(sorted(w)) for w in pair_w], ["".join(sorted(f[1])) for f in forms]),
    ])
    fits = np.flatnonzero(d <= limits[pair_f]) if pair_f else np.zeros(0, np.int64)
    # Where the words pair up, each word that tells entries apart must agree by itself: long common words must not
    # outweigh a different name.
    where, one, two = [], [], []
    for p in fits.tolist():
        words, form = pair_w[p], forms[p][1]
        if len(words) == len(form):
            for w, x in zip(words, form):
                if x not in canon.generic:
                    where.append(p), one.append(w), two.append(x)
    apart = np.zeros(len(pair_k), bool)
    slips = np.minimum(edit_distance(one, two), edit_distance([fold(w) for w in one], [fold(x) for x in two]))
    for p, n, x in zip(where, slips.tolist(), two):
        apart[p] |= n > max(2, allowed_edits(len(x))) or 0 < n >= len(x) - 1
    best: dict[int, tuple[int, int, int]] = {}
    for p in fits.tolist():
        if not apart[p]:
            best[pair_k[p]] = min(best.get(pair_k[p], (99, 0, 0)), (int(d[p]), forms[p][2], int(canon.size[pair_f[p]])))
    for k, (d, value_id, size) in best.items():
        out[k] = (value_id, 1 - d / max(size, 1), "similar")
    return out


def canon_entries(canon: DataFrame) -> dict[str, list[tuple[int, str, list[str]]]]:
    """The reference list by key. It is held in memory by every task, so its size is checked first."""
    rows = canon.where("value_id is not null and tag_key is not null and canonical is not null").select("tag_key", "value_id", "canonical", "aliases")
    if (n := rows.count()) > MAX_ENTRIES:
        raise ValueError(f"{n} canonical entries exceed the {MAX_ENTRIES} that a task may hold")
    out: dict[str, list] = defaultdict(list)
    for r in rows.collect():
        out[r.tag_key].append((r.value_id, r.canonical, [a for a in r.aliases or [] if a]))
    return dict(out)


def map_values(values: DataFrame, canon: DataFrame, filler: tuple[str, ...] = FILLER) -> DataFrame:
    """(tag_key, value, value_id, similarity, how) for each distinct (tag_key, value) of `values`.

    `value_id` is -1 for unmatched values: blank ones, ones far from every entry, and all values of keys without
    entries. `how` is 'same' (equal after normalisation), 'mention', 'similar' or 'none'. Null values and keys are
    left out; ties go to the smaller entry id. `filler` are phrases of normalised tokens that may stand beside a
    mention. Columns besides the two are ignored.
    """
    entries = canon_entries(canon)
    built: dict[str, Canon] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby("tag_key", sort=False):
                if key not in built:
                    built[key] = Canon(entries.get(key, []), filler)
                found = match_values(part["value"].tolist(), built[key])
                yield pd.DataFrame({"tag_key": key, "value": part["value"].to_numpy(), "value_id": [f[0] for f in found], "similarity": [f[1] for f in found], "how": [f[2] for f in found]})

    distinct = values.where("tag_key is not null and value is not null").select("tag_key", "value").distinct()
    # The rows are few and small for the work they stand for; they would be put together in few tasks.
    distinct = distinct.repartition(values.sparkSession.sparkContext.defaultParallelism)
    return distinct.mapInPandas(run, "tag_key string, value string, value_id int, similarity double, how string")


def typed_values(places: DataFrame, canon: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(id, tag_key, value) of the tags of `keys` that are not, character for character, an entry of their key."""
    tags = F.map_filter("tags", lambda k, v: k.isin(*keys) & v.isNotNull())
    typed = places.select("id", F.explode(tags).alias("tag_key", "value")).distinct()
    return typed.join(canon.select("tag_key", F.col("canonical").alias("value")), ["tag_key", "value"], "left_anti")


def map_places(places: DataFrame, canon: DataFrame, keys: tuple[str, ...], filler: tuple[str, ...] = FILLER) -> DataFrame:
    """(id, tag_key, value, value_id, similarity, how) of every typed value, unmatched ones with -1.

    Each distinct value is matched once; a value that a third of all places share is one row there, and the join back
    is an inner join that adaptive execution splits where it is skewed.
    """
    typed = typed_values(places, canon, keys)
    return typed.join(map_values(typed, canon, filler), ["tag_key", "value"]).select("id", "tag_key", "value", "value_id", "similarity", "how")
