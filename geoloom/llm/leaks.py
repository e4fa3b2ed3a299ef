"""Evaluation passages leaking into a corpus, found by latent semantic retrieval.

Texts are normalised and coded once as word ids of the evaluation items' vocabulary (0: any other word). Passages are
overlapping windows of words. Their TF-IDF vectors, with document frequencies over the whole corpus, are projected on
the leading singular vectors of the passage matrix, which a randomised SVD finds from sums that every task adds up
over its own passages. Corpus passages whose cosine with an item's passage is high enough are candidates; a candidate
is checked by the longest run of common words, the longest common subsequence and the item's answer.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.util import materialise, spread

PASSAGE, STRIDE = 24, 12
RANK, OVERSAMPLE, POWER = 128, 16, 1
COSINE = 0.5
FIT_DOCUMENTS = 2048  # bound of the hash sample of documents that the singular vectors are fitted on
MAX_VOCABULARY = 200_000
LEAST_RUN = 12

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑¬]\s*\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e0fff]")


def words_of(text: str | None) -> list[str]:
    """Words for comparison: no case, punctuation, markup, invisible characters, line-break hyphens or compatibility
    forms. Null and empty texts have none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    if "-\n" in text or not text.isascii() or re.search(r"-[ \t\r]+\n", text):
        text = _BROKEN.sub("", text)
    return _WORD.findall(text.casefold())


class Items:
    """The evaluation items, held by every task; their size is checked."""

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        self.answers: list[np.ndarray] = []
        for item_id, text, answer in sorted(rows, key=lambda r: r[0]):
            coded = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(coded):
                self.ids.append(item_id)
                self.words.append(coded)
                self.answers.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(answer)], np.int32))
        if len(self.vocabulary) > MAX_VOCABULARY:
            raise ValueError(f"the items' {len(self.vocabulary)} words exceed {MAX_VOCABULARY}; compare them in several calls")
        self.size = len(self.vocabulary) + 1
        starts = [(k, s) for k, w in enumerate(self.words) for s in range(0, max(1, len(w) - PASSAGE + STRIDE), STRIDE)]
        self.owner = np.array([k for k, _ in starts], np.int64)
        self.passages = [self.words[k][s : s + PASSAGE] for k, s in starts]


def windows(n: int) -> np.ndarray:
    """Starts of the passages of a text of n words: any STRIDE + 1 words in a row lie within one."""
    return np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE)


def _code(docs: DataFrame, items: Items) -> DataFrame:
    vocabulary = items.vocabulary
    dtype = np.uint16 if items.size < 1 << 16 else np.int32

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = vocabulary.get
        for batch in batches:
            coded = [np.array([get(w, 0) for w in words_of(t)], dtype).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "words": coded})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, words binary")


def _frequencies(coded: DataFrame, items: Items, dtype: type) -> tuple[np.ndarray, int]:
    """Documents holding each word, over all documents: one vector per task, added up."""
    size = items.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for raw in batch["words"]:
                seen = np.zeros(size, bool)
                seen[np.frombuffer(raw, dtype)] = True
                counts += seen
                n += 1
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"word": np.concatenate((used, [-1])), "n": np.concatenate((counts[used], [n]))})

    rows = coded.select("words").mapInPandas(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per word of the items
    df, docs = np.zeros(size, np.int64), 0
    for r in rows:
        if r.word < 0:
            docs = r.n
        else:
            df[r.word] = r.n
    return df, docs


def _project(passages: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """TF-IDF rows of word-id passages (padded by 0) times a basis; no row is scaled."""
    out = np.zeros((len(passages), basis.shape[1]), np.float32)
    row, col = np.nonzero(passages)
    if len(row):
        word = passages[row, col]
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[heads]] = np.add.reduceat(basis[word] * idf[word, None], heads, axis=0)
    return out


def _padded(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    long = np.zeros(starts[-1] + PASSAGE, np.int64)
    long[: len(words)] = words[: len(long)]
    return long[starts[:, None] + np.arange(PASSAGE)[None, :]]


def _gram_times(passages: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A times the basis for the passages' TF-IDF rows, each of length one."""
    norm2 = (idf[passages] ** 2).sum(1)
    out = np.zeros_like(basis)
    weighted = (basis * idf[:, None]).astype(np.float32)
    for s in range(0, len(passages), 2048):
        p, n2 = passages[s : s + 2048], norm2[s : s + 2048]
        row, col = np.nonzero(p)
        if not len(row):
            continue
        word = p[row, col]
        heads = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        z = np.zeros((len(p), basis.shape[1]), np.float32)
        z[row[heads]] = np.add.reduceat(weighted[word], heads, axis=0)
        z /= np.maximum(n2, 1e-9)[:, None]
        order = np.argsort(word, kind="stable")
        word, row = word[order], row[order]
        heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[heads]] += np.add.reduceat(z[row], heads, axis=0) * idf[word[heads], None]
    return out


def singular_basis(coded: DataFrame, items: Items, idf: np.ndarray, dtype: type, docs: int, seed: int = 5) -> np.ndarray:
    """The leading right singular vectors of the matrix of passages, one row per word."""
    rank = min(RANK + OVERSAMPLE, items.size - 1)
    q = np.random.default_rng(seed).standard_normal((items.size, rank)).astype(np.float32)
    q[0] = 0
    share = min(1.0, FIT_DOCUMENTS / max(docs, 1))
    sample = coded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("words")
    own = np.zeros((len(items.passages), PASSAGE), np.int64)
    for k, p in enumerate(items.passages):
        own[k, : len(p)] = p
    for _ in range(POWER + 1):
        basis = np.linalg.qr(q)[0].astype(np.float32)
        basis[0] = 0

        def run(batches: Iterator[pd.DataFrame], basis=basis) -> Iterator[pd.DataFrame]:
            total, n = np.zeros_like(basis), 0
            held: list[np.ndarray] = []
            for batch in batches:
                for raw in batch["words"]:
                    w = np.frombuffer(raw, dtype)
                    if len(w):
                        held.append(_padded(w, windows(len(w))))
                        n += len(held[-1])
                    if sum(map(len, held[-64:])) > 4096 or len(held) >= 64:
                        total += _gram_times(np.concatenate(held), idf, basis)
                        held = []
            if held:
                total += _gram_times(np.concatenate(held), idf, basis)
            used = np.concatenate((np.flatnonzero(np.any(total != 0, axis=1)), [0]))
            total[0] = n  # the unused row of word 0 carries the number of passages
            yield pd.DataFrame({"word": used, "row": [r.tobytes() for r in total[used]]})

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"word": rows["word"].iloc[:1], "row": [np.sum([np.frombuffer(r, np.float32) for r in rows["row"]], axis=0, dtype=np.float32).tobytes()]})

        # One row per word and task goes into the sum: at most the tasks' number of rows in a group.
        parts = sample.mapInPandas(run, "word bigint, row binary").groupBy("word").applyInPandas(add, "word bigint, row binary").collect()
        sums = np.zeros_like(basis)
        for r in parts:
            sums[r.word] = np.frombuffer(bytes(r.row), np.float32)
        # The items' few passages weigh as much as all of the sample's.
        q = sums + _gram_times(own, idf, basis) * max(1.0, sums[0, 0] / len(own))
        q[0] = 0
    u, _, _ = np.linalg.svd(q, full_matrices=False)
    return u[:, : min(RANK, rank)].astype(np.float32)


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longest stretch that both have in a row; 0 matches nothing."""
    best, prev = 0, np.zeros(len(b) + 1, np.int32)
    for w in a:
        if w == 0:
            prev[:] = 0
            continue
        cur = np.zeros(len(b) + 1, np.int32)
        hit = b == w
        cur[1:][hit] = prev[:-1][hit] + 1
        best = max(best, int(cur.max()))
        prev = cur
    return best


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longest common subsequence; 0 matches nothing."""
    prev = np.zeros(len(b) + 1, np.int32)
    for w in a[a != 0]:
        cur = prev.copy()
        cur[1:] = np.maximum(prev[1:], np.where(b == w, prev[:-1] + 1, 0))
        prev = np.maximum.accumulate(cur)
    return int(prev[-1])


def _has_run(at: np.ndarray, size: int) -> bool:
    """Whether `size` of the sorted positions stand in a row."""
    return len(at) >= size and bool((at[size - 1 :] - at[: len(at) - size + 1] == size - 1).any())


def find_leaks(docs: DataFrame, items: DataFrame, *, cosine: float = COSINE, least_run: int = LEAST_RUN) -> DataFrame:
    """(doc_id, item_id, run, subsequence, item_words, answer, cosine) of `docs` (doc_id, text) and `items` (item_id,
    item_text, answer): candidates by latent cosine with what the checks found.

    `run` is the longest stretch of consecutive common words, `subsequence` the longest common subsequence with the
    part of the document around the candidate passages, `answer` whether the item's answer stands there. Candidates
    with fewer than `least_run` common words in a row and a subsequence under half of the item are dropped. Null and empty
    texts leak nothing, items without words are never leaked; repeated documents come out once each if ids differ,
    of items with one id the one with the greatest text counts. Empty tables give an empty result.
    """
    best = items.where("item_id is not null").groupBy("item_id").agg(F.max(F.struct("item_text", "answer")).alias("x"))
    held = Items([(r.item_id, r.x.item_text, r.x.answer) for r in best.collect()])  # bounded by MAX_VOCABULARY
    kind = docs.schema["doc_id"].dataType.simpleString()
    out_type = f"doc_id {kind}, item_id bigint, run int, subsequence int, item_words int, answer boolean, cosine double"
    if not held.ids:
        return docs.sparkSession.createDataFrame([], out_type)
    dtype = np.uint16 if held.size < 1 << 16 else np.int32
    coded = materialise(_code(docs.where("doc_id is not null"), held))
    df, n_docs = _frequencies(coded, held, dtype)
    idf = np.log(1 + (1 + n_docs) / (1 + df)).astype(np.float32)
    idf[0] = 0
    basis = singular_basis(coded, held, idf, dtype, n_docs)

    own = np.zeros((len(held.passages), PASSAGE), np.int64)
    for k, p in enumerate(held.passages):
        own[k, : len(p)] = p
    target = _project(own, idf, basis)
    target /= np.maximum(np.linalg.norm(target, axis=1, keepdims=True), 1e-9)
    item_words = [np.unique(w) for w in held.words]
    item_counts = [np.bincount(w, minlength=held.size)[u] for w, u in zip(held.words, item_words)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, raw in zip(batch["doc_id"], batch["words"]):
                words = np.frombuffer(raw, dtype)
                if not len(words):
                    continue
                starts = windows(len(words))
                total = np.concatenate(([0], np.cumsum(words != 0)))
                starts = starts[total[np.minimum(starts + PASSAGE, len(words))] > total[starts]]  # else its cosine is 0
                if not len(starts):
                    continue
                seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for s in range(0, len(starts), 2048):
                    at = starts[s : s + 2048]
                    v = _project(_padded(words, at), idf, basis)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    sim = v @ target.T
                    hot = np.flatnonzero(sim.max(1) >= cosine)  # few rows, and far quicker than to test each value
                    i, j = np.nonzero(sim[hot] >= cosine)
                    seen.append((held.owner[j], at[hot[i]], sim[hot[i], j]))
                owner, where, found = (np.concatenate(x) for x in zip(*seen))
                order = np.argsort(owner, kind="stable")
                owner, where, found = owner[order], where[order], found[order]
                heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
                ends = [*heads[1:], len(owner)]
                for h, e in zip(heads, ends):
                    k, c, low, high = int(owner[h]), float(found[h:e].max()), int(where[h:e].min()), int(where[h:e].max()) + PASSAGE
                    item = held.words[k]
                    if k not in members:
                        if len(members) > 256:
                            members.clear()
                        members[k] = np.zeros(held.size, bool)
                        members[k][item] = True
                    part = words[max(0, low - len(item)) : high + len(item)]
                    # Bounds of either check: a common stretch lies within a run of the item's own words, and a
                    # common subsequence takes each word no more often than both sides have it.
                    own_words = members[k][part]
                    half = len(item) / 2
                    if np.count_nonzero(own_words) < min(least_run, half):
                        continue
                    hit = np.flatnonzero(own_words)
                    if not _has_run(hit, least_run):
                        if len(hit) < half:
                            continue
                        have = np.bincount(part[hit], minlength=held.size)
                        if np.minimum(have[item_words[k]], item_counts[k]).sum() < half:
                            continue
                    stretch = longest_run(part[hit[0] : hit[-1] + 1], item)
                    order = common_subsequence(part[hit], item)
                    if stretch < least_run and order < len(item) / 2:
                        continue
                    answer = held.answers[k]
                    told = bool(len(answer)) and longest_run(part, answer) == len(answer)
                    out.append((doc_id, held.ids[k], stretch, order, len(item), told, c))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "run", "subsequence", "item_words", "answer", "cosine"])

    return coded.mapInPandas(run, out_type)
