"""First rows of a batch of questions among items that pass by, for the workers of ``retrieval.best``.

A block of items meets all questions at once. Rough scores in single precision, by one matrix product for terms that many
questions and items share and by sums for the others, tell which pairs can still be among a question's first rows; only
these are scored exactly. The rough cosine is never too low: it takes the smallest norm that any question leaves an item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from veridex.functions import vocabulary as V

DIGITS = 9
CELLS = 2_000_000  # rough scores, and term counts of items, that a task holds at a time
DENSE = 512  # most terms of the matrix product
SHARED = 0.003  # share of (question, item) pairs from which a term is in the matrix product
SLACK = 1e-4  # by which a rough score may be too low, of its value


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10.0**DIGITS + 0.5) / 10.0**DIGITS


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def pool_scores(pool: pa.Table, asked: pa.Table, k1: float = V.BM25_K1, b: float = V.BM25_B) -> tuple[np.ndarray, np.ndarray]:
    """BM25, scaled to at most 1, and cosine of the rows (id, terms, tfs) of one question's pool for its terms (term, qtf).

    An id on several rows is one text, whose shared terms count for each of its rows.
    """
    lists = pa.concat_arrays(pool.column("terms").chunks)
    coded = lists.flatten().dictionary_encode()
    words, size = coded.dictionary, max(1, len(coded.dictionary))
    item, ids = pd.factorize(pool.column("id").to_pandas())
    key, at = np.unique(item[lists.value_parent_indices().to_numpy()] * size + coded.indices.to_numpy(), return_inverse=True)
    tf = np.bincount(at, weights=_flat(pool.column("tfs")), minlength=len(key))
    d, t = key // size, key % size
    n, times = float(len(item)), np.bincount(item, minlength=len(ids))
    length = np.bincount(d, weights=tf, minlength=len(ids))
    avg_len = max(float(length[item].mean()), 1.0)
    df = np.bincount(t, minlength=size).astype(float)
    place = pc.index_in(asked.column("term"), value_set=words).to_numpy()
    qtf = np.asarray(asked.column("qtf").to_numpy(), dtype=float)
    met = ~np.isnan(place.astype(float))
    count = np.zeros(size)
    count[place[met].astype(np.int64)] = qtf[met]
    w = np.log((n + 2) / (df + 2)) + 1
    q_norm = np.sum((qtf[met] * w[place[met].astype(np.int64)]) ** 2) + np.sum((qtf[~met] * (np.log((n + 2) / 2) + 1)) ** 2)
    gain = count[t] * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[d] / avg_len))
    total = lambda x: np.bincount(d, weights=x, minlength=len(ids))
    norm = total((tf * (np.log((n + 2) / (df[t] + (count[t] > 0) + 1)) + 1)) ** 2)
    bm25, dot = rounded(total(gain) * times), total(count[t] * tf * w[t] ** 2) * times
    cosine = rounded(np.divide(dot, np.sqrt(norm * q_norm), out=np.zeros(len(ids)), where=dot > 0))
    top = bm25.max(initial=0.0)
    return (rounded(bm25 / top) if top > 0 else bm25 * 0.0)[item], cosine[item]


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]) if column.num_chunks else np.zeros(0)


@dataclass
class Batch:
    """Distinct questions: their terms in ``t`` from ``start``, with their counts; and per term its weights and questions."""

    qs: pa.Array
    norms: np.ndarray
    vocabulary: pa.Array
    avg_len: float
    w: np.ndarray
    w0: np.ndarray
    idf: np.ndarray
    start: np.ndarray
    t: np.ndarray
    qtf: np.ndarray
    by_term: np.ndarray
    asked_by: np.ndarray
    asked_qtf: np.ndarray
    dense: np.ndarray
    k1: float = V.BM25_K1
    b: float = V.BM25_B

    @classmethod
    def of(cls, asked: pd.DataFrame, kind: pa.DataType) -> Batch:
        """Of rows (q, term, qtf, df, n, avg_len, w, w0, idf)."""
        q, qs = pd.factorize(asked["q"])
        norms = np.sqrt(np.bincount(q, weights=(asked["qtf"] * asked["w"]) ** 2, minlength=len(qs)))
        met = (asked["df"] > 0).to_numpy()
        rows, q = asked[met], q[met]
        t, words = pd.factorize(rows["term"])
        first = np.unique(t, return_index=True)[1]
        per = rows.iloc[first]
        order = np.argsort(q, kind="stable")
        by = np.argsort(t, kind="stable")
        qtf = rows["qtf"].to_numpy(dtype=float)
        asking = np.bincount(t, minlength=len(words))
        share = asking / max(1, len(qs)) * per["df"].to_numpy() / max(1.0, float(asked["n"].iloc[0]) if len(asked) else 1.0)
        dense = np.argsort(-share, kind="stable")[:DENSE]
        return cls(
            pa.array(list(qs), kind), norms, pa.array(list(words), pa.string()), float(asked["avg_len"].iloc[0]) if len(asked) else 1.0,
            *[per[c].to_numpy(dtype=float) for c in ("w", "w0", "idf")], np.searchsorted(q[order], np.arange(len(qs) + 1)), t[order], qtf[order],
            np.searchsorted(t[by], np.arange(len(words) + 1)), q[by], qtf[by], np.sort(dense[share[dense] > SHARED]),
        )

    def search(self, batches: Iterator[pa.RecordBatch], depth: int, kinds: tuple[str, ...], prefer: bool) -> Iterator[pa.RecordBatch]:
        """(first, id, bm25, cosine) of batches (id, prefer, terms, tfs, len, norm)."""
        top = Top(len(self.qs), depth, kinds, prefer)
        n_q, n_t = len(self.qs), len(self.vocabulary)
        most = max(16, CELLS // max(1, n_q, n_t))
        block, kind = min(most, 256), None
        # questions by the terms of the matrix product
        place = np.full(n_t, -1)
        place[self.dense] = np.arange(len(self.dense))
        parts = {k: np.zeros((n_q, len(self.dense)), dtype=np.float32) for k in ("bm25", "cosine")}
        w2 = self.w * self.w
        words = self.asked_qtf * np.repeat(self.idf, np.diff(self.by_term))
        angles = self.asked_qtf * np.repeat(w2, np.diff(self.by_term)) / self.norms[self.asked_by] if n_t else words
        own = np.repeat(place, np.diff(self.by_term))
        parts["bm25"][self.asked_by[own >= 0], own[own >= 0]] = words[own >= 0]
        parts["cosine"][self.asked_by[own >= 0], own[own >= 0]] = angles[own >= 0]
        per_posting = {"bm25": words.astype(np.float32), "cosine": angles.astype(np.float32)}
        for batch in batches:
            kind = batch.schema.field("id").type
            at = 0
            while at < len(batch) and n_t:
                self._block(batch.slice(at, block), top, kinds, place, parts, per_posting)
                at, block = at + block, min(most, block * 2)
        if kind is not None:
            yield from top.rows(self.qs, kind)

    def _block(self, batch: pa.RecordBatch, top: Top, kinds: tuple[str, ...], place: np.ndarray, parts: dict, per_posting: dict) -> None:
        lists = batch.column("terms")
        found = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        hit = found >= 0
        if not hit.any():
            return
        t, tf = found[hit].astype(np.int64), batch.column("tfs").flatten().to_numpy()[hit]
        # only items with a term of any question
        item, d = np.unique(lists.value_parent_indices().to_numpy()[hit], return_inverse=True)
        length, norm = (batch.column(c).to_numpy()[item] for c in ("len", "norm"))
        n_q, n_d = len(self.qs), len(item)
        w2, change = self.w**2, self.w**2 - self.w0**2
        damp = self.k1 * (1 - self.b + self.b * length / self.avg_len)
        least = norm + np.bincount(d, weights=tf * tf * change[t], minlength=n_d)
        values = {"bm25": tf * (self.k1 + 1) / (tf + damp[d]), "cosine": tf / np.sqrt(least[d])}
        in_product = place[t] >= 0
        rest = np.flatnonzero(~in_product)
        counts = np.diff(self.by_term)[t[rest]]
        pairs = spread(self.by_term[t[rest]], counts)
        cell = self.asked_by[pairs] * n_d + np.repeat(d[rest], counts)
        wanted = np.zeros((n_q, n_d), dtype=bool)
        for k in kinds:
            v = values[k].astype(np.float32)
            items = np.zeros((len(self.dense), n_d), dtype=np.float32)
            items[place[t[in_product]], d[in_product]] = v[in_product]
            rough = parts[k] @ items
            np.add.at(rough.reshape(-1), cell, per_posting[k][pairs] * np.repeat(v[rest], counts))
            wanted |= rough >= np.maximum((top.least[k] - 2 * 10.0**-DIGITS) * (1 - SLACK), 1e-30).astype(np.float32)[:, None]
        q, d_of = np.nonzero(wanted)
        counted = np.zeros((n_d, len(self.vocabulary)))
        counted[d, t] = tf
        ids, prefer = batch.column("id").take(pa.array(item)), batch.column("prefer").to_numpy(zero_copy_only=False)[item]
        ids = ids.to_numpy(zero_copy_only=False)
        for i in range(0, len(q), CELLS // 4):
            a, e = q[i : i + CELLS // 4], d_of[i : i + CELLS // 4]
            n = np.diff(self.start)[a]
            at = spread(self.start[a], n)
            x, term, qtf = counted[np.repeat(e, n), self.t[at]], self.t[at], self.qtf[at]
            begin = np.cumsum(n) - n
            total = lambda y, begin=begin: np.add.reduceat(y, begin)
            bm25 = total(qtf * self.idf[term] * x * (self.k1 + 1) / (x + np.repeat(damp[e], n)))
            dot, shift = total(qtf * x * w2[term]), total(x * x * change[term])
            top.add(a, ids[e], prefer[e], rounded(bm25), rounded(dot / (self.norms[a] * np.sqrt(norm[e] + shift))))


class Top:
    """The first rows of each question by each kind of score, so far. Ids are distinct."""

    def __init__(self, n_q: int, depth: int, kinds: tuple[str, ...], prefer: bool):
        self.depth, self.kinds, self.prefer = depth, kinds, prefer
        self.least = {k: np.zeros(n_q) for k in kinds}  # what a row must reach
        self.kept: list[tuple] = []
        self.waiting = 0
        self.room = max(CELLS // 8, n_q * depth)

    def add(self, q: np.ndarray, ids: np.ndarray, prefer: np.ndarray, bm25: np.ndarray, cosine: np.ndarray) -> None:
        scores = {"bm25": bm25, "cosine": cosine}
        keep = np.zeros(len(q), dtype=bool)
        for k in self.kinds:
            keep |= scores[k] >= self.least[k][q]
        if keep.any():
            self.kept.append(tuple(x[keep] for x in (q, ids, prefer, bm25, cosine)))
            self.waiting += int(keep.sum())
        if self.waiting > self.room:
            self.cut()

    def cut(self) -> None:
        if not self.kept:
            return
        q, ids, prefer, bm25, cosine = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order_of = ids if ids.dtype.kind in "iuf" else pd.factorize(ids, sort=True)[0]
        keep = np.zeros(len(q), dtype=bool)
        for k in self.kinds:
            score = bm25 if k == "bm25" else cosine
            later = [-np.where(np.isnan(prefer.astype(float)), -np.inf, prefer.astype(float))] if self.prefer else []
            order = np.lexsort([order_of, *later, -score, q])
            of = q[order]
            first = np.searchsorted(of, of)
            place = np.arange(len(of)) - first
            keep[order[place < self.depth]] = True
            last = order[place == self.depth - 1]
            self.least[k][q[last]] = score[last]
        self.kept, self.waiting = [tuple(x[keep] for x in (q, ids, prefer, bm25, cosine))], 0

    def rows(self, qs: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        self.cut()
        for q, ids, _, bm25, cosine in self.kept:
            for i in range(0, len(q), 100_000):
                own = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([qs.take(pa.array(q[own])), pa.array(ids[own], kind), pa.array(bm25[own]), pa.array(cosine[own])], names=["first", "id", "bm25", "cosine"])
