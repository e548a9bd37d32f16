"""Subject areas of documents: leaves of bisecting k-means, labelled by discriminative terms, mixed by sentence.

1. *Vectors*: every document becomes a normalised vector (square roots of its term counts under a signed
   projection), written to the shared folder.
2. *Leaves*: bisecting k-means over all vectors. Each round, every new leaf is tried as two: passes over the
   vectors move the two centres and measure what the split gains, and the splits that gain most are made. The
   centres of the first pass lie on the principal axes of all vectors of the leaf.
3. *Discriminative terms*: the terms of all documents are counted by leaf. A term's log-odds in a leaf against
   the average subject tell leaves apart; the terms that tell most are kept, and a leaf is labelled with the
   subject in whose hand-labelled documents its discriminative terms occur. Leaves whose terms no subject has
   for itself (boilerplate, say) get no label.
4. *Mixtures*: each sentence of each document belongs to the leaf with the highest sum of log-odds (its own, and
   those of all leaves with its label together), or to none if that is low. A document's mixture is the share of its sentences by leaf, and so by subject.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.leakage import _fold_table
from sievemark.session import durable

#: Leaves of the clustering, at most; and the least documents in a leaf.
LEAVES, LEAF_LEAST = 48, 20
#: Labelled documents whose terms label the leaves, at most (by the hash of their key).
FIT_LABELLED = 5_000
#: Principal axes of a leaf along which it is tried, and the passes over all vectors that move the centres before the best is taken.
AXES, MOVES = 3, 4
#: Terms the model keeps: those that tell most about leaves over all documents.
TERMS = 1 << 15
#: The most frequent of a leaf's discriminative terms, which label it; and the part a subject must have of them.
LABEL_TERMS, LABEL_SHARE = 300, 0.2
#: The log-odds a sentence needs to belong to a leaf at all, and per term of the sentence.
SENTENCE_ODDS, TERM_ODDS = 4.0, 0.58
#: A term is known by so many bits of its hash; the first says if its sentence is made of words or of ideographs.
TERM_BITS = 18
BUCKETS = 1 << TERM_BITS
#: Dimensions of a vector, and in how many of them a term shows.
DIMENSIONS, _SIGNS = 128, 4
#: Vectors that are written as one value, vectors handled at a time, and vectors that are worth a task of their own.
PACK, SLICE, TASK_VECTORS = 16, 8_192, 1 << 16
#: Sums of tasks of up to so many bytes are added up by the driver, others on the executors.
_DIRECT = 4 << 20
#: The half of a symmetric matrix that is sent.
_HALF = np.triu_indices(DIMENSIONS)
#: Terms of a sentence that are summed one by one; longer sentences are summed in pieces.
_PIECE = 32
#: Characters handled at a time; more fall out of the processor's cache.
_CHUNK = 20_000
_END, _POINT, _SPACE, _DIGIT, _WORD, _WIDE = 1, 2, 3, 4, 5, 6


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point to its part in a sentence."""
    fold = _fold_table()
    out = np.where(fold == 0, 0, np.where(fold >= 0x2E80, _WIDE, np.where((fold >= 48) & (fold <= 57), _DIGIT, _WORD))).astype(np.uint8)
    for c in "。！？!?":
        out[ord(c)] = _END
    out[ord(".")] = _POINT
    for c in " \t\n\r　\xa0":
        out[ord(c)] = _SPACE
    return out


@dataclass
class Terms:
    """The terms of some texts: bucket and sentence of each (pairs first, then words; sentences rise in either part), and the
    text of each sentence. Every sentence has letters."""

    parts: list[tuple[np.ndarray, np.ndarray]]
    owner: np.ndarray

    @property
    def bucket(self) -> np.ndarray:
        return np.concatenate([b for b, _ in self.parts])

    @property
    def sentence(self) -> np.ndarray:
        return np.concatenate([s for _, s in self.parts])


def _bucket(x: np.ndarray) -> np.ndarray:
    """The bucket of a hashed term, in the lower half."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return ((x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D) >> np.uint64(65 - TERM_BITS)).astype(np.int32)


def terms_of(texts: list[str]) -> Terms:
    """Terms are pairs of neighbouring ideographs (or kana, hangul) and words of other letters, without case and width. The
    terms of sentences made of words have buckets in the upper half, all others in the lower.

    Sentences end at full stops, question and exclamation marks, and at points followed by white space; line
    breaks end none, as they also come within sentences. Numbering alone is no sentence. A text's end ends one.
    """
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = _classes()
    raw = np.where(raw < len(table), raw, 0)
    kind, cp = table[raw], _fold_table()[raw]
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    end = kind == _END
    point = np.flatnonzero(kind[:-1] == _POINT)
    end[point[kind[point + 1] == _SPACE]] = True
    end[ends_of_texts - 1] = True
    stop = np.flatnonzero(end)
    first = np.concatenate([[0], stop[:-1] + 1])
    spoken = np.add.reduceat(kind >= _WORD, first) > 0
    number = (np.cumsum(spoken) - 1).astype(np.int32)
    owner = np.searchsorted(ends_of_texts, first[spoken], "right")
    wide = kind == _WIDE
    pair = np.flatnonzero(wide[:-1] & wide[1:])
    pairs = _bucket(cp[pair].astype(np.uint64) << np.uint64(21) | cp[pair + 1])
    parts = [(pairs, number[np.searchsorted(stop, pair)])]
    at = np.flatnonzero(kind == _WORD)
    if len(at):
        start = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
        inside = at - np.repeat(at[start], np.diff(np.append(start, len(at))))
        powers = np.cumprod(np.concatenate([[1], np.full(int(inside.max()), 0x9E3779B97F4A7C15, dtype=np.uint64)]).astype(np.uint64), dtype=np.uint64)
        words = _bucket(np.add.reduceat(cp[at] * powers[inside], start) + np.uint64(0x5851F42D))
        parts.append((words, number[np.searchsorted(stop, at[start])]))
        size = [np.bincount(s, minlength=len(owner)) for _, s in parts]
        wordy = 2 * size[1] > size[0]
        parts = [(b + np.where(wordy[s], BUCKETS // 2, 0).astype(np.int32), s) for b, s in parts]
    return Terms(parts, owner)


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield ids[start : k + 1], texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield ids[start:], texts[start:]


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    """The dimensions in which each term shows, twice, and one more where its sign is positive; a row for each of its signs."""
    rng = np.random.default_rng(1)
    at = rng.integers(0, DIMENSIONS, (BUCKETS, _SIGNS))
    return np.ascontiguousarray((2 * at + (rng.choice(np.array([-1.0, 1.0]), (BUCKETS, _SIGNS)) > 0)).T.astype(np.uint8))


def document_terms(t: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of each text: text, bucket, and how often the text has it."""
    cell, count = np.unique(t.owner[t.sentence].astype(np.int64) * BUCKETS + t.bucket, return_counts=True)
    return cell // BUCKETS, cell % BUCKETS, count


def document_vectors(doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The unit vectors of ``n`` texts with these terms, in steps of 1/127; texts without terms have null vectors."""
    first, root, both = doc * (2 * DIMENSIONS), np.sqrt(count), np.zeros(2 * n * DIMENSIONS)
    for at in _projection():
        both += np.bincount(first + at[term], root, minlength=2 * n * DIMENSIONS)
    x = both[1::2].reshape(n, DIMENSIONS) - both[::2].reshape(n, DIMENSIONS)
    return np.rint(127 * x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)).astype(np.int8)


@dataclass
class Tree:
    """Leaves by splits. ``splits`` has (leaf that was split, the two centres); the left part keeps the leaf's number, the right
    one gets the next. ``mean`` is the mean of all vectors, from which all are measured."""

    mean: np.ndarray
    splits: list[tuple[int, np.ndarray, np.ndarray]]

    def centred(self, x: np.ndarray) -> np.ndarray:
        y = x.astype(np.float32)
        y /= 127
        y -= self.mean.astype(np.float32)
        y /= np.sqrt(np.einsum("ij,ij->i", y, y))[:, None] + 1e-12
        return y

    def leaves(self, y: np.ndarray) -> np.ndarray:
        """The leaf of each centred vector."""
        leaf = np.zeros(len(y), dtype=np.int16)
        if self.splits:
            right = np.stack([b - a for _, a, b in self.splits]).astype(np.float32) @ y.T > 0  # a row for each split
            for k, (old, _, _) in enumerate(self.splits):
                leaf[(leaf == old) & right[k]] = k + 1
        return leaf.astype(np.int64)


def _starts(n: int, total: np.ndarray, moments: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of centres on the principal axes of ``n`` vectors, from their sum and the sum of their outer products; none if they don't differ."""
    mean = total / n
    spread, axes = np.linalg.eigh(moments / n - np.outer(mean, mean))
    out = []
    for k in range(1, 1 + AXES):
        axis = axes[:, -k] * np.sign(axes[np.argmax(np.abs(axes[:, -k])), -k])
        if spread[-k] > 1e-9:
            out.append((_unit(mean - np.sqrt(spread[-k]) * axis), _unit(mean + np.sqrt(spread[-k]) * axis)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x) + 1e-12)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, vectors)), dtype=np.int8).reshape(-1, DIMENSIONS)


#: Of some vectors: number, sum, and sum of the outer products (null where it wasn't asked for; of tasks, its upper half).
Sums = tuple[int, np.ndarray, np.ndarray | None]


def _added(rows: Iterable[tuple[int, int, bytes, bytes | None]]) -> dict[int, Sums]:
    """The sums of tasks, added up by cell."""
    out: dict[int, Sums] = {}
    for cell, n, total, outer in rows:
        m, before, square = out.get(cell, (0, 0.0, 0.0))
        out[cell] = m + n, before + np.frombuffer(total), None if outer is None else square + np.frombuffer(outer)
    return out


def _square(half: np.ndarray) -> np.ndarray:
    out = np.zeros((DIMENSIONS, DIMENSIONS))
    out[_HALF] = half
    return out + np.triu(out, 1).T


def _sums(vectors: DataFrame, tree: Tree | None, tries: list[dict[int, tuple[np.ndarray, np.ndarray]]], moments: bool = False, tasks: int = 0) -> dict[tuple[int, int, int], Sums]:
    """The sums of the vectors by (try, leaf, side), of leaves that a try has centres for. Without a tree: of all raw vectors, as (0, 0, 0).
    ``tasks``: how many partitions ``vectors`` has at most, if that is known."""
    shared = vectors.sparkSession.sparkContext.broadcast((tree, tries))
    k, wanted = 1 + len(tree.splits) if tree else 1, sorted({leaf for centres in tries for leaf in centres})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, tries = shared.value
        ways = {}  # of a leaf: its cells, left ones first, and the ways from left to right of its tries
        for leaf in wanted:
            some = [(j, centres[leaf]) for j, centres in enumerate(tries) if leaf in centres]
            left = [2 * (j * k + leaf) for j, _ in some]
            ways[leaf] = left + [1 + c for c in left], np.stack([b - a for _, (a, b) in some]).astype(np.float32)
        total, n = np.zeros((2 * k * len(tries), DIMENSIONS)), np.zeros(2 * k * len(tries), dtype=np.int64)
        outer: dict[int, np.ndarray] = {}
        for x in (part for b in batches if len(b) for whole in [_matrix(b["vec"])] for part in np.split(whole, range(SLICE, len(whole), SLICE))):
            y = tree.centred(x) if tree else x.astype(np.float32) / 127
            leaves = tree.leaves(y).astype(np.int16) if tree else np.zeros(len(y), dtype=np.int16)
            order = np.argsort(leaves, kind="stable")
            edges = np.searchsorted(leaves[order], np.arange(k + 1))
            for leaf, (cells, way) in ways.items():
                z = y[order[edges[leaf] : edges[leaf + 1]]]
                if not len(z):
                    continue
                right = way @ z.T > 0
                which = np.concatenate([~right, right])
                n[cells] += which.sum(1)
                total[cells] += which.astype(np.float32) @ z
                for c, mine in zip(cells, which, strict=True) if moments else ():
                    part = z[mine]
                    outer[c] = outer.get(c, 0.0) + (part.T @ part).astype(np.float64)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cell": some, "n": n[some], "total": [v.tobytes() for v in total[some]], "outer": [outer[c][_HALF].tobytes() if moments else None for c in some.tolist()]})

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _added(row for b in batches for row in zip(b["cell"], b["n"], b["total"], b["outer"], strict=True))
        cells = list(out)
        for some in (cells[i : i + 64] for i in range(0, len(cells), 64)):
            yield pd.DataFrame({"cell": some, "n": [out[c][0] for c in some], "total": [out[c][1].tobytes() for c in some], "outer": [out[c][2].tobytes() if moments else None for c in some]})

    kinds = "cell bigint, n bigint, total binary, outer binary"
    rows = vectors.select("vec").mapInPandas(add, kinds)
    if tasks != 1 and (not tasks or tasks * 2 * len(wanted) * len(tries) * 8 * (DIMENSIONS + len(_HALF[0]) * moments) > _DIRECT):
        # sums of tasks are added up on the executors: a row for each side of each leaf comes to the driver, whatever the number of tasks
        rows = rows.repartition("cell").mapInPandas(together, kinds)
    out = _added((r["cell"], r["n"], bytes(r["total"]), None if r["outer"] is None else bytes(r["outer"])) for r in rows.collect())
    return {(c // (2 * k), c // 2 % k, c % 2): (n, total, None if outer is None else _square(outer)) for c, (n, total, outer) in out.items()}


def bisecting_kmeans(vectors: DataFrame, leaves: int = LEAVES, least: int = LEAF_LEAST) -> Tree:
    """The tree over all ``vectors`` (``vec`` has one or more, one after the other). At most ``leaves`` leaves, none with less
    than ``least`` vectors. A round tries all leaves that are new, and splits the third of the leaves that gain most. New leaves are
    tried along their principal axes; passes over all vectors move the centres, and a last one measures the best try."""
    none, flat = (0, np.zeros(DIMENSIONS), None), (np.zeros(DIMENSIONS), np.zeros(DIMENSIONS))
    n, total, _ = _sums(vectors, None, [{0: flat}]).get((0, 0, 0), none)
    tree = Tree(total / max(n, 1), [])
    if n < 2 * least:
        return tree
    tasks = -(-n // TASK_VECTORS)  # a task takes as long to start as to sum some 50,000 vectors
    vectors = vectors.coalesce(tasks)
    whole = {0: _sums(vectors, tree, [{0: flat}], moments=True, tasks=tasks)[0, 0, 0]}  # of new leaves
    open_: dict[int, tuple[float, np.ndarray, np.ndarray, Sums, Sums]] = {}  # what a split of a leaf gains, its centres, its sides
    while len(tree.splits) + 1 < leaves:
        tries: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(AXES)]
        for leaf, sums in whole.items():
            for j, centres in enumerate(_starts(*sums)):
                tries[j][leaf] = centres
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for move in range(MOVES if any(tries) else 0):
            sums, gains = _sums(vectors, tree, tries, tasks=tasks), {}
            for j, centres in enumerate(tries):
                for leaf in list(centres):
                    (na, a, _), (nb, b, _) = sums.get((j, leaf, 0), none), sums.get((j, leaf, 1), none)
                    if min(na, nb) < least:
                        del centres[leaf]
                        continue
                    centres[leaf] = _unit(a), _unit(b)
                    gains[leaf, j] = float(np.linalg.norm(a) + np.linalg.norm(b))
            if move == MOVES - 1:
                best = {leaf: tries[j][leaf] for (leaf, j), _ in sorted(gains.items(), key=lambda x: (x[1], -x[0][1]))}
        sums = _sums(vectors, tree, [best], moments=True, tasks=tasks) if best else {}
        for leaf in best:
            left, right = sums.get((0, leaf, 0), none), sums.get((0, leaf, 1), none)
            if min(left[0], right[0]) >= least:
                a, b = left[1], right[1]
                open_[leaf] = float(np.linalg.norm(a) + np.linalg.norm(b) - np.linalg.norm(a + b)), _unit(a), _unit(b), left, right
        if not open_:
            break
        room, whole = min(leaves - len(tree.splits) - 1, 1 + len(open_) // 3), {}
        for leaf in sorted(open_, key=lambda x: (-open_[x][0], x))[:room]:
            _, a, b, left, right = open_.pop(leaf)
            tree.splits.append((leaf, a, b))
            whole[leaf], whole[len(tree.splits)] = left, right
    return tree


def _sums_of_rows(table: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of the rows ``row`` of ``table`` from each of ``first`` to the next. The n-th rows of all runs are added at a time, so that
    no row is gathered in memory before it is added; runs of more than ``_PIECE`` rows are summed in pieces of that size."""
    length = np.diff(np.append(first, len(row)))
    pieces = -(-length // _PIECE)
    run = np.cumsum(pieces) - pieces  # the first piece of each run
    within = np.arange(pieces.sum()) - np.repeat(run, pieces)
    start = np.repeat(first, pieces) + _PIECE * within
    size = np.minimum(np.repeat(length, pieces) - _PIECE * within, _PIECE)
    order = np.argsort(-size, kind="stable")
    start, sums = start[order], np.zeros((len(order), table.shape[1]), dtype=table.dtype)
    got = np.empty_like(sums)
    for k, many in enumerate(np.searchsorted(-size[order], -np.arange(1, size.max() + 1), "right").tolist()):
        np.take(table, row[start[:many] + k], axis=0, out=got[:many], mode="clip")  # any other mode copies once more
        sums[:many] += got[:many]
    back = np.empty_like(sums)
    back[order] = sums
    out = back[run]
    for k in np.flatnonzero(pieces > 1).tolist():
        out[k] = back[run[k] : run[k] + pieces[k]].sum(0)
    return out


@dataclass
class Model:
    """Terms (buckets, rising) with their log-odds in each leaf and then in each group of leaves with one label; the subject of
    each leaf (-1 for none), and the column of its group."""

    bucket: np.ndarray
    odds: np.ndarray
    label: np.ndarray
    group: np.ndarray

    def __post_init__(self) -> None:
        self.row = np.full(BUCKETS, -1, dtype=np.int32)
        self.row[self.bucket] = np.arange(len(self.bucket), dtype=np.int32)
        n = len(self.label)
        both = np.concatenate([self.odds[:, :n] + self.odds[:, self.group], self.odds[:, n:]], axis=1)  # of leaf and group together, and of groups
        self.both = np.ascontiguousarray(both)  # rows are taken from it

    def sentence_leaves(self, t: Terms) -> np.ndarray:
        """The leaf of each sentence: the one with the greatest odds of leaf and group together, if those of its group are high; else -1.

        The group counts because a sentence that all subjects use, or another subject, may be common in a leaf by chance or
        because its documents deal with both, but not in a subject.
        """
        n = len(t.owner)
        if not n or not len(self.bucket):
            return np.full(n, -1)
        sums, size = np.zeros((n, self.both.shape[1]), dtype=np.float32), np.zeros(n)
        for bucket, sentence in t.parts:
            size += np.bincount(sentence, minlength=n)
            row = self.row[bucket]
            row, sentence = row[row >= 0], sentence[row >= 0]
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
                sums[sentence[first]] += _sums_of_rows(self.both, row.astype(np.int64), first)
        best = sums[:, : len(self.label)].argmax(1)
        top = sums[np.arange(n), self.group[best]]
        return np.where((top > SENTENCE_ODDS) & (top > TERM_ODDS * size), best, -1)


def _within(counts: np.ndarray, words: np.ndarray, like: np.ndarray, weight: float = 200.0) -> np.ndarray:
    """P(term | row) of counts, for sentences of words and others apart (else the common words of a language would speak for
    the rows that have more texts in it), with ``weight`` terms distributed as in ``like``."""
    out = np.zeros(counts.shape)
    for part in (words, ~words):
        c, p = counts[:, part], like[part] + 1e-12
        out[:, part] = (c + weight * p / p.sum()) / (c.sum(1, keepdims=True) + weight)
    return out


def label_leaves(by_leaf: np.ndarray, by_subject: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The subject of each leaf, or -1: the one with the largest part of the leaf's discriminative terms.

    ``by_leaf`` and ``by_subject`` count terms (columns) in all documents of a leaf, and in the labelled documents of
    a subject. Terms weigh by how often they occur in the leaf times their log-odds against all leaves.
    A subject's part of a term is its rate against the rates of all subjects; subjects with hardly any labelled
    text have low rates, so that single wrong labels don't win.
    """
    every = by_leaf.sum(0)
    weigh = by_leaf * np.log(_within(by_leaf, words, every) / _within(every[None], words, every))
    rate = np.zeros(by_subject.shape)
    for part in (words, ~words):
        c = by_subject[:, part]
        rate[:, part] = c / (c.sum(1, keepdims=True) + 0.03 * c.sum() + 1e-9)
    part_of = rate / np.maximum(rate.sum(0), 1e-12)
    out = np.full(len(by_leaf), -1)
    for k in range(len(by_leaf)):
        top = np.argsort(-weigh[k], kind="stable")[:LABEL_TERMS]
        w = np.maximum(weigh[k, top], 0)
        score = (part_of[:, top] * w).sum(1) / max(w.sum(), 1e-9)
        if len(score) and score.max() >= LABEL_SHARE:
            out[k] = score.argmax()
    return out


def fit_model(bucket: np.ndarray, by_leaf: np.ndarray, by_subject: np.ndarray) -> Model:
    """The model from counts of the terms ``bucket`` (columns)."""
    words = bucket >= BUCKETS // 2
    label = label_leaves(by_leaf, by_subject, words)
    k = len(by_subject)
    names, at = np.unique(np.where(label < 0, k, label), return_inverse=True)
    merged = np.zeros((len(names), len(bucket)))
    np.add.at(merged, at, by_leaf)
    # against the average subject: else a subject that fills half the corpus would have no terms of its own
    average = _within(merged, words, by_leaf.sum(0)).mean(0)
    rows = np.concatenate([by_leaf, merged])
    odds = np.log((_within(rows, words, average) + 1e-12) / (average + 1e-12)).T.astype(np.float32)
    odds[by_leaf.sum(0) < 3] = 0
    return Model(bucket, odds, label, len(by_leaf) + at)


def _vectors(rows: DataFrame, text: str) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: list[bytes] = []
            for _, part in _chunks(b[text].tolist(), b[text].tolist()):
                x = document_vectors(*document_terms(terms_of(part)), len(part))
                x = x[x.any(axis=1)]
                got += [x[k : k + PACK].tobytes() for k in range(0, len(x), PACK)]
            if got:
                yield pd.DataFrame({"vec": got})

    return durable(rows.select(text).mapInPandas(make, "vec binary"), "vectors")


def _counts(rows: DataFrame, key: str, text: str, tree: Tree, known: dict, subjects: int) -> DataFrame:
    """``(row, bucket, n)``: the terms of all documents by leaf, and of the labelled ones by subject (rows after the leaves).

    A term that a document has 1, 3, 7, 15 times counts 1, 2, 3, 4 times.
    """
    shared = rows.sparkSession.sparkContext.broadcast((tree, known))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, known = shared.value
        k = 1 + len(tree.splits)
        total = np.zeros((k + subjects) * BUCKETS, dtype=np.int32)
        for b in batches:
            for ids, part in _chunks(b[key].tolist(), b[text].tolist()):
                doc, term, n = document_terms(terms_of(part))
                leaf = tree.leaves(tree.centred(document_vectors(doc, term, n, len(part))))
                n = np.log2(n + 1).astype(np.int32)  # a text that repeats itself is not many texts
                np.add.at(total, leaf[doc] * BUCKETS + term, n)
                for s in range(subjects):
                    has = np.array([s in known.get(i, ()) for i in ids])
                    if has.any():
                        has = has[doc]
                        np.add.at(total, (k + s) * BUCKETS + term[has], n[has])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"row": some // BUCKETS, "bucket": some % BUCKETS, "n": total[some].astype(np.int64)})

    return durable(rows.select(key, text).mapInPandas(count, "row bigint, bucket bigint, n bigint").groupBy("row", "bucket").agg(F.sum("n").alias("n")), "terms")


def _telling(counts: DataFrame, leaves: int, terms: int) -> DataFrame:
    """The ``terms`` buckets that tell most about leaves (by the information in their counts, over all documents)."""
    mine = counts.where(F.col("row") < leaves)
    size = {r["row"]: r["n"] for r in mine.groupBy("row").agg(F.sum("n").alias("n")).collect()}
    every = float(max(sum(size.values()), 1))
    sizes = F.array(*[F.lit(float(size.get(k, 0) or 1)) for k in range(leaves)])
    per = mine.groupBy("bucket").agg(F.sum("n").alias("t"), F.collect_list(F.struct("row", "n")).alias("c"))
    told: Column = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["n"] * F.log(x["n"] * every / (F.col("t") * F.get(sizes, x["row"].cast("int")))))
    return per.select("bucket", told.alias("told")).orderBy(F.desc("told"), "bucket").limit(terms).select("bucket")


def fit(rows: DataFrame, hand: DataFrame, names: list[str], key: str, text: str, leaves: int = LEAVES) -> Model:
    """The model of all documents ``rows``; ``hand`` has (``key``, ``subject_code``), at most ``FIT_LABELLED`` documents of which label leaves."""
    order = F.xxhash64(key)
    by_doc = hand.groupBy(key).agg(F.collect_set("subject_code").alias("names")).orderBy(order, key).limit(FIT_LABELLED).collect()
    known = {r[0]: {names.index(s) for s in r[1]} for r in by_doc}
    none = Model(np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.float32), np.full(1, -1), np.ones(1, dtype=np.int64))
    if not known:
        return none
    tree = bisecting_kmeans(_vectors(rows, text), leaves)
    counts = _counts(rows, key, text, tree, known, len(names))
    k = 1 + len(tree.splits)
    top = counts.join(_telling(counts, k, TERMS), "bucket", "left_semi").toPandas()
    if not len(top):
        return none
    bucket, at = np.unique(top["bucket"].to_numpy(), return_inverse=True)
    table = np.zeros((k + len(names), len(bucket)))
    table[top["row"].to_numpy(), at] = top["n"].to_numpy()
    return fit_model(bucket, table[:k], table[k:])


def leaf_mixtures(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", leaves: int = LEAVES) -> DataFrame:
    """``(key, leaf, subject_code, share, n_sentences)``: the share of each document's sentences that belong to each leaf.

    ``subject_code`` is the leaf's label and null for leaves without one. See ``subject_shares`` for the rest.
    """
    names = [r[0] for r in subjects.select("subject_code").where(F.col("subject_code").isNotNull()).distinct().orderBy("subject_code").collect()]
    rows = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text)
    hand = labels.where(F.col(key).isNotNull() & F.col("subject_code").isin(names)).select(key, "subject_code").distinct()
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, hand, names, key, text, leaves))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        k = len(m.label)
        for b in batches:
            found = []
            for at, part in _chunks(list(range(len(b))), b[text].tolist()):
                t = terms_of(part)
                leaf = m.sentence_leaves(t)
                size = np.bincount(t.owner, minlength=len(part))
                cells = np.bincount(t.owner[leaf >= 0] * k + leaf[leaf >= 0], minlength=len(part) * k)
                hit = np.flatnonzero(cells)
                found.append((np.array(at)[hit // k], hit % k, cells[hit] / size[hit // k], size[hit // k]))
            doc, leaf, share, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=int),) * 4
            if len(doc):
                subject = [None if s < 0 else names[s] for s in m.label[leaf]]
                yield pd.DataFrame({key: b[key].to_numpy()[doc], "leaf": leaf, "subject_code": subject, "share": share, "n_sentences": n})

    return rows.mapInPandas(classify, f"`{key}` {dict(docs.dtypes)[key]}, leaf int, subject_code string, share double, n_sentences bigint")


def subject_shares(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", leaves: int = LEAVES) -> DataFrame:
    """``(key, subject_code, share, n_sentences)``: the share of each document's sentences that deal with each subject.

    ``labels`` has ``key`` and ``subject_code`` (hand labels; wrong and repeated ones are outvoted), ``subjects``
    has ``subject_code`` (a small table). Leaves, terms and statistics come from all documents, of any length; labels of
    at most ``FIT_LABELLED`` documents (by the hash of their key) label the leaves. Every document is classified, whole.
    Null and blank texts, texts without letters and rows with a null key have no rows; nor have subjects without a
    sentence. A key that occurs twice has the shares of both texts added. Without labels there are no rows.
    """
    leaf = leaf_mixtures(docs, labels, subjects, key, text, leaves).where(F.col("subject_code").isNotNull())
    return leaf.groupBy(key, "subject_code").agg(F.sum("share").alias("share"), F.max("n_sentences").alias("n_sentences"))


def subjects_of(shares: DataFrame, least: float = 0.25, key: str = "doc_id") -> DataFrame:
    """``(key, subject_code)``: the subjects that at least ``least`` of a document's sentences deal with."""
    return shares.where(F.col("share") >= least - 1e-9).select(key, "subject_code").distinct()
