"""The k most similar vectors of every vector, by an inverted multi-index.

A vector is cut into two halves and each half quantised with a codebook of its own, so K + K
centroids give K * K cells. The codebooks are fitted on a bounded sample; every vector is
indexed. For a vector the pairs of centroids are visited in the order of their summed
distance, taken from a heap, until the cells visited hold at least `candidates` vectors; the
vectors of these cells are the candidates and are reranked by their cosine.
A count alone finds ever fewer close neighbours as a table grows: its cells fill up, and a neighbour just across the border of
a full one isn't visited. So the cells that a neighbour with a cosine of NEAR may be in are visited too, however full the others
are: such a neighbour is off by sqrt(2 - 2 NEAR), which in a direction without preference shifts the difference between the
distances to two cells by a deviation of 2 sqrt(2 - 2 NEAR) / sqrt(width) times that between their centroids. Cells whose
distance is greater than that of the home by at most MARGIN such deviations are visited; a pair has this chance from both sides.

Copies. Vectors with the same half-precision components are one class and count as one: cells are as large as their classes
are many, and a class is scored once for all its ids. Of a class only its k + 1 smallest ids can be among the neighbours of
any vector, as ties go to the smaller id. A class of more than `max_cell` rows doesn't travel at all but for
these; the neighbours of its other ids are the first k of them.

Placement. A cell is handled by tasks of bounded size. A vector is sent to its own cell once and, as a
query, to each further cell it visits, in half precision. Within a cell all of it is matrix
multiplication. A pair scored in a visited cell counts for both its vectors, which makes up for
cells that only one of them visits.
A cell above max_cell * hot_blocks classes gets a codebook of its own, fitted on the rows of the sample in it, whose cells
are visited in the order of their distance in its place. Cells still above `max_cell` rows are cut into blocks of about that many, and every
pair of blocks is scored by a task of its own. The visitors of a cell are counted before anything is sent; above `guests` they
are cut into parts, each of which meets each block in a task of its own. So no task gets more than two blocks or a block and
`guests` visitors, but for the spread of a hash and a class of up to max_cell rows in a block, and no pair is lost.

Nulls, vectors with all zeros, with a wrong width or with null elements take no part. Rows that
repeat an id count once; where their vectors differ, the id has the neighbours of all of them.
Ties in the score go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .sampling import hash_sample

SAMPLE_ROWS, TASK_BYTES = 20_000, 16 << 20
NEAR, MARGIN, COARSE = 0.80, 1.0, 64
STRIP = 4 << 20  # scores at a time


def kmeans(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's iterations on the sample; an empty centroid keeps its place."""
    if len(points) <= k:
        return points.copy()
    centroids = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = (points @ centroids.T - 0.5 * (centroids**2).sum(1)).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def split(points: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """k centroids at one distance from the mean, in the directions of spherical k-means. Where points scatter alike in all
    directions, Lloyd's iterations end with one centroid at the mean that gets nearly all of them; these share them."""
    mean = points.mean(0, keepdims=True)
    off = points - mean
    norm = np.sqrt((off**2).sum(1, keepdims=True))
    unit = (off / np.maximum(norm, 1e-12))[norm[:, 0] > 1e-6]
    if k < 2 or len(unit) <= k:
        return mean
    ways = unit[np.random.default_rng(seed).choice(len(unit), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = (unit @ ways.T).argmax(1)
        sums = np.zeros_like(ways)
        np.add.at(sums, nearest, unit)
        length = np.sqrt((sums**2).sum(1))
        ways[length > 0] = sums[length > 0] / length[length > 0, None]
    return mean + np.float32(max(0.0, float((off @ ways.T).max(1).mean()))) * ways


def codebook(points: np.ndarray, k: int) -> np.ndarray:
    """About k centroids: those of kmeans() up to COARSE, beyond it each of these split by its share of the points."""
    coarse = kmeans(points, min(k, COARSE))
    if k <= COARSE or len(coarse) < COARSE:
        return coarse
    nearest = (points @ coarse.T - 0.5 * (coarse**2).sum(1)).argmax(1)
    counts = np.bincount(nearest, minlength=len(coarse))
    return np.concatenate([split(points[nearest == c], min(round(k * n / len(points)), n // 4)) if k * n >= 1.5 * len(points) else coarse[c : c + 1] for c, n in enumerate(counts.tolist())])


def _gaps(centroids: np.ndarray) -> np.ndarray:
    """Squared distances between centroids."""
    norm = (centroids**2).sum(1)
    gaps = np.maximum(norm[:, None] + norm - 2 * centroids @ centroids.T, 0)
    np.fill_diagonal(gaps, 0)
    return gaps


def half_distances(x: np.ndarray, codebooks: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of both halves to their codebooks, up to a constant per row."""
    cut = codebooks[0].shape[1]
    return tuple((c**2).sum(1) - 2 * part @ c.T for part, c in zip((x[:, :cut], x[:, cut:]), codebooks))


def traverse(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, candidates: int) -> list[int]:
    """Cells in the order of d1[i] + d2[j] until they hold `candidates` vectors. The heap holds the next filled cell of each
    first-half centroid i, which enters once no cell of it can come before those in the heap; empty cells never enter."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    width, least = len(d2), float(d2[o2[0]])
    heap: list[tuple] = []
    cells, got, entered = [], 0, 0
    while got < candidates:
        while entered < len(o1) and (not heap or float(d1[o1[entered]]) + least <= heap[0][0]):
            i = int(o1[entered])
            filled = o2[np.flatnonzero(sizes[i * width : (i + 1) * width][o2])]
            if len(filled):
                heapq.heappush(heap, (float(d1[i] + d2[filled[0]]), entered, 0, i, filled))
            entered += 1
        if not heap:
            break
        _, rank, k, i, filled = heapq.heappop(heap)
        cell = i * width + int(filled[k])
        cells.append(cell)
        got += int(sizes[cell])
        if k + 1 < len(filled):
            heapq.heappush(heap, (float(d1[i] + d2[filled[k + 1]]), rank, k + 1, i, filled))
    return cells


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the usable rows of a batch with columns id, vec."""
    ids, vec = batch.column(0), batch.column(1)
    lengths = np.diff(vec.offsets.to_numpy())
    good = (lengths == width) & vec.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    keep = pa.array(np.flatnonzero(good))
    flat = vec.take(keep).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return ids.take(keep).to_numpy()[ok], (x[ok] / norm[ok, None]).astype(np.float32)


def _nearest_cells(x: np.ndarray, codebooks, inner: dict[int, tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances of both halves, and the cell of each row. inner: of a hot cell the number of its first
    inner cell and their centroids."""
    d1, d2 = half_distances(x, codebooks)
    home = d1.argmin(1) * d2.shape[1] + d2.argmin(1)
    for cell, (first, centroids) in inner.items():
        at = np.flatnonzero(home == cell)
        if len(at):
            home[at] = first + _inner_distances(x[at], centroids).argmin(1)
    return d1, d2, home


def _inner_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (centroids**2).sum(1) - 2 * x @ centroids.T


def _visits(x: np.ndarray, d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, inner: dict, candidates: int) -> list[int]:
    """The cells of traverse(), a hot one replaced by its inner cells, the nearest first, as far as they are needed."""
    out: list[int] = []
    for cell in traverse(d1, d2, sizes, candidates):
        if cell not in inner:
            out.append(cell)
            continue
        first, centroids = inner[cell]
        got = 0
        for sub in np.argsort(_inner_distances(x[None], centroids)[0], kind="stable"):
            if sizes[first + sub]:
                out.append(int(first + sub))
                got += int(sizes[first + sub])
            if got >= candidates:
                break
    return out


def _top(ids: np.ndarray, others: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (rows, k) of the best scores of each row, ties to the smaller id."""
    k = min(k, scores.shape[1])
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(k), (len(scores), 1))
    kth = np.take_along_axis(scores, part, 1).min(1)
    tied = (scores >= kth[:, None]).sum(1) > k
    for r in np.flatnonzero(tied):
        full = np.flatnonzero(scores[r] >= kth[r])
        part[r] = full[np.lexsort((others[full], -scores[r][full]))][:k]
    return part, np.take_along_axis(scores, part, 1)


def _classes(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the half-precision components of each row: equal rows have equal ones."""
    bits = half.view(np.uint16).astype(np.uint64)
    factors = np.random.default_rng(17).integers(1, 1 << 63, (bits.shape[1], 2), dtype=np.uint64) | np.uint64(1)
    out = []
    for c in range(2):
        h = (bits * factors[:, c]).sum(1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h ^ (h >> np.uint64(29))).view(np.int64))
    return out[0], out[1]


def _ranked(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Positions of the first `most` rows of each owner by score, ties to the smaller id; sorted by owner."""
    order = np.lexsort((ids, -scores, owner))
    o = owner[order]
    first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, int)
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)]))
    return order[rank < most]


class _Side:
    """The rows of one side of a group: its classes, and the distinct ids of each."""

    def __init__(self, ids: np.ndarray, half: np.ndarray, same: np.ndarray):
        order = np.lexsort((ids, same))
        ids, same, rows = ids[order], same[order], order
        once = np.r_[True, (same[1:] != same[:-1]) | (ids[1:] != ids[:-1])] if len(ids) else np.zeros(0, bool)
        self.ids, same, rows = ids[once], same[once], rows[once]
        self.first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]]) if len(same) else np.zeros(0, int)
        self.counts = np.diff(np.r_[self.first, len(same)])
        self.half, self.least = half[rows[self.first]], self.ids[self.first]

    def vectors(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The unit vectors of some classes."""
        x = self.half[start:end].astype(np.float32)
        return x / np.sqrt((x**2).sum(1))[:, None]

    def members(self, classes: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(position in `classes`, id) of the ids of each class, or of the smallest `most`."""
        n = self.counts[classes] if most is None else np.minimum(self.counts[classes], most)
        at = np.repeat(np.arange(len(classes)), n)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, self.ids[self.first[classes][at] + inner]


def _answers(who: _Side, owner: np.ndarray, of: _Side, near: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other, score) for the ids of `who`, whose classes `owner` found the classes `near` of the other side."""
    at, other = of.members(near, k + 1)
    own, score = owner[at], scores[at]
    keep = _ranked(own, other, score, k + 1)
    own, other, score = own[keep], other[keep], score[keep]
    # each id of a class takes the list of its class without itself
    first = np.searchsorted(own, np.arange(len(who.first)), side="left")
    length = np.searchsorted(own, np.arange(len(who.first)), side="right") - first
    cls = np.repeat(np.arange(len(who.first)), who.counts)
    n = length[cls]
    row = np.repeat(np.arange(len(cls)), n)
    src = first[cls][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    i, o, v = who.ids[row], other[src], score[src]
    good = i != o
    i, o, v, row = i[good], o[good], v[good], row[good]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return i[rank < k], o[rank < k], v[rank < k]


def _meet(a: _Side, b: _Side | None, k: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """What a and b find in each other, or a in itself; a is scored in strips."""
    t = a if b is None else b
    out: tuple[list, list, list] = ([], [], [])
    if not len(a.first) or not len(t.first):
        return out
    owner, near, found = [], [], []
    back_s, back_i = np.full((len(t.first), 0), -2.0, np.float32), np.zeros((len(t.first), 0), np.int64)
    against, step = t.vectors().T, max(64, STRIP // len(t.first))
    for s in range(0, len(a.first), step):
        sim = a.vectors(s, s + step) @ against
        pos, top = _top(a.least[s : s + step], t.least, sim, k + 1)
        owner.append(np.repeat(np.arange(s, s + len(sim)), pos.shape[1]))
        near.append(pos.ravel())
        found.append(top.ravel())
        if b is not None:
            pos, top = _top(t.least, a.least[s : s + step], sim.T, k + 1)
            back_s, back_i = np.concatenate([back_s, top], 1), np.concatenate([back_i, pos + s], 1)
            keep = np.lexsort((a.least[back_i], -back_s), axis=1)[:, : k + 1]
            back_s, back_i = np.take_along_axis(back_s, keep, 1), np.take_along_axis(back_i, keep, 1)
    parts = [_answers(a, np.concatenate(owner), t, np.concatenate(near), np.concatenate(found), k)]
    if b is not None:
        parts.append(_answers(b, np.repeat(np.arange(len(t.first)), back_s.shape[1]), a, back_i.ravel(), back_s.ravel(), k))
    for part in parts:
        for held, v in zip(out, part):
            held.append(v)
    return out


class Index:
    """Codebooks, how many classes and rows each cell has, and where the rows of a cell and its visitors go."""

    def __init__(self, width: int, k: int, candidates: int, max_cell: int, guests: int):
        self.width, self.k, self.candidates, self.max_cell, self.guests = width, k, candidates, max_cell, guests
        self.codebooks: tuple[np.ndarray, np.ndarray] = (np.zeros((0, 0)), np.zeros((0, 0)))
        self.gaps = self.codebooks
        self.reach = MARGIN * 2 * (2 - 2 * NEAR) ** 0.5 / width**0.5
        self.inner: dict[int, tuple[int, np.ndarray]] = {}
        self.cells = self.placed = 0
        self.sizes = self.blocks = self.parts = np.zeros(0, np.int64)
        self.heavy: np.ndarray = np.zeros(0, np.int64)  # sorted class hashes
        self.kept: set = set()

    def batch(self, b: pa.RecordBatch, all_rows: bool = False):
        """(ids, unit vectors, half-precision ones, class hashes, distances of both halves, cell) of the rows to index."""
        ids, x = _matrix(b, self.width)
        half = x.astype(np.float16)
        h1, h2 = _classes(half)
        if len(self.heavy) and not all_rows:
            at = np.minimum(np.searchsorted(self.heavy, h1), len(self.heavy) - 1)
            keep = (self.heavy[at] != h1) | np.fromiter((i in self.kept for i in ids.tolist()), bool, len(ids))
            ids, x, half, h1, h2 = ids[keep], x[keep], half[keep], h1[keep], h2[keep]
        # what is scored is what decides: a class has one cell
        d1, d2, home = _nearest_cells(half.astype(np.float32), self.codebooks, self.inner) if len(ids) else (x, x, np.zeros(0, np.int64))
        return ids, half, h1, h2, d1, d2, home

    def visits(self, half: np.ndarray, h1: np.ndarray, d1: np.ndarray, d2: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that each row visits besides its own, by count and by margin; equal vectors are traversed once."""
        rows, cells, known = [], [], {}
        for r in np.flatnonzero(self.sizes[home] < self.candidates).tolist():
            found = known.get(key := int(h1[r]))
            if found is None:
                own = int(home[r])
                found = known[key] = [c for c in _visits(half[r].astype(np.float32), d1[r], d2[r], self.sizes, self.inner, self.candidates) if c != own]
            rows += [r] * len(found)
            cells += found
        both = [np.array(rows, np.int64) * self.cells + np.array(cells, np.int64)]
        for s in range(0, len(home), 1024):
            row, cell = self.near_cells(half[s : s + 1024], d1[s : s + 1024], d2[s : s + 1024])
            other = (self.sizes[cell] > 0) & (cell != home[row + s])
            both.append((row[other] + s) * self.cells + cell[other])
        return np.divmod(np.unique(np.concatenate(both)), max(self.cells, 1))

    def near_cells(self, half: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells within the margin, of a hot one its inner cells within theirs."""
        m1, m2 = d1 - d1.min(1, keepdims=True), d2 - d2.min(1, keepdims=True)
        g1, g2 = (self.reach**2 * gaps[d.argmin(1)] for gaps, d in zip(self.gaps, (d1, d2)))
        # what one half leaves over counts for the other, so these hold all pairs with m1 + m2 <= sqrt(g1 + g2)
        over1, over2 = np.sqrt(g1) - m1, np.sqrt(g2) - m2
        r1, c1 = np.nonzero(over1 >= -over2.max(1, keepdims=True))
        r2, c2 = np.nonzero(over2 >= -over1.max(1, keepdims=True))
        n2 = np.bincount(r2, minlength=len(half))
        n = n2[r1]
        row, i = np.repeat(r1, n), np.repeat(c1, n)
        j = c2[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(n2) - n2)[row]]
        keep = (m1[row, i] + m2[row, j]) ** 2 <= g1[row, i] + g2[row, j]
        row, cell = row[keep], i[keep] * d2.shape[1] + j[keep]
        if not self.inner:
            return row, cell
        rows, cells, hot = [], [], np.zeros(len(cell), bool)
        for c, (first, centroids) in self.inner.items():
            at = np.flatnonzero(cell == c)
            if len(at):
                hot[at] = True
                d = _inner_distances(half[row[at]].astype(np.float32), centroids)
                r, sub = np.nonzero((d - d.min(1, keepdims=True)) ** 2 <= self.reach**2 * _gaps(centroids)[d.argmin(1)])
                rows.append(row[at][r])
                cells.append(first + sub)
        return np.concatenate([row[~hot], *rows]), np.concatenate([cell[~hot], *cells])


def _bytes(values: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values, one after the other, without a copy."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]]


PLACED = "cell long, block_a int, block_b int, part int, mine int, id {}, vec binary"


def placements(vectors: DataFrame, index: Index, id_type: str) -> DataFrame:
    """Rows of (cell, block_a, block_b, part): the groups in which vectors meet. mine is the block of a row in its own cell,
    -1 for a visitor."""
    width = index.width

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, half, h1, h2, d1, d2, home = index.batch(b)
            if not len(ids):
                continue
            own = (h2.view(np.uint64) % index.blocks[home].astype(np.uint64)).astype(np.int64)
            out: list[tuple[np.ndarray, ...]] = []
            # own rows: every pair of blocks that has theirs, and every part of the visitors with theirs
            m = index.blocks[home]
            row = np.repeat(np.arange(len(ids)), m)
            other = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            mine = own[row]
            out.append((row, home[row], np.minimum(mine, other), np.maximum(mine, other), np.zeros(len(row), np.int64), mine))
            extra = np.maximum(index.parts[home] - 1, 0)
            row = np.repeat(np.arange(len(ids)), extra)
            out.append((row, home[row], own[row], own[row], np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra) + 1, own[row]))
            who, cell = index.visits(half, h1, d1, d2, home)
            part = (pd.util.hash_array(ids[who]) % np.maximum(index.parts[cell], 1).astype(np.uint64)).astype(np.int64)
            m = index.blocks[cell]
            at = np.repeat(np.arange(len(who)), m)
            block = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            out.append((who[at], cell[at], block, block, part[at], np.full(len(at), -1)))
            row, cell, block_a, block_b, part, mine = (np.concatenate(c) for c in zip(*out))
            step = max(1, (64 << 20) // (2 * width))
            for s in range(0, len(row), step):
                take = row[s : s + step]
                offsets = np.arange(len(take) + 1, dtype=np.int32) * (2 * width)
                vec = pa.BinaryArray.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(offsets), pa.py_buffer(half[take].tobytes())])
                small = [pa.array(c[s : s + step].astype(np.int32)) for c in (block_a, block_b, part, mine)]
                yield pa.RecordBatch.from_arrays([pa.array(cell[s : s + step]), *small, pa.array(ids[take]), vec], names=["cell", "block_a", "block_b", "part", "mine", "id", "vec"])

    return vectors.mapInArrow(place, PLACED.format(id_type))


def build_index(usable: DataFrame, n: int, width: int, k: int, centroids: int | None, candidates: int, max_cell: int, sample_rows: int, hot_blocks: int, guests: int) -> tuple[Index, DataFrame | None]:
    """(the index, neighbours of the ids of large classes that don't travel)."""
    index = Index(width, k, candidates, max_cell, guests)
    centroids = centroids or min(1024, max(64, round((n / 75) ** 0.5)))
    sample_rows = max(sample_rows, 32 * centroids)
    parts = [_matrix(b, width)[1] for b in hash_sample(usable, "id", n, sample_rows).toArrow().to_batches()]
    points = (np.concatenate(parts) if parts else np.zeros((0, width), np.float32))[:sample_rows]
    if not len(points):
        return index, None
    cut = width // 2
    index.codebooks = (codebook(points[:, :cut], centroids), codebook(points[:, cut:], centroids))
    index.gaps = (_gaps(index.codebooks[0]), _gaps(index.codebooks[1]))
    index.cells = len(index.codebooks[0]) * len(index.codebooks[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, h1, h2, _, _, home = index.batch(b)
            if len(h1):
                order = np.lexsort((h2, h1))
                new = np.flatnonzero(np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(home[order][new]), pa.array(h1[order][new]), pa.array(h2[order][new]), pa.array(np.diff(np.r_[new, len(order)]))], names=["cell", "h1", "h2", "n"])

    def cell_sizes() -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """Classes, and the numbers of classes and of rows of each cell: at most as many numbers as cells get to the driver."""
        classes = materialize(usable.mapInArrow(count, "cell long, h1 long, h2 long, n long").groupBy("cell", "h1", "h2").agg(F.sum("n").alias("n")), "classes")
        got = classes.groupBy("cell").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).toArrow()
        many, rows = np.zeros(index.cells, np.int64), np.zeros(index.cells, np.int64)
        at = got["cell"].to_numpy()
        many[at], rows[at] = got["c"].to_numpy(), got["n"].to_numpy()
        return classes, many, rows

    classes, index.sizes, rows = cell_sizes()
    limit = max(max_cell, n // 100_000)  # fewer classes than 100,000 are above it
    large = np.sort(classes.where(F.col("n") > limit).select("h1").toArrow()["h1"].to_numpy())
    copies = None
    if len(large):
        index.heavy, copies = large, _large_classes(usable, index, large)
        rows = None
    hot = np.flatnonzero(index.sizes > max_cell * hot_blocks)
    if len(hot):
        whole, where = index.sizes, _nearest_cells(points, index.codebooks, {})[2]
        for cell in hot.tolist():
            mine = points[where == cell]
            wanted = min(len(mine) // 8, -(-4 * int(whole[cell]) // max_cell))
            if wanted > 1:
                index.inner[cell] = (index.cells, split(mine, wanted))
                index.cells += len(index.inner[cell][1])
        _, index.sizes, rows = cell_sizes()
        index.sizes[list(index.inner)] = whole[list(index.inner)]  # what traverse() sees of a hot cell
    elif rows is None:
        _, index.sizes, rows = cell_sizes()
    index.blocks = np.maximum(1, -(-rows // max_cell))

    def visitors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(index.cells, np.int64)
        for b in batches:
            _, half, h1, _, d1, d2, home = index.batch(b)
            if len(h1):
                total += np.bincount(index.visits(half, h1, d1, d2, home)[1], minlength=index.cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = usable.mapInArrow(visitors, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    visits = np.zeros(index.cells, np.int64)
    visits[got["cell"].to_numpy()] = got["n"].to_numpy()
    index.parts = np.maximum(1, -(-visits // guests))
    index.placed = int((rows * (index.blocks + index.parts - 1) + visits * index.blocks).sum())
    return index, copies


def _large_classes(usable: DataFrame, index: Index, large: np.ndarray) -> DataFrame:
    """The neighbours of the ids of large classes but the k + 1 smallest of each, which index.kept gets."""
    k, id_type = index.k, usable.schema["id"].dataType.simpleString()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _, h1, _, _, _, _ = index.batch(b, all_rows=True)
            at = np.isin(h1, large)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], b.schema.field(0).type), pa.array(h1[at])], names=["id", "h"])

    heavy = materialize(usable.mapInArrow(members, f"id {id_type}, h long"), "heavy").distinct()
    parts = heavy.groupBy("h", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    kept = materialize(parts.groupBy("h").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("kept")), "kept")
    index.kept = {i for r in kept.collect() for i in r.kept}  # k + 1 ids of fewer than 100,000 classes
    others = heavy.join(F.broadcast(kept), "h").where(~F.array_contains("kept", F.col("id")))
    return others.select("id", F.explode(F.slice("kept", 1, k)).alias("other"), F.lit(1.0).alias("score"))


def most_similar(vectors: DataFrame, id_col: str, vec_col: str, width: int, k: int = 10, centroids: int | None = None,
                 candidates: int = 1000, max_cell: int = 16384, sample_rows: int = SAMPLE_ROWS, hot_blocks: int = 4, guests: int = 32768) -> DataFrame:
    """The k most similar other vectors of every vector: (id, other, score).

    width: the length of a vector; rows of another width take no part. centroids: K of each half; by default it
    grows with the square root of the table, from 64 to 1024. candidates: how many different vectors a query visits at
    least; cells within the margin of a near neighbour come on top. sample_rows: bound of the sample that the codebooks are fitted on, 32 for each centroid at least. max_cell, guests: how many rows of a
    cell and how many visitors a task gets.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    id_type = rows.schema["id"].dataType.simpleString()
    usable = rows.where(F.col("id").isNotNull() & (F.size("vec") == width))
    index, copies = build_index(usable, vectors.count(), width, k, centroids, candidates, max_cell, sample_rows, hot_blocks, guests)
    if not index.cells:
        return spark.createDataFrame([], f"id {id_type}, other {id_type}, score double")

    def score(key: tuple, group: pa.Table) -> pa.Table:
        a, b, part = (v.as_py() for v in key[1:])
        ids, mine = group["id"].to_numpy(), group["mine"].to_numpy()
        raw = np.concatenate([_bytes(c) for c in group["vec"].chunks if len(c)]).view(np.float16).reshape(-1, width)
        _, same = np.unique(raw.view(np.dtype((np.void, 2 * width))).ravel(), return_inverse=True)
        side = lambda at: _Side(ids[at], raw[at], same.ravel()[at])
        left, guest = side(mine == a), side(mine < 0)
        found = [_meet(guest, left, k)] if a == b else []
        if part == 0:
            found.append(_meet(left, None if a == b else side(mine == b), k))
        i, o, v = (np.concatenate([c for f in found for c in f[n]] or [(ids[:0], ids[:0], np.zeros(0, np.float32))[n]]) for n in range(3))
        v = v.astype(np.float64).round(6)
        # a pair can be found from both sides
        order = np.lexsort((o, i))
        once = order[np.r_[True, (i[order][1:] != i[order][:-1]) | (o[order][1:] != o[order][:-1])]] if len(order) else order
        i, o, v = i[once], o[once], v[once]
        keep = _ranked(i, o, v, k)
        return pa.table({"id": i[keep], "other": o[keep], "score": v[keep]})

    # tasks of a size that the table doesn't change, whatever the session's number of partitions
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.placed * 2 * width // TASK_BYTES))
    placed = placements(usable, index, id_type).repartition(tasks, "cell", "block_a", "block_b", "part")
    found = placed.groupBy("cell", "block_a", "block_b", "part").applyInArrow(score, f"id {id_type}, other {id_type}, score double")
    # at most k rows of a vector come from each group it was scored in; both groupings use one shuffle
    result = (
        found.repartition("id")
        .groupBy("id", "other")
        .agg(F.max("score").alias("score"))
        .groupBy("id")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "other"))), 1, k).alias("best"))
        .select("id", F.explode("best").alias("b"))
        .select("id", F.col("b.other").alias("other"), (-F.col("b.s")).alias("score"))
    )
    return result if copies is None else result.unionByName(copies)


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """Unordered pairs of most_similar() with a score of at least `least`: (id_a, id_b), each once."""
    return (
        neighbours.where(F.col("score") >= least)
        .select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
        .distinct()
    )
