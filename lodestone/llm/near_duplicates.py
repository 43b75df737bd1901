"""Near-duplicate texts: all pairs above a Jaccard similarity of word sequences, and their groups.

Method: covering locality-sensitive hashing over MinHash signatures. A text's signature has
7 * groups coordinates; two texts of similarity s agree in each coordinate with probability s. Within
a group the coordinate i = 1..7 stands for the nonzero vector i of F2^3, and the mask v = 1..7 keeps
the coordinates with <i, v> = 1, always four of them. Any two coordinates are orthogonal to a
common v, as are the three of a line, so whichever two coordinates (or line) of a group
differ, some mask hides them and the texts collide in its table. Hence every pair of texts whose
signatures differ in at most 3 * groups - 1 coordinates collides in some table: one group then
has at most two of them. At similarity 0.5 a group collides with probability 0.28 and twelve
groups with 0.98, at 0.55 with 0.996, at 0.6 with 0.9996, at 0.7 and above with more than 0.999999.

Candidates are then checked exactly, on the sets of their word sequences (64-bit hashes of them). Texts with the same words form one
class, a 64-bit hash, and are handled once, so a group of copies costs as much as one text: among ten billion different texts three of 5 * 10^19 pairs
are expected to share one. Tables are buckets of key ranges; their number follows the table.

A key shared by more than CROWD classes isn't written out in pairs. Its classes are joined exactly
instead (a task that sees such a key passes on no more than it takes to see it there), on the rarest part of their sequences: of two sets above the threshold each has one of its
n - ceil(threshold * n) + 1 rarest sequences among those of the other, whatever the order of rareness.

Nulls and texts with fewer words than a sequence take no part. Repeated rows of an id count once.
An empty table gives empty results. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.incremental import salted_lookup
from ..session import discard, materialize

U64 = np.uint64
_WORD_LIMIT = 0x32400
MASKS = [[i for i in range(7) if bin((i + 1) & v).count("1") % 2] for v in range(1, 8)]
EXPAND = 20
PIECE = 256
PAIRS_IN = 4_000_000
CROWD = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and multiply)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(0x110000, bool)
    word[:_WORD_LIMIT] = [chr(c).isalnum() for c in range(_WORD_LIMIT)]
    return word, _mix(np.arange(0x110000, dtype=U64) + U64(0x9E3779B97F4A7C15))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document of each word, hash of each word) of lower-cased texts; words are maximal runs of
    letters and digits. A word's hash is a polynomial in its characters, so that all words come out
    of one running sum."""
    word, codes_mixed = _tables()
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_word = np.r_[False, word[codes], False]
    edges = np.flatnonzero(is_word[1:] != is_word[:-1])
    starts, ends = edges[::2], edges[1::2]
    base = U64(0x9E3779B97F4A7C15 | 1)
    powers = np.cumprod(np.r_[U64(1), np.full(len(codes), base, U64)])
    inverse = U64(pow(int(base), -1, 1 << 64))
    back = np.cumprod(np.r_[U64(1), np.full(len(codes), inverse, U64)])
    total = np.r_[U64(0), np.cumsum(codes_mixed[codes] * powers[:-1], dtype=U64)]
    hashes = _mix((total[ends] - total[starts]) * back[starts])
    ends_of_docs = np.cumsum(np.array([len(t) + 1 for t in lowered], np.int64))
    return np.searchsorted(ends_of_docs, starts, side="right"), hashes


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each word sequence, its hash, class of each text). The class is a hash of
    all words of the text in order, never 0 for a text with words."""
    doc, h = word_hashes(texts)
    n = len(texts)
    first = np.searchsorted(doc, np.arange(n + 1))
    position = np.arange(len(h)) - first[doc]
    per_word = _mix(h + position.astype(U64) * U64(0xD6E8FEB86659FD93))
    sums = np.r_[U64(0), np.cumsum(per_word, dtype=U64)]
    classes = _mix(sums[first[1:]] - sums[first[:-1]] + (first[1:] - first[:-1]).astype(U64))
    if len(h) < words:
        return np.zeros(0, np.int64), np.zeros(0, U64), classes
    seq = np.zeros(len(h) - words + 1, U64)
    for k in range(words):
        seq = _mix(seq + h[k : len(h) - words + 1 + k] * U64(2 * k + 3))
    inside = doc[: len(seq)] == doc[words - 1 :]
    return doc[: len(seq)][inside], seq[inside], classes


def _batches(source: Iterator[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of the rows with both, in portions of about `chars` characters. A text is never cut."""
    for b in source:
        ids, texts, held = [], [], 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None or t is None:
                continue
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= chars:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def signatures(doc: np.ndarray, seq: np.ndarray, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents with a sequence, their MinHash signatures of 32-bit values)."""
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    out = np.empty((len(starts), coordinates), np.uint32)
    low, high = (seq & U64(0xFFFFFFFF)).astype(np.uint32), (seq >> U64(32)).astype(np.uint32)
    rng = np.random.default_rng(11)
    for c in range(coordinates):
        a, b = (rng.integers(1, 1 << 32, 2, dtype=np.uint32) | np.uint32(1))
        x = low * a + high * b
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[:, c] = np.minimum.reduceat(x, starts) if len(starts) else 0
    return doc[starts], out


def table_keys(signature: np.ndarray, groups: int) -> np.ndarray:
    """The key of each text in each of the 7 * groups tables: (texts, tables) of 64 bits."""
    keys = np.empty((len(signature), 7 * groups), U64)
    for g in range(groups):
        part = signature[:, 7 * g : 7 * g + 7].astype(U64)
        for v, mask in enumerate(MASKS):
            key = np.full(len(part), 7 * g + v + 1, U64)
            for i in mask:
                key = _mix(key * U64(0x9E3779B97F4A7C15) + part[:, i])
            keys[:, 7 * g + v] = key
    return keys


def candidate_pairs(texts: DataFrame, id_col: str, text_col: str, words: int, groups: int, crowd: int = CROWD, tables_in: int = 50_000) -> DataFrame:
    """Distinct pairs (class_a, class_b) of classes that collide in a table; of a key that more than
    `crowd` classes share, each class with itself.

    An entry takes eleven bytes: the class and three of the key, of which the bucket holds
    the rest. Entries of a bucket travel as one value per input batch. Of a key that more than `crowd` classes of a batch share,
    crowd + 1 go to its bucket; the others are named under a negative bucket, which any task may take.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    n = texts.count()
    bits = max(4, math.ceil(math.log2(max(1, n * 7 * groups / tables_in))))
    parts = max(1, min(1 << bits, max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 16)))

    def entries(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys, cls = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            held.clear()
            _, once = np.unique(cls, return_index=True)
            keys, cls = keys[once], cls[once]
            flat, owner = keys.ravel(), np.repeat(cls, keys.shape[1])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            size = np.diff(np.r_[first, len(flat)])
            if size.max() > crowd:
                rank = np.arange(len(flat)) - np.repeat(first, size)
                more = np.unique(owner[rank > crowd])
                flat, owner = flat[rank <= crowd], owner[rank <= crowd]
                where = -1 - (more % U64(1 << bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array([c.tobytes() for c in more], pa.binary())], names=["bucket", "entries"])
            bucket = (flat >> U64(64 - bits)).astype(np.int64)
            packed = np.empty((len(flat), 11), np.uint8)
            packed[:, :3] = flat.view(np.uint8).reshape(-1, 8)[:, :3]
            packed[:, 3:] = owner.view(np.uint8).reshape(-1, 8)
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            offsets = (at * 11).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[at[:-1]]), pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])],
                names=["bucket", "entries"],
            )

        waiting = 0
        for _, texts_ in _batches(source):
            doc, seq, classes = shingles(texts_, words)
            who, sig = signatures(doc, seq, 7 * groups)
            held.append((table_keys(sig, groups), classes[who]))
            waiting += len(who)
            if waiting >= 20_000:
                yield from flush()
                waiting = 0
        yield from flush()

    def collide(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            if now < 0:
                c = np.unique(np.frombuffer(b"".join(blobs), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(c)], names=["class_a", "class_b"])
                return
            raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 11)
            key = np.zeros((len(raw), 4), np.uint8)
            key[:, :3] = raw[:, :3]
            key, cls = key.view(np.uint32).ravel(), np.ascontiguousarray(raw[:, 3:]).view(np.int64).ravel()
            order = np.lexsort((cls, key))
            key, cls = key[order], cls[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
            key, cls = key[new], cls[new]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            size = np.diff(at)
            large = np.flatnonzero(size > crowd)
            if len(large):
                c = np.unique(np.concatenate([cls[at[g] : at[g + 1]] for g in large]))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(c)], names=["class_a", "class_b"])
                size = np.where(size > crowd, 1, size)
            # the pairs at distance d in the sorted group, for all groups at once
            for d in range(1, int(size.max(initial=1))):
                starts, counts = at[:-1][size > d], size[size > d] - d
                left = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                for s in range(0, len(left), 1 << 18):
                    i = left[s : s + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[i + d])], names=["class_a", "class_b"])

        for b in source:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != now and blobs:
                    yield from pairs()
                    blobs.clear()
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from pairs()

    placed = rows.mapInArrow(entries, "bucket long, entries binary")
    met = placed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(collide, "class_a long, class_b long")
    return met.distinct()


class Filter:
    """A bitmap of a fixed size over the hashes of a set, shared with all tasks. It lets every member pass and of the rest a share
    that grows with the set, up to all: it only spares work, whatever the size of the set."""

    def __init__(self, classes: DataFrame, bits: int = 27):
        # 64 bits a row: at most 1 << (bits - 6) rows come to the driver
        at = F.shiftrightunsigned(F.col("class"), 64 - bits)
        words = classes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(class, {64 - bits}) & 63 as int))")).alias("mask")).toArrow()
        table = np.zeros(1 << (bits - 6), np.int64)
        table[words["word"].to_numpy()] = words["mask"].to_numpy()
        self.bits, self.shared = bits, classes.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def holds(self, classes: np.ndarray) -> np.ndarray:
        at = classes >> U64(64 - self.bits)
        return (self.shared.value[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def text_classes(texts: DataFrame, id_col: str, text_col: str, words: int, sets: bool = False, wanted: "Filter | None" = None) -> DataFrame:
    """(id, class) of the texts with at least one sequence; with sets: (class, seqs), the distinct
    sequences. wanted: a filter that classes must pass, before their sets leave the task."""
    id_type = texts.schema[id_col].dataType.simpleString()

    def classify(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, texts_ in _batches(source):
            doc, seq, classes = shingles(texts_, words)
            if sets and len(doc):  # a class once for each task, so that copies don't meet in one
                fresh, present = np.zeros(len(texts_), bool), np.unique(doc)
                for i in present[wanted.holds(classes[present])] if wanted else present:
                    if (c := int(classes[i])) not in seen:
                        fresh[i] = True
                        seen.add(c)
                seen = seen if len(seen) < 1_000_000 else set()
                doc, seq = doc[fresh[doc]], seq[fresh[doc]]
            who = doc[np.r_[True, doc[1:] != doc[:-1]]] if len(doc) else doc
            cls = pa.array(classes[who].view(np.int64))
            if not sets:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in who], b_type), cls], names=["id", "class"])
                continue
            value = seq.view(np.int64)
            order = np.lexsort((value, doc))
            doc, value = doc[order], value[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])] if len(doc) else np.zeros(0, bool)
            doc, value = doc[new], value[new]
            offsets = np.r_[np.searchsorted(doc, who), len(doc)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([cls, pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))], names=["class", "seqs"])

    b_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(id_type, pa.int64())
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    return rows.mapInArrow(classify, "class long, seqs array<bigint>" if sets else f"id {id_type}, class long")


def rare_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (class_a, class_b) of (class, seqs) that share one of their rarest sequences: all pairs above the
    threshold are among them. Sequences that only one set has leave no pair."""
    each = sets.select("class", F.size("seqs").alias("n"), F.explode("seqs").alias("seq"))
    counted = each.join(each.groupBy("seq").agg(F.count(F.lit(1)).alias("sets")), "seq")
    ordered = counted.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "seq"))).alias("o"))
    first = F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    prefix = ordered.select("class", "n", F.explode(F.filter(first, lambda x: x["sets"] > 1)).alias("x")).select("class", "n", "x.seq")
    other = prefix.select(F.col("class").alias("class_b"), F.col("n").alias("n_b"), "seq")
    sizes = (F.col("n") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n"))
    return prefix.join(other, "seq").where((F.col("class") < F.col("class_b")) & sizes).select(F.col("class").alias("class_a"), "class_b").distinct()


def similar_classes(texts: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, groups: int = 12, crowd: int = CROWD) -> DataFrame:
    """(class_a, class_b, similarity) of all classes of different texts with at least this similarity."""
    met = materialize(candidate_pairs(texts, id_col, text_col, words, groups, crowd), "candidates")
    pairs = met.where("class_a <> class_b")
    crowded = met.where("class_a = class_b").select(F.col("class_a").alias("class"))
    if not crowded.isEmpty():
        sets = text_classes(texts, id_col, text_col, words, sets=True, wanted=Filter(crowded)).join(crowded, "class", "left_semi").dropDuplicates(["class"])
        pairs = materialize(pairs.unionByName(rare_pairs(materialize(sets, "crowded"), threshold)).distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct()
    # of a class at most one row a task gets here, and few classes that no pair has
    sets = text_classes(texts, id_col, text_col, words, sets=True, wanted=Filter(nodes)).join(nodes, "class", "left_semi").dropDuplicates(["class"])
    a = sets.select(F.col("class").alias("class_a"), F.col("seqs").alias("seqs_a"))
    b = sets.select(F.col("class").alias("class_b"), F.col("seqs").alias("seqs_b"))
    both = F.size(F.array_intersect("seqs_a", "seqs_b"))
    return (
        pairs.join(a, "class_a")
        .join(b, "class_b")
        .select("class_a", "class_b", (both / (F.size("seqs_a") + F.size("seqs_b") - both)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def class_members(texts: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, class) and (classes: class, first, n, ids): the smallest id, the number of
    distinct ids and, of classes of up to EXPAND ids, all of them, of others the smallest. Salted, so that no task holds a large class."""
    members = materialize(text_classes(texts, id_col, text_col, words), "members")
    salted = members.groupBy("class", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("salt")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    # of a part only its EXPAND + 1 smallest ids can matter besides its count
    parts = salted.select("class", F.size("ids").alias("n"), F.slice("ids", 1, EXPAND + 1).alias("ids"))
    classes = (
        parts.groupBy("class")
        .agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
        .select("class", "n", F.col("ids")[0].alias("first"), F.when(F.col("n") <= EXPAND, F.col("ids")).otherwise(F.slice("ids", 1, 1)).alias("ids"))
    )
    return members, classes


def similar_ids(texts: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, groups: int = 12, whole: bool = False) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b. whole: every pair. Otherwise classes of up to EXPAND copies are written out in full;
    of a larger class every copy is paired with the smallest id, which alone stands for it in pairs with other texts."""
    links = materialize(similar_classes(texts, id_col, text_col, words, threshold, groups).select("class_a", "class_b"), "links")
    members, classes = class_members(texts, id_col, text_col, words)
    several = materialize(classes.where(F.col("n") > 1), "copies")
    large = several.where(F.col("n") > EXPAND)
    if whole and not large.isEmpty():
        return _all_pairs(links, members, classes, large)
    copies = several.select(F.explode("ids").alias("id_a"), "ids").select("id_a", F.explode("ids").alias("id_b"))
    stars = salted_lookup(members, large.select("class", F.col("first").alias("id_a")), "class", F.col("id"))
    a = classes.select(F.col("class").alias("class_a"), F.col("ids").alias("ids_a"))
    b = classes.select(F.col("class").alias("class_b"), F.col("ids").alias("ids_b"))
    linked = links.join(a, "class_a").join(b, "class_b").select(F.explode("ids_a").alias("x"), "ids_b").select("x", F.explode("ids_b").alias("y"))
    return (
        copies.where(F.col("id_a") < F.col("id_b"))
        .unionByName(stars.select("id_a", F.col("id").alias("id_b")).where(F.col("id_a") < F.col("id_b")).distinct())
        .unionByName(linked.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))
    )


def _all_pairs(links: DataFrame, members: DataFrame, classes: DataFrame, large: DataFrame) -> DataFrame:
    """All pairs of ids within a class and across linked ones. A large class is cut into pieces of about PIECE ids, and
    the pairs of two pieces are written out wherever they fall, so that no task gets all pairs of a class."""
    sized = salted_lookup(members, large.select("class", "n"), "class", F.col("id"))
    cut = sized.groupBy("class", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PIECE)).alias("piece")).agg(F.collect_set("id").alias("ids"))
    small = classes.where(F.col("n") <= EXPAND).select("class", F.lit(0).cast("long").alias("piece"), "ids")
    pieces = materialize(small.unionByName(cut), "pieces")
    a, b = (pieces.select(*(F.col(c).alias(f"{c}_{side}") for c in pieces.columns)) for side in "ab")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where(F.col("piece_a") <= F.col("piece_b"))
    across = links.join(a, "class_a").join(b, "class_b")
    met = within.select("class_a", "piece_a", "ids_a", "class_b", "piece_b", "ids_b").unionByName(across.select("class_a", "piece_a", "ids_a", "class_b", "piece_b", "ids_b"))
    most = large.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    parts = min(20_000, max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), most // PAIRS_IN))
    spread = met.repartition(parts, "class_a", "piece_a", "class_b", "piece_b")
    pairs = spread.select("*", F.explode("ids_a").alias("x")).select("*", F.explode("ids_b").alias("y"))
    # two ids of one piece meet twice
    once = (F.col("class_a") != F.col("class_b")) | (F.col("piece_a") != F.col("piece_b")) | (F.col("x") < F.col("y"))
    return pairs.where(once).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of the undirected edges (a, b); a component's name is its smallest node.
    Large-star and small-star alternate until nothing changes; each round is written to the shared folder and the one before removed.
    If that takes more than `rounds`, it is an error: no half-made component gets out."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # (u, v): for large-star both directions, for small-star the greater node has its lesser neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        met = both.join(least, "u")  # a hub's rows are split by AQE's skew join
        if large:
            out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    before = last = None
    for _ in range(rounds):
        now = materialize(star(star(now, True), False), "components")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last is not None:
            discard(last)
        last = now
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"the components weren't complete after {rounds} rounds")
    named = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return named.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(named, "node", "left_anti"))


def near_duplicate_groups(texts: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, groups: int = 12) -> DataFrame:
    """One row per text with a class: (id, group_id, n_links). group_id is the smallest id of the
    texts connected by links; n_links counts the other texts that a text's class is linked to, its copies not among them."""
    links = materialize(similar_classes(texts, id_col, text_col, words, threshold, groups).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), "links")
    members, classes = class_members(texts, id_col, text_col, words)
    classes = materialize(classes.select("class", "first"), "classes")
    component = connected_components(links).withColumnRenamed("node", "class")
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    joined = classes.join(component, "class", "left").join(degree, "class", "left").withColumn("component", F.coalesce("component", "class"))
    first = joined.groupBy("component").agg(F.min("first").alias("group_id"))
    info = joined.join(first, "component").select("class", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # one row of info a class: the members of a large class are split by AQE's skew join
    return members.distinct().join(info, "class").select("id", "group_id", "n_links")
