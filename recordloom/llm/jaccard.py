"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles, and its sketch the SKETCH smallest of their hashes (all of them in
a smaller set). Two sets at the similarity have at least that share of their sketches in common, give or take the
sampling error, so the recursion runs on sketches and never reads a text again. In each of RUNS runs a sketch falls
into a bucket for every token whose hash in that run is below 1 / (SPLIT x tokens): 1 / SPLIT of them on average.
Buckets of at most LEAF sets are compared by brute force. In larger ones a set takes all that are similar to it into
its group, which needs no comparison among themselves here; what no group took, and what stands on a group's edge, is
split again by tokens that are not on the path yet, until no bucket is large. One task does so for a bucket of up to PART
sets, leaves out buckets whose sets are in one component by then, and reports a tree of links. Candidates are linked, and each connected component is then compared
exactly, so that every reported link is exact and pairs are found as well that no run found but whose documents met
others of their group.

A component of up to BLOCK sets is one group, compared pair by pair. In a larger one every set is written as its
difference from one member: what it lacks and what it has beyond. Where these differences are small enough, two sets
are linked whatever they share of them, so sets are counted by the sizes of their differences, which is linear;
only sets with an undecided partner are compared in blocks, as differences instead of texts.

RUNS follows from TARGET. With c common tokens of two sketches of n, the number of common children of a common path is
Poisson-like with mean c / (SPLIT n), at the threshold SIMILARITY / SPLIT; found(d) is the probability that a common
path of d tokens exists in one run, found(d) = 1 - exp(-mean found(d - 1)). RUNS is the least number for which
(1 - found(DEPTH)) ** RUNS is at most 1 - TARGET. Deeper paths lose little more, as the mean is above 1.

Equal sets are one class with a representative, so copies are not compared with each other.

Defined cases: a null or blank text has no shingles, is a class of its own and has no links; a text of
one to four words has one shingle, all its words; repeated rows are copies of each other; a null id
sorts after all others and never names a class that has another id; an empty table gives an empty
table; extra columns are passed on unless their names clash with class_id, n_links, n_copies, first_of_class, or with
the operator's own names (OWN).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import Words, discard, gram_hashes, grouped, mix, pieces, segments, sieve, sieved, spread_join, stored, table, whole_groups
from recordloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Similarity below which sets part on the way down.
SPLIT = 0.5
TARGET = 0.9999
DEPTH = 3
LEAF = 32
#: Sets of a bucket that one task takes; larger buckets are dealt over many.
PART = 1 << 15
SKETCH = 64
#: Share of a pair's common sketch from which it is a candidate (some six standard errors below the similarity).
SKETCH_SHARE = 0.45
#: Share with the first set of a group from which a set's partners are in the group, too, as 1 - share is a distance;
#: and what is added where a sketch is a sample.
CLOSE_SHARE, SAMPLED = SKETCH_SHARE + 1 - SIMILARITY, 0.1
#: Comparisons of a bucket in which groups are taken out of it before it is split.
COMPARISONS = 1 << 18
#: Sets of a group in the exact comparison.
BLOCK = 128
#: Sets of a block of differences.
DIFF_BLOCK = 512
#: Names of columns on the way; a column of the input with one of them is not passed on.
OWN = frozenset(("_rid", "_s1", "_s2", "_size", "_sketch", "_word", "_mask", "_maybe", "_copies", "_links", "_first_rid", "_first_id"))
_ALL = float(1 << 64)
_STEP = np.uint64(0xA0761D6478BD642F)


def found(depth: int, mean: float) -> float:
    """Probability that a run keeps two sets together on some path of so many tokens."""
    return 1 - math.exp(-mean * found(depth - 1, mean)) if depth else 1.0


def runs_for(similarity: float, target: float = TARGET) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - found(DEPTH, similarity / SPLIT)))


RUNS = runs_for(SIMILARITY)

def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and each text's number of them."""
    w = Words(texts)
    h = w.hashes()
    long = gram_hashes(h, SHINGLE)
    at = np.flatnonzero(w.doc[: len(long)] == w.doc[SHINGLE - 1 :][: len(long)]) if len(long) else np.empty(0, np.int64)
    found, doc = long[at], w.doc[at]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(w.n == k)
        if len(short):
            found = np.concatenate([found, mix(gram_hashes(h, k)[w.first[short]] + np.uint64(k))])
            doc = np.concatenate([doc, short])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[new], np.bincount(doc[new], minlength=len(texts))


def _chosen(hashed: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes that are below 1 / (SPLIT x size)."""
    return hashed.astype(np.float64) < _ALL / np.maximum(SPLIT * sizes, 1e-9)


def first_buckets(tokens: np.ndarray, sizes: np.ndarray, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths of one token in all runs, and the index of the set of each; tokens: the sketches, one after another."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for r in range(runs):
        at = np.flatnonzero(_chosen(mix(tokens ^ mix(np.full(1, r + 1, np.uint64) * _STEP)), sizes[owner]))
        found.append(path_hash(np.full(1, r + 1, np.uint64), tokens[at]))
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


def path_hash(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(before * _STEP + np.uint64(1)) ^ mix(token + _STEP))


def flat(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of binary sketches, one after another, and each one's number of tokens."""
    if isinstance(sketches, pa.ChunkedArray):
        sketches = sketches.combine_chunks()
    sketches = sketches.cast(pa.large_binary())
    offsets = np.frombuffer(sketches.buffers()[1], np.int64, len(sketches) + 1, sketches.offset * 8) if len(sketches) else np.zeros(1, np.int64)
    data = np.frombuffer(sketches.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return data.view(np.uint32).astype(np.uint64), np.diff(offsets) // 4


def padded(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches as rows of SKETCH numbers; unused places are 2**32 - 1."""
    out = np.full((len(sizes), SKETCH), 0xFFFFFFFF, np.uint32)
    out[np.repeat(np.arange(len(sizes)), sizes), segments(np.zeros(len(sizes), np.int64), sizes)] = tokens
    return out


def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of sketches: the common share of the smallest hashes of the union."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = both != 0xFFFFFFFF
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(~same & real, axis=1)
    return (same & (rank <= SKETCH)).sum(axis=1) / np.minimum(np.maximum(rank[:, -1], 1), SKETCH)


def _shares(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0), *(share(sketch[i[k : k + 16384]], sketch[j[k : k + 16384]]) for k in range(0, len(i), 16384))])


def _spread(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes is linked to by the pairs (i, j), over any number of links."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            break
    return low


def _leaf_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, a bucket's being at most LEAF: links of sets with similar sketches, a tree for each bucket."""
    for rows in whole_groups(batches, "bucket", 1 << 14):
        bucket = rows.column("bucket").to_numpy()
        rid = rows.column("rid").to_numpy()
        sketch = padded(*flat(rows.column("sketch")))
        end = np.searchsorted(bucket, bucket, side="right")
        n = end - np.arange(len(bucket)) - 1
        i, j = np.repeat(np.arange(len(bucket)), n), segments(np.arange(len(bucket)) + 1, n)
        keep = _shares(sketch, i, j) >= SKETCH_SHARE
        low = _spread(len(bucket), i[keep], j[keep])
        linked = np.flatnonzero(low != np.arange(len(low)))
        links = np.unique(np.stack([rid[low[linked]], rid[linked]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0], pa.int64()), pa.array(links[:, 1], pa.int64())], ["a", "b"])


_PATHS = pa.schema([("bucket", pa.int64()), ("rid", pa.int64()), ("path", pa.list_(pa.int64())), ("loose", pa.bool_()), ("head", pa.int64())])
_PATHS_SQL = "bucket long, rid long, path array<long>, loose boolean, head long"


def _children(rows: pa.Table, runs: int) -> Iterator[pa.RecordBatch]:
    """The longer paths of rows (bucket, rid, path, sketch) by one token that is not on the path; a null path has one token."""
    for part in rows.to_batches(4096):
        tokens, sizes = flat(part.column("sketch"))
        bucket, rid, path = part.column("bucket").to_numpy().view(np.uint64), part.column("rid").to_numpy(), part.column("path").to_pylist()
        owner = np.repeat(np.arange(len(rid)), sizes)
        token = tokens.view(np.int64)
        own = {}
        used = np.zeros(len(tokens), bool)
        if any(x is None for x in path):  # the token of which some run makes this bucket
            for r in range(runs):
                used |= path_hash(np.full(1, r + 1, np.uint64), tokens) == bucket[owner]
            own = dict(zip(owner[used].tolist(), token[used].tolist(), strict=True))
        path = [([own[i]] if i in own else []) if x is None else x for i, x in enumerate(path)]
        length = np.array([len(x) for x in path])
        held = np.full((len(path), int(length.max(initial=0))), -1, np.int64)
        for i, x in enumerate(path):
            held[i, : len(x)] = x
        for k in range(held.shape[1]):
            used |= held[owner, k] == token
        at = np.flatnonzero(~used & _chosen(mix(tokens ^ mix(bucket + _STEP)[owner]), (sizes - length)[owner]))
        longer = [[*path[i], t] for i, t in zip(owner[at].tolist(), token[at].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(path_hash(bucket[owner[at]], tokens[at]).view(np.int64)), pa.array(rid[owner[at]]), pa.array(longer, pa.list_(pa.int64())), pa.array(np.ones(len(at), bool)), pa.nulls(len(at), pa.int64())], schema=_PATHS)


def _joined(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """low, the smallest index of each set's component, after further links (i, j)."""
    return _spread(len(low), low[i], low[j])[low]


def _taken(sketch: np.ndarray, close: np.ndarray, low: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's components low after some COMPARISONS, and the sets that may have partners in another component.

    The first set of order takes all that are similar to it, then the next that none took. Partners of a set that is
    close to it are in its component, so that set needs no more.
    """
    loose, stay, left = np.ones(len(low), bool), np.ones(len(low), bool), COMPARISONS
    at = np.arange(len(low))
    for head in order:
        if not loose[head]:
            continue
        at = np.flatnonzero(stay)
        if left < len(at) and loose.sum() > LEAF or (low[at] == low[at[0]]).all():
            break
        near = _shares(sketch, np.full(len(at), head), at)
        left -= len(at)
        link = at[near >= SKETCH_SHARE]
        low = _joined(low, np.full(len(link), head), link)
        loose[link] = loose[head] = False
        stay[at[near >= close[at]]] = stay[head] = False
    at = np.flatnonzero(stay)
    if not len(at) or (low[at] == low[at[0]]).all():
        return low, at[:0]
    if len(at) * (len(at) - 1) // 2 > COMPARISONS:
        return low, at
    i, j = (at[x] for x in np.triu_indices(len(at), 1))
    return _joined(low, *_similar(sketch, low, i, j)), at[:0]


def _similar(sketch: np.ndarray, low: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) of different components whose sketches are similar."""
    apart = low[i] != low[j]
    i, j = i[apart], j[apart]
    near = _shares(sketch, i, j) >= SKETCH_SHARE
    return i[near], j[near]


def _components(tokens: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, path: list[int]) -> np.ndarray:
    """The smallest index that each set of a bucket is linked to; bucket: its hash, path: its tokens.

    What is not decided in the bucket is split by tokens that are not on the path yet. Only buckets with sets of several
    components are looked at, as all sets of a component are compared exactly later.
    """
    n, edge, sketch = len(sizes), np.concatenate([[0], np.cumsum(sizes)]), padded(tokens, sizes)
    close = np.where(sizes == SKETCH, CLOSE_SHARE + SAMPLED, CLOSE_SHARE)
    low, todo = np.arange(n), [(np.arange(n), bucket, path)]
    while todo:
        at, bucket, path = todo.pop()
        first, mine = np.unique(low[at], return_index=True, return_inverse=True)[1:]
        if len(first) == 1:
            continue
        few = sizes[at]
        token, own = tokens[segments(edge[at], few)], np.repeat(np.arange(len(at)), few)
        _, which, often = np.unique(token, return_inverse=True, return_counts=True)
        central = np.bincount(own, often[which], len(at)) / np.maximum(few, 1)
        # a set with no token beyond the path has no children, so it comes first
        mine, left = _taken(sketch[at], close[at], first[mine], np.lexsort((at, -central, few > len(path))))
        low = _joined(low, at, at[mine])
        open_ = np.zeros(len(at), bool)
        open_[left] = True
        used = np.flatnonzero(open_[own] & ~np.isin(token, np.array(path, np.uint64)) & _chosen(mix(token ^ mix(bucket + _STEP)), few[own] - len(path)))
        used = used[np.argsort(token[used], kind="stable")]
        token, own = token[used], at[own[used]]
        start = np.flatnonzero(np.concatenate([np.ones(len(token[:1]), bool), token[1:] != token[:-1]]))
        size = np.diff(np.append(start, len(token)))
        leaf = size <= LEAF
        rows = segments(start[leaf], size[leaf])
        further = np.repeat((start + size)[leaf], size[leaf]) - rows - 1
        i, j = own[np.repeat(rows, further)], own[segments(rows + 1, further)]
        pair = np.unique(np.minimum(i, j) * n + np.maximum(i, j))
        low = _joined(low, *_similar(sketch, low, pair // n, pair % n))
        todo += [(own[a : a + k], path_hash(bucket, token[a : a + 1]), [*path, int(token[a])]) for a, k in zip(start[~leaf], size[~leaf], strict=True)]
    return low


def _split(runs: int):
    def run(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """A large bucket: links of sets with similar sketches, a tree for each component, so fewer rows than it has sets."""
        rid = rows.column("rid").to_numpy()
        tokens, sizes = flat(rows.column("sketch"))
        bucket, path = rows.column("bucket").to_numpy()[:1].view(np.uint64), rows.column("path")[0].as_py()
        if path is None:  # the token of which some run makes this bucket
            path = {t for r in range(runs) for t in tokens[: sizes[0]][path_hash(np.full(1, r + 1, np.uint64), tokens[: sizes[0]]) == bucket].tolist()}
        low = _components(tokens, sizes, bucket, [*path])
        linked = np.flatnonzero(low != np.arange(len(low)))
        yield pa.RecordBatch.from_arrays([pa.array(rid[low[linked]], pa.int64()), pa.array(rid[linked], pa.int64())], ["a", "b"])

    return run


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the sketch of one set of their bucket (head_sketch): how near they are to it."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            rows = batch.slice(a, 4096)
            near = share(padded(*flat(rows.column("sketch"))), padded(*flat(rows.column("head_sketch"))))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("bucket", "rid", "path", "loose", "sketch", "head", "loose_before")), pa.array(near)], ["bucket", "rid", "path", "loose", "sketch", "head", "loose_before", "near"])


def _split_huge(rows: DataFrame, runs: int) -> tuple[DataFrame, list[DataFrame]]:
    """The same for buckets beyond one task, one such group at a time: links, and rows of the same or longer paths.

    A bucket whose sets are mostly taken by the group comes again, with a next group; any other one is split.
    """
    heads = rows.where("loose").groupBy("bucket").agg(F.min("rid").alias("head"), F.count(F.lit(1)).alias("loose_before"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("all"))
    heads = heads.join(sizes, "bucket").join(rows.select(F.col("bucket"), F.col("rid").alias("head"), F.col("sketch").alias("head_sketch")), ["bucket", "head"])
    met = spread_join(rows, heads, ["bucket"], "all").drop("all").mapInArrow(_against, "bucket long, rid long, path array<long>, loose boolean, sketch binary, head long, loose_before long, near double")
    met = stored(met.withColumn("taken", (F.col("near") >= SKETCH_SHARE) | (F.col("rid") == F.col("head"))), "huge-buckets")
    left = met.groupBy("bucket").agg(F.sum(F.when(F.col("loose") & ~F.col("taken"), 1).otherwise(0)).alias("left"), F.count(F.lit(1)).alias("all"), F.min("loose_before").alias("before"))
    left = stored(left.where("left > 0").select("bucket", "all", (F.col("left") * 2 > F.col("before")).alias("longer")), "huge-left")
    link = met.where("taken and rid != head").select(F.lit(None).cast("long").alias("bucket"), "rid", F.lit(None).cast("array<long>").alias("path"), F.lit(None).cast("boolean").alias("loose"), "head")
    close = F.when(F.octet_length("sketch") == 4 * SKETCH, CLOSE_SHARE + SAMPLED).otherwise(CLOSE_SHARE)
    after = spread_join(met.where(F.col("near") < close).select("bucket", "rid", "path", "sketch", (F.col("loose") & ~F.col("taken")).alias("loose")), left, ["bucket"], "all")
    again = after.where("not longer").select("bucket", "rid", "path", "loose", F.lit(None).cast("long").alias("head"))

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _children(pa.Table.from_batches([batch]), runs)

    deeper = after.where("longer").select("bucket", "rid", "path", "sketch").mapInArrow(longer, _PATHS_SQL)
    return link.unionByName(again).unionByName(deeper), [met, left]


def common_counts(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of common tokens of all pairs of sets."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    _, token, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[token] > 1
    owner, token = owner[shared], token[shared]
    out = np.zeros((n, n), np.int64)
    if not len(token):
        return out
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for a in range(0, int(token[-1]) + 1, 4096):
        lo, hi = np.searchsorted(token, [a, a + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[owner[lo:hi], token[lo:hi] - a] = 1
        out += np.rint(m @ m.T).astype(np.int64)
    return out


def _together(rid: np.ndarray, link: np.ndarray) -> np.ndarray:
    """The smallest rid that each row's set is linked to; link: symmetric matrix."""
    order = np.argsort(rid, kind="stable")
    i, j = np.nonzero(link[np.ix_(order, order)])
    out = np.empty(len(rid), np.int64)
    out[order] = rid[order][_spread(len(rid), i, j)]
    return out


_EXACT = "rid long, links long, low long"


def _found(rid: np.ndarray, links: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(rid[some], pa.int64()), pa.array(links[some], pa.int64()), pa.array(low[some], pa.int64())], ["rid", "links", "low"])


def _exact(similarity: float):
    def run(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """A component of at most BLOCK sets: each set's exact links, and the first set it is linked to."""
        rid, copies = rows.column("rid").to_numpy(), rows.column("copies").to_numpy()
        tokens, sizes = shingle_sets(rows.column("text").combine_chunks())
        both = common_counts(tokens, sizes)
        link = (both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9) & (both > 0) & ~np.eye(len(rid), dtype=bool)
        yield _found(rid, (link * copies[None, :]).sum(axis=1), _together(rid, link))

    return run


# ---------------------------------------------------------------- large components

_DIFFS = "root long, rid long, copies long, whole long, size long, lacks long, tokens array<long>, step long, size_bin long, lacks_bin long"


def _differences(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """A part of a component, with the text of the set that names it: each set's difference from that set.

    whole: size of that set; lacks: its tokens that are missing; tokens: those and the tokens that it has not.
    Bins round size and lacks up, so that their number does not grow with the texts.
    """
    named = rows.column("centre").to_numpy()
    base, whole = shingle_sets(rows.filter(pa.array(named)).column("text").combine_chunks())
    step = int(max(1, whole[0] // 256))
    rounded = lambda x: -(-x // step) * step
    for batch in rows.filter(pa.array(~named)).to_batches():
        for piece in pieces(batch):
            tokens, sizes = shingle_sets(piece.column("text"))
            n, ends = len(sizes), np.cumsum(sizes)
            lists = [np.setxor1d(base, tokens[e - k : e], assume_unique=True) for e, k in zip(ends, sizes, strict=True)]
            differ = np.array([len(x) for x in lists], np.int64)
            # size = whole - lacks + beyond, differ = lacks + beyond
            lacks = (differ + whole[0] - sizes) // 2
            columns = {
                "root": piece.column("root"), "rid": piece.column("rid"), "copies": piece.column("copies"), "whole": pa.array(np.full(n, whole[0])), "size": pa.array(sizes), "lacks": pa.array(lacks),
                "tokens": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(differ)]), pa.int32()), pa.array(np.concatenate(lists).view(np.int64))),
                "step": pa.array(np.full(n, step)), "size_bin": pa.array(rounded(sizes)), "lacks_bin": pa.array(rounded(lacks)),
            }
            yield pa.RecordBatch.from_pydict(columns)


def decided(whole: int, step: int, size: np.ndarray, lacks: np.ndarray, other_size: np.ndarray, other_lacks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of bins: whether their sets are linked even if their differences share nothing, and whether they cannot be."""
    total = size[:, None] + other_size[None, :]
    least = whole - lacks[:, None] - other_lacks[None, :]
    most = whole + step - np.maximum(lacks[:, None], other_lacks[None, :]) + np.minimum((size + lacks)[:, None], (other_size + other_lacks)[None, :]) - whole
    return (least > 0) & (least >= similarity * (total - least) + 1e-6), most < similarity * (total - 2 * step - most) - 1e-6


_BINS = "root long, size_bin long, lacks_bin long, sure long, self_sure boolean, low long, open boolean"


def _count_bins(similarity: float):
    def run(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """The bins of a component: copies in bins that are surely linked, the first set linked in this way, and whether some pair is open."""
        rows = rows.take(pa.array(np.argsort(rows.column("first").to_numpy(), kind="stable")))
        size, lacks, copies, sets, first = (rows.column(c).to_numpy() for c in ("size_bin", "lacks_bin", "copies", "sets", "first"))
        whole, step, n = rows.column("whole")[0].as_py(), rows.column("step")[0].as_py(), len(size)
        sure, open_, self_sure, low = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool), np.arange(n)
        before = None
        while before is None or (low != before).any():
            before = low.copy()
            for a in range(0, n, 128):
                at = np.arange(a, min(n, a + 128))
                yes, no = decided(whole, step, size[at], lacks[at], size, lacks, similarity)
                self_sure[at] = yes[at - a, at]
                sure[at] = (yes * copies[None, :]).sum(axis=1)
                no[at - a, at] |= sets[at] == 1
                open_[at] = (~yes & ~no).any(axis=1)
                low[at] = np.minimum(low[at], np.where(yes, low[None, :], n).min(axis=1))
        root = np.full(n, rows.column("root")[0].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (root, size, lacks, sure, self_sure, first[low], open_)], ["root", "size_bin", "lacks_bin", "sure", "self_sure", "low", "open"])

    return run


def _compare_open(similarity: float):
    def run(_: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Sets of one block, or of two, of a component: exact links of the pairs that the bins leave open."""
        rid, copies, size, lacks, block = (rows.column(c).to_numpy() for c in ("rid", "copies", "size", "lacks", "block"))
        bins = [rows.column(c).to_numpy() for c in ("size_bin", "lacks_bin")]
        whole, step = rows.column("whole")[0].as_py(), rows.column("step")[0].as_py()
        held = rows.column("tokens").combine_chunks()
        both = whole - lacks[:, None] - lacks[None, :] + common_counts(held.flatten().to_numpy(), held.value_lengths().to_numpy())
        yes, no = decided(whole, step, *bins, *bins, similarity)
        link = (both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9) & (both > 0) & ~yes & ~no
        link &= (block[:, None] != block[None, :]) if block.min() != block.max() else ~np.eye(len(rid), dtype=bool)
        yield _found(rid, (link * copies[None, :]).sum(axis=1), _together(rid, link))

    return run


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (root, rid, ...) dealt into blocks of a root, each row once for every pair of blocks that its own is in."""
    blocks = rows.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    dealt = spread_join(rows, blocks, ["root"], "_n").withColumn("_blocks", F.ceil(F.col("_n") / size).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("_blocks")).cast("int"))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    paired = paired.withColumn("lower", F.least("block", "_other")).withColumn("upper", F.greatest("block", "_other"))
    return paired.drop("_n", "_blocks", "_other")


def _large_links(texts: DataFrame, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """texts: root, rid, n (sets of the component), copies, text. Links of all sets, and the stored tables they are read from."""
    members = texts.withColumn("parts", F.ceil(F.col("n") / DIFF_BLOCK).cast("int"))
    own = members.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).withColumn("centre", F.lit(False))
    centre = members.where("rid = root").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("centre", F.lit(True))
    diffs = stored(grouped(own.unionByName(centre), ["root", "part"], _differences, _DIFFS), "differences")
    bins = diffs.groupBy("root", "size_bin", "lacks_bin").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("sets"), F.min("rid").alias("first"), F.min("whole").alias("whole"), F.min("step").alias("step"))
    bins = stored(grouped(bins, ["root"], _count_bins(similarity), _BINS).join(bins.select("root", "size_bin", "lacks_bin", "sets"), ["root", "size_bin", "lacks_bin"]), "bins")
    binned = spread_join(diffs, bins, ["root", "size_bin", "lacks_bin"], "sets")
    sure = binned.select("rid", (F.col("sure") - F.when(F.col("self_sure"), F.col("copies")).otherwise(0)).alias("links"), "low").where("links > 0")
    left = _blocks(binned.where("open").drop("sets", "sure", "self_sure", "low", "open"), DIFF_BLOCK)
    return sure.unionByName(grouped(left, ["root", "lower", "upper"], _compare_open(similarity), _EXACT)), [diffs, bins]


# ---------------------------------------------------------------- the operator


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, runs: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with class_id (smallest id of the rows linked over any number of links), n_links (other rows at the
    similarity or more), n_copies (other rows with the same set), first_of_class (the row to keep)."""
    runs = runs or runs_for(similarity)
    own = ("class_id", "n_links", "n_copies", "first_of_class")
    keep = [c for c in docs.columns if c not in own and c not in OWN]
    extra = [T.StructField("_rid", T.LongType()), T.StructField("_s1", T.LongType()), T.StructField("_s2", T.LongType()), T.StructField("_size", T.LongType()), T.StructField("_sketch", T.BinaryType())]
    schema = T.StructType([f for f in docs.schema if f.name in keep] + extra)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch, text):
                n = piece.num_rows
                tokens, sizes = shingle_sets(piece.column(piece.schema.get_field_index(text)))
                total = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([mix(tokens), mix(tokens ^ _STEP)], axis=1), axis=0, dtype=np.uint64)])
                edge = np.concatenate([[0], np.cumsum(sizes)])
                sums = (total[edge[1:]] - total[edge[:-1]]).view(np.int64)
                few = np.minimum(sizes, SKETCH)
                small = (tokens[segments(edge[:-1], few)] >> np.uint64(32)).astype(np.uint32).tobytes()
                ends = np.concatenate([[0], np.cumsum(few * 4)]).astype(np.int32)
                sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(small)])
                columns = [piece.column(piece.schema.get_field_index(c)) for c in keep]
                columns += [pa.array(at + np.arange(n)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(sizes, pa.int64()), sketch]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *[f.name for f in extra]])
                at += n

    sets = stored(docs.select(*keep).mapInArrow(prepare, schema), "shingle-sets")
    # classes of equal sets, each with its first row
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_rid").alias("rid"), F.col("_sketch").alias("sketch"))
    classes = sets.where("_size > 0").groupBy("_s1", "_s2", "_size").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    heads = stored(classes.select("_s1", "_s2", "_size", "first.rid", "first.id", "first.sketch", "copies"), "set-heads")

    groups = components(_candidate_links(heads, runs))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = spread_join(groups.withColumnRenamed("node", "rid"), sizes, ["root"], "n").join(heads.select("rid", "copies"), "rid")
    placed = stored(placed.select("rid", "root", "n", "copies"), "candidates")
    # only the candidates' texts are shuffled
    words = sieve(placed, "rid")
    texts = sieved(sets.select(F.col("_rid").alias("rid"), F.col(text).alias("text")), words, "rid").where("_maybe").drop("_maybe").join(placed, "rid")
    exact = stored(grouped(texts.where(F.col("n") <= BLOCK), ["root"], _exact(similarity), _EXACT), "exact-links")
    tables = [exact]
    if not placed.where(F.col("n") > BLOCK).isEmpty():
        large, tables = _large_links(texts.where(F.col("n") > BLOCK), similarity)
        both = stored(exact.unionByName(large), "exact-links")
        discard(exact, *tables)
        exact, tables = both, [both]
    discard(words)

    degree = exact.groupBy("rid").agg(F.sum("links").alias("links"))
    linked = components(exact.select(F.col("low").alias("a"), F.col("rid").alias("b"))).withColumnRenamed("node", "rid")
    linked = linked.join(degree, "rid").join(heads.select("rid", "id"), "rid")
    firsts = linked.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"), F.count(F.lit(1)).alias("n"))
    linked = stored(spread_join(linked, firsts, ["root"], "n").select("rid", "links", "first"), "linked")
    # a class of one row without links needs no mention
    named = heads.join(linked, "rid", "left").where("copies > 1 or links is not null")
    named = stored(named.select("_s1", "_s2", "_size", F.col("copies").alias("_copies"), F.coalesce("links", F.lit(0)).alias("_links"), F.coalesce("first.rid", "rid").alias("_first_rid"), F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("_first_id")), "near-classes")
    discard(heads, placed, linked, *tables)
    rows = sieved(sets.select(*keep, "_rid", "_s1", "_s2", "_size"), sieve(named, "_s1", "_s2"), "_s1", "_s2")
    in_class = spread_join(rows.where("_maybe"), named, ["_s1", "_s2", "_size"], "_copies", "left")
    alone = F.col("_copies").isNull()
    in_class = in_class.select(
        *keep,
        F.when(alone, F.col(key)).otherwise(F.col("_first_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("_links") + F.col("_copies") - 1).alias("n_links"),
        F.when(alone, 0).otherwise(F.col("_copies") - 1).alias("n_copies"),
        (alone | (F.col("_rid") == F.col("_first_rid"))).alias("first_of_class"),
    )
    return rows.where("not _maybe").select(*keep, F.col(key).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"), F.lit(True).alias("first_of_class")).unionByName(in_class)


def _candidate_links(heads: DataFrame, runs: int) -> DataFrame:
    """Links a, b between sets whose sketches are similar and that share a bucket of some depth in some run."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                rows = batch.slice(a, 4096)
                path, owner = first_buckets(*flat(rows.column("sketch")), runs)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), rows.column("rid").take(pa.array(owner))], ["bucket", "rid"])

    sketches = heads.select("rid", "sketch")
    paths = heads.select("sketch", "rid").mapInArrow(first, "bucket long, rid long")
    paths = stored(paths.select("bucket", "rid", F.lit(None).cast("array<long>").alias("path"), F.lit(True).alias("loose")), "paths")
    leaves, links = None, None
    while True:
        sizes = paths.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("least"), F.max("rid").alias("most"), F.bit_xor(F.xxhash64("rid")).alias("members"))
        sizes = stored(sizes.where("n > 1"), "bucket-sizes")
        # small buckets of the same sets are compared once
        small = sizes.where(F.col("n") <= LEAF).groupBy("n", "least", "most", "members").agg(F.min("bucket").alias("bucket"))
        kept = small.select("bucket", "n").unionByName(sizes.where(F.col("n") > LEAF).select("bucket", "n"))
        counted = stored(spread_join(paths, kept, ["bucket"], "n"), "buckets")
        discard(sizes, paths)
        leaf = counted.where(F.col("n") <= LEAF).select("bucket", "rid")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        big = counted.where(F.col("n") > LEAF)
        if big.isEmpty():
            break
        big = big.join(sketches, "rid")
        link = stored(grouped(big.where(F.col("n") <= PART), ["bucket"], _split(runs), "a long, b long"), "bucket-links")
        links = link if links is None else links.unionByName(link)
        if counted.where(F.col("n") > PART).isEmpty():
            break
        huge = stored(big.where(F.col("n") > PART).drop("n"), "huge")
        more, read = _split_huge(huge, runs)
        split = stored(more, "split-buckets")
        discard(huge, *read)
        links = links.unionByName(split.where("head is not null").select(F.col("head").alias("a"), F.col("rid").alias("b")))
        paths = stored(split.where("head is null").drop("head"), "paths")
    found = leaves.join(sketches, "rid").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_leaf_links, "a long, b long")
    return found if links is None else found.unionByName(links)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all whole texts of documents: each one's class and number of links."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_copies")


OP2_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9::DOUBLE),
edges AS (SELECT a, b, same FROM links UNION ALL SELECT b, a, same FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b),
classes AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n_links, count_if(same)::BIGINT AS n_copies FROM edges GROUP BY a)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 0) AS n_copies
FROM documents d JOIN classes ON node = d.doc_id LEFT JOIN counts ON counts.a = d.doc_id
"""
