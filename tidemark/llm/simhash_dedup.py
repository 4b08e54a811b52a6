"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two values that differ in at most `radius` bits have a common variant within half that radius of either, so every
fingerprint emits all its variants and fingerprints that share one are compared. The shuffle on variants goes by a hash of
the variant that is linear over GF(2): the variants of a fingerprint that fall into a bucket then follow from the
fingerprint and the bucket's number, and the shuffle carries the fingerprint once for each bucket instead of 2,081
variants. The number of buckets grows with the fingerprints, so the variants held by one task stay bounded.

A plan says which bits are hashed so. EXACT hashes all 64 bits with radius 4, which finds every pair at 4 or fewer
differing bits. SIMILAR is for shingle similarities of 0.8 and more, at which a sixth of all bits differ: of 256 bits over
the distinct shingles sixteen ranges of 24 bits are hashed with radius 2, pairs that meet in any range and differ in at most
60 bits are candidates, and a candidate is a link only if the exact Jaccard similarity of the two shingle sets reaches the
bound. At a similarity of exactly 0.8 a pair becomes a candidate with probability 0.98, at 0.85 with 0.997 (simulated over
independent bits; a test measures it). By chance a fingerprint meets 3 in 10,000 others, a comparison of 32 bytes each; a
corpus of over 10^9 texts wants a plan with longer ranges.

A large group of near copies isn't compared pair by pair. First each fingerprint is compared with the middle one of those it
is connected with in a bucket, and with the one that connected it. Only where a connected group comes out in several pieces
all its remaining candidate pairs between pieces are compared, so no candidate is lost.

Defined cases. A null or empty text and one without words has fingerprint zero and is linked like any other; texts with
fewer words than a shingle have one shingle, the whole sequence; texts with equal fingerprints are linked. Very long texts
are taken whole. Rows with equal or null ids stay separate rows; a null id
takes part in linking but is never a component's id, which is null where a component has no other. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42


@dataclass(frozen=True)
class Plan:
    """Words of a shingle; 64-bit words of a fingerprint; the bit ranges (word, first bit, bits) whose variants are hashed
    and their radius; differing bits of a whole fingerprint at which two are linked, or candidates where links need a
    Jaccard similarity of distinct shingles."""

    shingle: int
    size: int
    tables: tuple[tuple[int, int, int], ...]
    radius: int
    most: int
    similarity: float | None = None

    @property
    def half(self) -> int:
        return (self.radius + 1) // 2

    @property
    def whole(self) -> bool:
        """Sharing a variant is proof enough."""
        return self.tables == ((0, 0, 64),) and self.size == 1 and 2 * self.half <= self.most


EXACT = Plan(shingle=4, size=1, tables=((0, 0, 64),), radius=4, most=4)
SIMILAR = Plan(shingle=5, size=4, tables=tuple((word, first, 24) for word in range(4) for first in (0, 13, 27, 40)), radius=2, most=60, similarity=0.8)
#: Variants that one task holds at a time, on average: 8 bytes each, and as many again for their order.
VARIANTS_A_TASK = 6_000_000
#: Least number of buckets over all tables, so that small inputs use all cores too.
LEAST_BUCKETS = 128
#: Shingles whose bits are counted at a time.
SHINGLES_AT_ONCE = 200_000
#: Candidate pairs whose shingles meet at a time: what a round shuffles stays bounded.
PAIRS_A_ROUND = 200_000


def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """XXH64 of each shingle of `width` words, space-joined; of all words where there are fewer; none without words."""
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: list[int], counts: list[int], size: int = 1) -> np.ndarray:
    """A fingerprint of `size` words for each run of `counts` hashes: a bit is 1 if it is set in over half of them.

    The first word is over the hashes themselves, the others over remixed ones."""
    out = np.zeros((len(counts), size), np.uint64)
    if not hashes:
        return out
    n, h = np.array(counts, np.int64), np.array(hashes, np.uint64)
    some = np.flatnonzero(n)
    for k in range(size):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some, k] = np.packbits(2 * sums > n[some, None], axis=1).view(">u8").ravel().astype(np.uint64)
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return out


def fingerprint_batches(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hashes, counts = [], [], []
            for text in batch.column("text"):
                got = shingle_hashes((text.as_py() or b"").lower().split(), plan.shingle)
                if plan.similarity is not None:
                    got = set(got)
                hashes += got
                counts.append(len(got))
                if len(hashes) > SHINGLES_AT_ONCE:
                    found.append(majority(hashes, counts, plan.size))
                    hashes, counts = [], []
            found.append(majority(hashes, counts, plan.size))
            fps = np.concatenate(found).astype(">u8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([x.tobytes() for x in fps], pa.binary())], ["doc_id", "h", "fp"])

    return run


def fingerprints(docs: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """(doc_id, h, fp): the SimHash of each text's word shingles, big-endian; h tells apart texts of one id."""
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(fingerprint_batches(plan), "doc_id long, h long, fp binary")


@cache
def flips(half: int, bits: int) -> np.ndarray:
    """All masks of at most `half` of the lowest `bits` bits."""
    return np.array([sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(bits), k)], np.uint64)


@cache
def codes() -> np.ndarray:
    """For each byte of a value and each value of it, what it adds to the linear hash."""
    of_bit = np.random.default_rng(SEED).integers(0, 1 << 31, 64, dtype=np.int64)
    values = np.arange(256)
    return np.stack([np.bitwise_xor.reduce(np.where((values[:, None] >> np.arange(8)) & 1, of_bit[8 * k : 8 * k + 8], 0), axis=1) for k in range(8)])


def linear_hash(x: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each value; buckets is a power of two, and hash(x ^ y) = hash(x) ^ hash(y)."""
    each = x.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.bitwise_xor.reduce(np.stack([codes()[k][each[:, k]] for k in range(8)]), axis=0) & (buckets - 1)


def part(fps: np.ndarray, table: tuple[int, int, int]) -> np.ndarray:
    word, first, bits = table
    return fps[:, word] >> np.uint64(first) & np.uint64((1 << bits) - 1)


def emit_batches(plan: Plan, buckets: int, labelled: bool = False):
    """For each batch, table and bucket one row with the fingerprints that have a variant there, packed, each with its piece
    where they are labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, plan.size)
            if not len(fps):
                continue
            sent = np.column_stack((fps, batch.column("piece").to_numpy().astype(np.uint64))) if labelled else fps
            for t, table in enumerate(plan.tables):
                steps = np.unique(linear_hash(flips(plan.half, table[2]), buckets))
                to = (linear_hash(part(fps, table), buckets)[:, None] ^ steps[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                values, starts = np.unique(to[order], return_index=True)
                rows = order // len(steps)
                packed = [sent[x].tobytes() for x in np.split(rows, starts[1:])]
                for k in range(0, len(values), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(t * buckets + values[k : k + 256]), pa.array(packed[k : k + 256], pa.binary())], ["bucket", "fps"])

    return run


class Forest:
    """Components of what has been joined so far, and the edges that joined them."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: tuple[list[int], list[int]] = ([], [])

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.edges[0].append(x)
                self.edges[1].append(y)


def differing(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64)


def meetings(bucket: int, fps: np.ndarray, plan: Plan, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each shared variant of this bucket in turn the fingerprints that have it: their places, and where the run of the
    variant starts."""
    table, bucket = plan.tables[bucket // buckets], bucket % buckets
    masks, own_part = flips(plan.half, table[2]), part(fps, table)
    step = linear_hash(masks, buckets)
    need = linear_hash(own_part, buckets) ^ bucket
    by_step, by_need = np.argsort(step, kind="stable"), np.argsort(need, kind="stable")
    step, need = step[by_step], need[by_need]
    values, at = np.unique(need, return_index=True)
    ends = np.append(at[1:], len(need))
    lo, hi = np.searchsorted(step, values, "left"), np.searchsorted(step, values, "right")
    variants, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b, c, d in zip(at, ends, lo, hi, strict=True):
        if d > c:
            own = by_need[a:b]
            variants.append((own_part[own][:, None] ^ masks[by_step[c:d]][None, :]).ravel())
            owners.append(np.repeat(own, d - c))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    new = np.ones(len(variant), bool)
    new[1:] = variant[1:] != variant[:-1]
    return owner, np.maximum.accumulate(np.where(new, np.arange(len(variant)), 0))


def middle(fps: np.ndarray, members: np.ndarray) -> int:
    """The member nearest to the majority of each bit."""
    bits = np.unpackbits(fps[members].astype(">u8").view(np.uint8).reshape(len(members), -1), axis=1)
    return int(members[np.argmin((bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(members))).sum(axis=1))])


def collide(bucket: int, packed: list[bytes], plan: Plan, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among the fingerprints whose variants share this bucket.

    Each shared variant links its fingerprints in a star. Where sharing is proof any two of them are within the radius, so
    the star loses nothing; else the star's pairs are verified, and of a variant whose fingerprints the star leaves in
    several components all pairs between components are. Where links are only candidates the middle of each component is
    paired with all others too."""
    fps = np.unique(np.frombuffer(b"".join(packed), np.uint64).reshape(-1, plan.size), axis=0)
    owner, first = meetings(bucket, fps, plan, buckets)
    at = np.flatnonzero(first != np.arange(len(first)))
    pair = np.unique(np.minimum(owner[first[at]], owner[at]) * len(fps) + np.maximum(owner[first[at]], owner[at]))
    a, b = pair // max(1, len(fps)), pair % max(1, len(fps))
    near = differing(fps, a, b) <= plan.most
    forest = Forest()
    forest.join(a[near], b[near])
    if not plan.whole:
        starts, sizes = np.unique(first[at], return_counts=True)
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            members = owner[s : s + n + 1]
            for k in range(1, len(members)):
                roots = np.array([forest.root(x) for x in members.tolist()])
                if (roots == roots[0]).all():
                    break
                others = members[k + 1 :][roots[k + 1 :] != roots[k]]
                mine = np.full(len(others), members[k])
                good = differing(fps, mine, others) <= plan.most
                forest.join(mine[good], others[good])
    left, right = forest.edges
    if plan.similarity is not None and left:
        nodes = np.unique(left + right)
        roots = np.array([forest.root(x) for x in nodes.tolist()])
        by_root = np.argsort(roots, kind="stable")
        for members in np.split(nodes[by_root], np.flatnonzero(np.diff(roots[by_root])) + 1):
            if len(members) > 2:
                centre, others = middle(fps, members), members.tolist()
                left += [centre] * len(others)
                right += others
    return fps[left], fps[right]


def collide_between(bucket: int, packed: list[bytes], plan: Plan, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All candidate pairs of this bucket between fingerprints of different pieces; a piece's label follows the fingerprint."""
    rows = np.unique(np.frombuffer(b"".join(packed), np.uint64).reshape(-1, plan.size + 1), axis=0)
    fps, label = np.ascontiguousarray(rows[:, : plan.size]), rows[:, plan.size]
    owner, first = meetings(bucket, fps, plan, buckets)
    found, ahead, at = np.zeros(0, np.int64), 1, np.arange(len(owner))
    while True:
        at = at[at + ahead < len(owner)]
        at = at[first[at] == first[at + ahead]]
        if not len(at):
            return fps[found // max(1, len(fps))], fps[found % max(1, len(fps))]
        a, b = owner[at], owner[at + ahead]
        apart = label[a] != label[b]
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        pair = np.setdiff1d(a * len(fps) + b, found)
        found = np.union1d(found, pair[differing(fps, pair // len(fps), pair % len(fps)) <= plan.most])
        ahead += 1


def links(distinct: DataFrame, n: int, plan: Plan = EXACT, between: bool = False) -> DataFrame:
    """(a, b): links, or candidates, between the n distinct fingerprints in column fp that connect all that the plan links.

    between: all candidates between those that differ in the long `piece`."""
    variants = n * max(len(flips(plan.half, table[2])) for table in plan.tables)
    buckets = max(LEAST_BUCKETS // len(plan.tables), 1 << max(0, int(np.ceil(np.log2(max(1, variants / VARIANTS_A_TASK))))))
    sent = distinct.select("fp", *(["piece"] if between else [])).mapInArrow(emit_batches(plan, buckets, between), "bucket long, fps binary")
    meet = collide_between if between else collide

    def of_bucket(key, group):  # without hints: Spark tells the kind by the arguments
        found = [x.astype(">u8") for x in meet(key[0].as_py(), group.column("fps").to_pylist(), plan, buckets)]
        return pa.table({c: pa.array([y.tobytes() for y in x], pa.binary()) for c, x in zip("ab", found, strict=True)})

    return sent.groupBy("bucket").applyInArrow(of_bucket, "a binary, b binary")


def shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes((t.as_py() or b"").lower().split(), width), np.uint64)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.binary())], ["fp", "shingles"])

    return run


def similar_pairs(similarity: float):
    """Keeps the pairs whose shingle sets reach the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 else 0
                good.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the plan's similarity; sets: (fp, shingles). Pairs meet the sets in rounds."""
    rounds, found = max(1, -(-pairs.count() // PAIRS_A_ROUND)), None
    for k in range(rounds):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k)
        two = some.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
        good = common.stored(two.select("a", "b", "x", "y").mapInArrow(similar_pairs(plan.similarity), "a binary, b binary"), "simhash-similar")
        found = good if found is None else found.unionByName(good)
    return found


def similar_links(docs: DataFrame, distinct: DataFrame, n: int, plan: Plan) -> DataFrame:
    """(a, b): verified links that connect all verified candidates. distinct: (fp, doc, h), with a text of each fingerprint."""
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    tried = common.stored(ordered(links(distinct, n, plan)), "simhash-candidates")
    wanted = tried.select(F.col("a").alias("fp")).unionAll(tried.select("b")).distinct().join(distinct, "fp")
    texts = common.only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("binary").alias("text"))
    own = texts.join(wanted, ["doc", "h"]).select("fp", "text").mapInArrow(shingle_sets(plan.shingle), "fp binary, shingles binary")
    sets = common.stored(own.groupBy("fp").agg(F.first("shingles").alias("shingles")), "simhash-shingles")
    found = verified(tried, sets, plan)
    # groups of candidates that came out in several pieces
    group = common.components(tried, "simhash-groups").select(F.col("node").alias("fp"), F.col("root").alias("group"))
    piece = common.components(found, "simhash-pieces").select(F.col("node").alias("fp"), F.col("root").alias("piece"))
    labelled = group.join(piece, "fp", "left").select("fp", "group", F.xxhash64(F.coalesce("piece", "fp")).alias("piece"))
    labelled = common.stored(labelled, "simhash-labels")
    several = labelled.groupBy("group").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low <> high").select("group")
    left = common.stored(labelled.join(several, "group", "left_semi").select("fp", "piece"), "simhash-left")
    n_left = left.count()
    if not n_left:
        return found
    more = common.stored(ordered(links(left, n_left, plan, between=True)).join(tried, ["a", "b"], "left_anti"), "simhash-between")
    return found.unionByName(verified(more, sets, plan))


def groups(docs: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """(doc_id, h, fp, component_id) for each document: component_id is the smallest id of the documents that a chain of
    links reaches. Fingerprints are written once; copies meet as one fingerprint before anything is linked."""
    rows = common.stored(fingerprints(docs, plan), "simhash-fingerprints")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "h")).alias("first")
    distinct = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), first).select("fp", "least", "first.*"), "simhash-distinct")
    n = distinct.count()
    edges = links(distinct, n, plan) if plan.similarity is None else similar_links(docs, distinct, n, plan)
    roots = common.components(edges, "simhash-links")
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = common.stored(of, "simhash-roots")
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "h", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, plan: Plan = SIMILAR) -> DataFrame:
    """The documents with all their columns, of each group the one with the smallest id (and hash of its text) alone."""
    found = groups(docs, plan)
    null_last = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    kept = found.groupBy("root").agg(F.min(F.struct(null_last.alias("doc"), "h")).alias("k")).select("k.*")
    kept = common.stored(kept, "simhash-kept")
    common.release(docs.sparkSession)
    plain, names = common.renamed(docs)
    doc, text = common.place(names, "doc_id"), common.place(names, "text")
    keyed = plain.withColumns({"doc": F.coalesce(F.col(doc).cast("long"), F.lit(2**63 - 1)), "h": F.xxhash64(F.col(text).cast("string"))})
    # rows equal in id and text have come together for the join, so that dropping repeats takes no further shuffle
    return common.restored(keyed.join(kept, ["doc", "h"], "left_semi").dropDuplicates(["doc", "h"]), names)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
