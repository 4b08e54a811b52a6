"""SimHash groups, line dedup and decontamination against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, decontamination, line_dedup, simhash_dedup

DATA = "/root/testdata/sf0.001"


def plain_print(text: str | None, width: int = 4) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[root(a)] = root(b)
    return [root(k) for k in range(n)]


def test_simhash_groups_of_the_table(spark):
    docs = common.table(spark, DATA, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.op5_simhash_near_dedup(spark, DATA).collect()}
    ids = sorted(texts)
    fps = [plain_print(texts[d]) for d in ids]
    assert {d: got[d][0] for d in ids} == {d: f"{f:016x}" for d, f in zip(ids, fps)}
    links = [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    roots = components(len(ids), links)
    least = {}
    for d, r in zip(ids, roots):
        least[r] = min(d, least.get(r, d))
    assert {d: got[d][1] for d in ids} == {d: least[r] for d, r in zip(ids, roots)}


@pytest.mark.parametrize("buckets", [1, 8, 256])
def test_every_pair_within_the_radius_is_connected(buckets):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:20]:
        for k in (1, 2, 3, 4, 5):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), k)))
    plan = simhash_dedup.EXACT
    import pyarrow as pa

    batch = pa.record_batch({"fp": pa.array([f.to_bytes(8, "big") for f in fps], pa.binary())})
    sent = {}
    for out in simhash_dedup.emit_batches(plan, buckets)(iter([batch])):
        for b, p in zip(out.column("bucket").to_pylist(), out.column("fps").to_pylist()):
            sent.setdefault(b, []).append(p)
    at = {f: k for k, f in enumerate(fps)}
    found = []
    for b, p in sent.items():
        x, y = simhash_dedup.collide(b, p, plan, buckets)
        found += [(at[int(i)], at[int(j)]) for i, j in zip(x.ravel(), y.ravel())]
    assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in found)
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    got = components(len(fps), found)
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_one_of_each_finds_near_copies_and_leaves_others(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5000)]
    texts = [[rng.choice(words) for _ in range(rng.randint(60, 300))] for _ in range(60)]
    rows, near = [], set()
    for k, t in enumerate(texts):
        rows.append((k, " ".join(t)))
        if k % 3 == 0:
            copy = list(t)
            copy[rng.randrange(5, len(copy) - 5)] = "changed"  # five shingles of sixty or more
            rows.append((1000 + k, " ".join(copy)))
            near.add(1000 + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash_dedup.one_of_each(docs).collect()}
    assert set(range(60)) <= kept
    assert len(near & kept) <= 1


def shingles(text: str, width: int = 5) -> set[tuple[str, ...]]:
    w = text.lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(words: list[str], rng: random.Random, least: float, most: float) -> list[str]:
    """A copy whose shingle similarity lies between the two."""
    while True:
        copy = list(words)
        for _ in range(rng.randint(1, max(2, len(words) // 25))):
            copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            got = jaccard(shingles(" ".join(words)), shingles(" ".join(copy)))
            if least <= got <= most:
                return copy
            if got < least:
                break


def test_near_copies_by_exact_similarity(spark):
    """Groups are those of the links at 0.8 and more, but for the few pairs close to the bound that never collide."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    texts, close = [], []
    for k in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(80, 250))]
        texts.append(text)
        if k < 100:
            close.append((len(texts) - 1, len(texts)))
            texts.append(edited(text, rng, 0.8, 0.84))
        elif k < 130:
            texts.append(edited(text, rng, 0.72, 0.79))
    for _ in range(3):  # chains: each similar to the next alone, so that no single middle settles them
        text = [rng.choice(words) for _ in range(300)]
        for _ in range(8):
            texts.append(text)
            text = edited(text, rng, 0.85, 0.9)
    sets = [shingles(" ".join(t)) for t in texts]
    want = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r["component_id"] for r in simhash_dedup.groups(docs, simhash_dedup.SIMILAR).collect()}
    got = [rows[k] for k in range(len(texts))]
    assert all(want[k] == want[got[k]] for k in range(len(texts)))  # nothing below 0.8 is linked
    assert sum(got[i] == got[j] for i, j in close) >= 0.95 * len(close)
    assert all(got[k] == got[len(texts) - 24 + 8 * c] for c in range(3) for k in range(len(texts) - 24 + 8 * c, len(texts) - 16 + 8 * c))


def test_all_candidates_between_pieces_are_found():
    rng = np.random.default_rng(4)
    plan = simhash_dedup.SIMILAR
    base = rng.integers(0, 2**63, (4, plan.size), dtype=np.uint64)
    fps = np.concatenate([base[k] ^ np.array([[np.uint64(1) << np.uint64(rng.integers(0, 64)) for _ in range(plan.size)] for _ in range(30)], np.uint64) for k in range(4)])
    piece = rng.integers(0, 3, len(fps)).astype(np.uint64)
    buckets, found = 8, set()
    at = {x.tobytes(): k for k, x in enumerate(fps)}
    masks = simhash_dedup.linear_hash(simhash_dedup.flips(plan.half, 24), buckets)
    for t, table in enumerate(plan.tables):
        own = simhash_dedup.linear_hash(simhash_dedup.part(fps, table), buckets)
        for b in range(buckets):
            here = np.flatnonzero([b in o ^ masks for o in own])
            a, c = simhash_dedup.collide_between(t * buckets + b, [np.column_stack((fps, piece))[here].tobytes()], plan, buckets)
            found |= {tuple(sorted((at[x.tobytes()], at[y.tobytes()]))) for x, y in zip(a, c)}
    parts = [simhash_dedup.part(fps, table) for table in plan.tables]
    want = {(i, j) for j in range(len(fps)) for i in range(j) if piece[i] != piece[j] and any(int(p[i] ^ p[j]).bit_count() <= 2 for p in parts) and np.bitwise_count(fps[i] ^ fps[j]).sum() <= plan.most and fps[i].tobytes() != fps[j].tobytes()}
    assert found == want and want


def test_simhash_takes_awkward_rows(spark, awkward, empty):
    got = simhash_dedup.groups(awkward).collect()
    assert len(got) == awkward.count()
    zero = {r["component_id"] for r in got if int.from_bytes(r["fp"], "big") == 0}
    assert zero == {2}
    kept = simhash_dedup.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() < awkward.count()
    assert simhash_dedup.groups(empty).count() == 0 and simhash_dedup.one_of_each(empty).count() == 0


def plain_removed(rows: list[tuple[int, str]], t: float = 0.8) -> set[tuple[int, int]]:
    sets = []
    for d, text in sorted(rows):
        for k, line in enumerate((text or "").split("\n")):
            w = frozenset(line.lower().split())
            if len(w) >= line_dedup.LEAST_WORDS:
                sets.append(((d, k), w))
    return {p for i, (p, w) in enumerate(sets) if any(len(w & x) >= t * len(w | x) - 1e-9 for _, x in sets[:i])}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_plain_version(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 25))] for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    got = line_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc"], r["no"]) for r in got} == plain_removed(rows)
    for r in got:
        a = set(dict(rows)[r["doc"]].split("\n")[r["no"]].lower().split())
        b = set(dict(rows)[r["earlier"]["doc"]].split("\n")[r["earlier"]["no"]].lower().split())
        assert len(a & b) >= 0.8 * len(a | b) - 1e-9 and (r["earlier"]["doc"], r["earlier"]["no"]) < (r["doc"], r["no"])
    # lines whose tried leader fails are joined with all others: the same result with one shared leader for all
    shared = [(0, "a b c d e f g h i j"), (1, "a b c d e f g h x y"), (2, "a b c d e f g h x z"), (3, "a b c d e f g h i k")]
    got = line_dedup.removed(spark.createDataFrame(shared, "doc_id long, text string")).collect()
    assert {(r["doc"], r["no"]) for r in got} == plain_removed(shared)


def test_short_lines_are_lines(spark):
    rows = [(1, "menu\n\nAll rights reserved.\nto be or not"), (2, "Menu\n\nall rights reserved.\nall rights"), (3, "a b c d\nmenu menu\n \nrights all"), (4, "a b c d e\na b c\nb a")]
    got = line_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc"], r["no"]): (r["earlier"]["doc"], r["earlier"]["no"], r["similarity"]) for r in got} == {(2, 0): (1, 0, 1.0), (2, 2): (1, 2, 1.0), (3, 1): (1, 0, 1.0), (3, 3): (2, 3, 1.0), (4, 0): (3, 0, 0.8)}


def test_descriptions_of_plans_stay_short(spark):
    """The driver keeps a description of each query, so none may spell a table out: the levels took half a million digits."""
    docs = common.table(spark, DATA, "documents")
    places = spark.createDataFrame([(1, 2)], "doc long, h long")
    for df in (line_dedup.described(docs, 0.8), line_dedup.texts_of(docs).where(line_dedup.among(places))):
        assert len(df._jdf.queryExecution().toString()) < 100_000


def test_components_make_no_broadcast(spark):
    """Of small edges too: each broadcast leaves a table and a thread with the driver, and there are two joins a round."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40, 2)] + [(1, 2)], "a long, b long")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    found = {r["node"]: r["root"] for r in common.components(edges, "test").collect()}
    assert found[3] == found[0] == 0 and found[5] == 4 and len(found) == 40
    plans = [store.execution(k).get().physicalPlanDescription() for k in range(before, store.executionsCount()) if store.execution(k).isDefined()]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_line_dedup_takes_awkward_rows(spark, awkward, empty):
    out = line_dedup.deduplicated(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    texts = [r[1] for r in out.collect()]
    # the later of two equal lines goes; rows equal in id and text stay alike
    assert texts.count("") == 1 + 2 and "Released under the MIT License.\nthe same line stands here twice over\nend" in texts
    assert line_dedup.deduplicated(empty).count() == 0 and line_dedup.removed(empty).count() == 0


def plain_leaks(docs, items):
    """(doc, item) → best similarity over all windows, by tuples of words: weights by the number of different items."""
    lists = {i: tuple(t.lower().split()) for i, t in items if t and len(t.split()) >= 5}
    tuples = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    held = Counter(s for w in set(lists.values()) for s in tuples(w).keys())
    out = {}
    for d, text in docs:
        w = text.lower().split()
        for i, own in lists.items():
            item = tuples(own)
            other = sum(n / held[s] for s, n in item.items()) / sum(item.values())
            for at in range(max(1, len(w) - len(own) + 1)):
                window = tuples(w[at : at + len(own)])
                low = sum(min(n, window[s]) / held[s] for s, n in item.items())
                high = sum(max(n, window[s]) / held[s] for s, n in item.items()) + other * sum(n for s, n in window.items() if s not in item)
                if low >= high * 0.8 - 1e-9:
                    out[d, i] = max(out.get((d, i), 0.0), low / high)
    return out


@pytest.mark.parametrize("words_a_block", [150, 2_000_000])
def test_leaks_plain_version(spark, monkeypatch, words_a_block):
    monkeypatch.setattr(decontamination, "WORDS_A_BLOCK", words_a_block)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(6, 40)))) for k in range(25)] + [(90, "only four words here"), (91, None)]
    template = " ".join(rng.choice(words) for _ in range(20))
    items += [(100 + k, f"{template} {rng.choice(words)} {' '.join(rng.choice(words) for _ in range(14))}") for k in range(8)]
    items += [(200 + k, items[0][1]) for k in range(10)]  # one item that stands eleven times
    docs = []
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            own = rng.choice(items[:25] + items[27:]).__getitem__(1).split()
            for _ in range(rng.choice((0, 0, 0, 1))):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = own
        docs.append((d, " ".join(text).title()))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_leaks(docs, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and got


def test_an_edited_copy_of_a_repeated_item_is_found(spark):
    rng = random.Random(8)
    own = [f"w{rng.randrange(10**9)}" for _ in range(60)]
    items = spark.createDataFrame([(k, " ".join(own)) for k in range(10)], "item_id long, text string")
    own[30] = "changed"
    got = decontamination.leaks(spark.createDataFrame([(1, "before it " + " ".join(own) + " after it")], "doc_id long, text string"), items).collect()
    assert {r["item_id"] for r in got} == set(range(10)) and all(abs(r["similarity"] - 51 / 61) < 1e-9 and r["first_word"] == 2 for r in got)


def index_of(items):
    hashes = decontamination.Hashes()
    return decontamination.Index([([k], len(w), decontamination.shingle_keys(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)))) for k, w in items], {})


def test_all_fingerprints_within_the_radius_are_found():
    rng = random.Random(1)
    index = index_of([(k, [f"a{rng.random()}" for _ in range(20)]) for k in range(50)])
    for k in range(50):
        other = index.prints[k].copy()
        for b in rng.sample(range(128), decontamination.RADIUS):
            other[b // 16] ^= np.uint16(1 << b % 16)
        assert k in index.within(other[None, :], 0)[1]


def test_the_index_asks_for_few_of_many_items():
    rng = np.random.default_rng(2)
    index = index_of([(k, [f"a{x}" for x in rng.integers(0, 10**9, 12 + k % 50)]) for k in range(20_000)])
    asked = decontamination.packed(rng.normal(size=(50, 128)))
    seen = 0
    for b, (values, _) in enumerate(index.blocks):
        probes = (7 << 16 | asked[:, b].astype(np.int64)[:, None] ^ decontamination.flips(decontamination.ASKED)[None, :]).ravel()
        seen += (np.searchsorted(values, probes, "right") - np.searchsorted(values, probes, "left")).sum()
    assert 0 < seen / 50 < 0.01 * 20_000 and len(index.within(asked, 7)[0]) == 0


def test_leaks_take_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(1, "a text without an id but with words"), (None, "the same line stands here twice over")], "item_id long, text string")
    got = decontamination.leaks(awkward, items).collect()
    assert sorted(str((r["doc_id"], r["item_id"])) for r in got) == sorted(map(str, [(None, 1), (1, None), (6, None), (6, None)]))
    kept = decontamination.clean(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(empty, items).count() == 0 and decontamination.leaks(awkward, none).count() == 0
    assert decontamination.clean(awkward, none).count() == awkward.count()


def test_fingerprint_bits():
    h = [0b1, 0b1, 0b11]
    assert simhash_dedup.majority(h, [3, 0]).ravel().tolist() == [1, 0]
    assert np.array_equal(simhash_dedup.linear_hash(np.array([5 ^ 9], np.uint64), 64), simhash_dedup.linear_hash(np.array([5], np.uint64), 64) ^ simhash_dedup.linear_hash(np.array([9], np.uint64), 64))
