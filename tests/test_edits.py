"""Edits against a plain version that keeps a whole copy of each state."""

from __future__ import annotations

import copy
import json
import random

from tidemark.operators import edits

SCHEMA = "key long, id {}, body string"


def plain(segments, documents, variants, log):
    """States as whole copies; restoring takes the copy."""
    state = {"cuts": {s: set() for s in segments}, "docs": copy.deepcopy(documents), "keep": copy.deepcopy(variants)}
    states, told = [copy.deepcopy(state)], []

    def parts(s):
        words = segments[s]["words"]
        at = [0, *sorted(state["cuts"][s]), len(words)]
        return [(s if a == 0 else 1_000_000 + 1000 * s + a, segments[s]["start"] if a == 0 else words[a][0], a, b) for a, b in zip(at, at[1:])]

    def kept(x, mid):
        return (not isinstance(x, str) and x == mid) or (isinstance(x, str) and x.split("/")[0] == str(mid))

    def zero(x):
        return max(0.0, x)

    for e in log:
        done = False
        where = [(s, parts(s), k) for s in segments for k, p in enumerate(parts(s)) if p[0] == e.get("id")]
        if e["op"] == "restore":
            done = 0 <= e["to"] < len(states)
            state = copy.deepcopy(states[e["to"]]) if done else state
        elif e["op"] == "split" and where and where[0][1][where[0][2]][3] - where[0][1][where[0][2]][2] > 1:
            s, ps, k = where[0]
            mid, start, a, b = ps[k]
            base, words = zero(start - 0.05), segments[s]["words"]
            best = sorted(range(a + 1, b), key=lambda w: (abs(words[w][0] - (base + e["t"])), w))[0]
            state["cuts"][s].add(best)
            second, cut, dt = 1_000_000 + 1000 * s + best, words[best][0] - base, zero(words[best][0] - 0.05) - base
            d = state["docs"].get(mid)
            if d:
                new = {"rush": d.get("rush")}
                for name in ("sfx", "vfx"):
                    if isinstance(d.get(name), list):
                        at = [(x["at"] if isinstance(x, dict) else 0.0, x) for x in d[name]]
                        new[name] = [x | {"at": round(zero(y - dt), 3)} if isinstance(x, dict) else x for y, x in at if y >= cut]
                        d[name] = [x | {"at": round(y, 3)} if isinstance(x, dict) else x for y, x in at if y < cut]
                moved = len(new) > 1
                out = (d.get("trim") or {}).get("out")
                if d.get("trim"):
                    first = d["trim"].get("in")
                    d["trim"] = {"in": round(first, 2), "out": None} if first is not None and first < cut else None
                d["text"] = d["alts"] = None
                if d.get("focus"):
                    new["focus"] = d["focus"]
                if out is not None and out - dt > 0:
                    new["trim"] = {"in": None, "out": round(out - dt, 2)}
                if moved or len(new) > 1:
                    state["docs"][second] = new
            for keep in state["keep"].values():
                if any(kept(x, mid) for x in keep) and second not in keep:
                    keep.append(second)
            done = True
        elif e["op"] == "unsplit" and where and where[0][2] > 0:
            s, ps, k = where[0]
            mid, start, a, _ = ps[k]
            pid, before, *_ = ps[k - 1]
            state["cuts"][s].discard(a)
            dt = zero(start - 0.05) - zero(before - 0.05)
            dp, dm = copy.deepcopy(state["docs"].get(pid, {})), state["docs"].get(mid, {})
            for name in ("sfx", "vfx"):
                if isinstance(dm.get(name), list):
                    dp[name] = (dp.get(name) or []) + [x | {"at": round(zero(x["at"] + dt), 3)} if isinstance(x, dict) else x for x in dm[name]]
            if dp.get("rush") or dm.get("rush"):
                first, out = (dp.get("trim") or {}).get("in"), (dm.get("trim") or {}).get("out")
                dp |= {"rush": dp.get("rush") or dm.get("rush"), "text": None, "alts": None}
                dp["trim"] = None if first is None and out is None else {"in": None if first is None else round(first, 2), "out": None if out is None else round(zero(out + dt), 2)}
                state["docs"][pid] = dp
            for v, keep in state["keep"].items():
                add = any(kept(x, mid) for x in keep) and not any(kept(x, pid) for x in keep)
                state["keep"][v] = [x for x in keep if not kept(x, mid)] + ([pid] if add else [])
            done = True
        told.append(done)
        states.append(copy.deepcopy(state))
    return state, told, parts


def recording(rng):
    segments, t = {}, 0.0
    for s in range(1, 4):
        words, start = [], t
        for _ in range(rng.randrange(1, 9)):
            words.append([round(t, 2), round(t + 0.25, 2)])
            t += rng.choice([0.3, 0.5])
        segments[s] = {"start": round(start, 2), "end": round(t, 2), "words": words}
        t += 1.0
    effect = lambda: rng.choice([{"at": round(rng.random() * 3, 2), "name": "bell"}, {"at": 0, "name": "x"}, "plain"])
    documents = {}
    for s in (1, 2):
        d = {"rush": rng.choice(["r1", None]), "sfx": [effect() for _ in range(rng.randrange(4))], "text": "t"}
        if rng.random() < 0.7:
            d["trim"] = {"in": rng.choice([None, 0.3]), "out": rng.choice([None, 1.9])}
        if rng.random() < 0.5:
            d |= {"vfx": [effect()], "focus": 2}
        documents[s] = d
    variants = {"a": [1, 2, 3], "b": ["1/0", 3], "c": []}
    log = []
    for n in range(25):
        s = rng.randrange(1, 5)
        part = rng.choice([s, 1_000_000 + 1000 * s + rng.randrange(1, 8)])
        log.append(rng.choice([{"op": "split", "id": part, "t": round(rng.random() * 3, 2)}, {"op": "split", "id": s, "t": 1.0}, {"op": "unsplit", "id": part}, {"op": "restore", "to": rng.randrange(n + 2)}]))
    return segments, documents, variants, log


def frames(spark, recordings):
    tables = ([], [], [], [])
    for key, (segments, documents, variants, log) in recordings.items():
        tables[0].extend((key, k, json.dumps(v)) for k, v in segments.items())
        tables[1].extend((key, k, json.dumps(v)) for k, v in documents.items())
        tables[2].extend((key, k, json.dumps({"data": {"keep": v}})) for k, v in variants.items())
        tables[3].extend((key, k, json.dumps(v)) for k, v in enumerate(log))
    kinds = ("long", "long", "string", "long")
    return [spark.createDataFrame(t, SCHEMA.format(k)).repartition(3) for t, k in zip(tables, kinds)]


def test_random_logs(spark):
    recordings = {k: recording(random.Random(k)) for k in range(40)}
    got: dict = {}
    for r in edits.replayed(*frames(spark, recordings)).collect():
        got.setdefault(r["key"], {}).setdefault(r["what"], {})[r["id"]] = r["body"]
    restored = 0
    for key, (segments, documents, variants, log) in recordings.items():
        state, told, parts = plain(segments, documents, variants, log)
        mine = got[key]
        assert [mine["edit"][str(n)] == "done" for n in range(len(log))] == told
        assert {int(k): json.loads(v) for k, v in mine["document"].items()} == state["docs"]
        assert {k: json.loads(v) for k, v in mine["variant"].items()} == state["keep"]
        assert {int(k): json.loads(v)["words"] for k, v in mine["part"].items()} == {p[0]: [p[2], p[3]] for s in segments for p in parts(s)}
        restored += sum(d and e["op"] == "restore" for d, e in zip(told, log))
    assert restored > 50


def test_split_and_put_together(spark):
    segments = {1: {"start": 0.0, "end": 3.0, "words": [[0.0, 0.4], [1.0, 1.4], [2.0, 2.4]]}}
    documents = {1: {"rush": "r", "sfx": [{"at": 0.2, "name": "a"}, {"at": 1.5, "name": "b"}], "text": None, "alts": None, "trim": {"in": 0.1, "out": 2.5}}}
    log = [{"op": "split", "id": 1, "t": 1.1}, {"op": "unsplit", "id": 1_001_001}]
    got = {(r["what"], r["id"]): r["body"] for r in edits.replayed(*frames(spark, {5: (segments, documents, {"v": [1]}, log)})).collect()}
    assert json.loads(got["document", "1"]) == documents[1] and json.loads(got["variant", "v"]) == [1] and json.loads(got["part", "1"])["words"] == [0, 3]
    one = {(r["what"], r["id"]): r["body"] for r in edits.replayed(*frames(spark, {5: (segments, documents, {"v": [1]}, log[:1])})).collect()}
    assert json.loads(one["document", "1001001"]) == {"rush": "r", "sfx": [{"at": 0.55, "name": "b"}], "trim": {"in": None, "out": 1.55}}


def test_awkward_rows(spark):
    none = spark.createDataFrame([], SCHEMA.format("long"))
    assert edits.replayed(none, none, none, none).count() == 0
    log = spark.createDataFrame([(None, 1, None), (None, 2, "{"), (None, 3, '{"op": "split", "id": 1}'), (None, 4, '{"op": "split", "id": true}'), (None, 5, '{"op": "restore", "to": 99}')], SCHEMA.format("long"))
    documents = spark.createDataFrame([(None, 1, "[1]"), (None, 2, None), (None, 3, '{"data": 3}')], SCHEMA.format("long"))
    got = sorted((r["what"], r["id"], r["body"]) for r in edits.replayed(none, documents, none, log).collect())
    assert got == [("document", "3", "{}")] + [("edit", str(k), "refused") for k in range(1, 6)]


def test_registered_query(spark):
    """The query over the whole smallest table, against whole copies."""
    from tidemark.plans import catalogue, stateful

    tables = [[tuple(r) for r in df.select("key", "id", "body").collect()] for df in stateful.recordings(spark, "/root/testdata/sf0.001")]
    got: dict = {}
    for r in catalogue.QUERIES["edited_recordings"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r["key"], {}).setdefault(r["what"], {})[r["id"]] = r["body"]
    for key in {t[0] for t in tables[0]}:
        own = [[r for r in t if r[0] == key] for t in tables]
        segments, documents = ({r[1]: json.loads(r[2]) for r in own[k]} for k in (0, 1))
        log = [json.loads(r[2]) if r[2] else {"op": "none"} for r in sorted(own[3], key=lambda r: r[1])]
        state, told, parts = plain(segments, documents, {r[1]: json.loads(r[2])["keep"] for r in own[2]}, log)
        assert [got[key]["edit"][str(r[1])] == "done" for r in sorted(own[3], key=lambda r: r[1])] == told
        assert {int(k): json.loads(v) for k, v in got[key]["document"].items()} == state["docs"]
        assert {k: json.loads(v) for k, v in got[key]["variant"].items()} == state["keep"]
        assert {int(k) for k in got[key]["part"]} == {p[0] for s in segments for p in parts(s)}
