"""Repair of conversations: the cheapest edits after which the roles read s?(ua)+, or nothing is left.

Keep costs 0, a new role (user or assistant) 1, Delete 2, Insert of an empty turn 5; a truncated row that stays adds 5, and
blank and duplicate rows must go. The pattern's states and what it costs to finish from each are a vector; a row maps the
vector behind it to the one before it. Vectors less their least entry are the states of an automaton that is built as rows
ask for it: its table holds for (state, kind of row) the next state and the cost that was taken out. A scan of the rows
from last to first is a look-up for each, and the way back along the scan takes, at each row, the first tight arc in the
order D, I, K, R: that is the cheapest audit that is least as a string. Within it roles are determined, since users and
assistants alternate.

No conversation is gathered. Equal rows of a turn are one row with a number; rows are dealt by range in order of
conversation and turn, and cut into blocks of at most BLOCK. A block's scans from the four unit vectors are a 4 x 4 matrix
over (min, +); a conversation's matrices, 16 numbers for up to BLOCK rows, are multiplied from the last to the first, which
gives every block the vector behind it. The later blocks are traced from each state, and the states that fit are chosen
from the first block on. Only a conversation's hash passes one task, as a stream of joined texts, for SHA-256 can't be cut.

Defined cases. Nulls are one space in role and text (such a row is blank, or can't be kept); a null turn comes first; a
null conv_id is a conversation of its own. Rows of one turn go by role and hash of text. A role whose first letter isn't s,
u or a, also an empty one, can't be kept. Repeated rows are duplicates; very long texts are taken whole. Extra columns are
ignored; an empty table gives an empty result, a conversation without rows zeros.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What edits cost, and what a truncated row that stays adds.
RELABEL, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Rows of a block; texts that are joined before they meet in their conversation.
BLOCK, TEXTS = 1 << 16, 1 << 10
NEVER = 1 << 40
WHITE = " \t\n\x0b\x0c\r"

#: States of the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial (s, u, a).
AFTER = {START: {0: SYSTEM, 1: USER}, SYSTEM: {1: USER}, USER: {2: ASSISTANT}, ASSISTANT: {1: USER}}
FINISHED = (START, ASSISTANT)
#: The role that may be put in at a state.
NEEDED = {q: max(after) for q, after in AFTER.items()}
#: A row's kind: the initial (3: any other), 4 more if truncated, or MUST_GO.
MUST_GO = 8

Vector = tuple[int, ...]


def closed(costs: list[int]) -> Vector:
    """With rows put in where that is cheaper: no three of them are, as the fourth state was met before."""
    for _ in range(3):
        costs = [min(costs[q], INSERT + costs[AFTER[q][NEEDED[q]]]) for q in range(4)]
    return tuple(min(c, NEVER) for c in costs)


FINAL = closed([0 if q in FINISHED else NEVER for q in range(4)])
UNITS = [tuple(0 if p == q else NEVER for p in range(4)) for q in range(4)]


def stay_costs(kind: int, q: int, behind: Vector) -> tuple[int, int]:
    """The cost of keeping a row at state q, and of giving it the role that the state needs."""
    if kind == MUST_GO:
        return NEVER, NEVER
    extra = CUT if kind >= 4 else 0
    kept = AFTER[q].get(kind % 4)
    return (NEVER if kept is None else extra + behind[kept]), RELABEL + extra + behind[AFTER[q][NEEDED[q]]]


def before(kind: int, behind: Vector) -> Vector:
    """The vector before a row, of the vector behind it."""
    return closed([min(DELETE + behind[q], *stay_costs(kind, q, behind)) for q in range(4)])


class Determinised:
    """The automaton over vectors, as far as rows have asked for it."""

    def __init__(self) -> None:
        self.ids: dict[Vector, int] = {}
        self.vectors: list[Vector] = []
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, tuple, int]] = {}

    def state(self, vector: Vector) -> tuple[int, int]:
        """A vector's state and its least entry."""
        least = min(vector)
        vector = tuple(NEVER if v >= NEVER else v - least for v in vector)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.ids[vector], least

    def scan(self, kinds: list[int], copies: list[int], behind: Vector) -> tuple[list[int], Vector]:
        """The states behind each row, and the vector before the first."""
        now, cost = self.state(behind)
        table, states = self.table, [0] * len(kinds)
        for i in range(len(kinds) - 1, -1, -1):
            states[i] = now
            step = table.get((now, kinds[i]))
            if step is None:
                step = table[now, kinds[i]] = self.state(before(kinds[i], self.vectors[now]))
            now = step[0]
            cost += step[1] + DELETE * (copies[i] - 1)
        return states, tuple(min(NEVER, v + cost) for v in self.vectors[now])

    def arc(self, state: int, kind: int, q: int) -> tuple[str, tuple, int]:
        """From q along tight arcs past a row: the edits' letters, what they leave (is it the row, its role's initial or
        None for its own), and the state reached."""
        behind = self.vectors[state]
        ahead, letters, left = before(kind, behind), "", []
        while DELETE + behind[q] != ahead[q]:
            needed = NEEDED[q]
            if INSERT + ahead[AFTER[q][needed]] == ahead[q]:
                letters, q = letters + "I", AFTER[q][needed]
                left.append((False, needed))
                continue
            keep, _ = stay_costs(kind, q, behind)
            role = None if keep == ahead[q] else needed
            left.append((True, role))
            return letters + ("R" if role is not None else "K"), tuple(left), AFTER[q][kind % 4 if role is None else role]
        return letters + "D", tuple(left), q

    def trace(self, kinds: list[int], copies: list[int], states: list[int], q: int, last: bool) -> tuple[str, list[tuple[int, int]], int]:
        """Letters, what is left as (row or -1, initial or -1 for the row's own), and the state at the end; the last block
        also finishes the pattern."""
        letters, left, arcs = [], [], self.arcs
        for i, kind in enumerate(kinds):
            step = arcs.get((states[i], kind, q))
            if step is None:
                step = arcs[states[i], kind, q] = self.arc(states[i], kind, q)
            some, stays, q = step
            letters.append(some if copies[i] == 1 else some + "D" * (copies[i] - 1))
            left.extend((i if own else -1, -1 if role is None else role) for own, role in stays)
        while last and q not in FINISHED:
            letters.append("I")
            left.append((-1, NEEDED[q]))
            q = AFTER[q][NEEDED[q]]
        return "".join(letters), left, q


@cache
def automaton() -> Determinised:
    """One for each worker process."""
    return Determinised()


def applied(matrix: list[int], behind: Vector) -> Vector:
    """A block's matrix (row q: from q; column p: ending at p) on the vector behind the block."""
    return tuple(min(NEVER, *(matrix[4 * q + p] + behind[p] for p in range(4))) for q in range(4))


def illegal_pairs(initials: list[int], copies: list[int]) -> int:
    """Neighbours other than su, ua and au; equal neighbours are among them."""
    return sum(copies) - len(copies) + sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block its matrix, and what its rows add to the counts."""
    automat = automaton()
    for batch in batches:
        out = []
        for initials, kinds, copies in zip(*(batch.column(c).to_pylist() for c in ("initials", "kinds", "copies"))):
            columns = [automat.scan(kinds, copies, unit)[1] for unit in UNITS]
            out.append(([columns[p][q] for q in range(4) for p in range(4)], illegal_pairs(initials, copies), initials[0], initials[-1]))
        matrix, illegal, first, last = zip(*out) if out else ((), (), (), ())
        kept = [batch.column(c) for c in ("none", "conv", "part", "block", "counts")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(matrix, pa.list_(pa.int64())), pa.array(illegal, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["none", "conv", "part", "block", "counts", "matrix", "illegal", "first", "last"])


COUNTS = ("blank", "duplicate", "truncated", "turns", "first_turn", "last_turn")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation its cost and counts, and for each block the vector behind it."""
    kind = pa.list_(pa.struct([("part", pa.int32()), ("block", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("behind", pa.list_(pa.int64()))]))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    for batch in batches:
        totals, ways = [], []
        for blocks in batch.column("blocks").to_pylist():
            vector, way = FINAL, []
            for k in range(len(blocks) - 1, -1, -1):
                way.append({"part": blocks[k]["part"], "block": blocks[k]["block"], "first": k == 0, "last": k == len(blocks) - 1, "behind": list(vector)})
                vector = applied(blocks[k]["matrix"], vector)
            sums = {n: sum(b["counts"][n] for b in blocks) for n in ("blank", "duplicate", "truncated", "turns")}
            illegal = sum(b["illegal"] for b in blocks)
            for a, b in zip(blocks, blocks[1:]):
                illegal += illegal_pairs([a["last"], b["first"]], [1, 1])
            dated = [b["counts"] for b in blocks if b["counts"]["turns"]]
            distinct = sums["turns"] - sum(a["last_turn"] == b["first_turn"] for a, b in zip(dated, dated[1:]))
            gaps = dated[-1]["last_turn"] - dated[0]["first_turn"] + 1 - distinct if dated else 0
            totals.append([gaps, sums["blank"], sums["duplicate"], sums["truncated"], illegal, vector[START]])
            ways.append(way)
        yield pa.RecordBatch.from_arrays([batch.column("none"), batch.column("conv"), *(pa.array([t[k] for t in totals], pa.int64()) for k in range(6)), pa.array(ways, kind)], ["none", "conv", *names, "ways"])


def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, and each state at which it may be entered: letters, what is left, and the state at its end."""
    automat = automaton()
    kind = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.int32())]))
    for batch in batches:
        out: list[tuple] = []
        for k, (kinds, copies, first, last, behind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kinds", "copies", "first", "last", "behind")))):
            states, ahead = automat.scan(kinds, copies, tuple(behind))
            for q in [START] if first else range(4):
                if ahead[q] < NEVER:
                    letters, left, end = automat.trace(kinds, copies, states, q, last)
                    out.append((k, q, end, letters, [{"row": r, "role": o} for r, o in left]))
        rows, entry, end, letters, left = zip(*out) if out else ((),) * 5
        keys = [batch.column(c).take(pa.array(rows, pa.int32())) for c in ("none", "conv", "part", "block")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(entry, pa.int32()), pa.array(end, pa.int32()), pa.array(letters, pa.string()), pa.array(left, kind)], ["none", "conv", "part", "block", "entry", "end", "letters", "left"])


def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's joined texts, which come in order."""
    now, digest = None, None
    for batch in batches:
        done = []
        for none, conv, lines in zip(*(batch.column(c).to_pylist() for c in ("none", "conv", "lines"))):
            if (none, conv) != now:
                if digest is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (none, conv), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(lines.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.bool_()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["none", "conv", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.bool_()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["none", "conv", "repaired_sha256"])


def conversation_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with one space for a null role or text."""
    rows = common.only(conversations, "conv_id", "turn", "role", "text")
    space = F.lit(" ")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as conversation_rows() gives them, dropped, emptied, cut, doubled or given a wrong role by a hash of their place."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(key.cast("binary")) % 20
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    kept = rows.withColumn("fate", fate).where("fate <> 0")
    once = kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), "fate")
    return once.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


CONV = ["none", "conv"]
ROW = [*CONV, "has_turn", "at", "role", "print"]
PLACE = [*CONV, "part", "block"]


def keyed(rows: DataFrame) -> DataFrame:
    """Keys without nulls, so that equality finds them: conversation, turn, role and a hash of the text."""
    return rows.select(
        F.col("conv_id").isNull().alias("none"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.coalesce("turn", F.lit(0)).alias("at"),
        "role",
        F.unhex(F.md5(F.col("text").cast("binary"))).alias("print"),
        "text",
    )


def blocks_of(rows: DataFrame) -> DataFrame:
    """A row for each block: none, conv, part, block, its rows in order, their initials, kinds and copies, and counts."""
    ending = F.rtrim(F.col("text"), F.lit(WHITE))
    seen = rows.select(*ROW, (ending == "").alias("blank"), (~F.right(ending, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    runs = seen.groupBy(*ROW).agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # the first turn of a text in its conversation; joined back by row, so that no text's turns meet
    first = runs.groupBy(*CONV, "role", "print").agg(F.min(F.struct("has_turn", "at")).alias("first")).select(*CONV, F.col("first.has_turn").alias("has_turn"), F.col("first.at").alias("at"), "role", "print", F.lit(True).alias("new"))
    marked = runs.join(first, ROW, "left")
    letter = F.substring("role", 1, 1)
    initial = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    must_go = F.col("blank") | F.col("new").isNull()
    kind = F.when(must_go, F.lit(MUST_GO)).otherwise(F.col("initial") + F.when(F.col("cut"), 4).otherwise(0))
    told = marked.withColumn("initial", initial.cast("int")).withColumn("kind", kind.cast("int"))
    spark = rows.sparkSession
    order = [F.asc(c) for c in ROW]
    ranged = common.stored(told, "repair-runs").repartitionByRange(common.shuffle_parts(spark), *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # partitions in order, and rows in order within them
    placed = ranged.withColumn("number", number)
    placed = placed.select("*", F.shiftright("number", 33).cast("int").alias("part"), (F.col("number").bitwiseAND((1 << 33) - 1) / BLOCK).cast("int").alias("block"))
    placed = common.stored(placed, "repair-places")
    each = F.struct("number", "has_turn", "at", "role", "print", "initial", "kind", "copies")
    dated = F.when(F.col("has_turn"), F.col("at"))
    counts = F.struct(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("copies") - F.col("new").isNotNull().cast("long")).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & F.col("new") & F.col("cut"), 1).otherwise(0)).alias("truncated"),
        F.count_distinct(dated).alias("turns"),
        F.min(dated).alias("first_turn"),
        F.max(dated).alias("last_turn"),
    )
    blocks = placed.groupBy(*PLACE).agg(F.sort_array(F.collect_list(each)).alias("rows"), counts.alias("counts"))
    lists = {"initials": "initial", "kinds": "kind", "copies": "copies"}
    return blocks.select(*PLACE, "counts", "rows", *[F.col(f"rows.{c}").alias(n) for n, c in lists.items()])


def walked(ends: Column) -> Column:
    """Of a conversation's blocks in order, each with its end for every entry: the entry that fits, from the start on."""
    steps = F.aggregate(
        ends,
        F.struct(F.lit(START).alias("now"), F.array().cast("array<int>").alias("entries")),
        lambda acc, block: F.struct(F.get(block["ends"], acc["now"]).alias("now"), F.concat(acc["entries"], F.array(acc["now"])).alias("entries")),
    )
    return steps["entries"]


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """A row for each conv_id of `conversations`: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows`, if given, are what is left of its rows (of conversation_rows()'s form); repaired_lines() gives the texts."""
    given = conversation_rows(conversations)
    keyed_rows = keyed(given if rows is None else rows)
    told, chosen, blocks = decided(keyed_rows)
    pieces = F.sort_array(F.collect_list(F.struct("part", "block", "letters")))
    audits = chosen.groupBy(*CONV).agg(F.array_join(F.transform(pieces, lambda p: p["letters"]), "").alias("audit"))
    joined = lines_of(chosen, blocks, keyed_rows)
    joined = joined.repartition(*CONV).sortWithinPartitions(*CONV, "part", "block", "some")
    prints = joined.mapInArrow(hashes, "none boolean, conv long, repaired_sha256 string")
    every = given.select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = every.join(told.select(*CONV, *numbers), CONV, "left").join(audits, CONV, "left").join(prints, CONV, "left")
    return out.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def decided(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Costs and counts of conversations; letters and what is left of each block; the blocks."""
    blocks = common.stored(blocks_of(rows), "repair-blocks")
    counts = "struct<blank:long,duplicate:long,truncated:long,turns:long,first_turn:long,last_turn:long>"
    place = "none boolean, conv long, part int, block int"
    sums = blocks.select(*PLACE, "initials", "kinds", "copies", "counts").mapInArrow(summaries, f"{place}, counts {counts}, matrix array<long>, illegal long, first int, last int")
    each = F.struct("part", "block", "counts", "matrix", "illegal", "first", "last")
    # struct<..> sorts by its first fields, which no two blocks of a conversation share
    whole = sums.groupBy(*CONV).agg(F.sort_array(F.collect_list(each)).alias("blocks"))
    way = "array<struct<part:int,block:int,first:boolean,last:boolean,behind:array<long>>>"
    told = common.stored(whole.mapInArrow(gathered, f"none boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, ways {way}"), "repair-costs")
    ways = told.select(*CONV, F.inline("ways"))
    tasks = blocks.select(*PLACE, "kinds", "copies").join(ways, PLACE)
    found = common.stored(tasks.mapInArrow(traced, f"{place}, entry int, end int, letters string, left array<struct<row:int,role:int>>"), "repair-traces")
    ends = found.groupBy(*PLACE).agg(F.array(*[F.max(F.when(F.col("entry") == q, F.col("end"))) for q in range(4)]).alias("ends"))
    walk = ends.groupBy(*CONV).agg(F.sort_array(F.collect_list(F.struct("part", "block", "ends"))).alias("blocks"))
    walk = walk.select(*CONV, F.col("blocks.part").alias("part"), F.col("blocks.block").alias("block"), walked(F.col("blocks")).alias("entry"))
    entries = walk.select(*CONV, F.inline(F.arrays_zip("part", "block", "entry")))
    return told, found.join(entries, [*PLACE, "entry"]), blocks


def lines_of(chosen: DataFrame, blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """What is left, in runs of TEXTS lines `role:text`: none, conv, part, block, some, lines."""
    fields = ("has_turn", "at", "role", "print")

    def item(what: Column) -> Column:
        row = F.get("rows", F.when(what["row"] >= 0, what["row"]))
        return F.struct(what["role"].alias("given"), *[row[c].alias(c) for c in fields])

    left = chosen.select(*PLACE, "left").join(blocks.select(*PLACE, "rows"), PLACE)
    items = left.select(*PLACE, F.posexplode(F.transform("left", item)).alias("line", "what")).select(*PLACE, "line", "what.*")
    role = F.when(F.col("given") == 1, F.lit("user")).when(F.col("given") == 2, F.lit("assistant")).otherwise(F.col("role"))
    texts = rows.groupBy(*ROW).agg(F.first("text").alias("text"))
    own = items.where("print is not null").join(texts, ROW)
    put_in = items.where("print is null").withColumn("text", F.lit(""))
    lines = own.select(*PLACE, "line", F.concat(role, F.lit(":"), F.col("text")).alias("words")).unionByName(put_in.select(*PLACE, "line", F.concat(role, F.lit(":")).alias("words")))
    some = lines.withColumn("some", (F.col("line") / TEXTS).cast("int"))
    joined = some.groupBy(*PLACE, "some").agg(F.sort_array(F.collect_list(F.struct("line", "words"))).alias("words"))
    return joined.select(*PLACE, "some", F.array_join(F.col("words.words"), "\n").alias("lines"))


def repaired_lines(rows: DataFrame) -> DataFrame:
    """The repaired conversations as lines `role:text`, up to TEXTS of them in a row: conv_id, part, block, some, lines;
    part, block and some give a conversation's order."""
    keyed_rows = keyed(conversation_rows(rows))
    _, chosen, blocks = decided(keyed_rows)
    return lines_of(chosen, blocks, keyed_rows).select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), "part", "block", "some", "lines")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.table(spark, sf_dir, "conversations")
    return repair(conversations, damaged(conversation_rows(conversations)))
