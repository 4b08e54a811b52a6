"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct lower-case words. Tokens are ordered by rarity in the corpus (counts in a table of fixed
size, ties by hash), and two lines can only reach the Jaccard similarity if they share a token in their prefixes, the
n - ceil(t*n) + 1 rarest ones. Pairs that share one must pass the length filter, the positional filter and a bound by
parity bitmaps of the sets before their words are compared. A line is removed if an earlier line, by (doc_id, line
number), reaches the similarity.

Lines with equal sets meet first, as one. Then each set is compared with the earliest one in the groups of its prefix
tokens; only sets that none of those matches are joined with all others, so that a large group of near copies takes a
number of pairs in proportion to its size, and no link is lost.

Defined cases. Lines are split at newlines. A null or empty text has no line to remove; a line without a word stays. Rows with equal id and text are one document: neither copy is later than the
other. Rows of one id with different texts are ordered by a hash of the text; null ids come first. Extra columns are kept
by deduplicated() and ignored by removed(). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SIMILARITY, LEAST_WORDS = 0.8, 1
#: Counts by which rarity is told: a table of this many places, each for the words that hash there, in LEVELS a doubling.
BINS, LEVELS = 1 << 18, 4
PLACE = ("doc", "h", "no")
#: Tokens up to which a set's bitmap has 64 bits, beyond 128.
NARROW = 48
BITMAP = ("k0", "k1")
#: Pairs whose sets meet at a time, each with some hundred words: what a round shuffles stays bounded.
PAIRS_A_ROUND = 1_000_000


#: White space inside a line, beside the space itself.
SPACES = ("\t", "\r", "\x0b", "\x0c")


def flat(text: Column) -> Column:
    """The text in lower case with a plain space for each white space but the newline. Most texts hold no other, which one
    look tells."""
    low = spaced = F.lower(text)
    for space in SPACES:
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    return F.when(text.rlike("[\\t\\r\\x0b\\x0c]"), spaced).otherwise(low)


def words(line: Column) -> Column:
    """The words of a flat line. Splitting at one character is far cheaper than by a pattern."""
    return F.array_remove(F.split(line, " "), "")


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc, h, text): flat texts that aren't empty; h tells apart texts of one id."""
    texts = common.only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.col("text").cast("string").alias("text"))
    return texts.where(F.length("text") > 0).select("doc", F.xxhash64("text").alias("h"), flat(F.col("text")).alias("text"))


def constant(spark: SparkSession, value: bytes) -> Column:
    """The bytes as a subquery of one row. A literal of them would stand, in digits, in every description of a plan that has it,
    and the driver keeps a thousand descriptions."""
    return spark.createDataFrame([(value,)], "value binary").scalar()


def rarity(docs: DataFrame) -> Column:
    """The levels of all places of the table of counts, a byte each, as a constant: its size is BINS whatever the corpus."""
    every = common.only(docs, "text").select(flat(F.col("text").cast("string")).alias("text")).select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = every.groupBy(F.xxhash64("w").bitwiseAND(BINS - 1).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    found = counts.select("bin", F.least(F.lit(127), F.floor(LEVELS * F.log2(F.col("n") + 1))).cast("tinyint").alias("level")).toArrow()
    level = np.zeros(BINS, np.uint8)
    level[found.column("bin").to_numpy()] = found.column("level").to_numpy()
    return constant(docs.sparkSession, level.tobytes())


def level_at(levels: Column, place: Column) -> Column:
    """One of the levels: they are below 128, so a byte of them is a character of its own."""
    return F.ascii(F.substring(levels, place.cast("int") + 1, F.lit(1)).cast("string"))


def bitmap(t: Column, n: Column) -> list[Column]:
    """k0 and k1: for each token a bit is turned. A set of up to NARROW tokens has 64 bits, in k0; a larger one 128, so that
    they aren't worn out. The 64 bits of a larger set are its two parts turned into each other."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    turned = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(x)))
    part = lambda k: turned(F.filter(t, lambda x: F.shiftright(x, 6).bitwiseAND(1) == k))
    narrow = n <= NARROW
    return [F.when(narrow, turned(t)).otherwise(part(0)).alias("k0"), F.when(narrow, F.lit(0).cast("long")).otherwise(part(1)).alias("k1")]


def described(docs: DataFrame, similarity: float) -> DataFrame:
    """For each line: its place, a signature of its set, the set's size, bitmap and prefix tokens."""
    level = rarity(docs)
    lines = texts_of(docs).select("doc", "h", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    hashes = F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w)))
    # the level in the highest byte, the hash below: sorting puts the rarest first, and equal words are equal
    token = lambda h: h.bitwiseAND((1 << 56) - 1).bitwiseOR(F.shiftleft(level_at(F.col("levels"), h.bitwiseAND(BINS - 1)).cast("long"), 56))
    # a subquery may not be written inside transform(); as a column used once Spark moves it there itself
    hashed = lines.select(*PLACE, hashes.alias("hashes"), level.alias("levels"))
    tokens = hashed.select(*PLACE, F.transform("hashes", token).alias("t")).select(*PLACE, F.sort_array("t").alias("t"))
    sized = tokens.select(*PLACE, "t", F.size("t").alias("n"))
    return sized.select(
        *PLACE,
        F.xxhash64("t").alias("s1"),
        F.hash("t").alias("s2"),
        "n",
        *bitmap(F.col("t"), F.col("n")),
        F.transform(F.slice("t", 1, F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1)), lambda x: F.shiftright(x, 20).bitwiseAND(2**31 - 1).cast("int")).alias("prefix"),
    )


def distinct_sets(lines: DataFrame) -> DataFrame:
    """A row for each set with its first place, and a number `id` in the order of these places."""
    first = lines.groupBy("s1", "s2").agg(F.min(F.struct(*PLACE, "n", *BITMAP, "prefix")).alias("r")).select("r.*", "s1", "s2")
    # places are unique, so the order and with it every number stays the same if a task runs again
    placed = first.repartitionByRange(common.shuffle_parts(lines.sparkSession), *PLACE).sortWithinPartitions(*PLACE)
    return placed.withColumn("id", F.monotonically_increasing_id() + 1)


SHAPE_BITS = 31


def prefix_rows(every: DataFrame, opened: Column | None = None) -> DataFrame:
    """A row for each prefix token: token, id, bitmap, the prefix token just before or null, and in one long, as a shuffle of
    few columns is smaller, whether the set is open, its size and the token's place."""
    shape = F.shiftleft(F.col("n").cast("long"), SHAPE_BITS)
    shape = shape if opened is None else shape.bitwiseOR(F.when(opened, F.lit(1 << 62)).otherwise(F.lit(0)))
    rows = every.select("id", shape.alias("shape"), *BITMAP, "prefix", F.posexplode("prefix").alias("pos", "token"))
    return rows.select("token", "id", F.col("shape").bitwiseOR(F.col("pos").cast("long")).alias("shape"), *BITMAP, F.get("prefix", F.col("pos") - 1).alias("before"))


COLUMNS = ("id", "shape", *BITMAP, "before")


class Row:
    """What the columns of a prefix row say; their names begin with `side`."""

    def __init__(self, side: str) -> None:
        shape, low = F.col(f"{side}shape"), (1 << SHAPE_BITS) - 1
        self.id, self.before = F.col(f"{side}id"), F.col(f"{side}before")
        self.n, self.pos = F.shiftright(shape, SHAPE_BITS).bitwiseAND(low), shape.bitwiseAND(low)
        self.bitmap = [F.col(f"{side}{k}") for k in BITMAP]


def least_shared(a: Row, b: Row, similarity: float) -> Column:
    """Tokens that similar sets must share."""
    return F.ceil((a.n + b.n) * (similarity / (1 + similarity)) - 1e-9)


def most_shared(a: Row, b: Row) -> Column:
    """Tokens that two sets can share, given that they share the ones of these rows. It is the same for the tokens before
    them, should they be shared too."""
    return F.least(a.n - a.pos, b.n - b.pos) + F.least(a.pos, b.pos)


def may_match(a: Row, b: Row, similarity: float) -> Column:
    """Length, positional and bitmap filters on two prefix rows that share a token."""
    both, least = a.n + b.n, least_shared(a, b, similarity)
    parts = [x.bitwiseXOR(y) for x, y in zip(a.bitmap, b.bitmap, strict=True)]
    alike = (a.n <= NARROW) == (b.n <= NARROW)
    differ = F.when(alike, F.bit_count(parts[0]) + F.bit_count(parts[1])).otherwise(F.bit_count(parts[0].bitwiseXOR(parts[1])))
    return (F.least(a.n, b.n) >= F.greatest(a.n, b.n) * similarity - 1e-9) & (most_shared(a, b) >= least) & (differ <= both - 2 * least)


def met_before(a: Row, b: Row) -> Column:
    """Whether the pair shares the tokens just before these too: then it passes there what it passes here, and is found
    there. Of a run of shared tokens only the first row stays, and by induction no pair is lost."""
    return F.coalesce(a.before == b.before, F.lit(False))


def leader_candidates(every: DataFrame, similarity: float) -> DataFrame:
    """(earlier, later): each set with the first one in the groups of its prefix tokens and with the one just before it
    there, where the pair passes. A group of near copies is mostly settled by these: few of its sets differ from both."""
    group = Window.partitionBy("token").orderBy("id")
    columns = [c for c in COLUMNS if c != "before"]
    rows = prefix_rows(every)
    led = rows.select(*COLUMNS, *[F.first(c).over(group).alias(f"x_{c}") for c in columns], F.lit(0).alias("x_before"), *[F.lag(c).over(group).alias(f"y_{c}") for c in columns], F.lit(0).alias("y_before"))
    own, leader, last = Row(""), Row("x_"), Row("y_")
    one = F.when((leader.id < own.id) & may_match(leader, own, similarity), leader.id)
    other = F.when((leader.id < last.id) & may_match(last, own, similarity), last.id)
    found = led.select("id", one.alias("one"), other.alias("other")).where("one is not null or other is not null")
    return found.select(F.explode(F.array("one", "other")).alias("earlier"), F.col("id").alias("later")).where("earlier is not null").distinct()


def all_candidates(every: DataFrame, matched: DataFrame, similarity: float) -> DataFrame:
    """(earlier, later): sets not yet matched with any earlier one that passes the filters.

    Both sides keep the same columns and no condition is on one side alone (adding the other's id to a set's shape keeps
    that so), so that Spark makes one exchange and reads it twice."""
    flagged = every.join(matched.select(F.col("later").alias("id"), F.lit(True).alias("done")), "id", "left")
    rows = prefix_rows(flagged, F.col("done").isNull())
    y, x = (rows.select("token", *[F.col(c).alias(f"{side}_{c}") for c in COLUMNS]) for side in ("y", "x"))
    earlier, later = Row("x_"), Row("y_")
    still_open = F.col("y_shape") + earlier.id >= F.lit(1 << 62) + earlier.id
    pairs = y.join(x, "token").where((earlier.id < later.id) & still_open & may_match(earlier, later, similarity) & ~met_before(earlier, later))
    return pairs.select(F.col("x_id").alias("earlier"), F.col("y_id").alias("later")).distinct()


def among(places: DataFrame) -> Column:
    """Whether a document may be one of the places: a table of BINS bytes tells which hashes they have, so that the texts of
    most others needn't be shuffled to find out."""
    bins = places.select(F.xxhash64("doc", "h").bitwiseAND(BINS - 1).alias("bin")).distinct().toArrow()  # BINS rows at most
    held = np.zeros(BINS, np.uint8)
    held[bins.column("bin").to_numpy()] = 1
    return level_at(constant(places.sparkSession, held.tobytes()), F.xxhash64("doc", "h").bitwiseAND(BINS - 1)) == 1


def compared(pairs: DataFrame, every: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """(earlier, later, similarity): pairs whose word sets reach the bound; words are compared by their 64-bit hashes.

    The lines that are in any pair are fetched once, by their documents; pairs meet them in rounds of bounded size."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("earlier").alias("id")).unionAll(pairs.select("later")).distinct()
    places = every.select("id", *PLACE).join(wanted, "id").groupBy("doc", "h").agg(F.collect_list(F.struct("id", "no")).alias("lines"))
    places = common.stored(places, "line-places")
    held = texts_of(docs).where(among(places)).join(places, ["doc", "h"]).select(F.split("text", "\n").alias("split"), F.explode("lines").alias("l"))
    sets = held.select("l.id", F.get("split", "l.no").alias("line")).dropDuplicates(["id"]).select("id", F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w))).alias("w"))
    sets = common.stored(sets, "line-words")
    common.release(spark)
    rounds, found = max(1, -(-pairs.count() // PAIRS_A_ROUND)), None
    for k in range(rounds):
        some = pairs.where(F.pmod(F.xxhash64("later"), F.lit(rounds)) == k)
        two = some.join(sets.select(F.col("id").alias("earlier"), F.col("w").alias("a")), "earlier").join(sets.select(F.col("id").alias("later"), F.col("w").alias("b")), "later")
        shared = F.size(F.array_intersect("a", "b"))
        ratio = two.select("earlier", "later", (shared / (F.size("a") + F.size("b") - shared)).alias("similarity")).where(F.col("similarity") >= similarity - 1e-9)
        ratio = common.stored(ratio, "line-matches")
        common.release(spark)
        found = ratio if found is None else found.unionByName(ratio)
    return found


def matches(docs: DataFrame, every: DataFrame, similarity: float) -> DataFrame:
    """(later, earlier, similarity): sets that an earlier one matches, by id."""
    spark = docs.sparkSession
    led = common.stored(leader_candidates(every, similarity), "line-leaders")
    common.release(spark)
    found = compared(led, every, docs, similarity)
    joined = common.stored(all_candidates(every, found.select("later").distinct(), similarity), "line-pairs")
    common.release(spark)
    found = found.unionByName(compared(joined, every, docs, similarity))
    return found.groupBy("later").agg(F.min(F.struct("earlier", "similarity")).alias("m")).select("later", "m.earlier", "m.similarity")


def removed(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, h, no, earlier, similarity): every removed line and an earlier line it matches."""
    # filtered as read: a filter on the set before it is written would make Spark build the set twice
    lines = common.stored(described(docs, similarity), "lines").where(F.col("n") >= LEAST_WORDS)
    every = common.stored(distinct_sets(lines), "line-sets")
    common.release(docs.sparkSession)
    # a set so small that one word more or less is too many only matches its equals, which have met already
    found = matches(docs, every.where(F.col("n") >= (F.col("n") + 1) * similarity - 1e-9), similarity)
    first = every.select("s1", "s2", "id", F.struct(*PLACE).alias("first"))
    place = first.select(F.col("id").alias("earlier"), F.col("first").alias("at"))
    met = found.join(place, "earlier").select(F.col("later").alias("id"), "at", "similarity")
    judged = first.join(met, "id", "left").select("s1", "s2", "first", "at", "similarity")
    each = lines.select(F.struct(*PLACE).alias("place"), "s1", "s2").join(judged, ["s1", "s2"]).where(F.col("at").isNotNull() | (F.col("place") > F.col("first")))
    same = F.col("at").isNull()
    return each.select("place.*", F.when(same, F.col("first")).otherwise(F.col("at")).alias("earlier"), F.when(same, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with all their columns, their texts without the removed lines; a column n_chars follows the text."""
    gone = removed(docs, similarity).groupBy("doc", "h").agg(F.collect_set("no").alias("nos"))
    gone = common.stored(gone, "line-removed")
    common.release(docs.sparkSession)
    plain, names = common.renamed(docs)
    doc, text = common.place(names, "doc_id"), common.place(names, "text")
    keyed = plain.withColumns({"doc": F.coalesce(F.col(doc).cast("long"), F.lit(-(2**63))), "h": F.xxhash64(F.col(text).cast("string"))})
    joined = keyed.join(gone, ["doc", "h"], "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda line, k: ~F.array_contains("nos", k)), "\n")
    out = joined.withColumn(text, F.when(F.col("nos").isNull(), F.col(text)).otherwise(kept))
    if "n_chars" in names:
        n = common.place(names, "n_chars")
        out = out.withColumn(n, F.when(F.col("nos").isNull(), F.col(n)).otherwise(F.length(text).cast(dict(plain.dtypes)[n])))
    return common.restored(out, names)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = removed(common.table(spark, sf_dir, "documents"))
    real = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return gone.select(real("doc").alias("doc_id"), F.col("no").cast("long").alias("line_no"), real("earlier.doc").alias("match_doc_id"), F.col("earlier.no").cast("long").alias("match_line_no"), "similarity")
