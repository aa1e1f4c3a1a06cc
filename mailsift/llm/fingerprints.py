"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, built of column functions.

A text's paragraphs (lines; a long one is cut at the sentence end that follows its first ``PIECE`` characters)
are digested to 64 bits. Each digest is added to one cell of each of three small tables; a cell keeps a
count, the exclusive-or of its digests and that of their check sums. The difference of two sketches, cell by
cell, is the sketch of the digests that only one text has: equal ones cancel. A cell that then holds a
single digest gives it away, it is taken out of its other cells, and so on until nothing is left. If
cells remain, the sketch was too small: it is retried larger, as a row of sketches, each for the digests
with equal bits, as many as the two texts' digests may need; one that fails again is retried as sixteen.
So the work grows in proportion to the digests. Digests of a part that fails the last size too are
compared as they are. Everything is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PIECE = 200
TABLES, SLOTS = 3, 4
CELLS = TABLES * SLOTS
ROUNDS = 8
# Sizes tried: one sketch; 4, 16, 64, ... of them, one for about three digests; sixteen for each that failed.
LEVELS = 3
PER_SKETCH = 3
MOST_BITS = 10
# Documents of one range of ids that stand in order in a task, and ranges at most.
RANGE_ROWS = 2000
MOST_RANGES = 4096

_CELL = "struct<c:int,k:bigint,h:bigint>"


def paragraphs(text: Column | str, piece: int = PIECE) -> Column:
    """The paragraphs of a text, long ones in pieces; white space around line ends is left as it is."""
    return F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{piece}}}[^\n.!?]*[.!?]*"), F.lit(0))


def digests(text: Column | str, piece: int = PIECE) -> Column:
    """Distinct 64-bit digests of the paragraphs, in ascending order; none for a null text."""
    found = F.array_sort(F.array_distinct(F.transform(paragraphs(text, piece), lambda p: F.xxhash64(p))))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def _slot(digest: Column, table: int | Column, level: int) -> Column:
    """The cell of a digest in a table, from bits that no other table, level or split reads."""
    base = 2 * MOST_BITS + 4 + 6 * level
    shift = F.lit(base) + F.lit(2) * table if isinstance(table, Column) else F.lit(base + 2 * table)
    return F.call_function("shiftrightunsigned", digest, shift.cast("int")).bitwiseAND(F.lit(3))


def sketch(digest_list: Column, level: int = 0) -> Column:
    """The cells of a digest list: arrays of (count, keys, check sums), table after table."""
    zero = F.expr("named_struct('c', 0, 'k', 0L, 'h', 0L)")

    def add(cell, d):
        return F.struct((cell["c"] + 1).alias("c"), cell["k"].bitwiseXOR(d).alias("k"),
                        cell["h"].bitwiseXOR(F.xxhash64(d)).alias("h"))

    def cell(table, slot):
        return F.aggregate(F.filter(digest_list, lambda d: _slot(d, table, level) == slot), zero, add)

    return F.array(*[cell(table, slot) for table in range(TABLES) for slot in range(SLOTS)])


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def peeled(cells: Column, level: int = 0) -> Column:
    """``cells, found`` after peeling: what is left, and (side, digest) with side 1 or -1."""
    start = F.struct(cells.alias("cells"), F.expr("cast(array() as array<struct<c:int,k:bigint>>)").alias("found"))

    def single(x):
        return (F.abs(x["c"]) == 1) & (F.xxhash64(x["k"]) == x["h"])

    def round_(state, _):
        def remove(pure):
            def cell(x, i):
                table = F.floor(i / SLOTS).cast("int")
                mine = F.filter(pure, lambda p: _slot(p["k"], table, level) == i % SLOTS)
                return F.aggregate(mine, x, lambda c, p: F.struct(
                    (c["c"] - p["c"]).alias("c"), c["k"].bitwiseXOR(p["k"]).alias("k"),
                    c["h"].bitwiseXOR(F.xxhash64(p["k"])).alias("h")))

            return F.when(F.size(pure) == 0, state).otherwise(F.struct(
                F.transform(state["cells"], cell).alias("cells"), F.concat(state["found"], pure).alias("found")))

        pure = F.array_distinct(F.transform(
            F.filter(state["cells"], single), lambda x: F.struct(x["c"].alias("c"), x["k"].alias("k"))))
        return _let(pure, remove)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def _clear(cells: Column) -> Column:
    return F.forall(cells, lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0))


def difference(a: Column, b: Column, level: int = 0) -> Column:
    """(side, digest) of all digests that one of the lists has and the other has not.

    Sketches are subtracted and peeled; a sketch that does not come out empty is retried larger, and the sets themselves are compared when the last size fails.
    """
    empty = F.expr("cast(array() as array<struct<c:int,k:bigint>>)")

    def sided(side, values):
        return F.transform(values, lambda d: F.struct(F.lit(side).alias("c"), d.alias("k")))

    if level == LEVELS:
        return F.concat(sided(1, F.array_except(a, b)), sided(-1, F.array_except(b, a)))

    def split(pair, shift, bits):
        """Parts of both lists by ``bits`` bits of the digests from ``shift`` on."""
        def share(part, j):
            mask = F.call_function("shiftleft", F.lit(1), bits) - 1 if isinstance(bits, Column) else F.lit((1 << bits) - 1)
            moved = F.lit(shift) if isinstance(shift, int) else shift
            return F.filter(part, lambda d: F.call_function("shiftrightunsigned", d, moved).bitwiseAND(mask) == j)

        count = F.call_function("shiftleft", F.lit(1), bits if isinstance(bits, Column) else F.lit(bits))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(
            share(pair["a"], j).alias("a"), share(pair["b"], j).alias("b")))

    def larger(pair):
        again = lambda p: difference(p["a"], p["b"], level + 1)
        if level:
            return F.flatten(F.transform(split(pair, 2 * MOST_BITS, 4), again))
        wanted = F.log2((F.size(pair["a"]) + F.size(pair["b"])) / PER_SKETCH) / 2
        bits = F.least(F.greatest(F.ceil(wanted), F.lit(1)), F.lit(MOST_BITS)).cast("int")
        # In two steps, so a digest is looked at a number of times that grows with the root of the parts.
        halves = split(pair, 0, bits)
        return F.flatten(F.transform(halves, lambda h: F.flatten(F.transform(split(h, MOST_BITS, bits), again))))

    def attempt(pair):
        def judge(state):
            return F.when(_clear(state["cells"]), state["found"]).otherwise(larger(pair))

        tried = _let(peeled(subtracted(sketch(pair["a"], level), sketch(pair["b"], level)), level), judge)
        one_sided = F.when(F.size(pair["b"]) == 0, sided(1, pair["a"])).when(
            F.size(pair["a"]) == 0, sided(-1, pair["b"]))
        return F.when((F.size(pair["a"]) == 0) & (F.size(pair["b"]) == 0), empty).otherwise(
            one_sided.otherwise(tried) if level else tried)

    return _let(F.struct(a.alias("a"), b.alias("b")), attempt)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two digest lists, from the digests that the sketches' difference gives back."""
    apart, both = F.size(difference(a, b)), F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - apart) / (both + apart)).cast("double")


def fingerprint(digest_list: Column) -> Column:
    """The sketch of the first size as text: number of digests, then count.keys.checks of each cell."""
    cells = F.transform(sketch(digest_list), lambda x: F.concat_ws(".", F.hex(x["c"]), F.hex(x["k"]), F.hex(x["h"])))
    return F.concat_ws("-", F.size(digest_list).cast("string"), F.array_join(cells, "-"))


def _range_of(ident: Column, ends: list[int]) -> Column:
    """The number of range ends below the id, by halving."""
    steps = [1 << b for b in range(max(len(ends).bit_length() - 1, 0), -1, -1)]
    array = F.array(*[F.lit(e).cast("bigint") for e in ends])
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(
        (at + s <= len(ends)) & (F.get(array, at + s - 1) < ident), at + s).otherwise(at))


def with_next(docs: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """Add the given columns of the next row, by descending doc_id, under new names; the last is followed by the first.

    Rows are dealt to ranges of ids whose upper ends are ids of the table, at most ``MOST_RANGES`` of them;
    the first row of each range is also put at the end of the range before. So the table is shuffled once
    and a task sorts one range. A null doc_id comes last; rows with equal ids follow by their text.
    """
    ids = docs.filter("doc_id is not null").select("doc_id")
    count = ids.count()
    ranges = max(1, min(MOST_RANGES, count // RANGE_ROWS))
    shares = [(i + 1) / ranges for i in range(ranges)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 20 * ranges), F.max("doc_id")).first()
    ends = sorted({*(found[0] or []), *([found[1]] if count else [])})
    if not ends:
        own, again = F.lit(0), F.lit(0)
    else:
        own = F.when(F.col("doc_id").isNull(), 0).otherwise(_range_of(F.col("doc_id"), ends)).cast("int")
        is_end = F.get(F.array(*[F.lit(e).cast("bigint") for e in ends]), F.col("_range")) == F.col("doc_id")
        again = F.when(is_end, F.pmod(F.col("_range") + 1, F.lit(len(ends))))
    rows = docs.withColumn("_range", own)
    spots = F.array(
        F.struct(F.col("_range").alias("r"), F.lit(0).alias("after")),
        F.struct((again if ends else F.lit(0)).cast("int").alias("r"), F.lit(1).alias("after")))
    rows = rows.withColumn("_spot", F.explode(F.filter(spots, lambda s: s["r"].isNotNull())))
    order = W.partitionBy("_spot.r").orderBy(
        "_spot.after", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    rows = rows.withColumns({new: F.lead(old).over(order) for old, new in zip(columns, names)})
    return rows.filter("_spot.after = 0").drop("_range", "_spot")


def edited_versions(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """Fingerprint each text and the version whose second half is taken from the next document.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and the
    numbers of differing paragraphs ``apart_edited, apart_next``. Null texts count as empty; texts without
    paragraphs are alike (1.0) and unlike any other (0.0). Rows that repeat follow each other by text; the
    only row of a table is its own next. Very long texts are handled in proportion to their paragraphs.
    Other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("own", digests("text", piece))
    rows = with_next(rows, ["text", "own"], ["next_text", "next"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited_text", edited).withColumn("n_chars", n.cast("bigint"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "own", "next",
        digests("edited_text", piece).alias("edited"))
    both = [("edited", "near_edited", "apart_edited"), ("next", "near_next", "apart_next")]
    rows = rows.withColumns({apart: F.size(difference(F.col("own"), F.col(other))) for other, _, apart in both})

    def near(other, apart):
        total = F.size("own") + F.size(other)
        return F.when(total == 0, 1.0).otherwise((total - F.col(apart)) / (total + F.col(apart))).cast("double")

    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        *[near(other, apart).alias(name) for other, name, apart in both], "apart_edited", "apart_next")
