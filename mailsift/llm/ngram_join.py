"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents are rows, word n-grams are columns. The product of the matrix with its transpose holds the
overlap of every two documents; it is formed in blocks that are certain to hold every pair above the
threshold, and pairs that cannot reach it by their sizes are discarded before and after.

1. *Identical sets* are one row of the matrix (hot groups of copies are one row).
2. *Blocks.* Two sets whose Jaccard similarity reaches t differ in at most D = (1-t)/(1+t)(|A|+|B|)
   n-grams. The n-grams are dealt by hash into K = D + s segments, so at least s segments are equal in
   both, and a document is keyed by each of its segments. Of its keys it keeps the D + 1 that fewest sets
   have (ties by key): two sets that share s keys, put in one order for all, share one of these. So texts
   that have a passage in common but little else do not meet. Documents that share a kept key are in one family,
   and no pair above the threshold has its ends in two families. Sizes are cut into bands whose ends
   stand in the ratio t, so that only equal or neighbouring bands meet: a document is keyed for its
   own band and the next one. A document with s or more empty segments could share only empty ones with
   a partner; that partner has them too, so all such documents are dealt anew under another seed, and
   after the last seed they share one key per band; they keep all their keys.
3. *Product.* Each family is multiplied on its own. A family larger than one block is cut by size band
   and by hash, and each pair of blocks that the sizes allow is a task of bounded size. Columns held by
   few rows add to the overlaps pair by pair, columns held by many through a dense product.
4. Links are reduced to a forest per block, and their components are found by star operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mailsift.llm.common import BYTE_CODE, LOWER, NOT_SPACE, Words, Workspace, grouped, mixed, runs, utf8
from mailsift.llm.components import components

# N-grams of one block of the product, and documents of one block.
BLOCK_GRAMS = 1_000_000
BLOCK_ROWS = 2048
SEEDS = 6
# Columns of a block held by more rows than this are multiplied densely.
DENSE_COLUMN = 128
PAIRS_AT_ONCE = 1 << 20


def gram_sets(data: np.ndarray, at: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text its sorted distinct n-gram hashes; fewer words than n are one n-gram."""
    found = Words(data, at, NOT_SPACE, BYTE_CODE[LOWER])
    hashed = found.hashes()
    ends = np.cumsum(found.count)
    grams = hashed.copy()
    for k in range(1, words):
        grams = mixed(grams)
        grams[: len(grams) - k] ^= hashed[k:]
    grams = mixed(grams)
    out = []
    for count, end in zip(found.count.tolist(), ends.tolist()):
        if count >= words:
            out.append(np.unique(grams[end - count : end - words + 1]))
        elif count:
            whole = mixed(np.array([count], np.uint64))
            for one in hashed[end - count : end]:
                whole = mixed(whole ^ one)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_code(grams: np.ndarray) -> int:
    """A 64-bit code of a whole set; sets with equal codes count as identical."""
    total = mixed(grams ^ np.uint64(0xA5A5)).sum(dtype=np.uint64) ^ np.uint64(len(grams))
    return int(mixed(np.array([total]))[0].astype(np.int64))


@lru_cache(maxsize=64)
def band_starts(percent: int, upto: int) -> np.ndarray:
    """First sizes of the size bands: sizes two bands apart are below the threshold's ratio."""
    starts = [1]
    while starts[-1] <= upto:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, np.int64)


@lru_cache(maxsize=4096)
def band_plan(percent: int, band: int) -> tuple[int, int]:
    """Segments and the number of surely equal ones, for pairs whose larger set is in the band."""
    starts = [1]
    while len(starts) < band + 2:
        starts.append(starts[-1] * 100 // percent + 1)
    highest, lowest = starts[band + 1] - 1, starts[max(band - 1, 0)]
    most = 2 * highest * (100 - percent) // (100 + percent)
    spare = 3
    for _ in range(8):
        empty = (most + spare) * float(np.exp(-lowest / (most + spare)))
        spare = int(3 + empty + 4 * empty**0.5)
    return (most + spare, spare) if most else (0, 0)


def segment_keys(grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of one set, and for each what it needs to be ranked.

    That is a number made of the deal it comes from (band and seed) and of how many more keys than the set
    has in that deal it may keep (one or fewer; 0 keeps all).
    """
    n = len(grams)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none
    own = int(np.searchsorted(band_starts(percent, 1 << max(n.bit_length(), 1)), n, side="right")) - 1
    keys, ranks = [], []
    for band in (own, own + 1):
        segments, spare = band_plan(percent, band)
        if not segments:
            continue
        for seed in range(SEEDS):
            spread = np.sort(mixed(grams ^ np.uint64(seed))) if seed else grams
            which = ((spread >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            sums = np.add.reduceat(mixed(spread ^ np.uint64(77)), first)
            salt = mixed(np.array([(band << 8) + seed], np.uint64))[0]
            keys.append(mixed(sums ^ mixed(which[first] + salt)).astype(np.int64))
            enough = segments - len(first) < spare
            more = segments - spare + 1 - len(first) if enough else 0
            ranks.append(np.full(len(first), _rank(band, seed, more), np.int64))
            if enough:
                break
        else:
            keys.append(mixed(np.array([(1 << 40) + band], np.uint64)).astype(np.int64))
            ranks.append(np.array([_rank(band, 255, 0)], np.int64))
    return (np.concatenate(keys), np.concatenate(ranks)) if keys else (none, none)


def _rank(band: int, seed: int, more: int) -> int:
    return (((band << 8) + seed) << 32) + more + (1 << 31)


def _sets(docs: DataFrame, words: int, names: dict[str, str], give) -> DataFrame:
    """Run ``give(sets, slice)`` over slices of the Arrow batches of ``docs``, whose text is ``text``."""
    fields = ", ".join(f"{k} {v}" for k, v in names.items())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in runs(batch, "text"):
                out = give(gram_sets(*utf8(part.column("text")), words), part, seen)
                if out.num_rows:
                    yield out

    return docs.mapInArrow(work, fields)


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_code, n_shingles, set_id``: one row per document."""

    def give(sets, part, seen):
        return pa.record_batch(
            [part.column("doc_id"), part.column("text_code"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([set_code(s) if len(s) else None for s in sets], pa.int64())],
            ["doc_id", "text_code", "n_shingles", "set_id"],
        )

    names = {"doc_id": "bigint", "text_code": "bigint", "n_shingles": "bigint", "set_id": "bigint"}
    return _sets(docs, words, names, give)


def key_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``key, set_id, rank``: the segment keys of each set, once per input partition."""

    def give(sets, part, seen):
        keys, ids, ranks = [], [], []
        for s in sets:
            code = set_code(s) if len(s) else None
            if code is None or code in seen:
                continue
            seen.add(code)
            own, rank = segment_keys(s, percent)
            keys.append(own)
            ranks.append(rank)
            ids.append(np.full(len(own), code, np.int64))
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        return pa.record_batch([flat(keys), flat(ids), flat(ranks)], ["key", "set_id", "rank"])

    return _sets(docs, words, {"key": "bigint", "set_id": "bigint", "rank": "bigint"}, give)


def candidate_links(keys: DataFrame) -> DataFrame:
    """``a, b``: sets that follow each other among those that share a kept key, so each key's sets are connected."""
    new = F.expr("coalesce(lag(set_id) over (partition by key order by set_id) <> set_id, true)")
    keys = keys.withColumn("new", new.cast("int")).withColumn("sets", F.expr("sum(new) over (partition by key)"))
    # Keys that one set alone has are counted by their absence; the rest is a small part of all.
    shared = keys.filter("new = 1 and sets > 1").withColumn("deal", F.expr("shiftright(rank, 32)")).withColumn(
        "more", F.expr("(rank & 4294967295L) - 2147483648L"))
    place = F.expr("row_number() over (partition by set_id, deal order by sets, key)")
    among = F.expr("count(*) over (partition by set_id, deal)")
    kept = shared.withColumn("place", place).withColumn("among", among).filter("place <= among + more")
    before = F.expr("lag(set_id) over (partition by key order by set_id)")
    return kept.select("key", "set_id").withColumn("a", before).filter("a is not null").select(
        "a", F.col("set_id").alias("b"))


def gram_rows(docs: DataFrame, words: int) -> DataFrame:
    """``family, blocks, set_id, grams``: rows of the matrix, the n-grams as packed 64-bit numbers."""

    def give(sets, part, seen):
        codes, new = [set_code(s) for s in sets], []
        for i, code in enumerate(codes):
            if code not in seen:
                seen.add(code)
                new.append(i)
        kept = part.take(pa.array(new, pa.int32()))
        return pa.record_batch(
            [kept.column("family"), kept.column("blocks"), pa.array([codes[i] for i in new], pa.int64()),
             pa.array([sets[i].tobytes() for i in new], pa.binary())], ["family", "blocks", "set_id", "grams"],
        )

    return _sets(
        docs, words, {"family": "bigint", "blocks": "map<int,int>", "set_id": "bigint", "grams": "binary"}, give)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``left`` and of ``right`` (None: ``left`` itself) with 100 * overlap >= percent * union."""
    rows = left if right is None else left + right
    sizes = np.array([len(r) for r in rows], np.int64)
    a, b = len(left), len(rows) - (0 if right is None else len(left))
    shift = 0 if right is None else a
    grams = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    held = np.diff(np.concatenate([first, [len(grams)]]))
    overlap = np.zeros((a, b), np.float32)
    flat = overlap.reshape(-1)
    for height in np.unique(held[(held > 1) & (held <= DENSE_COLUMN)]).tolist():
        i, j = np.triu_indices(height, 1)
        at = first[held == height]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(at), step):
            members = owner[at[k : k + step, None] + np.arange(height)]  # owners ascend within a column
            x, y = members[:, i].reshape(-1), members[:, j].reshape(-1)
            if right is not None:
                keep = (x < a) & (y >= a)
                x, y = x[keep], y[keep] - shift
            np.add.at(flat, x * b + y, 1)
    dense = np.flatnonzero(held > DENSE_COLUMN)
    step = max(256, (1 << 24) // max(len(rows), 1))
    for k in range(0, len(dense), step):
        part = dense[k : k + step]
        matrix = np.zeros((len(rows), len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), held[part])
        where = np.repeat(first[part] - np.concatenate([[0], np.cumsum(held[part])[:-1]]), held[part])
        matrix[owner[where + np.arange(len(where))], column] = 1
        overlap += matrix[:a] @ matrix[shift:].T
    x, y = np.nonzero(overlap)
    both = overlap[x, y].astype(np.int64)
    total = sizes[x] + sizes[y + shift] - both
    keep = (100 * both >= percent * total) & ((x < y) if right is None else True)
    return x[keep], y[keep]


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Links that suffice to connect what all links connect."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(x.tolist(), y.tolist()):
        p, q = root(i), root(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def _band(size: Column, percent: int) -> Column:
    starts = band_starts(percent, 1 << 40)
    return F.size(F.filter(F.array(*[F.lit(int(s)) for s in starts]), lambda s: s <= size)) - 1


def _spread(rows: DataFrame, percent: int) -> DataFrame:
    """Deal rows of the matrix to pairs of blocks.

    A family of one block (``blocks`` null) is one task. In a larger one, blocks are (size band, hash), as
    many for a band as ``blocks`` says, and a row goes to each pair of blocks that its block is part of:
    with blocks of its own band, of the next one and of the one before.
    """
    rows = rows.withColumn("band", F.when(F.col("blocks").isNotNull(), _band(F.length("grams") / 8, percent)).otherwise(0))
    count = lambda band: F.coalesce(F.try_element_at("blocks", band), F.lit(0))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("set_id"), F.greatest(count(F.col("band")), F.lit(1))).cast("int"))
    b, p, no, yes = F.col("band"), F.col("part"), F.lit(False), F.lit(True)

    def pair(low: Column, i: Column, high: Column, j: Column, left: Column) -> Column:
        return F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), left.alias("left"))

    def each(band: Column, one) -> Column:
        """``one`` for each block of a band, none if the family has none there."""
        return F.transform(F.filter(F.sequence(F.lit(0), count(band)), lambda o: o < count(band)), one)

    own = each(b, lambda o: pair(b, F.least(p, o), b, F.greatest(p, o), p <= o))
    above = each(b + 1, lambda o: pair(b, p, b + 1, o, yes))
    below = each(b - 1, lambda o: pair(b - 1, o, b, p, no))
    places = F.when(F.col("blocks").isNotNull(), F.concat(own, above, below)).otherwise(F.array(pair(b, p, b, p, yes)))
    return rows.withColumn("place", F.explode(places)).select("family", "place.*", "set_id", "grams")


KEYS = ["family", "low", "i", "high", "j"]


def _product(rows: DataFrame, percent: int) -> DataFrame:
    """``a, b``: for each pair of blocks a forest of the links between its sets."""

    def multiply(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(group.column("set_id").combine_chunks())
        left = np.asarray(group.column("left").combine_chunks().cast(pa.int8())).astype(bool)
        sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in group.column("grams").combine_chunks()]
        key = {k: group.column(k)[0].as_py() for k in KEYS}
        same = (key["low"], key["i"]) == (key["high"], key["j"])
        here, there = np.flatnonzero(left), np.flatnonzero(~left)
        if same:
            here = np.arange(len(ids))
        elif not (len(here) and len(there)):
            return
        out = []
        for p in range(0, len(here), BLOCK_ROWS):
            for q in range(p if same else 0, len(here) if same else len(there), BLOCK_ROWS):
                one = here[p : p + BLOCK_ROWS]
                two = (here if same else there)[q : q + BLOCK_ROWS]
                alone = same and p == q
                x, y = linked_pairs([sets[k] for k in one], None if alone else [sets[k] for k in two], percent)
                out += [(one[i], two[j]) for i, j in _block_forest(len(one), len(two), alone, x, y)]
        if out:
            pairs = _forest(len(ids), np.array([o[0] for o in out]), np.array([o[1] for o in out]))
            yield pa.record_batch(
                [pa.array(ids[[p[0] for p in pairs]]), pa.array(ids[[p[1] for p in pairs]])], ["a", "b"])

    def work(batches):
        yield from grouped(batches, KEYS, multiply)

    count = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return (
        rows.repartition(int(count), *KEYS).sortWithinPartitions(*KEYS, "set_id").mapInArrow(work, "a bigint, b bigint")
    )


def _block_forest(a: int, b: int, alone: bool, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the links of one block product, in its own row numbers."""
    if alone:
        return _forest(a, x, y)
    return [(i, j - a) for i, j in _forest(a + b, x, y + a)]


def linked_rows(docs: DataFrame, work: Workspace, words: int, percent: int) -> DataFrame:
    """``doc_id, text_code, n_shingles, root, component_id`` for each row; the root is null for empty sets."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_code", F.xxhash64("text"))
    base = work.keep(set_table(docs, words))
    family = components(candidate_links(key_table(docs, words, percent)), work)

    # One document stands for each set of a family; only the texts of these are read again.
    heads = base.filter("set_id is not null").join(family, base.set_id == family.node).groupBy("node", "root").agg(
        F.min(F.struct("doc_id", "text_code")).alias("head"), F.max("n_shingles").alias("n"))
    # Families of more than one block get a number of blocks for each size band.
    per_band = heads.groupBy("root", _band(F.col("n"), percent).alias("band")).agg(
        F.sum("n").alias("grams"), F.count("*").alias("rows"))
    blocks = F.greatest(F.ceil(F.col("grams") / BLOCK_GRAMS), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("int")
    large = (F.sum("grams") > BLOCK_GRAMS) | (F.sum("rows") > BLOCK_ROWS)
    per_family = per_band.groupBy("root").agg(
        large.alias("large"), F.map_from_entries(F.collect_list(F.struct("band", blocks))).alias("blocks")
    ).filter("large").drop("large")
    heads = work.keep(heads.join(per_family, "root", "left").select(
        F.col("head.doc_id").alias("head_id"), F.col("head.text_code").alias("head_code"),
        F.col("root").alias("family"), "blocks"))
    of_head = docs.text_code.eqNullSafe(heads.head_code) & docs.doc_id.eqNullSafe(heads.head_id)
    # The table of heads grows with the documents: it is joined by shuffling at every size.
    rows = gram_rows(docs.join(heads.hint("merge"), of_head).select("family", "blocks", "text"), words)
    links = work.keep(_product(_spread(rows, percent), percent))

    found = components(links, work)
    nodes = base.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    nodes = nodes.join(found, nodes.set_id == found.node, "left").select(
        "set_id", F.coalesce("root", "set_id").alias("root"), "doc_id")
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = nodes.join(least, "root").select("set_id", "root", "component_id")
    return base.join(named, "set_id", "left").select(
        "doc_id", "text_code", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, work: Workspace, words: int = 5, percent: int = 80) -> DataFrame:
    """Join ``docs(doc_id, text)`` with itself on Jaccard similarity of word n-grams >= percent / 100.

    Returns ``doc_id, n_shingles, component_id``, a row for each row of ``docs``: the size of its set of
    distinct n-grams (words between ASCII white space, A-Z lower-cased; fewer than n words are one
    n-gram), and the smallest doc_id that links reach, itself included. The result is exact: no link is
    lost, whatever the size of a group. Null and empty texts have empty sets, are linked with nothing and
    carry their own doc_id. Rows with equal text, repeated rows too, are linked; a null doc_id is passed
    over when the smallest is taken and stays null where a row has no partner with an id. Other columns
    are not read. An empty table gives an empty one.
    """
    return linked_rows(docs, work, words, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, work: Workspace, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one of each group of linked documents.

    The row with the smallest doc_id stays (null last, then the smallest code of the text), and one of rows
    that repeat it. Documents with empty sets all stay.
    """
    rows = work.keep(linked_rows(docs, work, words, percent).filter("root is not null"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_code")
    first = rows.groupBy("root").agg(F.min(order).alias("first"))
    rows = rows.join(first, "root").withColumn("stays", order == F.col("first"))
    # Rows are named by id and code; these tables grow with the documents and are joined by shuffling at every size.
    named = rows.groupBy("doc_id", "text_code").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    gone = work.keep(named.filter("not stays").select(F.col("doc_id").alias("id"), F.col("text_code").alias("code")))
    again = work.keep(named.filter("stays and n > 1").select(F.col("doc_id").alias("id"), F.col("text_code").alias("code")))
    this = F.expr("doc_id <=> id and xxhash64(text) = code")
    kept = docs.join(gone.hint("merge"), this, "left_anti")
    if not again.take(1):
        return kept
    every = [F.col(f"`{c}`") for c in docs.columns]
    place = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*every)))
    once = kept.join(again.hint("merge"), this, "left_semi").withColumn("_place", place).filter("_place = 1").drop("_place")
    return kept.join(again.hint("merge"), this, "left_anti").unionByName(once)
