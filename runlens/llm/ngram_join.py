"""Near-duplicate classes by an exact n-gram Jaccard join.

Each document is a row of a sparse document by n-gram incidence matrix A, and
the join is the part of A times its transpose that reaches the threshold.

1. Chunks exchange packed n-gram names and learn the logarithm of each name's
   document count.  With rare names first, two linked documents share a name
   in the first n - ceil(t n) + 1 of each (the size-derived prefix); names that
   occur once are left out.
2. Documents with equal sets are one row.  Rows that share a prefix name may be
   linked; they are dealt into blocks of bounded size so that rows with common
   names mostly meet in one block, and every pair of blocks that has a name in
   common becomes one tile.
3. A tile multiplies the whole incidence rows of its two blocks, accumulates the
   overlap counts and discards pairs below the bound that follows from the two
   set sizes.  Of the links it keeps a spanning forest and each row's number, so that a
   group of many near copies leaves as many rows as it has documents, not pairs.
4. The forests are joined to components, the numbers of links are added up.

Nothing is approximate: prefix and tiles only leave out pairs that cannot
reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PACKED, chunk_table, packed_rows, with_answers
from .common import Scratch, components, slices
from .suffix_dedup import _mix

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U32 = np.uint64(0xFFFFFFFF)
_BUCKET_NAMES = 4 << 20     # names that one bucket sorts, about
_BLOCK_ROWS = 1024          # documents in a block
_BLOCK_NAMES = 1 << 20      # n-grams in a block, about
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(n, base, dtype=np.uint64)
            t[:1] = 1
            _TABLES[name] = np.multiply.accumulate(t)
    return _TABLES["up"], _TABLES["down"]


def _lower() -> tuple[np.ndarray, np.ndarray]:
    if "value" not in _TABLES:
        value = np.random.default_rng(5).integers(1, 2**64, 256, dtype=np.uint64)
        value[65:91] = value[97:123]
        space = np.zeros(256, dtype=bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        _TABLES["value"], _TABLES["space"] = value, space
    return _TABLES["value"], _TABLES["space"]


def shingle_sets(body: bytes, sizes, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram names of each text, texts one after the other: (names, text numbers), sorted by text, then name.

    Words are runs of anything but the six ASCII white-space characters, A-Z in
    lower case; a text of fewer than ``width`` words has its whole sequence as one name.
    """
    value, space = _lower()
    names, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    sizes = np.asarray(sizes, dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    for lo, hi in slices(sizes.tolist(), 1 << 20):
        a = np.frombuffer(body, np.uint8, int(sizes[lo:hi].sum()), int(starts[lo]))
        up, down = _powers(len(a) + 1)
        blank = np.ones(len(a) + 1, dtype=bool)
        blank[:-1] = space[a]
        first = np.zeros(len(a) + 1, dtype=bool)   # a text begins here
        first[starts[lo:hi][sizes[lo:hi] > 0] - starts[lo]] = True
        opens = ~blank & (np.concatenate(([True], blank[:-1])) | first)
        at = np.flatnonzero(opens)
        if not len(at):
            continue
        ends = np.flatnonzero(~blank[:-1] & (blank[1:] | first[1:])) + 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[a] * up[:len(a)])))
        word = _mix((total[ends] - total[at]) * down[at] + (ends - at).astype(np.uint64))
        owner = np.searchsorted(starts[lo:hi] + sizes[lo:hi] - starts[lo], at, side="right") + lo
        m = max(0, len(word) - width + 1)
        whole = owner[:m] == owner[width - 1:width - 1 + m] if m else np.zeros(0, bool)
        h = np.full(m, width, dtype=np.uint64)
        for k in range(width):
            h = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + word[k:k + m])
        h, o = h[whole], owner[:m][whole]
        texts, begin, count = np.unique(owner, return_index=True, return_counts=True)
        extra, extra_o = [], []
        for t, b, c in zip(texts[count < width], begin[count < width], count[count < width]):
            x = np.array([c], dtype=np.uint64)
            for w in word[b:b + c]:
                x = _mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + w)
            extra.append(x[0])
            extra_o.append(t)
        h = np.concatenate((h, np.array(extra, dtype=np.uint64)))
        o = np.concatenate((o, np.array(extra_o, dtype=np.int64)))
        order = np.lexsort((h, o))
        h, o = h[order], o[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        names.append(h[new])
        owners.append(o[new])
    return np.concatenate(names), np.concatenate(owners)


def _names(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = (((h & _U32) % np.uint64(buckets)) << np.uint64(32)) | (h >> np.uint64(32))
    return np.unique(key, return_inverse=True, return_counts=True)


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sort one bucket's names; answer each with 0 if one document holds it, else the logarithm of how many do."""
    names = [np.frombuffer(b, "<u4") for b in pdf["packed"]]
    cut = np.cumsum([len(x) // 2 for x in names])[:-1]
    every = np.concatenate([x[:len(x) // 2] for x in names])
    times = np.concatenate([x[len(x) // 2:] for x in names]).astype(np.int64)
    _, back = np.unique(every, return_inverse=True)
    total = np.bincount(back, weights=times)
    level = np.where(total < 2, 0, np.floor(np.log2(np.maximum(total, 2)))).astype(np.uint8)[back]
    return pdf[["chunk", "kind", "bucket"]].assign(levels=[x.tobytes() for x in np.split(level, cut)])


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75,
                    chunk_bytes: int = 4 << 20) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, n_links.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    n-gram sets; ``component_id`` is the smallest id reachable by links, itself
    included.  Documents without words (null texts too) have no set and link
    with nothing.  Rows with the same id are one vertex.  A row with a null id
    links like any other but cannot name a component; where no row of a
    component has an id, component_id is null.  ``n_links`` counts the other rows
    that a row's set links with directly, rows with equal sets included; rows are
    counted one by one also where ids repeat.  Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunk_table(docs, scratch, chunk_bytes)
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    buckets = max(shards, ceil(total / 6 / _BUCKET_NAMES))

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                u, _, n = _names(shingle_sets(row.body, row.sizes, width)[0], buckets)
                yield from packed_rows(row.chunk, 0, u >> np.uint64(32), (u & _U32).astype("<u4"), n.astype("<u4"))

    levels = scratch.keep(chunks.select("chunk", "sizes", "body").mapInPandas(offer, PACKED).groupBy("bucket")
                          .applyInPandas(_count, "chunk long, kind int, bucket long, levels binary"), "levels")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                h, owner = shingle_sets(row.body, row.sizes, width)
                u, back, _ = _names(h, buckets)
                told = sorted((a for a in row.answers if a is not None), key=lambda a: a["bucket"]) if len(u) else []
                level = np.frombuffer(b"".join(a["levels"] for a in told), np.uint8)
                if len(level) != len(u):
                    raise RuntimeError("answers do not fit the names of the chunk")
                level = level[back] if len(u) else np.zeros(0, np.uint8)
                docs_n = len(row.sizes)
                n = np.bincount(owner, minlength=docs_n)
                begin = np.cumsum(n) - n
                order = np.lexsort((h, level, owner))     # within a text: rare names first, then by name
                rank = np.arange(len(h)) - begin[owner]
                need = n - -(-n * percent // 100) + 1
                use = (rank < need[owner]) & (level[order] > 0)
                tie, tie_o = h[order][use], owner[use]
                cut = np.searchsorted(tie_o, np.arange(1, docs_n))
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(h * np.uint64(k))))) for k in (3, 7)]
                sig = [(s[begin + n] - s[begin]).astype(np.int64) for s in sums]
                yield pd.DataFrame({"id": list(row.ids), "n": n, "cls": sig[0], "check": sig[1], "chunk": row.chunk,
                                    "pos": np.arange(docs_n, dtype=np.int32),
                                    "ties": np.split(tie.astype(np.int64), cut)})

    told = with_answers(chunks, levels, "bucket", "levels") \
        .withColumn("ids", F.col("ids").cast("array<string>"))
    described = told.select("chunk", "ids", "sizes", "body", "answers").mapInPandas(
        describe, "id string, n long, cls long, check long, chunk long, pos int, ties array<long>")
    sets = _told_apart(scratch.keep(described.withColumn("id", F.col("id").cast(id_type)), "sets"), scratch)
    links = _links(sets, chunks, scratch, width, percent, shards)

    # rows with one id are one vertex, whatever their sets
    same = sets.where("n > 0 and id is not null").groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")) \
        .where("a <> z").select("id", "a")
    same = sets.where("n > 0").join(same, "id").select(F.col("cls").alias("a"), F.col("a").alias("b")).where("a <> b")
    joined = components(links.select("a", "b").unionByName(same), scratch)
    degree = links.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    classes = sets.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"), F.count("*").alias("copies")) \
        .join(degree, "cls", "left")
    named = classes.join(joined, classes["cls"] == joined["id"], "left").select(
        "cls", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "cls").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("cls", "component_id", "n_links")
    some = F.col("n") > 0
    return sets.join(named, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(some, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.when(some, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def _told_apart(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Sets are equal where both 64-bit sums are: where a first sum is shared, the class takes in the second one too."""
    shared = sets.where("n > 0").groupBy("cls").agg(F.min("check").alias("first"), F.max("check").alias("last")) \
        .where("first <> last").select("cls", "first")
    if shared.isEmpty():
        return sets
    own = F.when((F.col("n") > 0) & (F.col("check") != F.col("first")), F.xxhash64("cls", "check")).otherwise(F.col("cls"))
    return scratch.keep(sets.join(shared, "cls", "left").withColumn("cls", own).drop("first"), "apart")


def _links(sets: DataFrame, chunks: DataFrame, scratch: Scratch, width: int, percent: int, shards: int) -> DataFrame:
    """Links between different sets, tile by tile: (class a, least class b of its tree there, links of a in rows)."""
    entry = sets.select(F.explode("ties").alias("name"), "cls")
    lists = entry.groupBy("name").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high")
    rows = scratch.keep(entry.join(lists.select("name", "low"), "name").select("name", "cls", "low").distinct(), "rows")
    # rows that share names take one label, from list to row and back once more
    root = rows.groupBy("cls").agg(F.min("low").alias("root"))
    near = rows.join(root, "cls").groupBy("name").agg(F.min("root").alias("root"))
    root = rows.select("name", "cls").join(near, "name").groupBy("cls").agg(F.min("root").alias("root"))
    where = sets.where("n > 0").groupBy("cls").agg(F.min(F.struct("chunk", "pos", "n")).alias("at"),
                                                   F.count("*").alias("copies")) \
        .select("cls", "at.chunk", "at.pos", "at.n", "copies")
    placed = scratch.keep(root.join(where, "cls"), "placed")
    room = placed.groupBy("root").agg(F.ceil(F.greatest(
        F.count("*") / _BLOCK_ROWS, F.sum("n") / _BLOCK_NAMES)).alias("parts"))
    placed = scratch.keep(placed.join(room, "root").select(
        "cls", "chunk", "pos", "n", "copies",
        F.xxhash64("root", F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("block")), "blocks")
    met = rows.select("name", "cls").join(placed.select("cls", "block"), "cls").select("name", "block").distinct()
    tiles = met.join(met.select("name", F.col("block").alias("other")), "name").where("block <= other") \
        .select("block", "other").distinct().withColumn("tile", F.xxhash64("block", "other"))
    tiles = scratch.keep(tiles, "tiles")
    parts = tiles.select("tile", "block", F.lit(0).alias("side")).union(
        tiles.where("block <> other").select("tile", "other", F.lit(1)))

    # the whole sets of the rows that may link, read again from their chunks
    ask = placed.groupBy("chunk").agg(F.collect_list(F.struct("pos", "cls", "copies", "block")).alias("asked"))
    told = chunks.join(ask.hint("shuffle_hash"), "chunk").select("sizes", "body", "asked")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                sizes = np.asarray(row.sizes, dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                asked = sorted(row.asked, key=lambda r: r["pos"])
                body = b"".join(row.body[starts[r["pos"]]:starts[r["pos"]] + sizes[r["pos"]]] for r in asked)
                h, owner = shingle_sets(body, [sizes[r["pos"]] for r in asked], width)
                cut = np.searchsorted(owner, np.arange(1, len(asked)))
                yield pd.DataFrame({"cls": [r["cls"] for r in asked], "copies": [r["copies"] for r in asked],
                                    "block": [r["block"] for r in asked], "names": [x.tobytes() for x in np.split(h, cut)]})

    full = told.mapInPandas(whole, "cls long, copies long, block long, names binary")
    links = full.join(parts, "block").select("tile", "side", "cls", "copies", "names").groupBy("tile") \
        .applyInPandas(_tile(percent), "a long, b long, links long")
    return scratch.keep(links, "links")


def _tile(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        alone = not len(right)
        if alone:
            right = left
        a, b = ([np.frombuffer(x, "<u8") for x in side["names"]] for side in (left, right))
        over = overlaps(a, b)
        union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - over
        link = (over > 0) & (100 * over >= percent * union)
        ids, other = left["cls"].to_numpy(), right["cls"].to_numpy()
        copies, others = left["copies"].to_numpy(), right["copies"].to_numpy()
        la, lb = _forest(link, ids, other)
        weight = link.astype(np.int64)
        # the copies of a set itself are counted outside the tiles
        out = np.stack((ids, la, weight @ others - copies * alone), 1)
        if not alone:
            out = np.concatenate((out, np.stack((other, lb, copies @ weight), 1)))
        return pd.DataFrame(out[out[:, 2] > 0], columns=["a", "b", "links"])
    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Overlap counts of two blocks of sets: names held by many rows by dense column blocks, the rest entry by entry."""
    names = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    _, name = np.unique(names, return_inverse=True)
    mine = row < len(a)
    n_a, n_b = np.bincount(name[mine], minlength=name.max() + 1), np.bincount(name[~mine], minlength=name.max() + 1)
    out = np.zeros(len(a) * len(b), dtype=np.int64)
    dense = n_a * n_b > 64
    place = np.cumsum(dense) - 1
    for lo in range(0, int(dense.sum()), columns):
        pick = dense[name] & (place[name] >= lo) & (place[name] < lo + columns)
        m = np.zeros((len(a) + len(b), columns), dtype=np.float32)
        m[row[pick], place[name[pick]] - lo] = 1
        out += np.rint(m[:len(a)] @ m[len(a):].T).astype(np.int64).ravel()
    # entry by entry: each entry of the left block meets the right entries of its name
    rest = ~dense & (n_a > 0) & (n_b > 0)
    la, lb = mine & rest[name], ~mine & rest[name]
    order = np.argsort(name[lb], kind="stable")
    rows_b, begin = row[lb][order] - len(a), np.cumsum(n_b * rest) - n_b * rest
    rows_a, name_a = row[la], name[la]
    for lo in range(0, len(rows_a), 1 << 16):
        ra, na = rows_a[lo:lo + (1 << 16)], name_a[lo:lo + (1 << 16)]
        k = n_b[na]
        at = np.repeat(begin[na], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out += np.bincount(np.repeat(ra, k) * len(b) + rows_b[at], minlength=len(out))
    return out.reshape(len(a), len(b))


def _forest(link: np.ndarray, ids: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of both sides the least row reachable over the links of a tile."""
    la, lb = ids.copy(), other.copy()
    top = np.iinfo(np.int64).max
    while True:
        nb = np.minimum(lb, np.where(link, la[:, None], top).min(axis=0))
        na = np.minimum(la, np.where(link, nb[None, :], top).min(axis=1))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb
