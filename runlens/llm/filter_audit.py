"""Audit of how quality filters interact, with exact duplicates found by radix text tries.

1. Every task computes the filter conditions of its documents as bits and inserts
   whole texts into a compressed trie (radix tree over bytes) that holds, at a
   text's terminal, the smallest id and how many rows carry it.  A trie that holds
   ``trie_bytes`` of text is emptied, so a task sends each distinct text about
   once, however many copies it has.
2. Distinct texts are range-partitioned by adaptive prefixes: a prefix whose
   texts exceed ``range_bytes`` is lengthened until they do not.  What is left is
   one text sent by very many tasks; its rows are merged in dealt groups first.
3. Each range is inserted into a trie of its own.  Traversing it yields the rows
   that have no smaller id with the same text; every other row is a duplicate.
4. Masks are reduced to counts per part, mask and label; permutations and steps
   are computed from at most 32 masks a part.

The four conditions on a text are given by ``CONDITIONS``; E is "identical to the
text of a smaller id, table-wide".  Null texts are empty texts.  A row without id
is smaller than none and has none smaller, so it never fails E; rows with equal
ids and equal texts do not make each other fail.  A document is good (toxic) if
any label row of its id says so; null languages and '' are one part.  An empty
table gives an empty result.  Only named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_batches

LETTERS = "ABCDE"
DUPLICATE = 1 << LETTERS.index("E")
_CAPITALS = bytes(range(0x41, 0x5B))
_CONTINUATION = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"
_STEPS = (8, 32, 128, 512, 2048, 8192, 1 << 30)   # prefix lengths in bytes; the last is the whole text
_HEAD = 32                                        # prefixes up to here have a column of their own
_LEAST_KEY = 1 << 16                              # bytes of text that a key may stand for in any table
_FAN_IN = 64                                      # rows of one text that a merge takes at least
_LOCAL = "id long, part string, mask int, rows long, text binary, head binary, size long"
_LOCAL_ARROW = pa.schema([("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("rows", pa.int64()),
                          ("text", pa.binary()), ("head", pa.binary()), ("size", pa.int64())])


def conditions(text: bytes) -> int:
    """Bits A to D of a text.  Words end at the six ASCII white-space characters, as bytes.split() has it."""
    words = text.split()
    points = len(text.translate(None, _CONTINUATION))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 \
        | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > 3 * points) << 2 \
        | (len(text.translate(None, _SIGNS)) < len(text)) << 3


class Node:
    """A trie node: the bytes on its edge, its children by first byte and, where a text ends, its smallest id."""

    __slots__ = ("edge", "kids", "least", "rows")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.least, self.rows = edge, {}, None, None


class TextTrie:
    """Compressed trie over whole texts; a terminal keeps the smallest id and its rows by tag."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, text: bytes, least: int, tag: tuple, rows: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.held += len(text) - at
            elif not text.startswith(kid.edge, at):
                kid = self._split(node, kid, text, at)
            node, at = kid, at + len(kid.edge)
        if node.rows is None or least < node.least:
            node.least, node.rows = least, {tag: rows}
        elif least == node.least:
            node.rows[tag] = node.rows.get(tag, 0) + rows

    @staticmethod
    def _split(parent: Node, kid: Node, text: bytes, at: int) -> Node:
        """Put a node where ``text`` leaves the edge of ``kid``; the border is found by bisection."""
        same, differs = 1, min(len(kid.edge), len(text) - at) + 1
        while differs - same > 1:
            mid = (same + differs) // 2
            if text.startswith(kid.edge[:mid], at):
                same = mid
            else:
                differs = mid
        upper = Node(kid.edge[:same])
        parent.kids[text[at]] = upper
        kid.edge = kid.edge[same:]
        upper.kids[kid.edge[0]] = kid
        return upper

    def terminals(self) -> Iterator[tuple[bytes, Node]]:
        stack = [(b"", self.root)]
        while stack:
            path, node = stack.pop()
            path += node.edge
            if node.rows is not None:
                yield path, node
            stack.extend((path, kid) for kid in node.kids.values())


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``limit`` bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[4] or b"")
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _emptied(trie: TextTrie) -> Iterator[tuple]:
    for text, node in trie.terminals():
        for (part, mask), rows in node.rows.items():
            yield node.least, part, mask, rows, text, text[:_HEAD], len(text)


def _local(trie_bytes: int):
    """Per document (id, part, mask, 1) without text, and per distinct text its rows with the smallest id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            trie = TextTrie()
            for batch in batches:
                for ident, part, text in zip(*(c.to_pylist() for c in batch.columns)):
                    mask = conditions(text)
                    yield ident, part, mask, 1, None, None, 0
                    if ident is not None:
                        trie.insert(text, ident, (part, mask), 1)
                        if trie.held > trie_bytes:
                            yield from _emptied(trie)
                            trie = TextTrie()
            yield from _emptied(trie)
        return _batches(rows(), _LOCAL_ARROW)
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One trie over all rows of a range."""
    trie = TextTrie()
    for batch in batches:
        for ident, part, mask, rows, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            trie.insert(text, ident, (part, mask), rows)
    return _batches(_emptied(trie), _LOCAL_ARROW)


def _prefix(n: int) -> Column:
    return F.col("head") if n == _HEAD else F.substring("head" if n < _HEAD else "text", 1, n)


def prefix_keys(texts: DataFrame, scratch: Scratch, range_bytes: int) -> tuple[DataFrame, int]:
    """``texts`` with ``key``, the shortest prefix of the steps whose texts fit into ``range_bytes``, and the number of
    prefix steps in use.

    The tables of heavy prefixes have fewer rows than there are ranges, since each stands for more than one range.
    """
    left, key, used = texts, None, 0
    heavy_tables = []
    for k, n in enumerate(_STEPS):
        used = k + 1
        if n == _STEPS[-1]:
            break
        sums = left.groupBy(_prefix(n).alias(f"p{k}")).agg(F.sum("size").alias("bytes"))
        heavy = scratch.keep(sums.where(F.col("bytes") > range_bytes).select(f"p{k}"), f"heavy-{k}")
        if heavy.isEmpty():
            break
        heavy_tables.append((n, heavy))
        left = left.join(heavy, _prefix(n) == F.col(f"p{k}"), "left_semi")
    out = texts
    for k, (n, heavy) in enumerate(heavy_tables):
        out = out.join(heavy, _prefix(n) == F.col(f"p{k}"), "left")
        here = F.when(F.col(f"p{k}").isNull(), _prefix(n))
        key = here if key is None else F.coalesce(key, here)
    last = _prefix(_STEPS[used - 1])
    return out.withColumn("key", last if key is None else F.coalesce(key, last)) \
        .drop(*[f"p{k}" for k in range(len(heavy_tables))]), used


def _thinned(texts: DataFrame, scratch: Scratch, range_bytes: int) -> DataFrame:
    """Merge the rows of single texts that exceed a range, in dealt groups of about ``_FAN_IN`` rows, until none does."""
    for k in range(60):
        heavy = texts.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")) \
            .where((F.col("bytes") > range_bytes) & (F.col("rows") > _FAN_IN)).select(
            F.col("key").alias("hot"), F.ceil(F.col("rows") / _FAN_IN).alias("groups"))
        heavy = scratch.keep(heavy, f"hot-{k}")
        if heavy.isEmpty():
            return texts
        dealt = texts.join(heavy, F.col("key") == F.col("hot"), "left")
        hot = dealt.where("hot IS NOT NULL").withColumn("deal", (F.rand(k) * F.col("groups")).cast("long"))
        # a lost task may deal its rows anew: the dealt rows are written before they are merged
        hot = scratch.keep(hot.select("key", "deal", *_LOCAL_ARROW.names), f"dealt-{k}")
        names = ", ".join(_LOCAL_ARROW.names)
        merged = hot.repartition("key", "deal").select(*_LOCAL_ARROW.names).mapInArrow(_merged, _LOCAL)
        texts = scratch.keep(dealt.where("hot IS NULL").selectExpr("key", *names.split(", ")).unionByName(
            merged.withColumn("key", F.col("text"))), f"thin-{k}")
    raise RuntimeError("rows of single texts did not thin out")


def first_rows(local: DataFrame, scratch: Scratch, range_bytes: int) -> DataFrame:
    """Of the locally distinct texts the rows that no smaller id precedes: id, part, mask, rows."""
    texts = local.where("text IS NOT NULL")
    total = texts.agg(F.sum("size")).first()[0] or 0
    # keys are finer than ranges where the table is small, so that its ranges can still be even
    keyed, steps = prefix_keys(texts, scratch, min(range_bytes, max(total // 256, _LEAST_KEY)))
    if steps == len(_STEPS):
        keyed = _thinned(keyed, scratch, range_bytes)
    # texts are spread over twice the ranges, so that unequal ones stay near the size
    ranges = max(-(-2 * total // range_bytes), int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartitionByRange(ranges, "key").select(*_LOCAL_ARROW.names).mapInArrow(_merged, _LOCAL) \
        .select("id", "part", "mask", "rows")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang",
                trie_bytes: int = 32 << 20, range_bytes: int = 32 << 20) -> DataFrame:
    """Documents, good and toxic ones per part and mask of failed filters: part, mask, n, good, toxic."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "filter-audit")
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    with arrow_batches(spark):
        local = scratch.keep(read.mapInArrow(_local(trie_bytes), _LOCAL), "local")
        firsts = scratch.keep(first_rows(local, scratch, range_bytes), "firsts")
    every = local.where("text IS NULL").select("id", "part", "mask", F.lit(1).alias("all"),
                                               F.col("id").isNull().cast("long").alias("first"))
    seen = every.unionByName(firsts.select("id", "part", "mask", F.lit(0).alias("all"), F.col("rows").alias("first"))) \
        .groupBy("id", "part", "mask").agg(F.sum("all").alias("all"), F.sum("first").alias("first"))
    known = labels.select(F.col("doc_id").alias("of"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")) \
        .where("of IS NOT NULL").groupBy("of").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    named = seen.join(known, F.col("id") == F.col("of"), "left")
    split = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("first").alias("n")),
        F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("all") - F.col("first")).alias("n")))).alias("m")
    return named.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
                        split).where("m.n > 0").groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.n").alias("n"), F.sum(F.when(F.col("good"), F.col("m.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("m.n")).otherwise(0)).alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """Every order of the five filters, step by step, from the counts per part and mask."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    each = counts.select("*", F.explode(orders).alias("filter_order"))

    def bit(step) -> Column:
        return F.expr(f"shiftleft(1, locate(substring(filter_order, {step}, 1), '{LETTERS}') - 1)")
    fails = [F.col("mask").bitwiseAND(bit(s)) > 0 for s in range(1, 6)]
    goes = F.coalesce(*[F.when(f, F.lit(s)) for s, f in enumerate(fails, 1)], F.lit(6))
    steps = each.withColumn("goes", goes).withColumn("fails", F.array(*fails)) \
        .select("*", F.posexplode("fails").alias("at", "failing")).withColumn("step", F.col("at") + 1)
    here = F.col("goes") == F.col("step")

    def total(cond: Column, of: str = "n") -> Column:
        return F.sum(F.when(cond, F.col(of)).otherwise(0))
    out = steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("goes") > F.col("step")).alias("kept"), total(here).alias("removed"),
        total(F.col("failing") & (F.col("goes") < F.col("step"))).alias("redundant"),
        total(F.col("mask") == bit("step")).alias("unique_fails"), total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", bit("step"))))
