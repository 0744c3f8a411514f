"""Phrase collocations by HAT-trie counting.

1. Texts become chunks of word numbers; a chunk gives its distinct words with counts
   as sorted runs, which are merged per partition of the words.  Words that are too
   rare for any candidate are left out from here on, the others get global ids by
   which everything is ordered; each chunk learns those of its own words.
2. A task counts the pairs of frequent words of a chunk in a HAT-trie: a shallow
   trie over word ids whose leaves are hash containers of the remaining ids.  A
   container that grows beyond ``burst`` entries bursts into a trie node with one
   container per next word; a trie that holds more than ``held`` entries spills its
   largest subtrees whole, as runs sorted by ids.
3. Runs are merged per prefix partition: a phrase belongs to the partition of its
   first word, of its first two words where the first word occurs more than
   ``split`` times, and of the whole phrase where the pair does.  Counts of prefixes
   are global, so all chunks agree and no prefix outgrows a partition.  Each chunk
   learns which of its pairs are frequent.
4. Phrases of three and four words are counted likewise at positions where all their
   pairs are frequent (a phrase is at most as frequent as its parts), and merged.
5. Scores, cuts and the rule on longer phrases are joins over the frequent phrases.

All counts cover all texts; only phrases below the threshold, which no result needs,
are ever left out.  Null and empty texts have no words; null languages are ``und``.
Rows are counted one by one, ids are not read, so null and repeated ids make no
difference; an empty table gives an empty result.  A chunk ends at a text's end,
so a task holds one text and ``chunk_words`` words at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_batches

# cutting characters become '.', tabs become spaces, A-Z become a-z
_TABLE = bytes(0x2E if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ENCODED = "chunk long, ids binary, bucket long, words array<binary>, packed binary"
_WORDS = "chunk long, packed binary, gid long, lang string, word string, f long"
_COUNTED = "chunk long, ids binary, gids binary, counts binary, bucket long, size int, packed binary"
_MERGED = "chunk long, size int, packed binary, gram array<long>, f long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _batch(schema: pa.Schema, rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type)
                                       for f in schema], schema=schema)


class _Numbers(dict):
    """Words of a language to numbers of the chunk; all languages share ``names``, a word's name being lang 0xFF word."""

    def __init__(self, lang: str, names: list):
        super().__init__({b".": 0})
        self.lang, self.names = lang.encode() + b"\xff", names

    def __missing__(self, word: bytes) -> int:
        self.names.append(self.lang + word)
        self[word] = n = len(self.names)
        return n


def _encode(chunk_words: int, buckets: int):
    """Chunks of word numbers (0 cuts), and the distinct words of a chunk as one sorted run per partition of the words."""
    schema = _schema(_ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, total, parts, names, tables = TaskContext.get().partitionId() << 33, 0, [], [], {}

        def done() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(parts)
            counts = np.bincount(ids, minlength=len(names) + 1)[1:].astype(np.int64)
            yield _batch(schema, 1, chunk=[no], ids=[ids.tobytes()])
            bucket = np.fromiter(map(crc32, names), np.int64, len(names)) % buckets
            for b, at in _grouped(bucket):
                at = np.array(sorted(at.tolist(), key=names.__getitem__))
                yield _batch(schema, 1, chunk=[no], bucket=[b], words=[[names[i] for i in at.tolist()]],
                             packed=[np.concatenate([at + 1, counts[at]]).tobytes()])
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = text.translate(_TABLE).replace(b".", b" . ").split()
                if lang not in tables:
                    tables[lang] = _Numbers(lang, names)
                ids = np.fromiter(map(tables[lang].__getitem__, tokens), np.int32, len(tokens))
                parts += [ids, np.zeros(1, np.int32)]
                total += len(tokens)
                if total >= chunk_words:
                    yield from done()
                    no, total, parts, names, tables = no + 1, 0, [], [], {}
        if parts:
            yield from done()
    return run


def _grouped(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, positions) of every group."""
    order = np.argsort(group, kind="stable")
    found, at = np.unique(group[order], return_index=True)
    return zip(found.tolist(), np.split(order, at[1:])) if len(group) else iter(())


def _merge_words(least: int):
    """Merge the words of one partition: frequent ones with their ids, all occurrences per language (word null), and for
    each chunk the numbers, ids and counts of its frequent words."""
    schema = _schema(_WORDS)

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        words = pa.chunked_array([c.flatten() for c in table.column("words").chunks])
        packed = [_ints(x).reshape(2, -1) for x in table.column("packed").to_pylist()]
        local, n = np.concatenate(packed, axis=1)
        chunk = np.repeat(table.column("chunk").to_numpy(), [x.shape[1] for x in packed])
        totals = pa.table({"w": words, "n": n}).group_by("w").aggregate([("n", "sum")]).sort_by("w")
        per_lang: dict[str, int] = {}
        names = totals.column("w").to_pylist()
        sums = totals.column("n_sum").to_numpy()
        for name, f in zip(names, sums.tolist()):
            lang = name.partition(b"\xff")[0].decode()
            per_lang[lang] = per_lang.get(lang, 0) + f
        out = [_batch(schema, len(per_lang), lang=list(per_lang), f=list(per_lang.values()))]
        rank = np.flatnonzero(sums >= least)
        if len(rank):
            split = [names[i].partition(b"\xff") for i in rank.tolist()]
            ids = bucket << 32 | rank
            out.append(_batch(schema, len(rank), gid=ids, lang=[x[0].decode() for x in split], word=[x[2].decode() for x in split],
                              f=sums[rank]))
            at = pc.index_in(words, totals.column("w").take(pa.array(rank)).combine_chunks()).to_numpy(zero_copy_only=False)
            known = np.flatnonzero(~np.isnan(at.astype(float)))
            which = at[known].astype(np.int64)
            for c, some in _grouped(chunk[known]):
                out.append(_batch(schema, 1, chunk=[c], packed=[np.concatenate(
                    [local[known[some]], ids[which[some]], sums[rank[which[some]]]]).tobytes()]))
        return pa.Table.from_batches(out, schema)
    return run


class HatTrie:
    """Counts of id sequences of one width: first id, then the rest as bytes of big-endian ids; id 0 fills up shorter ones.

    ``roots`` maps a first id to a container (Counter of rests) or, once that burst, to a node: a dict of the next id
    to a container of what follows it.
    """

    def __init__(self, width: int, burst: int):
        self.width, self.burst, self.roots, self.entries = width, burst, {}, {}
        self.held = 0

    def add(self, grams: np.ndarray) -> None:
        """Count rows of ids; rows are put in order of their first two ids."""
        grams = grams[np.argsort(grams[:, 0].astype(np.int64) << 32 | grams[:, 1], kind="stable")]
        rests = np.ascontiguousarray(grams[:, 1:].astype(">u4")).view(f"V{4 * (self.width - 1)}").ravel().tolist()
        firsts, at = np.unique(grams[:, 0], return_index=True)
        ends = [*at[1:].tolist(), len(grams)]
        for first, a, b in zip(firsts.tolist(), at.tolist(), ends):
            root = self.roots.get(first)
            if root is None:
                root = self.roots[first] = Counter()
            before = self.entries.get(first, 0)
            if type(root) is Counter:
                root.update(rests[a:b])
                size = len(root)
                if size > self.burst and self.width > 2:
                    self.roots[first] = self._burst(root)
            else:
                size = before
                for next_id, i, j in self._runs(grams[a:b, 1], a):
                    leaf = root.setdefault(next_id, Counter())
                    size -= len(leaf)
                    leaf.update(r[4:] for r in rests[i:j])
                    size += len(leaf)
            self.entries[first] = size
            self.held += size - before

    @staticmethod
    def _runs(ids: np.ndarray, base: int) -> Iterator[tuple[bytes, int, int]]:
        found, at = np.unique(ids, return_index=True)
        ends = [*(at[1:] + base).tolist(), base + len(ids)]
        return zip((int(x).to_bytes(4, "big") for x in found), (at + base).tolist(), ends)

    @staticmethod
    def _burst(root: Counter) -> dict:
        node: dict[bytes, Counter] = {}
        for rest, n in root.items():
            node.setdefault(rest[:4], Counter())[rest[4:]] = n
        return node

    def spill(self, down_to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out the largest subtrees until ``down_to`` entries are left: (rows of ids, counts), one pair per length."""
        firsts, sizes, keys, counts = [], [], [], []
        for first in sorted(self.entries, key=self.entries.__getitem__, reverse=True):
            if self.held <= down_to:
                break
            size = self.entries.pop(first)
            self.held -= size
            root = self.roots.pop(first)
            firsts.append(first)
            sizes.append(size)
            if type(root) is Counter:
                keys.extend(root)
                counts.extend(root.values())
            else:
                for head, leaf in root.items():
                    keys.extend(head + rest for rest in leaf)
                    counts.extend(leaf.values())
        if not firsts:
            return
        rest = np.frombuffer(b"".join(keys), ">u4").reshape(-1, self.width - 1)
        n = np.array(counts, np.int64)
        del keys, counts
        rows = np.column_stack([np.repeat(np.array(firsts, np.int32), sizes), rest.astype(np.int32)])
        length = (rows > 0).sum(axis=1)
        for k in np.unique(length):
            yield rows[length == k, :k], n[length == k]


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _ints(packed: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(packed, kind)


class _Pairs:
    """Frequent pairs of a chunk by their numbers in the chunk, with their counts in all texts."""

    def __init__(self, gids: np.ndarray, answers: list[bytes]):
        tables = [_ints(a).reshape(3, -1) for a in answers] or [np.zeros((3, 0), np.int64)]
        a, b, f = np.concatenate(tables, axis=1)
        keys = (np.searchsorted(gids, a) + 1) << 32 | (np.searchsorted(gids, b) + 1)
        order = np.argsort(keys)
        self.keys, self.f = np.append(keys[order], np.iinfo(np.int64).max), np.append(f[order], 0)

    def counts(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.f[at], 0)


def _sorted_runs(chunk: int, grams: np.ndarray, n: np.ndarray, gids: np.ndarray, counts: np.ndarray, pairs: _Pairs | None,
                 buckets: int, split: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Counted phrases as one run per prefix partition, sorted by global ids: the id columns, then the counts."""
    by_id = gids[grams - 1]
    hashed = _mix(np.zeros(len(n), np.uint64), by_id[:, 0])
    hot = counts[grams[:, 0] - 1] > split
    if hot.any():
        two = _mix(hashed, by_id[:, 1])
        hashed = np.where(hot, two, hashed)
        if pairs is not None:
            hot &= pairs.counts(grams[:, 0], grams[:, 1]) > split
            whole = two
            for k in range(2, by_id.shape[1]):
                whole = _mix(whole, by_id[:, k])
            hashed = np.where(hot, whole, hashed)
    bucket = (_mix(hashed, hashed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort([*by_id.T[::-1], bucket])
    by_id, n, bucket = by_id[order], n[order], bucket[order]
    found, at = np.unique(bucket, return_index=True)
    for no, a, b in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(n)]):
        packed = np.concatenate([by_id[a:b].T.ravel(), n[a:b]]).tobytes()
        yield _batch(schema, 1, chunk=[chunk], bucket=[no], size=[by_id.shape[1]], packed=[packed])


def _count(sizes: tuple[int, ...], buckets: int, split: int, burst: int, held: int, batch: int = 1 << 18):
    """Count the phrases of the given sizes of every chunk and give sorted runs; with size 2 also the chunk in frequent words."""
    schema = _schema(_COUNTED)

    def frequent_words(ids: np.ndarray, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunk in numbers of its frequent words in the order of their global ids (0: a cut or a rare word)."""
        local, gids, f = np.concatenate([np.zeros((3, 0), np.int64), *[_ints(a).reshape(3, -1) for a in answers]], axis=1)
        order = np.argsort(gids)
        number = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
        number[local[order]] = np.arange(1, len(gids) + 1, dtype=np.int32)
        return number[ids], gids[order], f[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {f.name: b.column(k)[i].as_py() for k, f in enumerate(b.schema)}
                chunk, pairs, ids = row["chunk"], None, _ints(row["ids"], np.int32)
                if sizes == (2,):
                    ids, gids, counts = frequent_words(ids, row["answers"] or [])
                    yield _batch(schema, 1, chunk=[chunk], ids=[ids.tobytes()], gids=[gids.tobytes()], counts=[counts.tobytes()])
                else:
                    gids, counts = _ints(row["gids"]), _ints(row["counts"])
                    pairs = _Pairs(gids, row["answers"] or [])
                del row
                good = (ids[:-1] > 0) & (ids[1:] > 0)
                if pairs is not None:
                    at = np.flatnonzero(good)
                    good[at] = pairs.counts(ids[at], ids[at + 1]) > 0
                width = max(sizes)
                trie = HatTrie(width, burst)

                def runs(down_to: int) -> Iterator[pa.RecordBatch]:
                    for grams, n in trie.spill(down_to):
                        yield from _sorted_runs(chunk, grams, n, gids, counts, pairs, buckets, split, schema)
                alive = good
                for size in range(2, max(sizes) + 1):
                    if size > 2:
                        alive = alive[:-1] & good[size - 2:]
                    if size in sizes:
                        starts = np.flatnonzero(alive)
                        for a in range(0, len(starts), batch):
                            some = starts[a:a + batch]
                            trie.add(np.column_stack([ids[some + k] if k < size else np.zeros(len(some), np.int32)
                                                      for k in range(width)]))
                            if trie.held > held:
                                yield from runs(held // 2)
                yield from runs(-1)
    return run


def _merge(least: int, reply: bool):
    """Merge the runs of a prefix partition: phrases found ``least`` times, and for each chunk those that it has."""
    schema = _schema(_MERGED)

    def run(table: pa.Table) -> pa.Table:
        out = []
        for size in sorted(set(table.column("size").to_pylist())):
            rows = [(r["chunk"], _ints(r["packed"]).reshape(size + 1, -1)) for r in
                    table.select(["chunk", "size", "packed"]).to_pylist() if r["size"] == size]
            cols = np.concatenate([r[1] for r in rows], axis=1)
            chunk = np.repeat(np.array([r[0] for r in rows], np.int64), [r[1].shape[1] for r in rows])
            del rows
            order = np.lexsort(cols[:-1][::-1])     # a stable sort that makes use of the runs
            cols, chunk = cols[:, order], chunk[order]
            new = np.append(True, (cols[:-1, 1:] != cols[:-1, :-1]).any(axis=0))
            total = np.add.reduceat(cols[-1], np.flatnonzero(new))
            frequent = total >= least
            heads = cols[:-1, new][:, frequent]
            flat = pa.array(heads.T.ravel())
            grams = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), flat)
            out.append(_batch(schema, len(grams), size=np.full(len(grams), size, np.int32), gram=grams, f=total[frequent]))
            if reply:
                f = total[np.cumsum(new) - 1]
                keep = f >= least
                chunk, ids, f = chunk[keep], cols[:-1, keep], f[keep]
                order = np.argsort(chunk, kind="stable")
                chunk, ids, f = chunk[order], ids[:, order], f[order]
                found, at = np.unique(chunk, return_index=True)
                ends = [*at[1:].tolist(), len(f)]
                out.append(_batch(schema, len(found), chunk=found, packed=[
                    np.concatenate([ids[:, a:b].ravel(), f[a:b]]).tobytes() for a, b in zip(at.tolist(), ends)]))
        return pa.Table.from_batches(out, schema)
    return run


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int, lang_col: str = "lang", text_col: str = "text",
                     chunk_words: int = 1 << 20, split: int = 1 << 20, bucket_words: int = 2 << 20, word_bytes: int = 16 << 20, burst: int = 4096,
                     held: int = 1 << 19) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (gid, lang, word, f) and phrases of 2 to 4 words (gram: list of gid, f) found ``least`` times per language,
    and all word occurrences per language (lang, n)."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    with arrow_batches(spark):
        n_bytes = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        encoded = scratch.keep(read.mapInArrow(_encode(chunk_words, max(1, -(-n_bytes // word_bytes))), _ENCODED), "encoded")
        listed = encoded.where("bucket IS NOT NULL").select("chunk", "bucket", "words", "packed")
        counted = scratch.keep(listed.groupBy("bucket").applyInArrow(_merge_words(least), _WORDS), "words")
        totals = counted.where("lang IS NOT NULL AND gid IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
        words = counted.where("gid IS NOT NULL").select("gid", "lang", "word", "f")
        buckets = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // bucket_words))
        known = counted.where("packed IS NOT NULL").groupBy("chunk").agg(F.collect_list("packed").alias("answers"))
        chunks = encoded.where("ids IS NOT NULL").select("chunk", "ids").join(known, "chunk", "left")
        pairs = scratch.keep(chunks.mapInArrow(_count((2,), buckets, split, burst, held), _COUNTED), "pairs")
        scratch.drop("encoded")
        runs = pairs.where("bucket IS NOT NULL").select("chunk", "bucket", "size", "packed")
        merged = scratch.keep(runs.groupBy("bucket").applyInArrow(_merge(least, True), _MERGED), "pairs-merged")
        told = merged.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list("packed").alias("answers"))
        chunks = pairs.where("ids IS NOT NULL").select("chunk", "ids", "gids", "counts").join(told, "chunk", "left")
        longer = scratch.keep(chunks.mapInArrow(_count((3, 4), buckets, split, burst, held), _COUNTED), "longer")
        scratch.drop("pairs")
        runs = longer.select("chunk", "bucket", "size", "packed")
        more = scratch.keep(runs.groupBy("bucket").applyInArrow(_merge(least, False), _MERGED), "longer-merged")
        scratch.drop("longer")
    grams = merged.where("gram IS NOT NULL").select("gram", "f").union(more.select("gram", "f"))
    return words, grams, totals


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, swallow_percent: int = 80, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language by the score of their weakest cut."""
    scratch = Scratch(docs.sparkSession, "collocations")
    words, grams, totals = frequent_phrases(docs, scratch, least, **options)
    wide = "decimal(38,0)"
    parts = grams.where(F.size("gram") < 4).union(words.select(F.array("gid"), "f"))
    cuts = grams.select("gram", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k")) \
        .select("gram", "a", "k", F.slice("gram", 1, F.col("k")).alias("head"),
                F.expr("slice(gram, k + 1, size(gram) - k)").alias("tail"))
    scored = cuts.join(parts.toDF("head", "l"), "head").join(parts.toDF("tail", "r"), "tail") \
        .withColumn("score", F.expr(f"(cast(2000000 as {wide}) * a) div (cast(l as decimal(20,0)) + r)")) \
        .groupBy("gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = grams.where(F.size("gram") > 2).select("f", F.explode(F.expr(
        "flatten(transform(sequence(2, size(gram) - 1), n -> transform(sequence(1, size(gram) - n + 1), i -> slice(gram, i, n))))"))
        .alias("gram")).groupBy("gram").agg(F.max("f").alias("longer"))
    free = scored.join(inside, "gram", "left").where(F.expr(
        f"longer IS NULL OR cast(100 as {wide}) * longer < cast({swallow_percent} as {wide}) * a"))
    named = free.withColumn("gid", F.element_at("gram", 1)).join(words.select("gid", "lang"), "gid") \
        .select("lang", "gram", "a", "cut.score", "cut.l", "cut.r")
    ahead = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scratch.keep(named.withColumn("place", F.rank().over(ahead)).where(F.col("place") <= top).drop("place"), "best")
    spelled = best.select("gram", F.posexplode("gram").alias("at", "gid")).join(words.select("gid", "word"), "gid") \
        .groupBy("gram").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))),
                                                          lambda x: x["word"])).alias("phrase"))
    ranked = best.join(spelled, "gram").withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
