"""Phrase collocations: the trie against a Counter, and whole results against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from runlens.llm.collocations import HatTrie, collocations


@pytest.mark.parametrize("burst", [3, 1000])
def test_trie_counts_bursts_and_spills(burst):
    rng = np.random.default_rng(burst)
    trie, want, got = HatTrie(4, burst), Counter(), Counter()
    for size in (3, 4, 3):
        grams = rng.integers(1, 7, (800, size)).astype(np.int32)
        want.update(map(tuple, grams.tolist()))
        trie.add(np.pad(grams, ((0, 0), (0, 4 - size))))
        for rows, n in trie.spill(100):
            for k, v in zip(map(tuple, rows.tolist()), n.tolist()):
                got[k] += v
        assert trie.held <= 100 and trie.held == sum(trie.entries.values())
    for rows, n in trie.spill(-1):
        for k, v in zip(map(tuple, rows.tolist()), n.tolist()):
            got[k] += v
    assert got == want and trie.held == 0


def brute(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        longer = Counter()
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i:i + size]] = max(longer[p[i:i + size]], a)
        found = []
        for p, a in cands.items():
            if p in longer and 100 * longer[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def _rows():
    rng = random.Random(4)
    words = ["a", "B", "é", "cc", "the", "The", "x\x00", "-", "#", "ß"]
    rows = [(rng.choice(["aa", "bb", None, "und"]),
             "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(40))))
            for _ in range(150)]
    return rows + [("aa", None), (None, ""), ("cc", "...!?"), ("dd", "once"), ("aa", "new york city " * 300), ("bb", "hot pair " * 200)]


@pytest.mark.parametrize("options", [{}, {"chunk_words": 50, "split": 20, "bucket_words": 100, "word_bytes": 200, "burst": 4, "held": 30}])
def test_collocations_against_brute_force(spark, options):
    rows = _rows()
    df = spark.createDataFrame([(t, la, 1) for la, t in rows], "text string, lang string, word int").repartition(4)
    got = collocations(df, least=4, top=40, **options).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4, 40)


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
