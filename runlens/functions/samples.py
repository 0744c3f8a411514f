"""Small user functions used by the registered UDF queries (importable on executors)."""

from __future__ import annotations

import re


def word_len(word: str):
    """Length of a word; a word with a digit is an error; a one-letter word gives no output."""
    if re.search(r"[0-9]", word):
        raise ValueError(f"digit in {word!r}")
    if len(word) == 1:
        return None
    return len(word)


def name_words(name: str) -> int:
    """Number of words in a name; names with the word 'hot' are rejected."""
    parts = name.split(" ")
    if "hot" in parts:
        raise ValueError("hot parts are not accepted")
    return len(parts)


def judge_doc(text: str, quality: int, toxic: int) -> dict:
    """A deterministic critic: verdict, score and reasons for one document."""
    return {"verdict": "pass" if quality == 1 and toxic == 0 else "fail",
            "score": min(1.0, len(text) / 5000), "reasons": f"{len(text)} chars"}
