"""Pair encoding for a cross-encoder and the surface for pluggable scorers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST, LONGEST = 512, 100
# Fixed names of the special tokens.
PAD, UNKNOWN, START, SEPARATOR = "[PAD]", "[UNK]", "[CLS]", "[SEP]"


def basic_tokens(text: str) -> list[str]:
    """Lower-cased words without accents; ideographs and punctuation stand alone."""
    out, word = [], ""
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn" or (kind[0] == "C" and c not in "\t\n\r"):
            continue
        alone = kind[0] in "PS" and (kind[0] == "P" or ord(c) < 128) or 0x3400 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF or 0x20000 <= ord(c) <= 0x2FA1F
        if alone or c.isspace():
            out += [word] if word else []
            out += [c] if alone else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def pieces(word: str, vocabulary: dict[str, int]) -> list[str]:
    """Longest known pieces from the left, later ones marked ##; unknown as a whole if one is missing."""
    if len(word) > LONGEST:
        return [UNKNOWN]
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            return [UNKNOWN]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def encode_pair(query: str, candidate: str, vocabulary: dict[str, int], most: int = MOST) -> tuple[list[int], list[int], list[int]]:
    """Ids, mask and segment of a pair, padded; the longer side is cut, on a tie the candidate."""
    a, b = ([p for w in basic_tokens(t) for p in pieces(w, vocabulary)] for t in (query, candidate))
    while len(a) + len(b) > most - 3:
        (a if len(a) > len(b) else b).pop()
    tokens = [START, *a, SEPARATOR, *b, SEPARATOR]
    ids = [vocabulary.get(t, vocabulary.get(UNKNOWN, 0)) for t in tokens]
    rest = most - len(ids)
    return ids + [vocabulary.get(PAD, 0)] * rest, [1] * len(ids) + [0] * rest, [0] * (len(a) + 2) + [1] * (len(b) + 1) + [0] * rest


def encode_pairs(query: Column, candidate: Column, vocabulary: dict[str, int], most: int = MOST) -> Column:
    """STRUCT<input_ids, attention_mask, token_type_ids> of pairs; a vocabulary does not grow with the data."""

    @F.pandas_udf("struct<input_ids:array<int>,attention_mask:array<int>,token_type_ids:array<int>>")
    def run(q: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = [encode_pair(x or "", y or "", vocabulary, most) for x, y in zip(q, c, strict=True)]
        return pd.DataFrame(rows, columns=["input_ids", "attention_mask", "token_type_ids"])

    return run(query, candidate)
