"""Count tokens by rank-synchronous merging of ragged arrays.

Pre-tokens not seen lately are laid end to end in one array of symbols. In each round every pre-token finds the lowest
rank among its pairs and merges all places of that pair at once; those without a mergeable pair leave. What is left
of each is its count. Merges made together can't change the order of merges, because a pair that holds a new
symbol always ranks behind the pair that made it, which is checked when the vocabulary is read.

Null and empty texts have no tokens. Repeated rows are counted each. Special strings in a text count as one token.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, vocabulary_path
from .encoding import map_texts
from .pieces import BYTE_LEVEL_PATTERN, PieceCoder, Specials, blank_pieces, byte_letters

LIMIT = 512
NONE = np.int64(1 << 60)


class PairTable:
    """Rank and outcome of pairs of symbols, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        self.bits = int(4 * len(left)).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int64)
        self.made = np.full(1 << self.bits, -1, np.int64)
        keys = left << 32 | right
        waiting, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(waiting):
            at = slot[waiting]
            free = self.keys[at] < 0
            _, first = np.unique(at, return_index=True)
            win = np.zeros(len(waiting), bool)
            win[first] = True
            win &= free
            w = waiting[win]
            self.keys[slot[w]], self.rank[slot[w]], self.made[slot[w]] = keys[w], w, made[w]
            waiting = waiting[~win]
            slot[waiting] = slot[waiting] + 1 & (1 << self.bits) - 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs, -1 for those that don't merge."""
        keys = left << 32 | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, slot, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        at = slot[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            at = at + 1 & (1 << self.bits) - 1
            held = self.keys[at]
            same = held == keys[open_]
            out[open_[same]] = at[same]
            go = ~same & (held >= 0)
            open_, at = open_[go], at[go]
        return out


class RankCounter:
    """Token counts for a byte-level vocabulary given as a tokenizer's JSON."""

    def __init__(self, blob: str):
        import regex

        spec = json.loads(blob)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or model["ignore_merges"]:
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], "".join))
        first = np.full(max(vocab.values()) + 1, -1, np.int64)
        first[made[::-1]] = np.arange(len(made))[::-1]
        last = np.full(len(first), -1, np.int64)
        last[made] = np.arange(len(made))
        if (first != last).any() or (np.maximum(last[left], last[right]) >= np.arange(len(made))).any():
            raise ValueError("a pair of this vocabulary ranks before the merges that make it")
        self.pairs = PairTable(left, right, made)
        self.letters = np.array([vocab[byte_letters()[b]] for b in range(256)], np.int64)
        self.coder = PieceCoder(Specials(spec), blank_pieces, regex.compile(BYTE_LEVEL_PATTERN).findall, self.counts, lambda _: 1, sum)

    def counts(self, words: list[str]) -> list[int]:
        raw = [w.encode() for w in words]
        out = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.letters[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), out)
        while len(symbols) > 1:
            slot = self.pairs.find(symbols[:-1], symbols[1:])
            rank = np.where((slot >= 0) & (owner[1:] == owner[:-1]), self.pairs.rank[slot], NONE)
            rank = np.append(rank, NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            hit = np.flatnonzero((rank == lowest) & (rank < NONE))
            if len(hit):  # of hits that overlap, as in aaa, every other one from the left
                run = np.append(True, hit[1:] != hit[:-1] + 1)
                hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
            done = lowest == NONE
            out[owner[starts]] = lengths
            keep = ~done
            keep[hit + 1] = False
            symbols = symbols.copy()
            symbols[hit] = self.pairs.made[slot[hit]]
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            out[owner[0]] = len(symbols)
        return out.tolist()

    def many(self, texts):
        return self.coder.many(texts)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    sized = [F.col("doc_id"), F.octet_length("text").cast("long").alias("n_bytes")]
    counted = map_texts(rows, "text", sized, vocabulary, RankCounter, lambda n: [(n,)], "n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
