"""BPE by backtracking: longest token matches from an Aho-Corasick automaton, accepted where neighbours are compatible.

A chain of tokens is what the merges of a word give if and only if every two neighbours stay apart when merged alone.
So a word is read from the left; at each place the longest token is tried first, and a dead end marks its place as no
boundary and takes the next shorter token before it. Each place dies at most once, which keeps the time linear.
Decoding copies slices of one table by offsets.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import read_vocabulary, table, text_or_empty, vocabulary_path
from .encoding import map_texts
from .pieces import PieceCoder, Specials, WordCutter, byte_letters, four_bytes

NEVER = 1 << 60
BLOCK = 1 << 16
WORD_END = "</w>"
#: A last letter with the word's end is one letter, this much further on.
MARK = 0x1000


class Compatible:
    """Whether the merges of two tokens laid side by side leave them apart; answers are kept, up to a bound."""

    def __init__(self, left: list[int], right: list[int], rank: list[int], pairs: dict[tuple[int, int], int]):
        self.left, self.right, self.rank, self.pairs, self.known = left, right, rank, pairs, {}

    def __call__(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= 400_000:
                self.known.clear()
            found = self.known[a, b] = self.apart(a, b, NEVER)
        return found

    def apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge across the border of a and b ranks before until, when all inner merges take place in order."""
        rank = self.rank
        outer_a, outer_b = [a], [b]  # the tokens at the border, from whole to single letters
        while rank[outer_a[-1]] >= 0:
            outer_a.append(self.right[outer_a[-1]])
        while rank[outer_b[-1]] >= 0:
            outer_b.append(self.left[outer_b[-1]])
        i, j = len(outer_a) - 1, len(outer_b) - 1
        while True:
            taken_a = rank[outer_a[i - 1]] if i else NEVER
            taken_b = rank[outer_b[j - 1]] if j else NEVER
            across = self.pairs.get((outer_a[i], outer_b[j]), NEVER)
            if across < until and across < taken_a and across <= taken_b:  # of equal ranks the one further left comes first
                return False
            if not i and not j:
                return True
            if taken_a <= taken_b:
                i -= 1
            else:
                j -= 1


class BacktrackingEncoder:
    """Ids of whole texts for a vocabulary with word ends, as little-endian unsigned 32-bit bytes."""

    def __init__(self, blob: str):
        spec = json.loads(blob)
        model = spec["model"]
        if model["end_of_word_suffix"] != WORD_END or model.get("dropout"):
            raise ValueError(f"a vocabulary with the word end {WORD_END} is needed")
        vocab, base = model["vocab"], list(byte_letters().values())
        spelt = {vocab[c]: c for c in base} | {vocab[c + WORD_END]: chr(ord(c) + MARK) for c in base}
        size = max(vocab.values()) + 1
        left, right, rank = [-1] * size, [-1] * size, [-1] * size
        pairs: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in spelt or max(rank[x], rank[y]) >= n or x not in spelt or y not in spelt:
                raise ValueError("each token must be made by one merge of tokens made before it")
            spelt[z], left[z], right[z], rank[z], pairs[x, y] = spelt[x] + spelt[y], x, y, n, n
        self.compatible = Compatible(left, right, rank, pairs)
        whole = [rank[t] < 0 for t in range(size)]
        self.matcher = ahocorasick.Automaton()
        for t in sorted(spelt, key=lambda t: rank[t]):
            if rank[t] >= 0:  # a token that its own merges can't reach never occurs
                whole[t] = whole[left[t]] and whole[right[t]] and self.compatible.apart(left[t], right[t], rank[t])
            if whole[t]:
                self.matcher.add_word(spelt[t][::-1], (t, len(spelt[t])))
        self.matcher.make_automaton()
        self.longest = max(map(len, spelt.values()))
        self.cutter = WordCutter(spec)
        self.coder = PieceCoder(Specials(spec), self.cutter.pieces, self.cutter, lambda words: [self.word(w) for w in words], lambda i: four_bytes([i]), b"".join)

    def _starts(self, letters: str, at: int) -> list[list[tuple[int, int]]]:
        """The tokens that begin at each place of a block, longest first: ends of matches in the reversed letters."""
        part = letters[at : at + BLOCK + self.longest - 1]
        out: list[list[tuple[int, int]]] = [[] for _ in range(min(BLOCK, len(letters) - at))]
        last = len(part) - 1
        for end, found in self.matcher.iter(part[::-1]):
            if last - end < len(out):
                out[last - end].append(found)
        return out

    def word(self, word: str) -> bytes:
        spelt = self.cutter.spelt(word)
        letters = spelt[:-1] + chr(ord(spelt[-1]) + MARK)
        size, blocks, dead = len(letters), {}, set()
        tokens: list[tuple[int, int, int]] = []  # token, its length, which of its place's matches it is
        at = tried = 0
        while at < size:
            first = at // BLOCK * BLOCK
            if first not in blocks:
                if len(blocks) > 3:
                    blocks.clear()
                blocks[first] = self._starts(letters, first)
            matches = blocks[first][at - first]
            before = tokens[-1][0] if tokens else -1
            while tried < len(matches):
                t, n = matches[tried]
                if at + n not in dead and (before < 0 or self.compatible(before, t)):
                    break
                tried += 1
            if tried < len(matches):
                tokens.append((t, n, tried))
                at, tried = at + n, 0
            else:
                dead.add(at)
                _, n, tried = tokens.pop()
                at, tried = at - n, tried + 1
        return four_bytes([t for t, _, _ in tokens])

    def many(self, texts):
        return self.coder.many(texts)


class SliceTable:
    """Strings laid end to end; those of many ids are copied out together by their offsets."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.offset = np.cumsum(self.size) - self.size

    def join(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        shift = np.repeat(self.offset[ids] - (ends - size), size)
        return self.data[shift + np.arange(len(shift))].tobytes()


class Decoder:
    """What a tokenizer without a decoder makes of ids: its tokens joined by blanks."""

    STEP = 1 << 18

    def __init__(self, blob: str):
        spec = json.loads(blob)
        if spec.get("decoder") is not None:
            raise ValueError("a vocabulary without a decoder of its own is needed")
        tokens = spec["model"]["vocab"] | Specials(spec).ids
        strings = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            strings[i] = token.encode() + b" "
        self.tokens = SliceTable(strings)
        self.numbers = SliceTable([b"%d " % i for i in range(len(strings))])

    def chunks(self, kind: SliceTable, ids: np.ndarray):
        """The joined strings in stretches; the last without its blank."""
        for at in range(0, len(ids), self.STEP):
            part = kind.join(ids[at : at + self.STEP])
            yield part if at + self.STEP < len(ids) else part[:-1]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.chunks(self.tokens, ids)).decode()


def sha256_of(parts) -> str:
    digest = hashlib.sha256()
    for part in parts:
        digest.update(part)
    return digest.hexdigest()


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (little-endian, 32 bits each) and the decoded text of each document."""
    rows, blob = docs.select("doc_id", text_or_empty().alias("text")), read_vocabulary(vocabulary)
    made: list[Decoder] = []

    def row(ids: bytes) -> list[tuple]:
        made or made.append(Decoder(blob))
        return [(ids, made[0].decode(np.frombuffer(ids, "<u4")))]

    return map_texts(rows, "text", ["doc_id"], vocabulary, BacktrackingEncoder, row, "ids binary, decoded string")


class RoundTrip(BacktrackingEncoder):
    """For each text the count of its ids, and the sha256 of the ids as text and of the decoded text."""

    def __init__(self, blob: str):
        super().__init__(blob)
        self.decoder = Decoder(blob)

    def many(self, texts):
        for ids in map(lambda b: np.frombuffer(b, "<u4"), super().many(texts)):
            d = self.decoder
            yield len(ids), sha256_of(d.chunks(d.numbers, ids)), sha256_of(d.chunks(d.tokens, ids))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return map_texts(docs, "text", ["doc_id"], vocabulary_path("word_bpe_49k.json"), RoundTrip, lambda r: [r], "n_tokens long, ids_sha256 string, decoded_sha256 string")
