"""Cut texts where a tokenizer certainly cuts them, so that pieces can be encoded once and looked up afterwards.

Both kinds of vocabulary used here first cut a text at its special strings and then at white space. A blank or line
feed that stands before a character that is not white space always begins a new pre-token, so a text's ids are those
of its pieces in turn. Pieces recur very often; a bounded dictionary holds what the last ones gave.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np

SLICE = 1 << 20
BLANK = re.compile(r"[ \n](?=\S)")
ODD = re.compile(r"[ \n](?=\s|\Z)")
BEFORE = re.compile(r"(?=[ \n]\S)")


class Specials:
    """The special strings of a tokenizer's JSON: matched in the raw text, leftmost first, then longest."""

    def __init__(self, spec: dict):
        added = spec.get("added_tokens") or []
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special strings that are normalized, stripped or whole words only aren't supported")
        self.ids = {t["content"]: t["id"] for t in added}
        found = "|".join(map(re.escape, sorted(self.ids, key=len, reverse=True)))
        self.cut = re.compile(f"({found})") if found else None

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of text with -1, and special strings with their ids."""
        if self.cut is None or not any(s in text for s in self.ids):
            yield text, -1
            return
        for part in self.cut.split(text):
            if part:
                yield part, self.ids.get(part, -1)


def slices(text: str) -> Iterator[str]:
    """Stretches of about a million characters, cut where pieces begin; bounds what is held for a very long text."""
    at = 0
    while len(text) - at > SLICE:
        found = BLANK.search(text, at + SLICE)
        if not found or found.start() == at:
            break
        yield text[at : found.start()]
        at = found.start()
    if at < len(text):
        yield text[at:]


def blank_pieces(text: str) -> list[str]:
    """Pieces that each begin with their blank or line feed, except perhaps the first. Joined they give the text."""
    if ODD.search(text):
        return BEFORE.split(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    out = [p if p[0] == "\n" else " " + p for p in rest]
    if first:
        out.insert(0, first)
    return out


def word_pieces(text: str) -> list[str]:
    """Pieces without blanks and line feeds, for vocabularies that drop white space."""
    return [p for p in text.replace("\n", " ").split(" ") if p]


class Memo:
    """Values of keys. Two generations bound it: when the newer is full it replaces the older, and keys still in use move up."""

    def __init__(self, solve: Callable[[list[str]], list], most: int, longest: int = 100):
        self.solve, self.most, self.longest, self.new, self.old = solve, most, longest, {}, {}

    def values(self, keys: list[str]) -> list:
        out = list(map(self.new.get, keys))
        gaps = [i for i, v in enumerate(out) if v is None]
        if gaps:
            absent = {keys[i] for i in gaps}
            fresh = {k: v for k in absent if (v := self.old.get(k)) is not None}
            missing = [k for k in absent if k not in fresh]
            fresh.update(zip(missing, self.solve(missing)))
            for i in gaps:
                out[i] = fresh[keys[i]]
            if len(self.new) + len(fresh) > self.most:
                self.old, self.new = self.new, {}
            self.new.update((k, v) for k, v in fresh.items() if len(k) <= self.longest)
        return out


class PieceCoder:
    """Values of texts from values of pieces, and those from values of pre-tokens; both are remembered.

    cut gives a text's pieces, split a piece's pre-tokens; solve gives the values of new pre-tokens, special that of a
    special string, join combines values. Among pieces a special string is a tuple of its id: normalised text may read like one.
    """

    HELD = 1 << 21

    def __init__(self, specials: Specials, cut: Callable, split: Callable, solve: Callable, special: Callable, join: Callable):
        self.specials, self.cut, self.split, self.special, self.join = specials, cut, split, special, join
        self.words = Memo(solve, 300_000)
        self.pieces = Memo(self._from_words, 400_000)

    def _from_words(self, pieces: list[str | tuple[int]]) -> list:
        split = [[] if isinstance(p, tuple) else self.split(p) for p in pieces]
        values = self.words.values([w for ws in split for w in ws])
        out, at = [], 0
        for p, ws in zip(pieces, split):
            if len(ws) == 1:
                out.append(values[at])
            else:
                out.append(self.special(*p) if isinstance(p, tuple) else self.join(values[at : at + len(ws)]))
            at += len(ws)
        return out

    def _pieces(self, text: str) -> Iterator[list[str | tuple[int]]]:
        for part, special in self.specials.parts(text):
            if special >= 0:
                yield [(special,)]
            else:
                yield from map(self.cut, slices(part))

    def many(self, texts: Iterable[str]) -> Iterator:
        """The value of each text. Texts of about two million characters are looked up together; a longer one goes slice by slice."""
        held, size = [], 0
        for text in texts:
            if len(text) > self.HELD:
                yield from self._together(held)
                held, size = [], 0
                yield self.join([self.join(self.pieces.values(p)) for p in self._pieces(text)])
                continue
            held.append(text)
            size += len(text)
            if size > self.HELD:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator:
        flat, ends = [], []
        for text in texts:
            for p in self._pieces(text):
                flat += p
            ends.append(len(flat))
        values, at = self.pieces.values(flat), 0
        for end in ends:
            yield self.join(values[at:end])
            at = end


def four_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


#: How the public vocabularies cut text into pre-tokens.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class WordCutter:
    """What a vocabulary with word ends does before it merges: compose, lower each character, cut by its pattern, spell bytes as letters."""

    def __init__(self, spec: dict):
        import regex

        steps, cuts, model = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"], spec["model"]
        found = [n["type"] for n in steps], [c["type"] for c in cuts], cuts[0].get("behavior"), cuts[0].get("invert"), steps[1].get("pattern"), cuts[1].get("use_regex"), cuts[1].get("add_prefix_space")
        if found != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], "Removed", True, {"Regex": r"\s+"}, False, False) or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("a vocabulary that composes, lowers and cuts words by one pattern is needed")
        self.find = regex.compile(cuts[0]["pattern"]["Regex"]).findall
        self.letters = [byte_letters()[b] for b in range(256)]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text:  # the library lowers a sigma alike at any place
                return "".join(c.lower() for c in text)
        return text.lower()

    def __call__(self, piece: str) -> list[str]:
        """The pre-tokens of a piece that is normal already. Most are letters, with one sign at most behind them."""
        if piece.isalpha():
            return [piece]
        if piece[:-1].isalpha() and piece[-1] in ".,":
            return [piece[:-1], piece[-1]]
        return self.find(piece)

    def pieces(self, text: str) -> list[str]:
        return word_pieces(self.normal(text))

    def spelt(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode()))


class LibraryEncoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian unsigned 32-bit bytes. The library merges each new word."""

    def __init__(self, blob: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(blob)
        self.model, self.cutter = Tokenizer.from_str(blob).model, WordCutter(spec)
        self.coder = PieceCoder(Specials(spec), self.cutter.pieces, self.cutter, self._solve, lambda i: four_bytes([i]), b"".join)

    def _solve(self, words: list[str]) -> list[bytes]:
        spelt, tokenize = self.cutter.spelt, self.model.tokenize
        return [four_bytes([t.id for t in tokenize(spelt(w))]) for w in words]

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        return self.coder.many(texts)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class ByteEncoder:
    """Ids of whole texts for a byte-level vocabulary whose ids rank its merges: tiktoken merges them several times as fast.

    The ids are those that the tokenizers library gives for the same file; the vocabulary is checked to be of that kind.
    tiktoken's pattern engine fails on very long runs of white space, so these are cut out and merged without it: all of a run
    is one pre-token but for its last character where something else follows.
    """

    LONG_RUN = 10_000

    def __init__(self, blob: str):
        import regex
        import tiktoken

        spec = json.loads(blob)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        back = {ord(c): b for b, c in byte_letters().items()}
        letters = {b: model["vocab"][c] for b, c in byte_letters().items()}
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(set(made)) or made[0] <= max(letters.values()):
            raise ValueError("the ids of this vocabulary don't rank its merges")
        ranks = {bytes(token.translate(back).encode("latin-1")): i for token, i in model["vocab"].items()}
        self.specials = Specials(spec)
        self.engine = tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.runs = regex.compile(rf"\p{{White_Space}}{{{self.LONG_RUN},}}").finditer

    def _part(self, part: str) -> Iterator[bytes]:
        at = 0
        for run in self.runs(part) if len(part) >= self.LONG_RUN else ():
            end = run.end() - (run.end() < len(part))
            yield from (four_bytes(self.engine.encode_ordinary(s)) for s in slices(part[at : run.start()]))
            yield four_bytes(self.engine._encode_single_piece(part[run.start() : end].encode()))
            at = end
        yield from (four_bytes(self.engine.encode_ordinary(s)) for s in slices(part[at:] if at else part))

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            parts = ([four_bytes([special])] if special >= 0 else self._part(part) for part, special in self.specials.parts(text))
            yield b"".join(ids for part in parts for ids in part)


_made: dict = {}


def once(kind: type, blob: str):
    """One instance for each process, so that a reused worker keeps what it has learnt of frequent pieces."""
    key = (kind, hash(blob))
    if key not in _made:
        _made.clear()
        _made[key] = kind(blob)
    return _made[key]
