"""Packing, encoding, table shards and token counts against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from wayfare.llm import bpe, packing, sstable, token_counts  # noqa: E402
from wayfare.llm.common import new_dir, read_vocabulary, vocabulary_path  # noqa: E402
from wayfare.llm.encoding import map_texts  # noqa: E402
from wayfare.llm.pieces import ByteEncoder, LibraryEncoder, Memo, four_bytes  # noqa: E402

BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
LETTERS = ["a", "b", " ", " ", "\n", "\t", "'s", "1", "é", "́", "Σ", "<|endoftext|>", "<|startoftext|>", "　", "\x1c", "\x85", "中", "!", "  ", "\n\n", "İ", "ﬁ", "\r", "😀", "aaa", "th", "ation", "</w>", ".", ","]


def odd_texts(count, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(16))) for _ in range(count)] + ["ab" * 9000, "aaaaabaaa" * 1500, " " * 5000 + "x", "\n \n" * 3000]


@pytest.mark.parametrize("kind, path", [(ByteEncoder, BYTE), (LibraryEncoder, WORD), (bpe.BacktrackingEncoder, WORD)])
def test_encoders_equal_the_library(kind, path):
    texts, library = odd_texts(4000, 1), Tokenizer.from_file(path)
    for text, ids in zip(texts, kind(read_vocabulary(path)).many(texts)):
        assert ids == four_bytes(library.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("kind", [LibraryEncoder, bpe.BacktrackingEncoder])
def test_text_that_lowers_to_a_special_string_is_text(kind):
    texts, library = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "<|StartOfText|>\n<|startoftext|> <|ENDOFTEXT|>", "a <|ENDOFTEXT|> b"], Tokenizer.from_file(WORD)
    coder = kind(read_vocabulary(WORD))
    for order in (texts, texts[::-1]):
        for text, ids in zip(order, coder.many(order)):
            assert ids == four_bytes(library.encode(text, add_special_tokens=False).ids), text


def test_counts_equal_the_library():
    texts, library = odd_texts(4000, 2), Tokenizer.from_file(BYTE)
    assert list(token_counts.RankCounter(read_vocabulary(BYTE)).many(texts)) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_texts_go_in_slices():
    text = ("word and\n more. " * 400_000)[: 5 << 20]
    coder = LibraryEncoder(read_vocabulary(WORD))
    whole = next(iter(coder.many([text])))
    assert whole == b"".join(coder.many([text[: 1 << 20].rsplit(" ", 1)[0], text[len(text[: 1 << 20].rsplit(" ", 1)[0]) :]]))


LONG_RUNS = {"blanks": " " * 2_000_000 + "x y", "tabs": "a\t" + "\t" * 2_000_000, "lines": "two words" + "\n" * 2_000_000 + "end", "mixed": "w " * 50 + " \r\n\u2003" * 400_000 + " w"}


@pytest.mark.parametrize("name", LONG_RUNS)
def test_long_white_space_equals_the_library(name):
    text = LONG_RUNS[name]
    byte, word = (Tokenizer.from_file(p).encode(text, add_special_tokens=False).ids for p in (BYTE, WORD))
    assert next(iter(ByteEncoder(read_vocabulary(BYTE)).many([text]))) == four_bytes(byte)
    assert next(iter(token_counts.RankCounter(read_vocabulary(BYTE)).many([text]))) == len(byte)
    for kind in (LibraryEncoder, bpe.BacktrackingEncoder):
        assert next(iter(kind(read_vocabulary(WORD)).many([text]))) == four_bytes(word)


def test_runs_of_any_length_equal_the_library(monkeypatch):
    monkeypatch.setattr(ByteEncoder, "LONG_RUN", 2)
    library, coder = Tokenizer.from_file(BYTE), ByteEncoder(read_vocabulary(BYTE))
    texts = odd_texts(3000, 9)
    for text, ids in zip(texts, coder.many(texts)):
        assert ids == four_bytes(library.encode(text, add_special_tokens=False).ids), text


def test_long_white_space_is_packed(spark):
    text = "word " * 600 + " " * 1_000_000 + "word " * 600
    docs = spark.createDataFrame([(1, text), (1, text), (2, "\t" * 1_500_000)], "doc_id long, text string")
    got = packing.packed_documents(docs, BYTE, keep_ids=True).orderBy("doc_id", "start").collect()
    for i, t, copies in ((1, text, 2), (2, "\t" * 1_500_000, 1)):
        ids = Tokenizer.from_file(BYTE).encode(t, add_special_tokens=False).ids + [1]
        pieces = {(r["start"], bytes(r["ids"])) for r in got if r["doc_id"] == i}
        assert b"".join(p for _, p in sorted(pieces)) == four_bytes(ids)
        assert sum(r["length"] for r in got if r["doc_id"] == i) == copies * len(ids)


def test_decoding_equals_the_library():
    library, decoder = Tokenizer.from_file(WORD), bpe.Decoder(read_vocabulary(WORD))
    decoder.STEP = 7
    for text in odd_texts(500, 3):
        ids = library.encode(text, add_special_tokens=False).ids
        assert decoder.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_memo_forgets_but_stays_right():
    memo = Memo(lambda keys: [k * 2 for k in keys], 5)
    rng = random.Random(4)
    for _ in range(200):
        keys = [str(rng.randrange(30)) for _ in range(8)]
        assert memo.values(keys) == [k * 2 for k in keys]
    assert len(memo.new) + len(memo.old) <= 26


def test_bpe_query_form(spark, odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(WORD)
    got = map_texts(odd_docs, "text", ["doc_id"], WORD, bpe.RoundTrip, lambda r: [r], "n_tokens long, ids_sha256 string, decoded_sha256 string")
    want = Counter()
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert bpe.encoded(odd_docs, WORD).count() == len(odd_rows)
    assert bpe.encoded(no_docs, WORD).count() == 0


def test_token_counts(spark, odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(BYTE)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in odd_rows)
    assert Counter(map(tuple, token_counts.token_counts(odd_docs, BYTE).collect())) == want
    assert token_counts.token_counts(no_docs, BYTE).count() == 0


def by_key(rows):
    """doc_id, ids with the end id, and ids before, in the order of shards: null first, then by doc_id, then by the hash of the text."""
    import xxhash

    library, start, out = Tokenizer.from_file(WORD), 0, []
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    for i, t in sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        ids = four_bytes(library.encode(t, add_special_tokens=False).ids + [2])
        out.append((i, start, ids))
        start += len(ids) // 4
    return out


def test_table_shards(spark, odd_docs, odd_rows, no_docs):
    directory = new_dir(spark, "sst-test")
    manifest = sstable.write_shards(odd_docs, WORD, directory, shards=5)
    want = by_key(odd_rows)
    assert Counter(map(tuple, sstable.read_shards(manifest, directory).collect())) == Counter((i, at, len(ids) // 4, zlib.crc32(ids)) for i, at, ids in want)
    assert manifest.count() > 1
    keys = [3, 999_999, None, -5, 104]
    found = [tuple(r) for r in sstable.looked_up(manifest, directory, keys).collect()]
    assert Counter((i, at, bytes(ids)) for i, at, ids in found) == Counter(r for r in want if r[0] in keys)
    empty = sstable.write_shards(no_docs, WORD, new_dir(spark, "sst-test"))
    assert sstable.read_shards(empty, directory).count() == 0 and sstable.looked_up(empty, directory, [1]).count() == 0


def test_one_key_spans_shards(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SUMMED", 2)
    rows = [(7, f"text {k % 40}") for k in range(200)] + [(None, "same")] * 200 + [(8, "end"), (6, "begin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    directory = new_dir(spark, "sst-test")
    manifest = sstable.write_shards(docs, WORD, directory, shards=6)
    assert manifest.count() >= 5 and manifest.agg({"n_docs": "max"}).first()[0] < 200
    want = by_key(rows)
    assert Counter(map(tuple, sstable.read_shards(manifest, directory).collect())) == Counter((i, at, len(ids) // 4, zlib.crc32(ids)) for i, at, ids in want)
    assert sstable.looked_up(manifest, directory, [7, None]).count() == 400


def test_shards_follow_bytes():
    assert [sstable.shard_count(n, 8) for n in (0, 1, 9 << 20, 1 << 30, 100 << 40)] == [1, 1, 2, 32, 409_600]


def test_shard_file(tmp_path):
    rng = random.Random(6)
    rows = sorted((sstable.key_of(rng.randrange(-4000, 4000)), four_bytes([rng.randrange(60_000) for _ in range(rng.randrange(200))])) for _ in range(3000))
    with open(tmp_path / "x.sst", "wb") as f:
        writer = sstable.Writer(f, 2)
        for key, ids in rows:
            writer.add(key, ids)
        writer.close()
    with open(tmp_path / "x.sst", "rb") as f:
        reader = sstable.Reader(f)
        assert [(k, ids) for k, _, ids in reader.scan()] == rows and len(reader.index) > 5
        held = {}
        for key, ids in rows:
            held.setdefault(key, []).append(ids)
        misses = 0
        for n in range(-4100, 4100):
            key = sstable.key_of(n)
            assert [ids for _, ids in reader.get(key)] == held.get(key, [])
            misses += key not in held and reader.may_hold(key)
        assert misses < 200


def test_planning_is_tight():
    rng = random.Random(7)
    for _ in range(30):
        counts = Counter(rng.choices(range(1, 101), k=rng.randrange(1, 400)))
        plan = packing.plan_windows(counts, 100)
        used = Counter()
        for repeats, pattern in plan:
            assert sum(n * c for n, c in pattern.items()) <= 100
            used.update({n: repeats * c for n, c in pattern.items()})
        assert used == counts
    for _ in range(300):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(1, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        found = packing.closest_fill(room, counts)
        assert sum(n * c for n, c in found.items()) == max(sums) and all(c <= counts[n] for n, c in found.items())


def test_packing(spark, odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(BYTE)
    got = packing.packed_documents(odd_docs, BYTE, keep_ids=True).collect()
    windows, docs = {}, {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter((i, four_bytes(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in odd_rows)
    pieces = Counter((r["doc_id"], r["doc_tokens"], r["start"], bytes(r["ids"])) for r in got)
    for (i, ids), copies in want.items():
        starts = [*range(0, len(ids) // 4, 2048)]
        if len(ids) // 4 - starts[-1] > 1024 and len(ids) // 4 % 2048:
            starts.append(starts[-1] + 1024)
        for at, end in zip(starts, [*starts[1:], len(ids) // 4]):
            pieces[i, len(ids) // 4, at, ids[4 * at : 4 * end]] -= copies
    assert not any(pieces.values())
    assert len(windows) <= sum(r["length"] for r in got) / 2048 + 2
    assert packing.packed_documents(no_docs, BYTE).count() == 0
    assert packing.cut_pieces(b"", end_id=None) == []


def test_places_are_joined_where_they_are_many(spark, odd_docs, monkeypatch):
    found = []
    for most in (packing.BROADCAST_PLACES, -1):
        monkeypatch.setattr(packing, "BROADCAST_PLACES", most)
        found.append(Counter((r["sequence_id"], r["offset"], r["length"]) for r in packing.packed_documents(odd_docs, BYTE).collect()))
    assert found[0] == found[1]
