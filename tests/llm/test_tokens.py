"""Encoding, counting and packing against the libraries."""

import array
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from cases import AWKWARD
from kinosift.llm import bpe, packing, token_counts
from kinosift.llm.chunks import Generations, PartEncoder
from kinosift.llm.runtime import new_path
from kinosift.llm.tokenizers_io import PATTERN, rank_encoder, ranks, vocabulary

RANKS, WORDS, BYTES = (P.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "byte_bpe_50k.json"))
PIECES = list("aaabbcd'stre  \n\n\t.,!12é漢я  ́İΣσ\x1c\x85\r") + ["<|endoftext|>", "'re", "the ", " \n", "\n\n "]


def texts(seed, n=1500):
    draw = random.Random(seed)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(vocabulary(RANKS)[1]), special_tokens={})


def test_pattern_is_the_public_one():
    assert PATTERN == P.PATTERN


def test_merge_replay_equals_the_library(library):
    codec = bpe.Codec(vocabulary(RANKS)[1], limit=50)
    for some in (texts(1), texts(2), ["", "z" * 3000, "ab" * 2000, " " * 500, "\n" * 9]):
        for text, ids in zip(some, codec.encode(some)):
            assert ids.tolist() == library.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()


def test_encoded_rows(spark, table, library):
    rows = bpe.digest(bpe.encoded(table(AWKWARD), RANKS, decode=True)).collect()
    want = []
    for doc, text in AWKWARD:
        ids = library.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert bpe.encoded(table([]), RANKS).count() == 0


def test_decoding_a_column(spark, table):
    ids = bpe.encoded(table(AWKWARD[:4]), RANKS)
    assert [bytes(r.decoded) for r in bpe.decoded(ids, RANKS).collect()] == [(t or "").encode() for _, t in AWKWARD[:4]]


def test_counts_equal_the_library(spark):
    library, count = Tokenizer.from_file(WORDS), token_counts.Counter(vocabulary(WORDS)[1], limit=40)
    for text in texts(3, 1000):
        assert count(text) == len(library.encode(text, add_special_tokens=False))


def test_cache_is_filled_once(spark, table):
    library, cache = Tokenizer.from_file(WORDS), new_path(spark, "test-cache")
    want = sorted((str(d), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for d, t in AWKWARD)
    for _ in range(2):
        rows = token_counts.token_counts(table(AWKWARD), WORDS, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    stored = spark.read.parquet(cache)
    # This tokenizer drops white space, so texts that differ in it alone share an entry; nothing is encoded twice.
    assert stored.count() == stored.select("content_digest").distinct().count() == len({" ".join((t or "").split()) for _, t in AWKWARD})
    before = stored.count()
    token_counts.token_counts(table([(None, "hot one")] * 20 + [(7, "hot one"), (7, "hot\none")]), WORDS, cache).collect()
    assert spark.read.parquet(cache).count() == before + 1
    before += 1
    token_counts.token_counts(table([(9, "new one")]), WORDS, cache).collect()
    assert spark.read.parquet(cache).count() == before + 1
    assert token_counts.token_counts(table([]), WORDS, new_path(spark, "test-cache")).count() == 0


def test_white_space_changes_no_count():
    library, count = Tokenizer.from_file(WORDS), token_counts.Counter(vocabulary(WORDS)[1])
    assert count.collapses
    for text in texts(5, 400):
        normal = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")
        assert len(library.encode(text, add_special_tokens=False)) == len(library.encode(normal, add_special_tokens=False))


def test_rank_order_has_the_library_ids():
    library, content = Tokenizer.from_file(BYTES), vocabulary(BYTES)[1]
    own = rank_encoder(content)
    assert rank_encoder(vocabulary(WORDS)[1]) is None
    for text in [t for t in texts(4) if "<|" not in t] + [t for t in library.get_vocab() if "<|" not in t][::7]:
        assert own(text) == library.encode(text, add_special_tokens=False).ids


def test_parts_add_up_or_decline():
    library = Tokenizer.from_file(BYTES)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    parts = PartEncoder(ids, limit=30, marker="<|endoftext|>")
    found = [(t, parts(t)) for t in texts(5) + ["a\nb", "a\n\nb c", "\nx", "x\n"]]
    assert sum(v is not None for _, v in found) > 100
    assert all(sum(v, []) == ids(t) for t, v in found if v is not None)


def test_generations_forget():
    held = Generations(4)
    for i in range(10):
        held.put(str(i), i)
    assert len(held.young) + len(held.old) <= 4 and held.find("0") is None


def check_packing(docs, found, capacity):
    library = Tokenizer.from_file(BYTES)
    want = []
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(str(doc), i, a, b - a, zlib.crc32(array.array("I", ids[a:b]).tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packed_pieces(spark, table, capacity):
    docs = [*AWKWARD, *((100 + i, "word " * (i % 37)) for i in range(60)), (300, "<|endoftext|> a")]
    found = packing.packed_documents(table(docs), BYTES, capacity).collect()
    n = check_packing(docs, found, capacity)
    assert n <= -(-sum(r.length for r in found) // capacity) * 1.25 + 1
    assert packing.packed_documents(table([]), BYTES, capacity).count() == 0


def least_sequences(sizes, capacity):
    best = [len(sizes)]

    def place(at, room):
        if len(room) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(room)
            return
        for i, left in enumerate(room):
            if left >= sizes[at] and left not in room[:i]:
                place(at + 1, [*room[:i], left - sizes[at], *room[i + 1 :]])
        place(at + 1, [*room, capacity - sizes[at]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_dominance_costs_no_sequence(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 17, 24])
    sizes = sorted((draw.randint(1, capacity) for _ in range(9)), reverse=True)
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    fixed = packing.reduce_by_dominance(counts, capacity)
    assert all(sum(s) <= capacity for s, _ in fixed)
    rest = [s for s in range(capacity, 0, -1) for _ in range(counts[s])]
    assert sorted(rest + [s for sizes_, n in fixed for s in sizes_ * n], reverse=True) == sizes
    assert sum(n for _, n in fixed) + least_sequences(rest, capacity) == least_sequences(sizes, capacity)
