"""Vocabulary files: read once on the driver from a path given by the caller, carried to the workers by broadcast.

A vocabulary file has a fixed size of a few MB, so the broadcast is bounded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from pathlib import Path

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str) -> tuple[str, bytes]:
    """The digest and the content of a vocabulary file."""
    content = Path(path).read_bytes()
    return hashlib.sha256(content).hexdigest(), content


def ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to ranks, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def library_tokenizer(content: bytes):
    """A tokenizer of the tokenizers library without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + at): b for at, b in enumerate(others)}


def rank_encoder(content: bytes):
    """A rank-based encoder with the ids of a byte-level file of the tokenizers library, or None.

    Ids serve as ranks only if the file's merges come in the order of the ids they make and nothing but the byte-level
    cut happens before them; special tokens are left to the caller.
    """
    spec = json.loads(content)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    if not plain or model.get("type") != "BPE" or any(model.get(o) for o in options):
        return None
    vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    if made != sorted(set(made)) or len(made) + 256 != len(vocab) - len(special & vocab.keys()):
        return None
    byte = _byte_of_char()
    own = {bytes(byte[c] for c in token): at for token, at in vocab.items() if token not in special}
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary
