"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only.

Texts are cut into pieces of about ``PIECE_BYTES`` at safe boundaries and the pieces dealt into batches of about
``BATCH_BYTES``, so one very long text neither makes a batch of its own size nor slows one down. A boundary is safe
where an ASCII letter is followed by one blank and another ASCII letter: byte-level pre-tokenizers start a new word at
that blank, and no special token holds a blank, so the counts of the pieces add up to the count of the text. A text
without such a place stays whole.

A vocabulary whose tokens are byte-level merges in the order of their ids can be read as ranks as well, and merging by
ranks gives the same ids several times faster. That is checked when the vocabulary is loaded: no step before or after
the merges, and every token's own bytes merge, by ranks, from the two tokens that the file merges into it. Other
vocabularies are left to their own library.

Null and empty texts have no tokens. Special strings inside a text are handled as the library does by default.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.llm.bpe import byte_symbols, chunks

#: Size at which a long text is cut, and the size of a batch for the encoder; neither changes a count.
PIECE_BYTES = 64 << 10
BATCH_BYTES = 1 << 20
#: Bytes of text turned into Python strings at a time.
CHUNK_BYTES = 4 << 20

# How a byte-level vocabulary cuts texts before merging, in a form that never goes back over a long run.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PLAIN_STEPS = {"add_prefix_space": False, "trim_offsets": True, "type": "ByteLevel", "use_regex": True}
PLAIN_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
    "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
}

_SAFE = re.compile("[A-Za-z](?= [A-Za-z])")


def pieces(text: str, limit: int = PIECE_BYTES) -> Iterator[str]:
    """The text cut at the first safe boundary after every ``limit`` characters."""
    at = 0
    while len(text) - at > limit and (m := _SAFE.search(text, at + limit)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def balanced(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of about ``limit`` characters with the index of the text each piece is from."""
    owner, batch, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text):
            if batch and size + len(piece) > limit:
                yield owner, batch
                owner, batch, size = [], [], 0
            owner.append(i)
            batch.append(piece)
            size += len(piece)
    if batch:
        yield owner, batch


def ranked(path: str):
    """The vocabulary as an encoder by ranks, or None if its ids could be others."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = dict(spec["model"])
    vocab, merges = model.pop("vocab"), [m if isinstance(m, list) else m.split(" ") for m in model.pop("merges")]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    steps = spec.get("normalizer") or spec.get("post_processor")
    if steps or not plain or spec["pre_tokenizer"] != PLAIN_STEPS or {**PLAIN_MODEL, **model} != PLAIN_MODEL:
        return None
    byte_of = {symbol: bytes([b]) for b, symbol in enumerate(byte_symbols())}
    ranks = {b"".join(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
    parts = [(b"".join(byte_of[c] for c in a), b"".join(byte_of[c] for c in b)) for a, b in merges]
    order = [ranks[a + b] for a, b in parts]
    singles = [ranks.get(bytes([b]), 1 << 30) for b in range(256)]
    if max(singles) > min(order, default=1 << 30) or order != sorted(set(order)) or len(order) + 256 != len(ranks):
        return None
    if any(halves(a + b, ranks) != (a, b) for a, b in parts):
        return None
    import tiktoken

    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...]:
    """What is left of a token's bytes before the merge that makes it, lowest rank and leftmost first."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        low, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if low >= own:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


class Counter:
    """Counts by the library that reads the vocabulary: ``.json`` by tokenizers (or by ranks, if these are the same),
    ``.model`` by sentencepiece."""

    def __init__(self, path: str, by_ranks: bool = True):
        self.batches = balanced
        if path.endswith(".json") and by_ranks and (encoder := ranked(path)) is not None:
            special = encoder.special_tokens_set
            self.lengths = lambda batch: [len(encoder.encode_to_numpy(t, allowed_special=special, disallowed_special=())) for t in batch]
        elif path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(path)
            encoder.no_truncation()
            encoder.no_padding()
            self.lengths = lambda batch: [len(e) for e in encoder.encode_batch_fast(batch, add_special_tokens=False)]
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            encoder = SentencePieceProcessor(model_file=path)
            # its pieces may span blanks, so texts stay whole
            self.batches = lambda texts: (([i], [text]) for i, text in enumerate(texts))
            self.lengths = lambda batch: [len(ids) for ids in encoder.encode(batch, num_threads=1)]
        else:
            raise ValueError(f"no library for {path}")

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for owner, batch in self.batches(texts):
            np.add.at(out, owner, self.lengths(batch))
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Counter:
    return Counter(path)


def token_count(text: str | Column, path: str) -> Column:
    """Number of tokens of each text as a long; 0 for null."""

    @F.arrow_udf("bigint")
    def count_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = load(path)
        for batch in batches:
            done = [counter.count(part.to_pylist()) for part in chunks(batch, CHUNK_BYTES)]
            yield pa.array(np.concatenate(done) if done else [], pa.int64())

    return count_tokens(F.col(text) if isinstance(text, str) else text)


def with_token_counts(
    docs: DataFrame, path: str, text: str = "text", limit: int = 512, prefix: str = ""
) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` added, their names led by ``prefix``.

    A column of ``docs`` with one of these names is replaced; choose a prefix to keep it.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            f"{prefix}n_bytes": F.octet_length(whole).cast("bigint"),
            f"{prefix}n_tokens": token_count(whole, path),
        }
    ).withColumn(f"{prefix}over_limit", F.col(f"{prefix}n_tokens") > limit)
