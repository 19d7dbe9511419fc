"""Exact word-level caching in front of the ``tokenizers`` library, and token attribution.

The word tokenizer's pre-tokenizer never joins characters across white space, so
a text's ids are those of its space-separated chunks in a row. Chunks repeat, so
a batch's texts are split and dictionary-encoded as a whole, each worker keeps
the ids of the chunks it has met, and only unseen chunks go to the library. The tokenizer is used as its file says: the strings of its special
tokens, which hold no white space, become their ids.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.base import bounded, byte_slices, text_or_empty

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 600_000  # chunks whose ids a worker keeps
CACHE_BYTES = 64_000_000
SLICE_BYTES = 4_000_000
WORD_SLICE_BYTES = 5_000_000

#: Letters that are single code points in NFC with single-letter lower cases.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A run of these is one pre-token (an apostrophe may begin a suffix instead).
_MARKS = string.punctuation.replace("'", "")
#: What splitting takes for white space and the tokenizer does not.
_NOT_SPACES = r"[\x1c-\x1f]"


def _byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: printable bytes stand for themselves, the rest follow from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


class WordEncoder:
    """Ids of whole texts under a word tokenizer file; the ids of the chunks met last are kept, up to a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.chunks = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.list_(pa.uint16()))

    def _word(self, word: str) -> list[int]:
        """Ids of one lower-case word: it is one pre-token, so the library's model is asked directly."""
        letters = word if word.isascii() else "".join([_BYTE_LETTERS[b] for b in word.encode()])
        return [t.id for t in self.model.tokenize(letters)]

    def _other(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _ids(self, chunks: list[str]) -> pa.ListArray:
        """Ids of each of some distinct chunks."""
        words: dict[str, list[int]] = {"": []}
        out, ends = [], [0]
        for chunk in chunks:
            core = chunk.rstrip(_MARKS)
            if not core or (core.isascii() and core.isalpha()) or _LETTERS.fullmatch(core):
                word, marks = core.lower(), chunk[len(core) :]
                found = words.get(word)
                if found is None:
                    found = words[word] = self._word(word)
                out += found
                if marks:
                    found = words.get(marks)
                    if found is None:
                        found = words[marks] = self._other(marks)
                    out += found
            else:
                out += self._other(chunk)
            ends.append(len(out))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.uint16()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (no nulls) in a row, and where each text's ids end."""
        texts = texts.cast(pa.large_string())
        if pc.any(pc.match_substring_regex(texts, _NOT_SPACES)).as_py():
            split = pa.array([re.sub(r"[\n\t\r]", " ", t).split(" ") if re.search(_NOT_SPACES, t) else t.split() for t in texts.to_pylist()], pa.large_list(pa.large_string()))
        else:
            split = pc.utf8_split_whitespace(texts)
        met = split.flatten().dictionary_encode()
        if len(self.chunks) > CACHE_ENTRIES or self.chunks.nbytes > CACHE_BYTES:
            self._forget()
        if len(self.chunks) > 2 * len(met):  # so few words are not worth a look at all that is kept
            ids, place = self._ids(met.dictionary.to_pylist()), np.arange(len(met.dictionary))
        else:
            found = pc.index_in(met.dictionary, value_set=self.chunks)
            new = met.dictionary.filter(pc.is_null(found))
            place = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place[found.is_null().to_numpy(zero_copy_only=False)] = len(self.chunks) + np.arange(len(new))
            ids = self.ids = pa.concat_arrays([self.ids, self._ids(new.to_pylist())])
            self.chunks = pa.concat_arrays([self.chunks, new])
        at = place[met.indices.to_numpy(zero_copy_only=False)]
        lengths = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths[at])])
        return ids.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), ends[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def word_tokenizer_path() -> str:
    return public_tokenizers.path(WORD_TOKENIZER)


@lru_cache(maxsize=2)
def byte_encoder(path: str):
    """``encode(text) -> ids`` of byte-level BPE, and the number of bytes of each id."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, sizes


RULES = ("first", "last", "majority")


def attribute(token_ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens to sections, both contiguous from 0.

    ``token_ends`` are the exclusive ends of the tokens, ``cuts`` those of the
    sections. Returns each token's section and whether the token crosses a
    section's end. ``first`` gives a crossing token to the section of its first
    unit, ``last`` to that of its last, ``majority`` to the one with most of
    its units (a tie: the earlier).
    """
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(cuts, starts, side="right")
    last = np.searchsorted(cuts, token_ends - 1, side="right")
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    owner = first.copy()
    for i in np.flatnonzero(crossing).tolist():
        edges = np.clip(cuts[first[i] : last[i]], starts[i], token_ends[i])
        parts = np.diff(np.concatenate([[starts[i]], edges, [token_ends[i]]]))
        owner[i] = first[i] + int(parts.argmax())
    return owner, crossing


def section_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", section_end: str = r"\n", rule: str = "majority", path: str | None = None) -> DataFrame:
    """Tokens of each section of each document, counted from one encoding of the whole text.

    A section ends after each match of ``section_end`` (a regular expression;
    the match belongs to the section it ends) and at the end of the text. The
    text is encoded once as a whole; token spans are joined to section spans,
    and a token across a boundary goes to one section by ``rule``.

    Returns ``doc_id, section`` (from 0), ``start, end`` (code points),
    ``n_tokens, n_crossing`` (tokens counted here that also cover another
    section). Every document has at least one row: a null or empty text one
    section of no tokens. The counts of a document add up to its tokens.
    Repeated rows are each counted.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or public_tokenizers.path(BYTE_TOKENIZER)
    ender = re.compile(section_end)

    def one(text: str, encode, sizes):
        ends = [m.end() for m in ender.finditer(text) if m.end() > m.start()]
        if not ends or ends[-1] != len(text):
            ends.append(len(text))
        ends = np.array(ends, np.int64)
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        if len(raw) == len(text):
            cuts = ends
        else:  # byte offset of each code point, then of each section's end
            at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            cuts = at[ends]
        ids = np.array(encode(text), np.int64)
        if not len(ids):
            return ends, np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        owner, crossing = attribute(np.cumsum(sizes[ids]), cuts, rule)
        return ends, np.bincount(owner, minlength=len(ends)), np.bincount(owner[crossing], minlength=len(ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = byte_encoder(path)
        for b in (part for b in batches for part in byte_slices(b, 1, SLICE_BYTES)):
            found = [one(t, encode, sizes) for t in b.column(1).to_pylist()]
            each = np.array([len(x[0]) for x in found])
            column = lambda i: np.concatenate([x[i] for x in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(len(found)), each))),
                    pa.array(np.concatenate([np.arange(n) for n in each]).astype(np.int64)),
                    pa.array(np.concatenate([np.concatenate([[0], x[0][:-1]]) for x in found]).astype(np.int64)),
                    pa.array(column(0)),
                    pa.array(column(1)),
                    pa.array(column(2)),
                ],
                names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
            )

    source = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")
