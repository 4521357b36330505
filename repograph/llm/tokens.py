"""Token ids of whole texts by the ``tokenizers`` library, encoding repeated words once.

A byte-level BPE tokenizer of the 50k family never merges across the start of a single space
or line feed that stands between two non-space characters, nor from a letter or digit to the
full stops and commas after it. Texts are cut at the former with Arrow kernels, equal chunks
are found by dictionary encoding, their closing stops and commas are taken off, and only stems
not met before are encoded (by the library, as one text, told apart by the bytes of each id).
The ids of all texts are then put together by one numpy gather.
"""
from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_STEMS = 700_000         # stems kept between batches; beyond it the cache starts anew
LONGEST_CACHED = 64           # bytes of a stem that is worth keeping
JOINED_STEMS = 1 << 14        # stems encoded as one text
LONG_BYTES = 16 << 20         # a text above this is encoded in parts of about half of it
_BETWEEN = re.compile(r"(?<=\S)[ \n](?=\S)")
_TEXT = pa.large_string()
#: Characters after which a full stop or comma surely starts a new pre-token.
_BEFORE_STOP = pa.array([chr(c) for r in ("09", "AZ", "az", "\xc0\xd6", "\xd8\xf6", "\xf8\xff")
                         for c in range(ord(r[0]), ord(r[1]) + 1)], _TEXT)


def id_bits(vocab_size: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, (vocab_size - 1).bit_length())


@lru_cache(maxsize=1)
def chunk_encoder(vocab_path: str) -> "ChunkEncoder":
    """The process's encoder: Python workers serve many tasks, and its cache serves them all."""
    return ChunkEncoder(vocab_path, encode_special_tokens=False)


def gather(ids: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the lists ``ids[ends[r]:ends[r + 1]]`` of ``rows``; also their ends."""
    size = np.diff(ends)[rows]
    total = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    at = np.repeat(ends[rows] - total[:-1], size)
    at += np.arange(total[-1])
    return ids[at], total


class ChunkEncoder:
    """Encodes Arrow string arrays, with a bounded cache of stems.

    ``encode_special_tokens`` is the library's switch: whether the strings of special tokens are
    plain text. The operators leave it off, as the library does."""

    def __init__(self, vocab_path: str, encode_special_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocab_path)
        self.tokenizer.encode_special_tokens = encode_special_tokens
        resize = getattr(self.tokenizer.model, "_resize_cache", None)
        if resize:
            resize(0)              # stems come once: the library's own word cache only costs time
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values()
                 if t.content and not (t.special and encode_special_tokens)]
        # tokens that are matched in the text: chunks with one go to the library as they are; a
        # token that takes or asks for characters around it ties the whole text together
        self.matched = [t.content for t in added]
        self.tying = [t.content for t in added if t.lstrip or t.rstrip or t.single_word or t.normalized
                      or any(c.isspace() for c in t.content)]
        size = self.tokenizer.get_vocab_size()
        self.bits = id_bits(size)
        # a byte-level token has one character for each of its bytes
        self.id_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self._reset()

    def _reset(self):
        self.stems = pa.array([], _TEXT)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def _with(texts: pa.Array, strings: list[str]) -> np.ndarray:
        """Which texts hold one of the strings."""
        found = np.zeros(len(texts), bool)
        for s in strings:
            found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return found

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their ends of texts that are encoded one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
        return np.array(found[0] if len(found) == 1 else [x for f in found for x in f], np.uint32), ends

    def _encode_joined(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for stems that are a separator and a text without spaces at its ends."""
        found = []
        for i in range(0, len(stems), JOINED_STEMS):
            part = stems.slice(i, JOINED_STEMS).cast(pa.large_binary()).to_numpy(zero_copy_only=False)
            found.append(self._encode([b"".join(part).decode()])[0])
        ids = np.concatenate(found)
        ends = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(pc.binary_length(stems).to_numpy()))
        return ids, np.r_[0, ends + 1]

    def _known(self, stems: pa.Array, joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, row of each of the distinct ``stems``); joinable new ones are kept."""
        if len(self.stems) > CACHE_STEMS:
            self._reset()
        rows = pc.fill_null(pc.index_in(stems, value_set=self.stems), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero((rows < 0) & joinable)
        ids, ends = self.ids, self.ends
        if len(new):
            sub = stems.take(pa.array(new))
            more, stop = self._encode_joined(sub)
            rows[new] = len(ends) - 1 + np.arange(len(new))
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + stop[1:]])
            self.stems, self.ids, self.ends = pa.concat_arrays([self.stems, sub]), ids, ends
        other = np.flatnonzero(rows < 0)
        if len(other):
            more, stop = self._encode(stems.take(pa.array(other)).to_pylist())
            rows[other] = len(ends) - 1 + np.arange(len(other))
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + stop[1:]])
        return ids, ends, rows

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ends of distinct chunks, and whether each starts (bit 0) and ends (bit 1)
        with a non-space, its separator not counted."""
        size = pc.utf8_length(chunks).to_numpy()
        led = pc.or_(pc.starts_with(chunks, " "), pc.starts_with(chunks, "\n")).to_numpy(zero_copy_only=False)
        inner = pc.utf8_length(pc.utf8_trim_whitespace(chunks)).to_numpy()
        plain = (inner > 0) & (inner == size - led)
        edge = np.where(plain, 3, 0).astype(np.uint8)
        odd = np.flatnonzero(~plain)
        for i, c in zip(odd.tolist(), chunks.take(pa.array(odd)).to_pylist()):
            body = c[1:] if c[:1] in (" ", "\n") else c
            edge[i] = (not body[:1].isspace()) + 2 * (not body[-1:].isspace()) if body else 0

        bare = pc.utf8_rtrim(chunks, characters=".,")
        ok = pc.is_in(pc.utf8_slice_codeunits(bare, -1, None), value_set=_BEFORE_STOP)
        matched = self._with(chunks, self.matched)
        stem = pc.if_else(pc.and_(ok, pa.array(~matched)), bare, chunks)
        stem_size = pc.utf8_length(stem).to_numpy()
        coded = stem.dictionary_encode()
        code = coded.indices.to_numpy()
        joinable = np.zeros(len(coded.dictionary), bool)
        short = pc.binary_length(coded.dictionary).to_numpy() <= LONGEST_CACHED
        joinable[code] = plain & led & ~matched
        ids, ends, rows = self._known(coded.dictionary, joinable & short)
        rows = rows[code]
        tailed = np.flatnonzero(stem_size < size)
        if not len(tailed):
            return *gather(ids, ends, rows), edge
        text = chunks.take(pa.array(tailed)).to_numpy(zero_copy_only=False)
        tail = [t[s:] for t, s in zip(text.tolist(), stem_size[tailed].tolist())]
        kinds = {t: i for i, t in enumerate(dict.fromkeys(tail))}
        more, stop = self._encode(list(kinds))
        empty = len(ends) - 1 + len(kinds)
        last = np.full(len(chunks), empty, np.int64)
        last[tailed] = len(ends) - 1 + np.fromiter(map(kinds.__getitem__, tail), np.int64, len(tail))
        ids = np.concatenate([ids, more])
        ends = np.concatenate([ends, ends[-1] + stop[1:], [ends[-1] + stop[-1]]])
        out, total = gather(ids, ends, np.stack([rows, last], axis=1).ravel())
        return out, total[::2], edge

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of ids of each text (null: none). A very
        long text is cut where chunks are, so that what is held at once stays bounded."""
        tied = self._with(pc.fill_null(texts.cast(_TEXT), ""), self.tying) if self.tying else np.zeros(0, bool)
        if tied.any():
            rows, known = np.flatnonzero(tied), np.flatnonzero(~tied)
            parts = [self._encode(texts.take(pa.array(rows)).to_pylist())]
            counts = np.zeros(len(texts), np.int64)
            counts[rows] = np.diff(parts[0][1])
            if len(known):
                ids, counts[known] = self._encode_all(texts.take(pa.array(known)))
                parts.append((ids, np.r_[0, np.cumsum(counts[known])]))
            ids = np.concatenate([p[0] for p in parts])
            ends = np.r_[0, np.cumsum(np.r_[counts[rows], counts[known]])]
            return gather(ids, ends, np.argsort(np.r_[rows, known], kind="stable"))[0], counts
        if len(texts) == 1 and texts.nbytes > LONG_BYTES and texts[0].is_valid:
            text, at, found = texts[0].as_py(), 0, []
            while at < len(text):
                cut = _BETWEEN.search(text, at + LONG_BYTES // 2)
                end = cut.start() if cut else len(text)
                found.append(self._encode_all(pa.array([text[at:end]], _TEXT))[0])
                at = end
            ids = np.concatenate(found)
            return ids, np.array([len(ids)])
        return self._encode_all(texts)

    def _encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(_TEXT), "")
        lines = pc.split_pattern(texts, "\n")
        pieces = pc.split_pattern(lines.flatten(), " ")
        line_at, piece_at = lines.offsets.to_numpy(), pieces.offsets.to_numpy()
        flat, n = pieces.flatten(), int(piece_at[-1])
        text_at = piece_at[line_at]                    # first piece of each text, and the end
        sep = np.ones(n, np.int8)
        sep[piece_at[:-1]] = 2
        sep[text_at[:-1]] = 0
        # a chunk is a separator and a piece: only the distinct ones become strings
        coded = flat.dictionary_encode()
        key = coded.indices.to_numpy().astype(np.int64) * 3 + sep
        used = np.zeros(3 * len(coded.dictionary), bool)
        used[key] = True
        rows, distinct = (np.cumsum(used) - 1)[key], np.flatnonzero(used)
        chunks = pc.binary_join_element_wise(
            pa.array(["", " ", "\n"], _TEXT).take(pa.array(distinct % 3)),
            coded.dictionary.take(pa.array(distinct // 3)), pa.scalar("", _TEXT))
        del lines, pieces, flat, sep, coded, key, used, distinct
        ids, ends, edge = self._chunk_ids(chunks)
        if not (edge == 3).all():                      # some spaces tie chunks together
            edge = edge[rows]
            cut = np.r_[True, (edge[1:] & 1 == 1) & (edge[:-1] & 2 == 2)][:n]
            cut[text_at[:-1]] = True
            first = np.flatnonzero(cut)
            last = np.r_[first[1:], n]
            tied = np.flatnonzero(last - first > 1)
            more, stop = self._encode(["".join(chunks.take(pa.array(rows[i:j])).to_pylist())
                                       for i, j in zip(first[tied].tolist(), last[tied].tolist())])
            rows = rows[first]
            rows[tied] = len(ends) - 1 + np.arange(len(tied))
            ids, ends = np.concatenate([ids, more]), np.concatenate([ends, ends[-1] + stop[1:]])
            text_at = np.searchsorted(first, text_at)
        out, total = gather(ids, ends, rows)
        del chunks
        pa.default_memory_pool().release_unused()
        return out, np.diff(total[text_at])
