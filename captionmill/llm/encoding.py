"""Exact byte-level BPE with reuse of whitespace-delimited pieces.

A byte-level pre-tokenizer of the common pattern never lets a token run from
a non-space character into a following space. The place between a visible
character and a following space or line feed is thus always a token boundary,
in the whole text and in any part that begins or ends there. So the ids of a
text are the ids of its pieces cut at those places, and a piece that was seen
before need not be encoded again.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from captionmill.llm.common import held

#: White space before U+0020 or U+000A, where a cut would not be safe.
_ODD = r"\x00|[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}][ \n]"
#: Places of the table of pieces that came once.
MARKS = 1 << 23
_CUT = re.compile("(?<=[^\\s᠎])(?=[ \\n])")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule.

    Printable Latin-1 bytes stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each id of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        added = {t["id"]: t["content"] for t in spec.get("added_tokens") or []}
        size = 1 + max([*vocab.values(), *added])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token if c in alphabet)
        for i, content in added.items():
            self.bytes[i] = content.encode()
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self.opens = np.array([b[:1] in (b" ", b"\n") for b in self.bytes])

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PieceEncoder:
    """``encode`` of the tokenizers library, with a bounded memory of pieces.

    A piece is kept when it comes a second time, as most never do: a table of
    ``MARKS`` places by hash tells which came before. ``limit`` bounds the
    pieces held; beyond it the memory starts afresh, so a worker's memory does
    not grow with the corpus.
    """

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab = vocabulary(path)
        self.limit, self.seen, self.marks = limit, {}, np.zeros(MARKS, np.bool_)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, self.vocab.dtype).tobytes()

    def _made(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of each of ``pieces``, by the library."""
        plain, other, made = [], [], {}
        for p in pieces:
            simple = len(p) > 1 and p[0] in " \n" and not p[-1].isspace() and p[-1] != "᠎" and " " not in p[1:] and "\n" not in p[1:]
            (plain if simple else other).append(p)
        groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        for group, ids in zip(groups, self._raw(["".join(g) for g in groups])):
            ids = np.asarray(ids, np.int64)
            at = np.flatnonzero(self.vocab.opens[ids])
            if len(at) != len(group) or (len(at) and at[0]):
                other += group
                continue
            packed, w = self._pack(ids), self.vocab.dtype.itemsize
            ends = [*(at[1:] * w).tolist(), len(packed)]
            made.update(zip(group, [packed[a:b] for a, b in zip((at * w).tolist(), ends)]))
        for p, ids in zip(other, self._raw(other) if other else []):
            made[p] = self._pack(ids)
        return made

    def _keep(self, made: dict[str, bytes]) -> None:
        at = np.fromiter(map(hash, made), np.int64, len(made)) & (MARKS - 1)
        again = self.marks[at]
        self.marks[at] = True
        if len(self.seen) + np.count_nonzero(again) > self.limit:
            self.seen.clear()
            self.marks[:] = False
        else:
            self.seen.update(itertools.compress(made.items(), again.tolist()))

    def _packed(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.seen.get, pieces))
        if None in found:
            made = self._made([p for p, v in zip(pieces, found) if v is None])
            found = [made[p] if v is None else v for p, v in zip(pieces, found)]
            self._keep(made)
        return found

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD)
        if pc.any(odd).as_py():
            cut = [_CUT.split(t) for t in texts.filter(odd).to_pylist()]
            rest = pc.if_else(odd, "", texts)
        else:
            cut, rest = [], texts
        rest = pc.replace_substring(pc.replace_substring(rest, "\n", "\x00\n"), " ", "\x00 ")
        lists = pc.split_pattern(rest, "\x00")
        coded = lists.flatten().dictionary_encode()
        values = self._packed(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        dtype, which = self.vocab.dtype, coded.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, values), np.int64, len(values)) // dtype.itemsize
        start, n = np.cumsum(size) - size, size[which]
        done = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(start[which] - done[:-1], n) + np.arange(done[-1])
        ids = np.frombuffer(b"".join(values), dtype)[place]
        ends = done[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])]
        if not cut:
            return ids, ends
        each = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for i, p in zip(np.flatnonzero(odd.to_numpy(zero_copy_only=False)), cut):
            each[i] = np.frombuffer(b"".join(self._packed(p)), dtype)
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def encode(self, texts, block: int = 12_000_000):
        """(ids of all texts in a row, the place where each text's ids begin and the end).

        ``texts`` is a list or an Arrow array without nulls; about ``block``
        bytes are split at a time.
        """
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
        parts, ends, i = [np.zeros(0, self.vocab.dtype)], [np.zeros(1, np.int64)], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + block)))
            ids, at = self._block(texts.slice(i, j - i))
            ends.append(at[1:] + ends[-1][-1])
            parts.append(ids)
            i = j
        return np.concatenate(parts), np.concatenate(ends)


class PieceCounter:
    """Numbers of tokens under several byte-level tokenizers at once: (version,
    file, pattern) each, the pattern being that of a .tiktoken file.

    Texts are cut into pieces once, and each distinct piece is counted once
    under every tokenizer while a bounded memory of ``limit`` pieces holds it.
    """

    def __init__(self, tokenizers: tuple[tuple[str, str, str | None], ...], limit: int = 700_000):
        self.count = [self._tiktoken(path, pattern) if pattern else self._tokenizers(path) for _, path, pattern in tokenizers]
        self.limit, self.seen = limit, {}

    @staticmethod
    def _tokenizers(path: str):
        own = PieceEncoder(path, 0).tokenizer
        return lambda pieces: [len(e.ids) for e in own.encode_batch_fast(pieces, add_special_tokens=False)]

    @staticmethod
    def _tiktoken(path: str, pattern: str):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        own = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda pieces: list(map(len, map(own.encode_ordinary, pieces)))

    def _known(self, pieces: list[str]) -> np.ndarray:
        """A row of counts for each piece."""
        fresh = [p for p in pieces if p not in self.seen]
        if len(self.seen) + len(fresh) > self.limit:
            self.seen.clear()
            fresh = pieces
        self.seen.update(zip(fresh, zip(*(count(fresh) for count in self.count)) if fresh else ()))
        return np.array([self.seen[p] for p in pieces], np.int64).reshape(len(pieces), len(self.count))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (columns) under each tokenizer (rows)."""
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), "\n", "\x00\n"), " ", "\x00 "), "\x00")
        coded = lists.flatten().dictionary_encode()
        n = self._known(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        out = np.stack([np.bincount(row, n[:, k], len(texts)) for k in range(len(self.count))]).astype(np.int64)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[:, i] = self._known(list(dict.fromkeys(cut := _CUT.split(texts[i].as_py()))))[[*map({p: k for k, p in enumerate(dict.fromkeys(cut))}.get, cut)]].sum(0)
        return out


@held
def piece_encoder(path: str, limit: int = 700_000) -> PieceEncoder:
    """One encoder for each Python worker, kept while the worker is reused."""
    return PieceEncoder(path, limit)
