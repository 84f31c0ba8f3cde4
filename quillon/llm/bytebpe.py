"""Byte-level BPE without a training step: a linear-time encoder and an offset-table decoder.

The encoder takes, at each place, the longest vocabulary entry that starts there (all entries are found in one
Aho-Corasick pass) and keeps it only if the pair with the entry before is one that merging would leave apart.
If no shorter entry fits either, it gives up the entry before and marks the place as a dead end, so that each
place is tried once. Pairs are tested against the table of merges. This gives the merges' own result in linear time.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

#: Fixed value: the split that the vocabulary files are made for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of text whose ids are kept in each worker.
CACHE = 300_000
#: Longer texts go to the own encoder, as the compiled one fails on runs of a million white-space characters.
COMPILED = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, turned round: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("the vocabulary must be byte-level, without a normaliser and without a prefixed space")
        of = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = {i: w for w, i in vocab.items() if w not in self.special}
        self.size = max([*letters, *self.special.values()]) + 1
        self.token = [b""] * self.size
        for i, w in letters.items():
            self.token[i] = bytes(of[c] for c in w)
        for w, i in self.special.items():
            self.token[i] = w.encode()
        # merges: rank by pair, and for each token the pair it is made of
        self.pair: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(self.size)), list(range(self.size))
        last = -1
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[a + b]
            if made <= last:
                raise ValueError("token ids must rise with the order of merges, as they serve as ranks")
            last = made
            self.pair[vocab[a], vocab[b]] = made
            self.left[made], self.right[made] = vocab[a], vocab[b]
        self.length = np.array([len(t) for t in self.token], dtype=np.int64)
        self.bytes_all = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self._whole = {t: i for i, t in enumerate(self.token) if i in letters}
        self._cut = regex.compile(SPLIT)
        self._kept: dict[str, tuple[bytes, str]] = {}

    @property
    def ranks(self) -> dict[bytes, int]:
        return self._whole

    def _automaton(self):
        if not hasattr(self, "_machine"):
            machine = ahocorasick.Automaton()
            for t, i in self._whole.items():
                machine.add_word(t.decode("latin-1"), (len(t), i))
            machine.make_automaton()
            self._machine = machine
            self._shorter: dict[int, int] = {}
        return self._machine

    def shorter(self, token: int) -> int:
        """The longest entry that is a proper prefix of this one, or -1."""
        found = self._shorter.get(token)
        if found is None:
            t, found = self.token[token], -1
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in self._whole:
                    found = self._whole[t[:n]]
                    break
            self._shorter[token] = found
        return found

    @lru_cache(maxsize=200_000)  # noqa: B019  one encoder lives as long as its worker
    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the entries a and b apart when they stand side by side.

        Undo the merges of both, latest first; if on the way the parts that touch could merge before the merge
        undone last, they would have merged."""
        before = self.size
        while True:
            made = self.pair.get((a, b))
            if made is not None and made < before:
                return False
            if a > b:
                before, part = a, self.right[a]
                if part == a:
                    before, part = b + 1, self.left[b]
                    if part == b:
                        return True
                    b = part
                else:
                    a = part
            else:
                before, part = b + 1, self.left[b]
                if part == b:
                    before, part = a, self.right[a]
                    if part == a:
                        return True
                    a = part
                else:
                    b = part

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of the split."""
        whole = self._whole.get(piece)
        if whole is not None and len(piece) < 2:
            return [whole]
        longest = [-1] * len(piece)
        size = [0] * len(piece)
        for end, (n, i) in self._automaton().iter(piece.decode("latin-1")):
            start = end - n + 1
            if n > size[start]:
                size[start], longest[start] = n, i
        open_ = bytearray(b"\x01") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0] if piece else -1
        while at < len(piece):
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.token[token])
                if open_[end] and (last < 0 or self.apart(last, token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
            elif last >= 0:
                open_[at] = 0
                at -= len(self.token[out.pop()])
                token = last
            else:
                raise ValueError("no vocabulary entry starts here")
        return out

    def encode_parts(self, text: str) -> list[tuple[bytes, str]]:
        """For each piece of the text its ids, as little-endian 16- or 32-bit numbers and as decimals joined by commas."""
        out: list[tuple[bytes, str]] = []
        kept, kind = self._kept, self.kind
        for i, run in enumerate(self.special_split.split(text) if self.special_split else [text]):
            if i % 2:
                out.append((np.array([self.special[run]], dtype=kind).tobytes(), str(self.special[run])))
                continue
            for piece in self._cut.findall(run):
                known = kept.get(piece)
                if known is None:
                    ids = self.encode_piece(piece.encode())
                    known = (np.array(ids, dtype=kind).tobytes(), ",".join(map(str, ids)))
                    if len(piece) <= 100:
                        if len(kept) >= CACHE:
                            kept.clear()
                        kept[piece] = known
                out.append(known)
        return out

    @property
    def kind(self) -> str:
        return "<u2" if self.size <= 65536 else "<u4"

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([x[0] for x in self.encode_parts(text)]), dtype=self.kind)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the entries, gathered from the table of all entries' bytes by their offsets."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        sizes = self.length[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.offset[ids] - (ends - sizes), sizes)
        return self.bytes_all[at].tobytes()


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBPE:
    """One encoder per worker and vocabulary."""
    return ByteBPE(path)


@lru_cache(maxsize=2)
def fast_bpe(path: str):
    """The same vocabulary in a compiled encoder, for operators that need only ids."""
    import tiktoken

    own = bpe(path)
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=own.ranks, special_tokens={}), own


def fast_ids(path: str, text: str) -> np.ndarray:
    """Ids of a whole text, of any length and with any runs."""
    enc, own = fast_bpe(path)
    if len(text) > COMPILED:
        return own.encode(text).astype(np.uint32)
    if own.special_split is None or not any(s in text for s in own.special):
        return np.array(enc.encode_ordinary(text), dtype=np.uint32)
    parts: list[int] = []
    for i, run in enumerate(own.special_split.split(text)):
        parts += [own.special[run]] if i % 2 else enc.encode_ordinary(run)
    return np.array(parts, dtype=np.uint32)
