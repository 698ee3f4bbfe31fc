"""Byte-level byte-pair encoding on ragged numpy arrays: every sequence's lowest-rank pair is merged at the same time."""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import public_tokenizers
import regex

from .textgrid import CONTRACTION, SPACE, classes, code_points, first_marks, gather, owner_of, run_hashes, with_contractions

NO_PAIR = np.int64(1) << 40
_SHIFT = np.int64(20)
_SPLIT = regex.compile(CONTRACTION + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: printable Latin-1 itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """The ranks of one vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in data["model"]["merges"]]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        keys = np.array([(vocab[a] << int(_SHIFT)) | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of[at], NO_PAIR)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode all sequences (none empty).  Each round merges all places of each sequence's lowest-rank pair; a symbol made by
        a merge only takes part in later ranks, so this equals merging one place at a time.  Finished sequences leave."""
        symbols, lengths = symbols.astype(np.int64), lengths.astype(np.int64)
        which = np.arange(len(lengths))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(symbols), NO_PAIR)
        inner = np.ones(len(symbols), bool)
        inner[np.cumsum(lengths) - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.ranks(symbols[at], symbols[at + 1])
        while len(lengths):
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest < NO_PAIR
            if not live.all():
                keep = np.repeat(live, lengths)
                done.append((which[~live], lengths[~live], symbols[~keep]))
                which, lengths, lowest = which[live], lengths[live], lowest[live]
                symbols, rank = symbols[keep], rank[keep]
                if not len(lengths):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, lengths))
            fresh = np.ones(len(hits), bool)
            fresh[1:] = hits[1:] != hits[:-1] + 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]  # "aaa": the left pair first
            symbols[hits] = self.made[rank[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            lengths = np.add.reduceat(keep, np.cumsum(lengths) - lengths, dtype=np.int64)
            place = np.cumsum(keep) - 1
            symbols, rank = symbols[keep], rank[keep]
            touched = place[hits]
            touched = np.concatenate([touched, touched - 1])
            touched = touched[touched >= 0]
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(lengths) - 1] = True
            rank[touched[last[touched]]] = NO_PAIR
            touched = touched[~last[touched]]
            rank[touched] = self.ranks(symbols[touched], symbols[touched + 1])
        order = np.argsort(np.concatenate([d[0] for d in done]), kind="stable")
        sizes = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        begin = np.cumsum(sizes) - sizes
        return gather(flat, begin[order], sizes[order]), sizes[order]


class Words:
    """Ids of the pre-tokens met so far in this worker, kept by hash in sorted arrays; forgotten beyond a fixed size."""

    def __init__(self, merges: Merges, most_ids: int = 8_000_000):
        self.merges, self.most = merges, most_ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        symbols = self.merges.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ids, sizes = self.merges.merge(symbols, np.array([len(r) for r in raw], np.int64))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.ids[self.used:self.used + len(ids)] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.sizes = (np.insert(old, at, new) for old, new in
                                              ((self.keys, keys), (self.starts, starts), (self.sizes, sizes)))

    def find(self, joined: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of every pre-token; unknown ones are encoded once, together."""
        if self.used > self.most:
            self.clear()
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not known.all():
            new = np.flatnonzero(~known)
            places = first[new]
            self.learn(keys[new], [joined[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        return self.starts[at][back], self.sizes[at][back]


def pre_tokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Split as the byte-level vocabulary does: joined text, its code points, starts, ends and the text of each pre-token.

    Runs of letters, numbers or other signs take one blank (0x20) before them along; of a longer run of white space the last
    character stands apart.  Texts with contractions are split by the published pattern itself."""
    joined, points, bounds = code_points(texts)
    if not len(points):
        none = np.zeros(0, np.int64)
        return joined, points, none, none, none
    kind = classes()[points]
    first = first_marks(len(points), bounds)
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    after_space = np.flatnonzero(begins[1:] & ~first[1:] & (kind[:-1] == SPACE)) + 1
    begins[after_space - 1] = True
    begins[after_space[points[after_space - 1] == 32]] = False
    for d in with_contractions(points, bounds).tolist():
        a, b = int(bounds[d]), int(bounds[d + 1])
        begins[a:b] = False
        begins[[a + m.start() for m in _SPLIT.finditer(joined[a:b])]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    return joined, points, starts, ends, owner_of(starts, bounds)


class Encoder:
    """Texts to ids, block by block, exactly as the vocabulary's own library gives them (special strings included)."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.words = Words(self.merges)
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.merges.special, key=len, reverse=True)) or r"(?!)")

    def parts(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at special strings: the parts, the text each comes from, and its special id (-1: ordinary)."""
        parts, owner, special = [], [], []
        for i, text in enumerate(texts):
            end = 0
            if any(s in text for s in self.merges.special):
                for m in self.cut.finditer(text):
                    parts += [text[end:m.start()], ""]
                    owner += [i, i]
                    special += [-1, self.merges.special[m[0]]]
                    end = m.end()
            parts.append(text[end:] if end else text)
            owner.append(i)
            special.append(-1)
        return parts, np.array(owner, np.int64), np.array(special, np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        parts, owner, special = self.parts(texts)
        joined, points, starts, ends, part = pre_tokens(parts)
        _, sizes = self.words.find(joined, run_hashes(points, starts, ends), starts, ends)
        total = np.bincount(owner[part], sizes, len(texts)) if len(part) else np.zeros(len(texts))
        return total.astype(np.int64) + np.bincount(owner, special >= 0, len(texts)).astype(np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        parts, owner, special = self.parts(texts)
        joined, points, starts, ends, part = pre_tokens(parts)
        begin, sizes = self.words.find(joined, run_hashes(points, starts, ends), starts, ends)
        flat = gather(self.words.ids, begin, sizes)
        per_part = np.bincount(part, sizes, len(parts)).astype(np.int64) if len(part) else np.zeros(len(parts), np.int64)
        marks = np.flatnonzero(special >= 0)
        if len(marks):
            flat = np.insert(flat, (np.cumsum(per_part) - per_part)[marks], special[marks])
            per_part[marks] = 1
        return flat.astype("<u4"), np.bincount(owner, per_part, len(texts)).astype(np.int64)


@cache
def encoder(name: str = "byte_bpe_50k.json") -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(public_tokenizers.path(name))
