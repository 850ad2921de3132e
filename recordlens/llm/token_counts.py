"""Token counts by rank-synchronous merging of arrays (operator 13).

A task normalises and lower-cases a slice of texts, cuts it into pre-tokens by one table of character kinds, and holds
the slice's distinct pre-tokens as one ragged array of symbols. In each round every pre-token merges all places of its
lowest-ranked pair at once, equal symbols in a row pair by pair from the left; pre-tokens without a pair to merge
leave the array. What is left of a pre-token is its number of tokens, and a document's are the sum over its pre-tokens.
All places of a pair may merge at once because no merge makes a symbol that an earlier merge uses; a vocabulary of which
that is not true is refused.

The vocabulary is a byte-level BPE with word ends after NFC and lower-casing, white space dropped. Special tokens
written out in a text count as one token each, as the tokenizers library has it.

Null text is the empty text: no bytes, no tokens. Every row is counted by itself, so repeated rows, null ids, ties and
extra columns change nothing; an empty table gives an empty result. Very long texts are worked on in pieces that end
at a space, very long pre-tokens by a queue of ranks, with the same result: memory follows the longest pre-token.
"""

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .bpe import _byte_chars
from .words import hashes, same

#: Characters of the pieces of texts that are counted at once.
PIECE_CHARS = 1 << 21
#: Symbols from which a pre-token is merged by a queue of ranks.
LONG = 512
NONE = np.int32(2**31 - 1)
END = "</w>"

SPACE, LETTER, DIGIT, OTHER = range(4)
#: No version of Unicode has letters, digits or spaces from here on.
ASSIGNED = 0x34000


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each code point, as the tokenizers library's version of Unicode has it."""
    points = _points()
    text = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[points[a:b]] = kind
    return out


@lru_cache(1)
def odd() -> dict[str, str]:
    """What the tokenizers library makes of letters whose lower case it and Python know differently."""
    points = _points()[0x80:]
    text = points.tobytes().decode("utf-32-le")
    lower = normalizers.Lowercase().normalize_str("\n".join(text)).split("\n")
    return {c: got for c, got in zip(text, lower, strict=True) if c.lower() != got}


def _points() -> np.ndarray:
    points = np.arange(ASSIGNED, dtype="<u4")
    return points[(points < 0xD800) | (points > 0xDFFF)]


class Merges:
    """The merges of a vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 32 | right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        latest, earliest = np.full(len(vocab), -1), np.full(len(vocab), len(pairs))
        np.maximum.at(latest, self.made, np.arange(len(pairs)))
        for side in (left, right):
            np.minimum.at(earliest, side, np.arange(len(pairs)))
        if (latest >= earliest).any():
            raise ValueError("a merge makes a symbol that an earlier merge uses")
        self.inside, self.final = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for c, b in _byte_chars().items():
            self.inside[b], self.final[b] = vocab[c], vocab[c + END]
        # Ranks of pairs of bytes, which are looked up most.
        self.bytes = np.full((512, 512), NONE)
        low = (left < 512) & (right < 512)
        self.bytes[left[low], right[low]] = np.flatnonzero(low)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NONE where it has no merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def counts(self, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Symbols that are left of each sequence; sequence i is sym[starts[i]:starts[i + 1]]."""
        out = np.zeros(len(starts) - 1, np.int64)
        size = np.diff(starts)
        long = size > LONG
        if long.any():
            take = np.repeat(long, size)
            out[long] = self.queued(sym[take], np.concatenate([[0], np.cumsum(size[long])]))
            sym, size = sym[~take], size[~long]
        who, first = np.flatnonzero(~long), np.cumsum(size) - size
        rank = np.full(len(sym), NONE)
        rank[:-1] = self.bytes[sym[:-1], sym[1:]] if len(sym) and sym.max() < 512 else self.ranks(sym[:-1], sym[1:])
        rank[first + size - 1] = NONE
        while len(who):
            best = np.minimum.reduceat(rank, first)
            done = best == NONE
            if done.any():
                out[who[done]] = size[done]
                stay = np.repeat(~done, size)
                sym, rank = sym[stay], rank[stay]
                who, size, best = who[~done], size[~done], best[~done]
                first = np.cumsum(size) - size
                if not len(who):
                    break
            at = alternate(np.flatnonzero(rank == np.repeat(best, size)))
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            gone = np.searchsorted(at, first)
            size = size - np.diff(np.append(gone, len(at)))
            first = first - gone
            sym, rank = sym[stay], rank[stay]
            at = at - np.arange(len(at))
            last = np.zeros(len(sym), bool)
            last[first + size - 1] = True
            rank[at] = NONE
            for p in (at[~last[at]], at[at > 0] - 1):
                p = p[~last[p]]
                rank[p] = self.ranks(sym[p], sym[p + 1])
        return out

    def queued(self, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """As ``counts``, but over all sequences by rising rank: a round costs what it merges, not what is there."""
        n = len(sym)
        sym = np.append(sym, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive, rank = np.ones(n, bool), np.full(n + 1, NONE)
        rank[: n - 1] = self.ranks(sym[: n - 1], sym[1:n])
        last = np.zeros(n + 1, bool)
        last[starts[1:] - 1] = True
        rank[last] = NONE
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(p: np.ndarray) -> None:
            p = p[rank[p] < NONE]
            p = p[np.argsort(rank[p], kind="stable")]
            for part in np.split(p, np.flatnonzero(np.diff(rank[p])) + 1) if len(p) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(part)

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = alternate(at, after)
            gone = after[at]
            sym[at] = self.made[r]
            last[at] |= last[gone]
            alive[gone], rank[gone] = False, NONE
            after[at] = after[gone]
            before[np.minimum(after[at], n)] = at
            left = before[at]
            changed = np.unique(np.concatenate([at, left[left >= 0]]))
            rank[changed] = np.where(last[changed], NONE, self.ranks(sym[changed], sym[np.minimum(after[changed], n)]))
            put(changed)
        return np.add.reduceat(alive.astype(np.int64), starts[:-1])


def alternate(at: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Of places that follow each other directly, every second, from the first on."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != (at[:-1] + 1 if after is None else after[at[:-1]])
    k = np.arange(len(at))
    return at[(k - np.maximum.accumulate(np.where(new, k, 0))) % 2 == 0]


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


def normalised(text: str) -> str:
    """NFC, then lower case letter by letter."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    for c, lower in odd().items():
        if c in text:
            text = text.replace(c, lower)
    return text.lower()


def pieces(text: str) -> list[str]:
    """Parts of at most about PIECE_CHARS that end at a space, or longer ones without a space."""
    out, at = [], 0
    while len(text) - at > PIECE_CHARS:
        cut = text.rfind(" ", at, at + PIECE_CHARS)
        cut = text.find(" ", at + PIECE_CHARS) if cut < at else cut
        if cut < 0:
            break
        out.append(text[at : cut + 1])
        at = cut + 1
    return [*out, text[at:]]


_AFTER_QUOTE = {b: [ord(c) for c in b] for b in ("s", "t", "m", "d", "re", "ve", "ll")}


def pre_tokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one code points of the pre-tokens of normalised text: words, single digits, runs of marks, and
    a quote with its ending where a run of marks would be that quote alone."""
    kind = kinds()[points]
    n = len(kind)
    new = np.ones(n + 1, bool)
    new[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    padded = np.concatenate([points, np.zeros(3, points.dtype)])
    quote = np.flatnonzero((points == ord("'")) & new[:n] & new[1:])
    ends = np.zeros(len(quote), np.int64)
    for part in _AFTER_QUOTE.values():
        ends = np.where((ends == 0) & np.all([padded[quote + 1 + k] == c for k, c in enumerate(part)], axis=0), len(part), ends)
    quote, ends = quote[ends > 0], ends[ends > 0]
    new[quote + 1] = False
    new[quote + 1 + ends] = True
    starts = np.flatnonzero(new)
    starts, stops = starts[:-1], starts[1:]
    word = kind[starts] != SPACE
    return starts[word], stops[word]


def count(texts: list[str], m: Merges) -> np.ndarray:
    """Tokens of each text."""
    extra = np.zeros(len(texts), np.int64)
    if m.special:
        for k, t in enumerate(texts):
            if "<" in t and (found := len(m.special.findall(t))):
                extra[k] = found
                texts[k] = m.special.sub(" ", t)
    texts = [normalised(t) for t in texts]
    rows = np.cumsum([len(t) + 1 for t in texts])
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), "<u4")
    starts, stops = pre_tokens(points)
    if not len(starts):
        return extra
    data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
    byte = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
    row = np.searchsorted(starts, np.concatenate([[0], rows]))
    starts, stops = byte[starts], byte[stops]
    size = stops - starts
    _, first, which = np.unique(hashes(data, starts, stops), return_index=True, return_inverse=True)
    # A pre-token that differs from the one that stands for its hash is counted for itself.
    other = np.flatnonzero((size != size[first][which]) | ~same(data, starts, starts[first][which], np.minimum(size, size[first][which])))
    which[other] = len(first) + np.arange(len(other))
    first = np.concatenate([first, other])
    at = np.concatenate([[0], np.cumsum(size[first])])
    sym = m.inside[data[np.arange(at[-1]) - np.repeat(at[:-1] - starts[first], size[first])]]
    sym[at[1:] - 1] = m.final[data[stops[first] - 1]]
    total = np.concatenate([[0], np.cumsum(m.counts(sym, at)[which])])
    return total[row[1:]] - total[row[:-1]] + extra


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row."""

    def run(batches):
        m = merges(vocabulary)
        for b in batches:
            text = pc.fill_null(b.column("text").cast(pa.large_string()), "")
            n_bytes = pc.binary_length(text).to_numpy()
            tokens = np.zeros(len(text), np.int64)
            held, rows, size = [], [], 0
            for row in range(len(text) + 1):
                for part in pieces(text[row].as_py()) if row < len(text) else ():
                    held.append(part)
                    rows.append(row)
                    size += len(part)
                    if size >= PIECE_CHARS:
                        np.add.at(tokens, rows, count(held, m))
                        held, rows, size = [], [], 0
            if held:
                np.add.at(tokens, rows, count(held, m))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes.astype(np.int64)), pa.array(tokens), pa.array(tokens > limit)], names)

    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
