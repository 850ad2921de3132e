"""Byte-level BPE by prefix-sharing trie traversal (operator 7).

A task cuts texts into pieces at single spaces, gathers the distinct pre-tokens that it has not met,
and walks their byte trie depth first. A trie node is a prefix; its state is the last token of the
prefix's encoding. The encoding of a prefix is that of a shorter prefix plus one token, the only one
that is compatible with the shorter prefix's last token, so all words below a node share its work.

Null text is the empty text: no tokens, and the digests of empty strings. Special tokens written out
in a text are encoded as the special id, as the tokenizers library does. Repeated rows are encoded alike, null ids are kept, extra columns are
ignored, and an empty table gives an empty result. Very long texts are encoded whole.
"""

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .staging import lean

#: Pieces that a worker remembers; it forgets all of them when there are more. The second number is for tasks that forget at their end.
CACHE_PIECES, FEWER_PIECES = 400_000, 100_000

_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Where cutting at single spaces differs from cutting by the pattern.
_ODD = re.compile(r"\s (?:\s|\Z)")


_SHORT = (2, 1)


def _byte_chars() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        raw = lambda t: bytes(chars[c] for c in t)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: raw(t) for t, i in model["vocab"].items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(ids[raw(a)], ids[raw(b)]): (k, ids[raw(a) + raw(b)]) for k, (a, b) in enumerate(merges)}
        self.halves = {new: pair for pair, (_, new) in reversed(self.merges.items())}
        self.made = {new: self.merges[pair][0] for new, pair in self.halves.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        # Only tokens that merging can reach may end a prefix.
        self.ids = {b: i for b, i in ids.items() if len(b) == 1 or self.merge(b) == [i]}
        sizes: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                sizes.setdefault(t[-3:], set()).add(len(t))
        #: Token lengths that occur before three last bytes, the longest first.
        self.sizes = {end: (*sorted(found, reverse=True), *_SHORT) for end, found in sizes.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.most = CACHE_PIECES
        self.pieces: dict[str, tuple[str, bytes]] = {}
        self.words: dict[bytes, tuple[str, bytes]] = {}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: merges by rank, the leftmost first."""
        out = [self.single[b] for b in data]
        while len(out) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            pair, i, new = (out[best[1]], out[best[1] + 1]), 0, []
            while i < len(out):
                if i + 1 < len(out) and (out[i], out[i + 1]) == pair:
                    new.append(self.merges[pair][1])
                    i += 2
                else:
                    new.append(out[i])
                    i += 1
            out = new
        return out

    def compatible(self, last: int, token: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together.

        Undoes the merges of both tokens, latest first, and looks at each pair that then meets at the
        boundary: had that pair a merge of lower rank than the one undone, it would have come first.
        """
        key = (last, token)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self._apart(last, token)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # made[t]: rank of the merge that makes t, -1 for a byte. A pair at the boundary exists from the
        # later of its tokens' merges until the earlier of the merges that swallow them.
        until_left = until_right = len(self.made) + 1
        while True:
            merge = self.merges.get((left, right))
            # Of merges of one rank, the leftmost comes first: inside `left` it precedes, inside `right` it follows.
            if merge is not None and merge[0] < until_left and merge[0] <= until_right:
                return False
            a, b = self.made.get(left, -1), self.made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a >= b:
                until_left, left = a, self.halves[left][1]
            else:
                until_right, right = b, self.halves[right][0]

    def encode_words(self, words: set[bytes]) -> None:
        """Encode distinct words. Sorted order walks their trie depth first; the stack holds the states of the current path."""
        ids, sizes, fits, apart, raw, known = self.ids, self.sizes, self.fits, self.compatible, self.bytes, self.words
        path, state = b"", [-1]  # state[n]: last token of the encoding of path[:n]
        for word in sorted(words):
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del state[shared + 1 :]
            for n in range(shared + 1, len(word) + 1):
                for size in sizes.get(word[n - 3 : n], _SHORT) if n > 2 else _SHORT:
                    if size > n:
                        continue
                    token = ids.get(word[n - size : n])
                    if token is not None:
                        if size == n:
                            break
                        fit = fits.get((state[n - size], token))
                        if fit or (fit is None and apart(state[n - size], token)):
                            break
                state.append(token)
            path, n, out = word, len(word), []
            while n:
                out.append(state[n])
                n -= len(raw[state[n]])
            out.reverse()
            known[word] = ",".join(map(str, out)), b"".join([raw[i] for i in out])

    def forget(self) -> None:
        self.pieces, self.words = {}, {}

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not known yet."""
        if len(self.pieces) + len(pieces) > self.most:
            self.forget()
        words, parts = self.words, {}
        for p in pieces:
            body = p[1:] if p[0] == " " else p
            if body.isascii() and body.isalpha():
                parts[p] = [p.encode()]
            elif body[:-1].isascii() and body[:-1].isalpha() and body[-1] in ".,;!":
                parts[p] = [p[:-1].encode(), p[-1].encode()]
            else:
                parts[p] = [w.encode() for w in _PRE.findall(p)]
        self.encode_words({w for ws in parts.values() for w in ws if w not in words})
        for p, ws in parts.items():
            self.pieces[p] = words[ws[0]] if len(ws) == 1 else (",".join([words[w][0] for w in ws]), b"".join([words[w][1] for w in ws]))

    def split(self, text: str) -> list[str]:
        """Pieces that encode apart; together they are the text."""
        if not text:
            return []
        if _ODD.search(text):
            return _PRE.findall(text)
        first, *rest = text.split(" ")
        return [*([first] if first else []), *[" " + x for x in rest]]

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """(ids joined by commas, decoded bytes) of each text."""
        cut = []
        for t in texts:
            at, parts = 0, []
            for m in self.cut.finditer(t) if self.cut else ():
                parts += [self.split(t[at : m.start()]), m[0]]
                at = m.end()
            cut.append([*parts, self.split(t[at:])])
        new = {p for parts in cut for ps in parts if not isinstance(ps, str) for p in ps if p not in self.pieces}
        if len(self.pieces) + len(new) > self.most:
            new = {p for parts in cut for ps in parts if not isinstance(ps, str) for p in ps}
        self.learn(new)
        known, out = self.pieces, []
        for parts in cut:
            got = []
            for ps in parts:
                if isinstance(ps, str):
                    got.append((str(self.special[ps]), self.bytes[self.special[ps]]))
                else:
                    got += [known[p] for p in ps]
            out.append((",".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Characters that a task encodes at once.
GROUP_CHARS = 1 << 22


def encode_documents(docs: DataFrame, vocabulary: str, full: bool = False, forget: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; with ``full`` also ids and decoded.

    With ``forget``, a task drops the pieces that it has learnt when it ends: a worker outlives its tasks,
    and where other kinds of stages share the executors, they need the memory. Else later tasks use them.
    It also remembers fewer at once.
    """

    def run(batches):
        enc = encoder(vocabulary)
        enc.most = FEWER_PIECES if forget else CACHE_PIECES
        for b in batches:
            ids_out, texts = b.column("doc_id"), b.column("text")
            row = 0
            while row < len(texts):
                group, size, start = [], 0, row
                while row < len(texts) and (not group or size < GROUP_CHARS):
                    group.append(texts[row].as_py() or "")
                    size += len(group[-1])
                    row += 1
                got = enc.encode(group)
                decoded = [raw.decode("utf-8", "replace") for _, raw in got]
                cols = [
                    ids_out.slice(start, row - start),
                    pa.array([csv.count(",") + 1 if csv else 0 for csv, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(csv.encode()).hexdigest() for csv, _ in got]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                if full:
                    cols += [pa.array([np.fromstring(csv, np.int32, sep=",") for csv, _ in got], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(cols, names)
        if forget:
            enc.forget()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])]
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return docs.select("doc_id", "text").mapInArrow(lean(run) if forget else run, schema)
