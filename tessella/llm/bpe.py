"""Byte-level BPE by dynamic programming over prefixes.

A BPE encoding of a string ends in exactly one token for every prefix of it. So for each prefix the
tokens that are suffixes of it (found through a suffix automaton of the vocabulary) are tried, and
the one that is compatible with the last token of the prefix before it is kept; the ids are read off
by following the back-pointers. Two tokens are compatible if merging their joined bytes gives the
two tokens again. Pieces repeat, so each worker remembers the encodings of the pieces that it met.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import by_chars, map_batches, ship_file, table, texts

PIECE_CACHE_BYTES = 24_000_000  # of remembered pieces with their ids, in each worker; longer pieces are not kept
LONGEST_KEPT = 100  # code points of a piece that is remembered
PAIR_CACHE = 200_000
CHARS_AT_ONCE = 500_000
_ENTRY = 200  # bytes that Python needs for a remembered piece besides its text and ids


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class SuffixAutomaton:
    """Of a set of byte strings; each state knows the strings of the set that end there.

    Transitions are in one dict, by state and byte; links and lengths in flat arrays.
    """

    def __init__(self, items: list[bytes]):
        self.go: dict[int, int] = {}
        self.out: list[bytes] | None = [b""]  # the bytes that leave each state, while it is built
        self.link, self.length = array("i", [-1]), array("i", [0])
        for item in items:
            last = 0
            for c in item:
                last = self._extend(last, c)
        own: dict[int, list[int]] = {}
        for k, item in enumerate(items):
            s = 0
            for c in item:
                s = self.go[s << 8 | c]
            own.setdefault(s, []).append(k)
        self.out = None
        #: for each state, the indices of the items that are suffixes of its longest string, longest first
        self.suffixes: list[tuple[int, ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            below = self.suffixes[self.link[s]]
            self.suffixes[s] = (*own[s], *below) if s in own else below  # the items of one state are equal in length

    def _extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        there = go.get(last << 8 | c)
        if there is not None:
            return there if length[there] == length[last] + 1 else self._split(last, c, there)
        new = self._state(-1, length[last] + 1)
        p = last
        while p != -1 and p << 8 | c not in go:
            self._lead(p, c, new)
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = go[p << 8 | c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        go, link = self.go, self.link
        copy = self._state(link[q], self.length[p] + 1)
        for d in self.out[q]:
            self._lead(copy, d, go[q << 8 | d])
        link[q] = copy
        while p != -1 and go.get(p << 8 | c) == q:
            go[p << 8 | c] = copy
            p = link[p]
        return copy

    def _lead(self, p: int, c: int, to: int) -> None:
        self.go[p << 8 | c] = to
        self.out[p] += bytes((c,))

    def _state(self, link: int, length: int) -> int:
        self.link.append(link)
        self.length.append(length)
        self.out.append(b"")
        return len(self.link) - 1


class PrefixEncoder:
    """Encodes and decodes with the vocabulary in a tokenizers JSON file of the byte-level kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {bytes(map(alphabet.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        as_bytes = lambda s: bytes(map(alphabet.__getitem__, s))
        #: of two tokens a and b, under a << 20 | b: the place in the list of merges
        self.rank = {vocab[as_bytes(a)] << 20 | vocab[as_bytes(b)]: k for k, (a, b) in enumerate(merges)}
        self.merged = array("i", [vocab[as_bytes(a + b)] for a, b in merges])
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        self.of_id: list[bytes] = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for k, v in vocab.items():
            self.of_id[v] = k
        for k, v in special.items():
            self.of_id[v] = k.encode()
        reachable = set(self.byte_id) | set(self.merged)
        tokens = [(k, v) for k, v in vocab.items() if v in reachable]
        self.automaton = SuffixAutomaton([k for k, _ in tokens])
        #: for each state, (length, id) of the tokens that may end there; one pair for each token, shared by all states
        pair = [(len(k), v) for k, v in tokens]
        self.candidates = [tuple(map(pair.__getitem__, x)) for x in self.automaton.suffixes]
        self.automaton.suffixes = []
        self.parts = self._parts()
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # the public byte-level pattern
        self.latin_pieces = self._latin_pattern()
        self.special = special
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def forget(self) -> None:
        """Lets go of what was remembered from texts; the vocabulary's tables stay."""
        for held in (self.known, self.pairs, self.left, self.right):
            held.clear()
        self.known_bytes = 0

    @staticmethod
    def _latin_pattern() -> re.Pattern[str]:
        """The same pattern for texts of code points under 256, with its classes written out for the faster engine."""
        of = lambda kind: re.escape("".join(c for c in map(chr, range(256)) if regex.match(kind, c)))
        letter, number, space = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")

    def _parts(self) -> dict[int, int]:
        """For each merged token, the place of the merge that makes it last when its own bytes are merged."""
        made: dict[int, list[int]] = {}
        for k, new in enumerate(self.merged):
            made.setdefault(new, []).append(k)
        self.two = array("i", [0]) * (2 * len(self.merged))
        for pair, k in self.rank.items():
            self.two[2 * k], self.two[2 * k + 1] = pair >> 20, pair & 0xFFFFF
        return {token: ks[0] if len(ks) == 1 else self._last_merge(token) for token, ks in made.items()}

    def _last_merge(self, token: int) -> int:
        """Which of several merges makes this token when its own bytes are merged."""
        ids = [self.byte_id[b] for b in self.of_id[token]]
        while len(ids) > 2:
            rank, k = min((self.rank[p], k) for k, p in enumerate(a << 20 | b for a, b in zip(ids, ids[1:])) if p in self.rank)
            ids[k : k + 2] = [self.merged[rank]]
        return self.rank[ids[0] << 20 | ids[1]]

    def spine(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The token's first (side 0) or last (side 1) part at every stage of its own merging, with the rank that absorbs the part."""
        found, rank, part = [(token, len(self.merged))], self.parts.get(token), token
        while rank is not None:
            part = self.two[2 * rank + side]
            found.append((part, rank))
            rank = self.parts.get(part)
        return tuple(found[::-1])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two again.

        Follows the two parts that touch at the seam while each grows inside its own token, and asks
        whether they would merge with each other first. Of equal ranks the merge further left comes first.
        """
        grow_a, grow_b, rank = self.right.get(a), self.left.get(b), self.rank
        if grow_a is None:
            grow_a = self.right[a] = self.spine(a, 1)
        if grow_b is None:
            grow_b = self.left[b] = self.spine(b, 0)
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = grow_a[i], grow_b[j]
            cross = rank.get(x << 20 | y)
            if cross is not None and cross < until_x and cross <= until_y:
                return False
            if until_x <= until_y:
                if i + 1 == len(grow_a):
                    return True
                i += 1
            else:
                j += 1

    def encode_sorted(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: the last token of every prefix, then the back-pointers.

        Pieces that follow each other share what was found for their common prefix.
        """
        auto, candidates, pairs = self.automaton, self.candidates, self.pairs
        go, link, length = auto.go, auto.link, auto.length
        states, matches, last, size = [0], [0], [-1], [0]
        before, out = b"", []
        for data in pieces:
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            before = data
            del states[same + 1 :], matches[same + 1 :], last[same + 1 :], size[same + 1 :]
            state, matched = states[same], matches[same]
            for i in range(same + 1, len(data) + 1):
                c = data[i - 1]
                there = go.get(state << 8 | c)
                while there is None and state:
                    state = link[state]
                    matched = length[state]
                    there = go.get(state << 8 | c)
                if there is None:
                    raise ValueError("the vocabulary lacks a byte of the text")
                state = there
                matched += 1
                for n, token in candidates[state]:
                    if n > matched:
                        continue
                    if n == i:
                        break
                    prior = last[i - n]
                    key = prior << 20 | token
                    good = pairs.get(key)
                    if good is None:
                        good = pairs[key] = self.compatible(prior, token)
                    if good:
                        break
                states.append(state)
                matches.append(matched)
                last.append(token)
                size.append(n)
            ids, i = [], len(data)
            while i:
                ids.append(last[i])
                i -= size[i]
            out.append(array("I", ids[::-1]).tobytes())
            if len(pairs) > PAIR_CACHE:
                pairs.clear()
                self.left.clear()
                self.right.clear()
        return out

    def learn(self, found: set[str]) -> dict[str, bytes]:
        """Ids of all these pieces: those that are known, and the others, of which the shorter are remembered."""
        new = found.difference(self.known)
        order = sorted((x.encode(), x) for x in new)
        made = dict(zip((x for _, x in order), self.encode_sorted([b for b, _ in order])))
        if len(new) < len(found):
            made.update((x, self.known[x]) for x in found.difference(new))
        kept = [x for x in new if len(x) <= LONGEST_KEPT]
        size = sum(_ENTRY + 2 * len(x) + len(made[x]) for x in kept)
        if self.known_bytes + size > PIECE_CACHE_BYTES:
            self.known.clear()
            self.known_bytes = 0
        if size <= PIECE_CACHE_BYTES:
            self.known.update((x, made[x]) for x in kept)
            self.known_bytes += size
        return made

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pieces.findall(text)
        return self.latin_pieces.findall(text)

    def encode_all(self, batch: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self._marked(t) for t in batch]
        found: set[str] = set()
        for text in parts:
            for special, x in text:
                if not special:
                    found.update(x)
        known = self.learn(found).__getitem__
        for text in parts:
            yield b"".join([array("I", [self.special[x]]).tobytes() if special else b"".join(map(known, x)) for special, x in text])

    def _marked(self, text: str) -> list[tuple[bool, list[str] | str]]:
        """The text's pieces between reserved strings, and these."""
        if not any(s in text for s in self.special):
            return [(False, self.cut(text))]
        return [(s in self.special, s if s in self.special else self.cut(s)) for s in self.special_split.split(text)]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        of_id = self.of_id
        return b"".join([of_id[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """One encoder for each worker and file; of several files the last stays."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = PrefixEncoder(path)
    return _LOADED[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (unless ``keep_ids`` is false), ids_sha256 and decoded_sha256 for each row.

    The decoded text is read back from the ids. Null text counts as empty: no ids, the digest of
    nothing. Texts of any length are streamed row by row; repeated rows are each encoded; an empty
    table gives no rows; other columns are ignored. Nothing is shuffled.
    """
    name = ship_file(docs.sparkSession, path or vocabulary())
    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        try:
            for batch in by_chars(batches, 1, CHARS_AT_ONCE):
                n, a, b, lists = [], [], [], []
                for ids in enc.encode_all(texts(batch.column(1))):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                    if keep_ids:
                        lists.append(np.frombuffer(ids, "<u4").astype("i4"))
                out = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    out.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)
        finally:
            enc.forget()

    return map_batches(docs.select("doc_id", "text"), run, columns)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with the 50k byte-level vocabulary and decoded again."""
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)
