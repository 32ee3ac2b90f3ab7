"""Byte-level BPE by traversal of a trie of distinct words.

A BPE encoding is decided by its neighbouring pairs: a sequence of tokens is the encoding of
its bytes if and only if each token is the encoding of its own bytes and each neighbouring
pair is the encoding of the pair's bytes. So one state per trie node, the last token of the
encoding of the prefix that ends there, is enough: it is the token that is a suffix of the
prefix and pairs with the state of the node where that suffix begins. The distinct words of a
batch are put in a trie, held in depth-first order as sorted words with shared-prefix
lengths, and a state is computed once for each node, however many words share it.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigspark.llm.common import map_batches, small_batches

#: The split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks that are a word of their own after letters, as the pattern has it.
MARKS = frozenset(".,;:!?")
#: White space before a space: there the pattern may join the space to what is before.
SPACED = re.compile(r"\s ")
#: Bytes of encoded pieces that a worker keeps, by an estimate of ENTRY bytes a piece beside its text and ids, in two halves: when the
#: young half is full it becomes the old one, and what the old one had and was not used again is gone. Pairs and transitions kept.
CACHE_BYTES, ENTRY, KEPT = 110_000_000, 200, 300_000
#: Characters of texts whose pieces are gathered at a time.
BLOCK_CHARS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder for one tokenizers JSON file with byte-level pre-tokenizer, BPE model and no normalizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if spec.get("normalizer") or model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path}: byte-level BPE without a normalizer is needed")
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        ids = model["vocab"]
        self.text = {i: raw[t] for t, i in ids.items() if t in raw}
        self.rank: dict[tuple[int, int], int] = {}
        #: token -> (rank of the merge that makes it, its two parts); single bytes have rank -1.
        self.made: dict[int, tuple[int, int, int]] = {ids[t]: (-1, -1, -1) for t, b in raw.items() if len(b) == 1}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[ids[a], ids[b]] = r
            self.made.setdefault(ids[a + b], (r, ids[a], ids[b]))
        self.of = {self.text[i]: i for i in self.made}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self._suffixes()
        self.packed = [struct.pack("<I", i) for i in range(max(self.text) + 1)]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens") or []):
            raise ValueError(f"{path}: added tokens with strip, word or normalisation rules are not supported")
        self.text |= {i: t.encode() for t, i in self.added.items()}
        self.find_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split = regex.compile(SPLIT)
        #: young and old half: (words and pieces that follow no space, those that follow one) -> packed ids, with the space's.
        self.young: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.held = 0  # estimated bytes of the young half

    def _suffixes(self) -> None:
        """An automaton over bytes whose states know the tokens that are suffixes of what was read, longest first.

        goto: state << 8 | byte -> state, filled for the tokens' own bytes and lazily for the rest;
        fail: the state of the longest proper suffix; ending: (token, its bytes) for each suffix token.
        """
        goto: dict[int, int] = {}
        fail, mine, depth, letters = [0], [-1], [0], [0]
        parents = [0]
        for b, t in sorted(self.of.items(), key=lambda x: len(x[0])):
            at = 0
            for byte in b:
                nxt = goto.get(at << 8 | byte)
                if nxt is None:
                    nxt = goto[at << 8 | byte] = len(fail)
                    fail.append(0)
                    mine.append(-1)
                    depth.append(depth[at] + 1)
                    letters.append(byte)
                    parents.append(at)
                at = nxt
            if self.whole(t):
                mine[at] = t
        ending: list[tuple[tuple[int, int], ...]] = [()] * len(fail)
        for s in sorted(range(1, len(fail)), key=depth.__getitem__):
            if depth[s] > 1:
                f = fail[parents[s]]
                while (to := goto.get(f << 8 | letters[s])) is None and f:
                    f = fail[f]
                fail[s] = to or 0
            ending[s] = (((mine[s], depth[s]),) if mine[s] >= 0 else ()) + ending[fail[s]]
        #: the tokens' own transitions, and with those that were asked for beyond them.
        self.trie, self.goto, self.fail, self.ending = goto, dict(goto), fail, ending

    def _go(self, state: int, byte: int) -> int:
        s = state
        while (to := self.goto.get(s << 8 | byte)) is None and s:
            s = self.fail[s]
        self.goto[state << 8 | byte] = to or 0
        return to or 0

    def whole(self, t: int) -> bool:
        """Whether t is the encoding of its own bytes."""
        if (known := self.own.get(t)) is None:
            r, a, b = self.made[t]
            known = self.own[t] = r < 0 or self.whole(a) and self.whole(b) and self._apart(a, b, r, r, False)
        return known

    def pair(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their joined bytes, each being that of its own."""
        if (known := self.pairs.get((a, b))) is None:
            known = self.pairs[a, b] = self._apart(a, b, 1 << 60, 1 << 60, True)
        return known

    def _apart(self, x: int, y: int, x_used: int, y_used: int, check: bool) -> bool:
        """No merge takes place over the seam between x and y at any time of the merging.

        Walks back in time: x and y are what touches the seam, x_used and y_used the ranks at which
        they go into something larger. The seam's own merge would come first if its rank is below
        x_used (equal ranks go left to right) and not above y_used.
        """
        made, rank = self.made, self.rank
        while True:
            if check and (r := rank.get((x, y))) is not None and r < x_used and r <= y_used:
                return False
            check = True
            rx, ry = made[x][0], made[y][0]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:  # of two equal ones, the left was made first
                x, x_used = made[x][2], rx
            else:
                y, y_used = made[y][1], ry

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each distinct word with its packed ids, by depth-first traversal of the words' trie."""
        goto, ending, pairs, pair, packed = self.goto, self.ending, self.pairs, self.pair, self.packed
        last: list[int] = []  # last token at each depth of the current path
        size: list[int] = []  # and its bytes
        auto: list[int] = [0]  # the automaton's state before each depth
        before = b""
        for word in sorted(words):
            same, n = 0, min(len(word), len(before))
            while same < n and word[same] == before[same]:
                same += 1
            del last[same:], size[same:], auto[same + 1 :]
            before, s = word, auto[-1]
            for end in range(same, len(word)):
                to = goto.get(s << 8 | word[end])
                s = self._go(s, word[end]) if to is None else to
                auto.append(s)
                for t, k in ending[s]:
                    if k > end:
                        break
                    key = last[end - k], t
                    if (fits := pairs.get(key)) or fits is None and pair(*key):
                        break
                else:
                    raise ValueError(f"no token for byte {word[end]}")
                last.append(t)
                size.append(k)
            out, at = [], len(word)
            while at:
                out.append(packed[last[at - 1]])
                at -= size[at - 1]
            yield word, b"".join(reversed(out))

    def _learn(self, wanted: tuple[set[str], set[str]]) -> None:
        """Puts pieces that follow no space, and those that follow one, in the young half; words are pieces, too."""
        findall, old = self.split.findall, self.old
        parts: list[tuple[int, str, list[tuple[int, str]]]] = []
        new: list[dict[str, None]] = [{}, {}]
        size = 0
        for k, space in ((0, ""), (1, " ")):
            young = self.young[k]
            for p in wanted[k].difference(young):
                if (code := old[k].get(p)) is not None:
                    young[p] = code
                    size += ENTRY + len(p) + len(code)
                elif p.isalpha():
                    new[k][p] = None
                elif p and p[-1] in MARKS and p[:-1].isalpha():
                    w = p[:-1]
                    parts.append((k, p, [(k, w), (0, p[-1])]))
                    for i, w in parts[-1][2]:
                        if w not in self.young[i] and w not in new[i]:
                            if (code := old[i].get(w)) is not None:
                                self.young[i][w] = code
                                size += ENTRY + len(w) + len(code)
                            else:
                                new[i][w] = None
                else:
                    ws = [(1, w[1:]) if w[0] == " " and w[1:] and not w[1].isspace() else (0, w) for w in findall(space + p)]
                    if len(ws) == 1:
                        new[ws[0][0]][ws[0][1]] = None
                    if ws != [(k, p)]:
                        parts.append((k, p, ws))
                    for i, w in ws:
                        if w not in self.young[i]:
                            if (code := old[i].get(w)) is not None:
                                self.young[i][w] = code
                                size += ENTRY + len(w) + len(code)
                            else:
                                new[i][w] = None
        words = {(" " + w if k else w).encode(): (k, w) for k in (0, 1) for w in new[k] if w not in self.young[k]}
        for raw, code in self.encode_words(words):
            k, w = words[raw]
            self.young[k][w] = code
            size += ENTRY + len(w) + len(code)
        for k, p, ws in parts:
            self.young[k][p] = code = b"".join([self.young[i][w] for i, w in ws])
            size += ENTRY + len(p) + len(code)
        self.held += size

    def _age(self) -> None:
        """Called between blocks: keeps the tables within their bounds."""
        if self.held > CACHE_BYTES // 2:
            self.old, self.young, self.held = self.young, ({}, {}), 0
        if len(self.pairs) > KEPT:
            self.pairs.clear()
        if len(self.goto) > len(self.trie) + KEPT:
            self.goto = dict(self.trie)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text.

        A text is cut at its spaces, which the split pattern never joins to what is before; one with white space before
        a space is cut by the pattern itself.
        """
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            chars, end = 0, at
            block: list[list[tuple[int, list, bytes]]] = []
            wanted: tuple[set[str], set[str]] = (set(), set())
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BLOCK_CHARS):
                text = texts[end]
                spans: list[tuple[int, list, bytes]] = []
                for i, part in enumerate(self.find_added.split(text) if self.find_added and "<|" in text else [text]):
                    if i % 2:
                        spans.append((0, [], struct.pack("<I", self.added[part])))
                    elif SPACED.search(part):
                        words = [(1, w[1:]) if w[0] == " " and w[1:] and not w[1].isspace() else (0, w) for w in self.split.findall(part)]
                        spans.append((2, words, b""))
                        for k, w in words:
                            wanted[k].add(w)
                    elif part:
                        pieces = part.split(" ")
                        spans.append((1, pieces, b""))
                        wanted[0].add(pieces[0])
                        wanted[1].update(pieces[1:])
                block.append(spans)
                chars, end = chars + len(text), end + 1
            self._learn(wanted)
            first, after = self.young
            get = after.__getitem__
            for spans in block:
                out.append(b"".join([first[p[0]] + b"".join(map(get, p[1:])) if kind == 1 else b"".join([self.young[k][w] for k, w in p]) if kind else code for kind, p, code in spans]))
            self._age()
            at = end
        return out

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, special tokens included; bytes that are not UTF-8 give U+FFFD."""
        return b"".join(map(self.text.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> TrieBpe:
    return TrieBpe(path)


def transcode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `token_ids` binary (little-endian unsigned 32-bit ids of the whole text) and `decoded` string.

    A null text counts as empty and gives no ids and an empty text. Every row gives one, repeated ones too; an
    empty df gives an empty result; columns of df other than `keep` and the text are not read, and `keep` must not name
    the results. No shuffle: each task builds the tries of its own batches, in memory bounded by CACHE_BYTES, a block and the
    longest text. path: a tokenizers JSON file at the same place on every executor.
    """
    small_batches(df.sparkSession)
    narrow = df.select(*keep, text)
    schema = T.StructType([*narrow.select(*keep).schema.fields, T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path)
        ids = bpe.encode_batch([t or "" for t in b[text].to_pylist()])
        return pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], schema.names)

    return map_batches(narrow, run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `decoded`, the text of packed ids; null ids give null."""
    narrow = df.select(*keep, ids)
    schema = T.StructType([*narrow.select(*keep).schema.fields, T.StructField("decoded", T.StringType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path)
        return pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array([None if x is None else bpe.decode(x) for x in b[ids].to_pylist()], pa.string())], schema.names)

    return map_batches(narrow, run, schema)
