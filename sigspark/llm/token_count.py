"""Token counts of whole texts, long ones by overlapping chunks spliced where both sides agree.

A text above `huge` characters is cut into overlapping chunks, each encoded on its own with offsets. Two neighbours are
spliced at a stable common boundary: a position in their overlap, after white space, at which both
begin a pre-token. The pre-tokenizer reads left to right, nothing before a boundary matters after it, and no pre-token
crosses it, so from there on both chunks would give the same tokens as the whole text. A boundary counts on the left
side only if it lies well before the chunk's own end. Where the overlap holds no such position (one very long
word, say), it is widened and that chunk encoded again. Memory is bounded by a chunk, not by a text's tokens. Shorter
texts are the sums over white-space pieces, each counted once by the library and kept within a bound of bytes.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Encoding, Tokenizer

from sigspark.llm.common import map_batches, small_batches

#: Characters above which a text is counted by chunks (at sf0.001 11 of 200 texts, with 27 % of the characters; on the check tables
#: 7 % of the texts, with 40 %); a chunk's characters; the first overlap; how far a boundary must lie from the left chunk's end.
HUGE, CHUNK, OVERLAP, MARGIN = 8192, 4096, 256, 64
#: Bytes of counted pieces that a worker keeps, by an estimate of ENTRY bytes a piece beside its text, in two halves: when the young half is
#: full it becomes the old one, and what the old one had and was not used again is gone.
CACHE_BYTES, ENTRY = 60_000_000, 150
#: What a boundary's pre-token may begin with, after which white space.
BOUNDARY = re.compile(r"(?<=[ \n\t\r])[^\W_]")
#: White space for str.split but not for the tokenizer's patterns.
SEPARATORS = re.compile("[\x1c-\x1f]")


class Counter:
    """Counts for a tokenizers JSON file that lowers and composes text and whose pre-tokenizer drops white space (and so never joins over it); other files raise ValueError."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        lowers = {x["type"] for x in steps} <= {"NFC", "Replace", "Lowercase"} and {"NFC", "Lowercase"} <= {x["type"] for x in steps}
        drops = splits and splits[0]["type"] == "Split" and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        self.whole = Tokenizer.from_file(path)
        if not (lowers and drops) or any(self.whole.pre_tokenizer.pre_tokenize_str(x) for x in (" ", "\n", "\t", "\xa0 \u2003")) or any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens") or []):
            raise ValueError(f"{path}: a tokenizer that lowers its text and drops white space is needed")
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or "(?!)")
        # a piece is normalised before it is kept, so that both spellings share an entry
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.held = 0  # estimated bytes of the young half

    def _simple(self, text: str) -> str | None:
        """The text as the normaliser would leave it, white space apart; None where only the library should do it."""
        if SEPARATORS.search(text) or "<|" in text and self.special.search(text):
            return None
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                return None
            text = text.replace("Σ", "σ")  # lowered letter by letter there, by context in Python
        return text.lower()

    def count_batch(self, texts: list[str], huge: int = HUGE) -> list[tuple[int, int]]:
        """(tokens, chunks that were encoded) of each text; no chunks where pieces were summed."""
        out, pieces = [(0, 0)] * len(texts), {}
        for i, text in enumerate(texts):
            if len(text) > huge:
                out[i] = self.count_huge(text)
            elif (simple := self._simple(text)) is None:
                out[i] = len(self.whole.encode(text, add_special_tokens=False)), 1
            else:
                pieces[i] = simple.split()
        wanted: set[str] = set()
        for p in pieces.values():
            wanted.update(p)
        wanted.difference_update(self.young)
        known = {p: n for p in wanted if (n := self.old.get(p)) is not None}
        order = list(wanted.difference(known))
        if order:
            known.update(zip(order, map(len, self.whole.encode_batch_fast(order, add_special_tokens=False)), strict=True))
        self.young.update(known)
        self.held += sum(map(len, known)) + ENTRY * len(known)
        get = self.young.__getitem__
        for i, p in pieces.items():
            out[i] = sum(map(get, p)), 0
        if self.held > CACHE_BYTES // 2:
            self.old, self.young, self.held = self.young, {}, 0
        return out

    def count_huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> tuple[int, int]:
        """The whole text's token count from overlapping chunks, and how many were encoded."""
        n = len(text)
        start, end, total, chunks = 0, min(chunk, n), 0, 1
        left = self.whole.encode(text[:end], add_special_tokens=False)
        resume, done = 0, 0  # the boundary from which tokens are still to be counted, and how many of the chunk's lie before it
        while end < n:
            width = overlap
            while True:
                # the next chunk begins in the current one, or where that began if its overlap is all of it
                nxt = max(end - width, start)
                # widening also moves the end, so that a run without boundary is left behind
                nxt_end = min(n, nxt + max(chunk, 2 * width))
                right = self.whole.encode(text[nxt:nxt_end], add_special_tokens=False)
                chunks += 1
                if nxt == start or (found := self._common(text, left, start, max(resume, nxt) + 1, right, nxt, end - margin)):
                    break
                width *= 2
            if nxt == start:  # the longer chunk takes the place of the current one; counting goes on where it stood
                end, left = nxt_end, right
                done = left.char_to_token(resume - start) if resume > start else 0
                continue
            i, j, resume = found
            total += i - done
            start, end, left, done = nxt, nxt_end, right, j
        return total + len(left) - done, chunks

    def _common(self, text: str, left: Encoding, start: int, low: int, right: Encoding, nxt: int, high: int) -> tuple[int, int, int] | None:
        """(tokens of left before it, tokens of right before it, place) of the first stable common boundary from low to high.

        A boundary follows white space, which no pre-token holds and no composition crosses.
        """
        for m in BOUNDARY.finditer(text, low, max(low, high)):
            p = m.start()
            if unicodedata.combining(text[p]):
                continue
            i, j = left.char_to_token(p - start), right.char_to_token(p - nxt)
            if i is not None and j is not None and left.token_to_chars(i)[0] == p - start and right.token_to_chars(j)[0] == p - nxt:
                return i, j, p
        return None


@lru_cache(2)
def loaded(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, `n_bytes` long (of the whole text in UTF-8), `n_tokens` long and `n_chunks` int (0 for texts of at most HUGE characters counted by pieces).

    A null text counts as empty, an empty one has no tokens. Special strings inside texts count as the library's default has
    it, one token each. Every row gives one, repeated ones too; an empty df gives an empty result; columns of df other than
    `keep` and the text are not read, and `keep` must not name the results. No shuffle.
    """
    small_batches(df.sparkSession)
    narrow = df.select(*keep, text)
    schema = T.StructType([*narrow.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_chunks", T.IntegerType())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b[text].to_pylist()]
        sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        counts = loaded(path).count_batch(texts)
        return pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(sizes, pa.int64()), pa.array([n for n, _ in counts], pa.int64()), pa.array([k for _, k in counts], pa.int32())], schema.names)

    return map_batches(narrow, run, schema)
