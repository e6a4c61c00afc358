"""Token ids, exact token counts of every prefix, and cutting documents into pieces."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwright.llm.common import small_batches, text_or_empty
from partwright.session import cut_lineage

#: Values kept per store and generation in a Python worker.
KEPT = 250_000
#: Pairs of tokens whose fit is kept.
PAIRS = 1_000_000
LONG = 96
#: Characters whose class all Unicode versions agree on; other chunks are split by the library itself.
UNSURE = re.compile(r"[^\t-\r -~\xa1-ɏ]")
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_S = r"\t-\r "
#: The split of byte-level BPE (contractions, letters, numbers, others, white space).
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
SPACE_RUN = re.compile(r"\s\s")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
TWO_STEPS = {"'re", "'ve", "'ll"}


class OddSpace(Exception):
    """White space beside a space: the text can't be cut at its spaces."""


def is_space(c: str) -> bool:
    """White space as the vocabulary's split has it (``str.isspace`` also takes four separators)."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


class Store(dict):
    """Values computed when first asked for. Two generations of ``KEPT`` values are kept; what is in use moves up."""

    def __init__(self, value):
        super().__init__()
        self.value, self.older = value, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.value(word)
        if len(word) <= LONG:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


def _after_space(value):
    """``value`` of a word with the space before it."""

    def found(word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise OddSpace
        return value(" " + word)

    return found


def _first(value):
    def found(word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise OddSpace
        return value(word)

    return found


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character; this is the way back."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary file with its library tokenizer.

    The library gives the ids. Texts are cut before single spaces, where its split always ends a piece, and chunks met
    before are not encoded again. Chunks of unambiguous characters go through the faster rank encoder, which gives
    the same ids for files whose merges are in id order (else it isn't used).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = _bytes_of_symbols()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.longest = max(map(len, self.ranks))
        self.fast = self._rank_encoder(spec)
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        vocab = spec["model"]["vocab"]
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        for order, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[left + right]
            self.halves.setdefault(whole, (vocab[left], vocab[right]))
            self.joined[vocab[left], vocab[right]] = (order, whole)
        self._born = {whole: self.joined[pair][0] for whole, pair in self.halves.items()}
        # Finds all tokens that end at each byte of a piece, longest first; a token is its length and its id in one number.
        self.ends = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.ends.add_word(token.decode("latin-1"), len(token) << 32 | i)
        self.ends.make_automaton()
        self._fits: dict[int, bool] = {}
        self.piece_steps = Store(self._piece_steps)
        self.ids_after, self.ids_first = Store(_after_space(self._ids)), Store(_first(self._ids))
        self.steps_after, self.steps_first = Store(_after_space(self._steps)), Store(_first(self._steps))

    def _rank_encoder(self, spec: dict):
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        ids = [vocab[m.replace(" ", "", 1)] for m in merges]
        if ids != sorted(ids):
            return None
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def _ids(self, chunk: str) -> bytes:
        if self.fast is not None and not UNSURE.search(chunk):
            found = self.fast.encode_ordinary(chunk)
        else:
            found = self.library.encode(chunk, add_special_tokens=False).ids
        return array("I", found).tobytes() if LITTLE else np.array(found, dtype="<u4").tobytes()

    def _whole(self, text: str, first: Store, after: Store, other) -> bytes:
        if not text:
            return b""
        if self._special is not None and self._special.search(text):
            return other(text)
        head, *rest = text.split(" ")
        try:
            return first[head] + b"".join(map(after.__getitem__, rest))
        except OddSpace:
            return other(text)

    def ids(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        return self._whole(text, self.ids_first, self.ids_after, lambda t: np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes())

    # Prefix counts

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens, written together, stay these two tokens.

        They don't if some merge across their border comes before the merges that complete the tokens beside it. The
        tokens at the border are, going back in time, the right halves of ``left`` and the left halves of ``right``;
        at every step the one completed last is taken apart, and the pair at the border must not have been merged
        before that time (at equal times the leftmost merge comes first).
        """
        born, joined, halves = self._born, self.joined, self.halves
        until = (1 << 60, 0)
        while True:
            merge = joined.get((left, right))
            if merge is not None and (merge[0], 1) < until:
                return False
            l, r = born.get(left, -1), born.get(right, -1)
            if l < 0 and r < 0:
                return True
            if r >= l:
                until, right = (r, 2), halves[right][0]
            else:
                until, left = (l, 0), halves[left][1]

    def _counted(self, data: bytes) -> tuple[list[int], list[int]]:
        """Tokens of every byte prefix of one piece, from the empty one on, and the change with each byte.

        Dynamic programming: the last token of a prefix is the token that ends there and stays whole after the last
        token of the prefix before it; there is one such token, and its count is one more.
        """
        count, last, steps = [0] * (len(data) + 1), [-1] * (len(data) + 1), [0] * len(data)
        fits, known, done = self._fits, self._fits.get, -1
        if len(fits) > PAIRS:
            fits.clear()
        for end, token in self.ends.iter(data.decode("latin-1")):
            if end == done:
                continue
            start = end + 1 - (token >> 32)
            token &= 0xFFFFFFFF
            if start:
                pair = last[start] << 32 | token
                fit = known(pair)
                if fit is None:
                    fit = fits[pair] = self._fit(last[start], token)
                if not fit:
                    continue
            done = end
            count[end + 1] = now = count[start] + 1
            last[end + 1] = token
            steps[end] = now - count[end]
        return count, steps

    def piece_counts(self, data: bytes) -> list[int]:
        return self._counted(data)[0]

    def _piece_steps(self, piece: str) -> bytes:
        data = piece.encode()
        counts, steps = self._counted(data)
        if len(data) > len(piece):
            # A character's change is that of its bytes together: sum them up to the byte before the next character.
            ends = [k for k in range(1, len(data)) if data[k] & 0xC0 != 0x80] + [len(data)]
            steps = [counts[b] - counts[a] for a, b in zip([0, *ends], ends)]
        elif piece in TWO_STEPS:
            # A contraction cut short is an apostrophe and a letter.
            counts[2] = self.piece_counts(data[:1])[-1] + self.piece_counts(data[1:2])[-1]
            steps = [b - a for a, b in zip(counts, counts[1:])]
        return array("h", steps).tobytes()

    def _split(self, chunk: str) -> list[str]:
        if not UNSURE.search(chunk):
            return SPLIT.findall(chunk)
        spans = self.library.pre_tokenizer.pre_tokenize_str(chunk)
        return [chunk[a:b] for _, (a, b) in spans]

    def _steps(self, chunk: str) -> bytes:
        """Change of the token count with each character of a text, as 16-bit integers."""
        pieces = self._split(chunk)
        if not SPACE_RUN.search(chunk):
            return b"".join(map(self.piece_steps.__getitem__, pieces))
        # A cut within a run of white space leaves all of the run so far as one piece.
        out: list[bytes] = []
        base, run, run_base, now = 0, "", 0, 0
        for piece in pieces:
            own = np.frombuffer(self.piece_steps[piece], dtype=np.int16)
            counts = base + np.cumsum(own, dtype=np.int64)
            k = 0
            while k < len(piece) and is_space(piece[k]):
                run_base = run_base if run else base
                run += piece[k]
                counts[k] = run_base + self.piece_counts(run.encode())[-1]
                k += 1
            if k < len(piece):
                run = ""
            out.append(np.diff(counts, prepend=now).astype(np.int16).tobytes())
            now = int(counts[-1])
            base += int(own.sum(dtype=np.int64))
        return b"".join(out)

    def _any_steps(self, text: str) -> bytes:
        """As ``_steps``, with a special string counted as one token once it is complete."""
        out: list[bytes] = []
        at = 0
        for m in self._special.finditer(text) if self._special is not None else ():
            plain = np.frombuffer(self._steps(text[at : m.start()]), dtype=np.int16)
            open_ = np.frombuffer(self._steps(text[at : m.end()]), dtype=np.int16).astype(np.int64)
            counts = np.cumsum(open_)
            counts[: len(plain)] = np.cumsum(plain, dtype=np.int64)
            counts[-1] = (counts[len(plain) - 1] if len(plain) else 0) + 1
            out.append(np.diff(counts, prepend=0).astype(np.int16).tobytes())
            at = m.end()
        return b"".join(out) + self._steps(text[at:])

    def prefix_steps(self, text: str) -> bytes:
        """Change of the token count with each character: their running sum is the count of every prefix."""
        return self._whole(text, self.steps_first, self.steps_after, self._any_steps)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per Python worker."""
    return Vocabulary(path)


def prefix_counts(steps: bytes) -> np.ndarray:
    """Exact token count of every prefix (of 1, 2, ... characters)."""
    return np.cumsum(np.frombuffer(steps, dtype=np.int16), dtype=np.int64)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_counts(docs: DataFrame, path: str, budget: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_steps: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, budget_chars`` (and ``steps`` on request), one row per input row.

    ``steps`` holds the change of the token count with each character as 16-bit integers: ``prefix_counts`` turns it
    into the exact count of every prefix, so that truncation and budget questions need no tokenizer.
    ``budget_chars`` is one answer: the characters of the longest prefix of at most ``budget`` tokens.

    Null and empty texts have no tokens. Texts are never cut; any length takes time in proportion. Repeated ids are
    counted row by row, null ids are kept, further columns are ignored, a table without rows gives none.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                steps = vocab.prefix_steps(text)
                n = np.frombuffer(steps, dtype=np.int16)
                total = int(n.sum())
                fits = len(text) if total <= budget and not (n < 0).any() else longest_within(prefix_counts(steps), budget)
                rows.append((len(text.encode()), total, fits, steps) if with_steps else (len(text.encode()), total, fits))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "budget_chars", "steps"][: 3 + with_steps])
            out.insert(0, "doc_id", batch["doc_id"].values)
            yield out

    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInPandas(count, f"doc_id {kind}, n_bytes long, n_tokens long, budget_chars long" + ", steps binary" * with_steps)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` on request): documents with their end id as pieces.

    Only documents longer than ``capacity`` are cut; all their pieces have that length but the first. A null or empty
    text is its end id alone. Rows are handled one by one, so repeated ids give repeated pieces; null ids are kept;
    further columns are ignored; a table without rows gives none.
    """
    small_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        for batch in batches:
            rows = []
            for k, text in enumerate(batch["text"]):
                ids = vocab.ids(text) + end
                n = len(ids) // 4
                start, length = 0, n % capacity or min(n, capacity)
                piece = 0
                while start < n:
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((k, piece, start, length, zlib.crc32(own), own) if with_ids else (k, piece, start, length, zlib.crc32(own)))
                    start, length, piece = start + length, capacity, piece + 1
            out = pd.DataFrame(rows, columns=["_k", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])
            out.insert(0, "doc_id", batch["doc_id"].values[out.pop("_k").to_numpy(dtype=int)])
            yield out

    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def stored_pieces(docs: DataFrame, path: str, **options) -> DataFrame:
    """``token_pieces`` written once: packing reads them several times."""
    return cut_lineage(token_pieces(docs, path, **options))
