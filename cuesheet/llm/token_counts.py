"""Token counts by rank-synchronous array merging of byte-level BPE.

Distinct pre-tokens of a batch are one ragged numpy array of symbols. In each step every sequence
looks up the ranks of its neighbouring pairs and merges all occurrences of its own lowest-ranked
pair, all sequences at once; a sequence without a mergeable pair is finished, and its count is the
number of symbols that survive. Counts of pieces seen lately, a space and what follows it, come from a
bounded cache.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cuesheet.llm.runtime import equal_spans, separators, span_hashes, text_pieces, tidy

#: White space as the Unicode property has it (Python's own \\s also takes U+001C to U+001F).
_WS = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the byte-level pre-token pattern, with white space spelled out.
PRETOKEN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_BLANK = separators((0x09, 0x0D), (0x20, 0x20))
#: First bytes of the white space beyond ASCII.
_MAY_BLANK = separators((0xC2, 0xC2), (0xE1, 0xE3))
_NO_RANK = np.int64(1 << 40)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the others take U+0100 and up, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class ArrayBpe:
    """Counts tokens as a byte-level BPE tokenizer file (JSON) defines them, without special tokens added."""

    def __init__(self, source: str, cache_entries: int = 1 << 18):
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if model.get("type") != "BPE" or not plain or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are counted")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need word bounds are not counted")
        vocab = model["vocab"]
        self._size = len(vocab) + 1
        symbols = byte_symbols()
        self._bytes = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self._size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._made = made
        self._table(keys)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._split = regex.compile(PRETOKEN).findall
        self._added_bytes = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        # Counts of pieces seen lately, by two hashes, sorted by the first; emptied when there is no room for more.
        self._keys, self._checks, self._counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._entries = cache_entries

    def _table(self, keys: np.ndarray) -> None:
        """An open-addressed hash table from pair to rank: as many probes as its longest run has entries."""
        self._mask = (1 << max(10, int(len(keys) * 8).bit_length())) - 1
        self._slots = np.full(self._mask + 1, -1, np.int64)
        self._rank = np.full(self._mask + 1, _NO_RANK)
        rest, at, self._probes = np.arange(len(keys)), self._home(keys), 0
        while len(rest):
            free = self._slots[at] < 0
            slot, which = np.unique(np.where(free, at, -1), return_index=True)
            which = which[slot >= 0]
            self._slots[at[which]], self._rank[at[which]] = keys[rest[which]], rest[which]
            left = np.ones(len(rest), bool)
            left[which] = False
            rest, at = rest[left], (at[left] + 1) & self._mask
            self._probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self._mask

    def _rank_of(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        found = self._slots[at]
        out = np.where(found == keys, self._rank[at], _NO_RANK)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self._probes):
            if not len(rest):
                break
            at = (at[rest] if len(at) == len(keys) else at) + 1 & self._mask
            found = self._slots[at]
            hit = found == keys[rest]
            out[rest[hit]] = self._rank[at[hit]]
            go = ~hit & (found >= 0)
            rest, at = rest[go], at[go]
        return out

    def survivors(self, pieces: list[str]) -> np.ndarray:
        """Symbols that are left of each pre-token when no pair can be merged."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(x) for x in raw], np.int64)
        done = np.zeros(len(raw), np.int64)
        sym = self._bytes[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), sizes)
        while len(sym):
            rank = np.full(len(sym), _NO_RANK)
            near = np.flatnonzero(seq[1:] == seq[:-1])
            key = sym[near] * self._size + sym[near + 1]
            rank[near] = self._rank_of(key)
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(sym)))
            over = lowest == _NO_RANK
            done[seq[first[over]]] = counts[over]
            if over.all():
                break
            mine = np.repeat(lowest, counts)
            merge = (rank == mine) & (mine != _NO_RANK)
            where = np.flatnonzero(merge)
            # In a run of neighbouring hits (one symbol repeated) every other pair is merged, from the left.
            new_run = np.concatenate(([True], np.diff(where) > 1))
            run = where[new_run][np.cumsum(new_run) - 1]
            where = where[(where - run) % 2 == 0]
            sym[where] = self._made[rank[where]]
            stay = np.repeat(~over, counts)
            stay[where + 1] = False
            sym, seq = sym[stay], seq[stay]
        return done

    def _pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of the text, and how many added tokens stand in it as such."""
        if self._added is None or not self._added.search(text):
            return self._split(text), 0
        parts = self._added.split(text)
        return [t for p in parts for t in self._split(p)], len(parts) - 1

    def _of_strings(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, pre-token by pre-token, added tokens as such."""
        lists, extra = zip(*(self._pretokens(t) for t in texts), strict=True) if texts else ((), ())
        tokens = [t for part in lists for t in part]
        sums = np.concatenate(([0], np.cumsum(self.survivors(tokens)))) if tokens else np.zeros(1, np.int64)
        ends = np.cumsum([len(part) for part in lists], dtype=np.int64)
        return sums[ends] - sums[ends - np.array([len(part) for part in lists], np.int64)] + np.array(extra, np.int64)

    def _of_pieces(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece, a space and what follows it up to the next place where a text may be cut."""
        if any(" " in p[1:] for p in pieces):
            return self._of_strings(pieces)
        # One split for all: a pre-token that begins with a space is the first of the next piece.
        tokens = self._split("".join(pieces))
        first = np.flatnonzero(np.fromiter((t[0] == " " for t in tokens), bool, len(tokens)))
        return np.add.reduceat(self.survivors(tokens), first)

    def _known(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, -1 where there is none yet."""
        if not len(self._keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where((self._keys[at] == keys) & (self._checks[at] == checks), self._counts[at], -1)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray) -> None:
        if len(self._keys) + len(keys) > self._entries:
            self._keys, self._checks, self._counts = keys, checks, counts
            return
        both = np.concatenate([self._keys, keys])
        order = np.argsort(both, kind="stable")
        self._keys, self._checks, self._counts = both[order], np.concatenate([self._checks, checks])[order], np.concatenate([self._counts, counts])[order]

    def _of_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each of the spans, which are pieces."""
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        # A text's first piece has no space before it, unless it begins with one.
        led = np.fromiter((t[0] == " " for t in texts), bool, len(texts))
        made = np.zeros(len(texts), np.int64)
        if led.any():
            made[led] = self._of_pieces([t for t in texts if t[0] == " "])
        if not led.all():
            made[~led] = self._of_strings([t for t in texts if t[0] != " "])
        return made

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; data: their UTF-8 bytes, one after another, offsets: where they begin.

        A space between two characters that are no white space always begins a pre-token, and no pre-token goes on
        over it. Texts are cut there, and each distinct piece is counted once. Pieces of equal hash are compared byte by
        byte; counts of earlier calls are taken where 128 bits of hash are equal.
        """
        n = len(data)
        out = np.zeros(len(offsets) - 1, np.int64)
        if not n:
            return out
        if self._added is not None and (whole := data.tobytes()) and self._added_bytes.search(whole):
            # Texts with added tokens are counted apart.
            apart = [i for i in range(len(out)) if self._added_bytes.search(whole[offsets[i] : offsets[i + 1]])]
            out[apart] = self._of_strings([whole[offsets[i] : offsets[i + 1]].decode() for i in apart])
            keep = np.ones(len(out), bool)
            keep[apart] = False
            parts = [data[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(keep)]
            rest = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
            out[keep] = self.counts(np.concatenate(parts) if parts else data[:0], rest)
            return out
        inside = np.flatnonzero(data == 0x20)
        inside = inside[(inside > 0) & (inside + 1 < n)]
        before, after = data[inside - 1], data[inside + 1]
        # Neighbours that are, or by their first bytes may be, white space: no cut there.
        open_ = ~_BLANK[before] & ~_BLANK[after] & ~_MAY_BLANK[after]
        wide = before >= 0x80
        wide[wide] = (data[inside[wide] - 2] == 0xC2) | _MAY_BLANK[data[np.maximum(inside[wide] - 3, 0)]]
        edge = np.zeros(n + 1, bool)
        edge[inside[open_ & ~wide]] = True
        starts_at = offsets[:-1][np.diff(offsets) > 0]
        edge[starts_at] = True  # also where a text begins with a space: then that space was cut at anyway
        starts = np.flatnonzero(edge[:n])
        ends = np.append(starts[1:], n)
        keys = span_hashes(data, starts, ends, fold_case=False)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        checks = span_hashes(data, starts[first], ends[first], fold_case=False, seed=1)
        found = self._known(distinct, checks)
        fresh = np.flatnonzero(found < 0)
        if len(fresh):
            found[fresh] = self._of_spans(data, starts[first[fresh]], ends[first[fresh]])
            self._learn(distinct[fresh], checks[fresh], found[fresh])
        each = found[back]
        odd = np.flatnonzero(~equal_spans(data, starts, ends, first[back]))
        if len(odd):
            each[odd] = self._of_spans(data, starts[odd], ends[odd])
        total = np.concatenate(([0], np.cumsum(each)))
        at = np.searchsorted(starts, offsets)
        return total[at[1:]] - total[at[:-1]]

    def counts_of(self, texts: list[str | None]) -> list[int]:
        """counts of strings; null counts as empty."""
        raw = [(t or "").encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))
        return self.counts(np.frombuffer(b"".join(raw), np.uint8), offsets).tolist()


_loaded: dict[int, ArrayBpe] = {}


def _counter(source: str) -> ArrayBpe:
    key = hash(source)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ArrayBpe(source)
    return _loaded[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens). Whole texts are counted, however long. Repeated rows
    and null ids give a row each; other columns are not read. The vocabulary (a fixed file) is broadcast.
    """
    source = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    id_type = df.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            for first, end, data, offsets in text_pieces(batch, "text"):
                n = counter.counts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    rows = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(tidy(count), f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
