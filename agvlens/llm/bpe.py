"""Byte-level BPE with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged over, so every such pair is a certain
cut. The text is first split into pretokens (whose rule looks at neighbouring characters), each pretoken is cut at
its certain boundaries, the fragments are encoded independently of each other, and the ids are concatenated.

Memory is bounded: a text is worked through in blocks of pretokens, and the memo of fragments is emptied when full.
Defined cases: null is the empty text (no ids); the strings of special tokens become their ids, as in the tokenizers
library; repeated rows are encoded each; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

BLOCK = 1 << 16  # pretokens worked on at once
LONG = 256  # fragments of more bytes are merged one by one, with a queue
WIDE = 1 << 31  # above any id and any rank
MEMO = 300_000  # fragments remembered per worker

# The pretoken pattern of byte-level BPE (contractions, letters, numbers, the rest, spaces), and the same for ASCII.
PRETOKEN = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRETOKEN_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, mapped back to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file (the JSON text of a byte-level BPE)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level vocabularies are supported")
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", ())):
            raise ValueError("special tokens that take neighbouring text are not supported")
        vocab = {bytes(map(letters.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.special = {t: np.uint32(i).tobytes() for t, i in added.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.token: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in [*vocab.items(), *((t.encode(), i) for t, i in added.items())]:
            self.token[i] = t
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(map(letters.__getitem__, s)) for s in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge[vocab[left], vocab[right]] = (rank, vocab[left + right])
        pairs = sorted((left * WIDE + right, rank, new) for (left, right), (rank, new) in self.merge.items())
        self.pair, self.rank, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.inside = np.zeros((256, 256), bool)
        for t in vocab:
            b = np.frombuffer(t, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        self.single_ids = np.array(self.single, np.int64)
        self.memo: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encode pretokens into the memo, all of their fragments at once."""
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        cut = np.zeros(len(data) + 1, bool)
        cut[np.cumsum(sizes)] = cut[0] = True
        cut[1:-1] |= ~self.inside[data[:-1], data[1:]]
        edges = np.flatnonzero(cut)
        owner = np.repeat(np.arange(len(raw)), sizes)[edges[:-1]]
        ids, fragment = self.merged(data, edges)
        ends = np.cumsum(np.bincount(owner[fragment], minlength=len(raw))) * 4
        packed, start, memo = ids.astype("<u4").tobytes(), 0, self.memo
        for piece, end in zip(pieces, ends.tolist(), strict=True):
            memo[piece] = packed[start:end]
            start = end

    def merged(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and fragment numbers after merging each fragment (between ``edges``) on its own.

        Every round merges, in each fragment, its pair of lowest rank at all its places from left to right.
        """
        lengths = np.diff(edges)
        fragment = np.repeat(np.arange(len(lengths)), lengths)
        ids, done = self.single_ids[data], []
        for f in np.flatnonzero(lengths > LONG).tolist():
            done.append((np.array(self.merged_long(data[edges[f]:edges[f + 1]].tobytes()), np.int64), f))
        keep = lengths[fragment] <= LONG
        ids, fragment = ids[keep], fragment[keep]
        done = [(x, np.full(len(x), f)) for x, f in done]
        while len(ids):
            code = ids[:-1] * WIDE + ids[1:]
            at = np.searchsorted(self.pair, code)
            at[at == len(self.pair)] = 0
            rank = np.full(len(ids), WIDE)
            rank[:-1] = np.where((self.pair[at] == code) & (fragment[1:] == fragment[:-1]), self.rank[at], WIDE)
            starts = np.flatnonzero(np.r_[True, fragment[1:] != fragment[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            ended = lowest == WIDE
            if ended.any():
                done.append((ids[ended], fragment[ended]))
            places = np.flatnonzero((rank == lowest) & ~ended)
            new_run = np.r_[True, np.diff(places) != 1][: len(places)]  # "aaa": the first two, not both pairs
            nth = np.arange(len(places)) - np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
            places = places[nth % 2 == 0]
            ids[places] = self.made[at[places]]
            keep = ~ended
            keep[places + 1] = False
            ids, fragment = ids[keep], fragment[keep]
        if done:
            ids, fragment = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(fragment, kind="stable")
        return ids[order], fragment[order]

    def merged_long(self, fragment: bytes) -> list[int]:
        """The same for long fragments, with a queue of pairs instead of passes over the whole fragment."""
        ids: list[int] = [self.single[b] for b in fragment]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= len(ids) or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (m := self.merge.get((ids[a], ids[b]))):
                    heapq.heappush(queue, (m[0], a, m[1], ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def blocks(self, text: str) -> Iterator[list[str] | bytes]:
        """The pretokens of a text, a block at a time; a special token as its id."""
        parts = self.special_split.split(text) if self.special_split else [text]
        pattern = PRETOKEN_ASCII if text.isascii() else PRETOKEN
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif len(part) < BLOCK:
                yield pattern.findall(part)
            else:
                found = (m.group() for m in pattern.finditer(part))
                while block := list(islice(found, BLOCK)):
                    yield block

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes]]:
        """Numbers of texts with parts of their ids, in order; each text at least once."""
        waiting: list[tuple[int, list[str] | bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            for block in self.blocks(text):
                waiting.append((i, block))
                held += len(block)
                if held >= 2 * BLOCK:
                    yield from self._settled(waiting)
                    waiting, held = [], 0
        yield from self._settled(waiting)

    def _settled(self, waiting: list[tuple[int, list[str] | bytes]]) -> Iterator[tuple[int, bytes]]:
        wanted = set().union(*(b for _, b in waiting if isinstance(b, list)))
        if len(self.memo) + len(wanted) > MEMO:
            self.memo.clear()
        if missing := [p for p in wanted if p not in self.memo]:
            self.learn(missing)
        remembered = self.memo.__getitem__
        for i, block in waiting:
            yield i, block if isinstance(block, bytes) else b"".join(map(remembered, block))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}  # one per worker and vocabulary


def codec_of(source: str, name: str) -> Codec:
    if name not in _CODECS:
        _CODECS[name] = Codec(source)
    return _CODECS[name]


class _Row:
    """One text as it is encoded and decoded; only what ``want`` names is kept in memory."""

    def __init__(self, want: tuple[str, ...]):
        self.want, self.n, self.ids, self.text = want, 0, [], []
        self.ids_hash, self.text_hash = hashlib.sha256(), hashlib.sha256()
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: bytes, data: bytes, last: bool = False) -> None:
        decoded = self.utf8.decode(data, last)
        self.n += len(ids) // 4
        self.ids_hash.update(ids)
        self.text_hash.update(decoded.encode("utf-8"))
        if "ids" in self.want:
            self.ids.append(ids)
        if "decoded" in self.want:
            self.text.append(decoded)

    def values(self) -> dict:
        self.add(b"", b"", True)
        return {
            "n_tokens": self.n, "ids_sha256": self.ids_hash.hexdigest(), "decoded_sha256": self.text_hash.hexdigest(),
            "ids": np.frombuffer(b"".join(self.ids), "<u4").astype(np.int32), "decoded": "".join(self.text),
        }


# The outputs and their types.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def round_trip(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text encoded with the vocabulary file and decoded again; ``outputs`` are names of OUTPUTS.

    The file is read on the driver and sent to the executors, so they need not see its path.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    name, shared, outputs = hashlib.sha256(source.encode()).hexdigest(), spark.sparkContext.broadcast(source), tuple(outputs)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(shared.value, name)
        for batch in batches:
            rows, state = [], [_Row(outputs)]
            for i, ids in codec.encode_all("" if t is None else t for t in batch["t"]):
                if i > len(rows):
                    rows.append(state.pop().values())
                    state.append(_Row(outputs))
                state[0].add(ids, codec.decode(ids))
            rows += [state.pop().values()] if len(batch) else []
            yield pd.DataFrame({"k": batch["k"]} | {c: pd.Series([r[c] for r in rows], dtype=object if OUTPUTS[c] != "long" else "int64") for c in outputs})

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.selectExpr(f"`{key}` as k", f"`{text}` as t")
    return slim.mapInPandas(work, f"k {kind}, " + ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)).withColumnRenamed("k", key)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
