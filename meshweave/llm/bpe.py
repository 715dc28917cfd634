"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for all new words at once; a vectorised check tests every adjacent pair of
proposed tokens; only words with a pair that real merging would not leave behind are merged exactly.

Why the check is enough: merging the bytes of a word ends in the proposed tokens if each of them is what its own bytes
merge to, and no merge ever reaches across the border of two neighbours. At a border the left side shows, as time goes
on, the nodes of the left token's right spine, the right side those of the right token's left spine. A merge of such
two nodes happens if its rank comes before both sides' next merge (on the left side also at the same rank, because
equal merges run from left to right).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: The pre-tokenizer's pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most words that a worker remembers; beyond it, it starts afresh (results don't depend on it).
CACHED_WORDS = 400_000
#: Words of more bytes are merged one by one; still longer ones are not speculated on, and not remembered.
LONG_WORD, HUGE_WORD = 64, 1024
NEVER = np.int64(1) << 40


def byte_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary of a tokenizers file, with what speculation needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in text)
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.digits = [str(i) for i in range(size)]
        self.of_byte = [0] * 256
        for text, i in vocab.items():
            if len(text) == 1:
                self.of_byte[alphabet[text]] = i
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.packed: dict[int, int] = {}  # left << 20 | right: rank << 20 | merged
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = vocab[a] << 20 | vocab[b], vocab[a + b]
            if pair not in self.packed:
                self.packed[pair] = rank << 20 | made
                if self.rank[made] < 0:
                    self.left[made], self.right[made], self.rank[made] = vocab[a], vocab[b], rank
        keys = np.array(list(self.packed), np.int64)
        order = np.argsort(keys)
        self.merge_keys = keys[order]
        self.merge_ranks = np.array(list(self.packed.values()), np.int64)[order] >> 20
        self.merged_to = np.array(list(self.packed.values()), np.int64)[order] & 0xFFFFF
        self.right_spine = self._spine(self.right)
        self.left_spine = self._spine(self.left)
        self._build_trie(sorted(i for i in vocab.values()))
        self.split = regex.compile(PATTERN)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def _spine(self, child: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By depth: the node of each token's spine (-1: none), and the rank at which that node is merged away."""
        node, until, out = np.arange(len(child)), np.full(len(child), NEVER), []
        while (node >= 0).any():
            out.append((node, until))
            inner = np.where(node >= 0, node, 0)
            below = np.where(node >= 0, child[inner], -1)
            until = np.where(below >= 0, self.rank[inner], NEVER)
            node = below
        return out

    def crossed(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging reaches across the border of tokens a and b (before a rank, if given)."""
        out = np.zeros(len(a), bool)
        for left, left_until in self.right_spine:
            has_left = np.flatnonzero((left[a] >= 0) & ~out)
            if not len(has_left):
                break
            for right, right_until in self.left_spine:
                at = has_left[right[b[has_left]] >= 0]
                if not len(at):
                    break
                key = left[a[at]] << 20 | right[b[at]]
                found = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
                rank = np.where(self.merge_keys[found] == key, self.merge_ranks[found], NEVER)
                hit = (rank < left_until[a[at]]) & (rank <= right_until[b[at]]) & (rank < NEVER)
                if before is not None:
                    hit &= rank < before[at]
                out[at[hit]] = True
        return out

    def _build_trie(self, ids: list[int]) -> None:
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(len(self.rank), bool)
        sound[made] = ~self.crossed(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:
            sound[i] &= sound[self.left[i]] and sound[self.right[i]]
        edges: dict[int, int] = {}
        token = [-1]
        for i in ids:
            # a token that its own bytes don't merge to is never proposed
            if not sound[i] or self.rank[i] < 0 and len(self.bytes[i]) > 1:
                continue
            node = 0
            for byte in self.bytes[i]:
                key = node << 8 | byte
                if key not in edges:
                    edges[key] = len(token)
                    token.append(-1)
                node = edges[key]
            token[node] = i
        keys = np.array(list(edges), np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.node_token = np.array(token, np.int64)

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: word numbers and tokens, in order."""
        buffer = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(lengths)
        active, at = np.flatnonzero(lengths > 0), (end - lengths)[lengths > 0]
        whose, tokens = [], []
        while len(active):
            best, best_end = np.zeros(len(active), np.int64), at.copy()
            row, node, p, stop = np.arange(len(active)), np.zeros(len(active), np.int64), at.copy(), end[active]
            while len(row):
                key = node << 8 | buffer[p]
                found = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                ok = self.edge_keys[found] == key
                row, node, p, stop = row[ok], self.edge_to[found[ok]], p[ok] + 1, stop[ok]
                token = self.node_token[node]
                final = token >= 0
                best[row[final]], best_end[row[final]] = token[final], p[final]
                more = p < stop
                row, node, p, stop = row[more], node[more], p[more], stop[more]
            whose.append(active)
            tokens.append(best)
            more = best_end < end[active]
            active, at = active[more], best_end[more]
        if not whose:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, token = np.concatenate(whose), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Tokens of each word: speculate, verify, and merge exactly where the check fails."""
        raw = [w.encode() for w in words]
        huge = np.array([len(w) > HUGE_WORD for w in raw], bool)
        word, token = self.propose([b"" if h else w for w, h in zip(raw, huge.tolist(), strict=True)])
        inside = np.flatnonzero(word[:-1] == word[1:]) if len(word) else np.zeros(0, np.int64)
        pairs, back = np.unique(token[inside] << 20 | token[inside + 1], return_inverse=True)
        bad_pair = self.crossed(pairs >> 20, pairs & 0xFFFFF)
        bad = huge
        bad[word[inside[bad_pair[back]]]] = True
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        flat = token.tolist()
        exact = iter(self.merge_words([raw[i] for i in np.flatnonzero(bad)]))
        return [next(exact) if b else tuple(flat[bounds[i] : bounds[i + 1]]) for i, b in enumerate(bad.tolist())]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place in the merge table of each pair, or -1."""
        key = a << 20 | b
        found = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[found] == key, found, -1)

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Exact merging of all words at once: in each round, every word merges its leftmost pair of lowest rank."""
        out: list[tuple[int, ...]] = [()] * len(words)
        for i in (long := [i for i, w in enumerate(words) if len(w) > LONG_WORD]):
            out[i] = tuple(self._merge_long([self.of_byte[x] for x in words[i]]))
        whose = np.array(sorted({*range(len(words))} - {*long}) if long else range(len(words)), np.int64)
        if not len(whose):
            return out
        lengths = np.array([len(words[i]) for i in whose], np.int64)
        token = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join(words[i] for i in whose), np.uint8)]
        last = np.zeros(len(token), bool)
        last[np.cumsum(lengths) - 1] = True
        none = int(NEVER) << 22

        def order(at: np.ndarray) -> np.ndarray:
            """Rank, then row in the merge table, of the pairs that begin at these places."""
            right = np.minimum(at + 1, len(token) - 1)
            row = self._pairs(token[at], token[right])
            return np.where((row < 0) | last[at], none, self.merge_ranks[row] << 22 | np.maximum(row, 0))

        pair = order(np.arange(len(token)))
        while len(whose):
            start = np.cumsum(lengths) - lengths
            best = np.minimum.reduceat(pair, start)
            done = best == none
            if done.any():
                gone = np.repeat(done, lengths)
                flat, at = token[gone].tolist(), 0
                for i, n in zip(whose[done].tolist(), lengths[done].tolist(), strict=True):
                    out[i], at = tuple(flat[at : at + n]), at + n
                token, last, pair, whose, lengths, best = token[~gone], last[~gone], pair[~gone], whose[~done], lengths[~done], best[~done]
                if not len(whose):
                    break
                start = np.cumsum(lengths) - lengths
            hits = np.flatnonzero(pair == np.repeat(best, lengths))
            word = np.repeat(np.arange(len(whose)), lengths)[hits]
            at = hits[np.r_[True, word[1:] != word[:-1]]]
            token[at], last[at] = self.merged_to[pair[at] & 0x3FFFFF], last[at + 1]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one place went in each earlier word
            token, last, pair, lengths = token[keep], last[keep], pair[keep], lengths - 1
            pair[at] = order(at)
            left = at[at > (np.cumsum(lengths) - lengths)] - 1
            pair[left] = order(left)
        return out

    def _merge_long(self, token: list[int]) -> list[int]:
        """The same for one long word, by a heap over a linked list: scanning all pairs each time would be slow."""
        n, mask = len(token), 0xFFFFF
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m >> 20, i, m & mask) for i, (a, b) in enumerate(itertools.pairwise(token)) if (m := self.packed.get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i] if token[i] >= 0 else n
            if j >= n or self.packed.get(token[i] << 20 | token[j]) != rank << 20 | made:
                continue
            token[i], token[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (m := self.packed.get(token[a] << 20 | token[b])) is not None:
                    heapq.heappush(heap, (m >> 20, a, m & mask))
        return [t for t in token if t >= 0]

    def encode_texts(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text, special tokens' strings included."""
        parts = [[(p, None if i % 2 == 0 else self.special[p]) for i, p in enumerate(self.split_special.split(t))] if self.split_special and any(s in t for s in self.special) else [(t, None)] for t in texts]
        split = [[(self.split.findall(p), None) if i is None else (None, i) for p, i in part] for part in parts]
        new = list({w for text in split for words, _ in text if words for w in words} - self.cache.keys())
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
            new = list({w for text in split for words, _ in text if words for w in words})
        self.cache.update(zip(new, self.encode_words(new), strict=True))
        for text in split:
            ids: list[int] = []
            for words, special in text:
                if special is None:
                    ids.extend(itertools.chain.from_iterable(map(self.cache.__getitem__, words)))
                else:
                    ids.append(special)
            yield ids
        for w in new:
            if len(w) > HUGE_WORD // 4:
                del self.cache[w]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The vocabulary at a path, once a worker."""
    return Bpe(path)


#: What round_trip can return besides doc_id.
OUTPUTS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_SQL_TYPES = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def round_trip(docs: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("ids", "decoded"), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again; one row per input row: doc_id and the chosen outputs.

    Null texts count as empty (no ids, empty decoded text, digests of the empty string); null doc_ids stay null;
    repeated rows each give a row; an empty table gives an empty table; other columns are ignored. `tokenizer` is the
    path of a tokenizers file, which must exist on every executor.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        got: dict[str, list] = {name: [] for name in outputs}
        for ids in bpe.encode_texts(texts):
            if "n_tokens" in got:
                got["n_tokens"].append(len(ids))
            if "ids" in got:
                got["ids"].append(ids)
            if "ids_sha256" in got:
                got["ids_sha256"].append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
            if "decoded" in got or "decoded_sha256" in got:
                decoded = bpe.decode(ids)
                if "decoded" in got:
                    got["decoded"].append(decoded)
                if "decoded_sha256" in got:
                    got["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[n], OUTPUTS[n]) for n in outputs)], names=["doc_id", *outputs])

    schema = ", ".join(["doc_id bigint", *(f"{n} {_SQL_TYPES[n]}" for n in outputs)])
    return map_arrow(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, schema, rows=500)
