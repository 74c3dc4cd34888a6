"""Language-model scoring with an Elias-Fano n-gram trie.

A trie has memory-mapped levels: sorted context ids, then for each order the followers of every n-gram, as ids shifted by the n-gram's
rank, and monotone pointers to where its followers begin, all Elias-Fano coded, with one quantised smoothed probability per n-gram and
one quantised weight per n-gram that is a context. An n-gram is found by the successor of (rank of its context, word), order by order.
The trie is cut into shards by first word, and by second word too where the first is frequent; texts never travel.

Blocks of documents send each shard their distinct n-grams of all orders once, with training counts, as subtrees; a shard adds them up,
builds its part of the trie, looks all asked n-grams up in one ascending pass and sends codes back in the order asked. A block has a
message for a shard only if one of its first words lies there, so its messages never outnumber its distinct words, however many shards
there are: messages grow with the square of the input only until then, and in proportion after.

Smoothing is interpolated absolute discounting: P(w|h) = max(c(hw) - D, 0) / c(h) + D * T(h) / c(h) * P(w|h without its first word), with
T(h) the distinct followers of h, down to the add-0.1 unigram share. A context unseen in training leaves the shorter context's P.
"""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Text bytes of a block; tokens for each shard of a level; discount; added to every count; longest n-grams.
BLOCK_BYTES, SHARD_TOKENS, DISCOUNT, ADDED, ORDER = 12 << 20, 1_500_000, 0.85, 0.1, 3
#: Elements decoded at a time, and the range of log10 probabilities that 16-bit codes cover (0 stands for unseen).
WINDOW, LOWEST, CODES = 4096, -14.0, 65_535
#: The hash that stands for the end of a text, and the id of its beginning.
END, BEGIN = 0, 0


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types, bytes regrouped by significance and compressed."""
    out = io.BytesIO()
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros((0, 0), np.uint8)
        out.write(f"{a.dtype.str} {len(a)}\n".encode() + np.ascontiguousarray(planes).tobytes())
    return zstandard.compress(out.getvalue(), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, arrays = zstandard.decompress(blob), 0, []
    while at < len(data):
        end = data.index(b"\n", at)
        kind, n = data[at:end].decode().split()
        dtype = np.dtype(kind)
        planes = np.frombuffer(data, np.uint8, int(n) * dtype.itemsize, end + 1).reshape(dtype.itemsize, int(n))
        arrays.append(np.ascontiguousarray(planes.T).view(dtype).reshape(int(n)))
        at = end + 1 + int(n) * dtype.itemsize
    return arrays


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(universe / n) bits an element, in a memory-mapped file."""

    def __init__(self, values: np.ndarray, universe: int, file):
        self.n = len(values)
        self.low_bits = max(0, (universe // max(1, self.n)).bit_length() - 1)
        values = values.astype(np.uint64)
        ones = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(self.n)
        self.samples = np.r_[ones[::WINDOW] // 8, (ones[-1] // 8 + 1) if self.n else 0]
        high = np.zeros(int(ones[-1]) + 1 if self.n else 0, dtype=np.uint8)
        high[ones] = 1
        self.first = values[::WINDOW].copy()
        self.low_at = file.tell()
        for i in range(0, self.n, WINDOW):
            bits = np.unpackbits(values[i : i + WINDOW].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            file.write(np.packbits(bits[:, 64 - self.low_bits :]).tobytes())
        self.high_at = file.tell()
        file.write(np.packbits(high).tobytes())
        self.file = file

    def window(self, k: int) -> np.ndarray:
        """Elements k * WINDOW and following, decoded."""
        data = np.memmap(self.file, dtype=np.uint8, mode="r")
        n = min(WINDOW, self.n - k * WINDOW)
        begin, end = int(self.samples[k]), int(self.samples[k + 1]) + 1
        # ones of the window before lie in the first byte too: count from the back of what precedes
        bits = np.flatnonzero(np.unpackbits(data[self.high_at + begin : self.high_at + end]))
        top = int(self.first[k] >> np.uint64(self.low_bits)) + k * WINDOW - begin * 8
        bits = bits[np.searchsorted(bits, top) :][:n]
        high = (bits + begin * 8 - np.arange(k * WINDOW, k * WINDOW + n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        size = -(-WINDOW * self.low_bits // 8)
        low = np.zeros((n, 64), dtype=np.uint8)
        low[:, 64 - self.low_bits :] = np.unpackbits(data[self.low_at + k * size : self.low_at + k * size + -(-n * self.low_bits // 8)])[: n * self.low_bits].reshape(n, self.low_bits)
        return high + np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each wanted value, -1 where its successor is another; ``wanted`` ascends, so windows are decoded once."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        if not self.n or not len(wanted):
            return out
        of = np.searchsorted(self.first, wanted, side="right") - 1
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(wanted)], strict=True):
            if of[a] < 0:
                continue
            here = self.window(int(of[a]))
            at = np.minimum(np.searchsorted(here, wanted[a:b]), len(here) - 1)
            out[a:b] = np.where(here[at] == wanted[a:b], at + of[a] * WINDOW, -1)
        return out

    def take(self, positions: np.ndarray) -> np.ndarray:
        """Values at ascending positions."""
        out = np.zeros(len(positions), dtype=np.int64)
        of = positions // WINDOW
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
        for a, b in zip(cuts, np.r_[cuts[1:], len(of)], strict=True):
            out[a:b] = self.window(int(of[a]))[positions[a:b] % WINDOW]
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as block-local word numbers, most frequent first, with the hashes of the block's words."""
    ids: list = []
    train: list[bool] = []
    lengths: list[int] = []
    tokens: list[np.ndarray] = []
    words: dict[bytes, int] = {}
    size = 0

    def block() -> pa.RecordBatch:
        flat = np.concatenate(tokens)
        used = np.bincount(flat, minlength=len(words) + 1)
        order = np.argsort(-used, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order))
        hashes = np.r_[np.uint64(END), np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))][order]
        blob = pack(np.array(train, dtype=np.uint8), np.array(lengths, dtype=np.uint32), rank[flat], hashes)
        out = {"block": uuid.uuid4().hex, "ids": list(ids), "data": blob, "tokens": len(flat), "words": len(hashes)}
        for x in (ids, train, lengths, tokens, words):
            x.clear()
        return pa.RecordBatch.from_pylist([out], schema=_BLOCK)

    for batch in batches:
        for i, text, is_train in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = (text or "").encode("utf-8", "surrogatepass").lower().split()
            row = np.zeros(len(found) + 1, dtype=np.uint32)
            row[:-1] = [words.setdefault(w, len(words) + 1) for w in found]
            ids.append(i)
            train.append(is_train)
            lengths.append(len(row))
            tokens.append(row)
            size += len(text or "") + 64
            if size >= BLOCK_BYTES:
                yield block()
                size = 0
    if ids:
        yield block()


_BLOCK = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("data", pa.binary()), ("tokens", pa.int64()), ("words", pa.int64())])
_ASK = pa.schema([("shard", pa.int32()), ("block", pa.string()), ("data", pa.binary())])
_ANSWER = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.string()), ("data", pa.binary()), ("key", pa.int64()), ("number", pa.int64())])
_ASK_SQL, _ANSWER_SQL = "shard int, block string, data binary", "kind string, shard int, block string, data binary, key long, number long"


def _word_shards(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's words by (shard, hash), and where each shard begins in it."""
    shard = ((hashes >> np.uint64(7)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((hashes, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                train, lengths, tokens, hashes = unpack(data)
                counts = np.bincount(tokens, weights=np.repeat(train, lengths), minlength=len(hashes)).astype(np.uint32)
                order, cuts = _word_shards(hashes, shards)
                yield pa.RecordBatch.from_pylist([{"shard": s, "block": name, "data": pack(hashes[order[a:b]], counts[order[a:b]])} for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a], schema=_ASK)

    return run


def _answer_words(shards: int):
    """First level: word hashes. A word's id is its rank by frequency in its shard, dealt round the shards, so ids are dense."""

    def run(asked: pa.Table) -> pa.Table:
        shard, names = asked.column("shard")[0].as_py(), asked.column("block").to_pylist()
        parts = [unpack(d) for d in asked.column("data").to_pylist()]
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        asked_keys, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(asked_keys)).astype(np.int64)
        distinct, total = asked_keys[total > 0], total[total > 0]
        rank = np.empty(len(distinct), dtype=np.int64)
        rank[np.lexsort((distinct, -total))] = np.arange(len(distinct))
        number = rank * shards + shard + 1
        with tempfile.TemporaryFile() as file:
            level = EliasFano(distinct, 1 << 64, file)
            file.flush()
            found = level.find(asked_keys)[at]
        ids, counts = (np.where(found >= 0, np.r_[x, 0][found], 0).astype(np.uint64) for x in (number, total))
        out = [{"kind": "sum", "key": int(total.sum()), "number": len(distinct)}]
        ends = np.cumsum([len(p[0]) for p in parts])
        for name, a, b in zip(names, np.r_[0, ends[:-1]], ends, strict=True):
            out.append({"kind": "words", "shard": shard, "block": name, "data": pack(ids[a:b], counts[a:b])})
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return run


def _pieces(counts: np.ndarray, shards: int, total: int) -> np.ndarray:
    """Into how many pieces the followers of a first word are dealt, by second word: more than one where it is long against a shard."""
    return 1 + counts * (4 * shards) // max(1, total)


def _deal(context: np.ndarray, piece: np.ndarray, shards: int) -> np.ndarray:
    return ((context * 0x85EBCA6B + piece * 0xC2B2AE35) % 0x7FFFFFFF % shards).astype(np.int64)


class _Block:
    """A block's words with their ids and counts, and its distinct n-grams of known words, by shard."""

    def __init__(self, data: bytes, words: list[dict], word_shards: int, shards: int, total: int, order: int):
        train, self.lengths, tokens, hashes = unpack(data)
        by_shard, cuts = _word_shards(hashes, word_shards)
        ids, counts = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for row in words:
            at = by_shard[cuts[row["shard"]] : cuts[row["shard"] + 1]]
            found = unpack(row["data"])
            ids[at], counts[at] = found[0].astype(np.int64), found[1].astype(np.int64)
        now = tokens.astype(np.int64)
        begins = np.cumsum(self.lengths.astype(np.int64)) - self.lengths
        begin, width = len(hashes), len(hashes) + 1  # one more context: the beginning of a text, as frequent as its end
        before = np.r_[begin, now[:-1]] if len(now) else now
        before[begins] = begin
        inner = np.ones(len(now), dtype=bool)
        inner[begins] = False
        end = np.flatnonzero(hashes == np.uint64(END))
        ids, counts = np.r_[ids, BEGIN], np.r_[counts, counts[end[0]] if len(end) else 0]
        by_id = np.empty(width, dtype=np.int64)
        by_id[np.argsort(ids, kind="stable")] = np.arange(width)
        word_of = np.argsort(by_id)
        weight = np.repeat(train, self.lengths).astype(np.float64)

        self.now, self.before, self.counts, self.shards = now, before, counts, shards
        known, self.levels = counts[now] > 0, []
        context_seen, head = counts[before] > 0, before
        for k in range(2, order + 1):
            asked = context_seen & known
            grams, inverse = np.unique(head[asked] * width + by_id[now[asked]], return_inverse=True)
            parent, word = grams // width, word_of[grams % width]
            if k == 2:
                piece = ids[word] * 0x9E3779B1 % 0x7FFFFFFF % _pieces(counts[parent], shards, total)
                shard = _deal(ids[parent], piece, shards)
                order_ = np.lexsort((ids[word], ids[parent], shard))
                self.cuts = [np.searchsorted(shard[order_], np.arange(shards + 1))]
                rank = np.empty(len(order_), dtype=np.int64)
                rank[order_] = np.arange(len(order_))
                inverse, parent, word = rank[inverse], parent[order_], word[order_]
            else:
                self.cuts.append(np.searchsorted(parent, self.cuts[-1]))
            trained = np.bincount(inverse, weights=weight[asked], minlength=len(parent)).astype(np.uint32)
            gram = np.full(len(now), -1, dtype=np.int64)
            gram[asked] = inverse
            self.levels.append((parent, ids[word], trained, gram, context_seen, head))
            head = np.r_[-1, gram[:-1]] if len(gram) else gram
            context_seen = inner & (head >= 0)

        # a shard is told of the first words whose followers it is asked for, and one shard of every first word
        parent = self.levels[0][0]
        used = np.unique(before[counts[before] > 0])
        context, shard = np.r_[parent, used], np.r_[np.repeat(np.arange(shards), np.diff(self.cuts[0])), _deal(ids[used], np.zeros(len(used), dtype=np.int64), shards)]
        told = np.unique(shard * width + by_id[context])
        self.context = word_of[told % width]
        self.context_id = ids[self.context]
        self.context_cuts = np.searchsorted(told // width, np.arange(shards + 1))
        self.place = {int(i): int(c) for i, c in zip(ids[used], used, strict=True)}

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """For each shard: first words with their counts and numbers of followers; for each order words, counts, numbers of followers."""
        for s in range(self.shards):
            a, b = self.context_cuts[s : s + 2]
            if a == b:
                continue
            out, above = [self.context_id[a:b], self.counts[self.context[a:b]]], None
            for (parent, words, trained, *_), cuts in zip(self.levels, self.cuts, strict=True):
                own = slice(cuts[s], cuts[s + 1])
                if above is None:
                    id_of = np.zeros(len(self.counts), dtype=np.int64)
                    id_of[self.context[a:b]] = np.arange(b - a)
                    sizes = np.bincount(id_of[parent[own]], minlength=b - a)
                else:
                    sizes = np.bincount(parent[own] - above.start, minlength=above.stop - above.start)
                out += [sizes.astype(np.uint32), words[own].astype(np.uint32 if words.max(initial=0) < 1 << 32 else np.uint64), trained[own]]
                above = own
            yield s, pack(*out)

    def scores(self, answers: list[dict], total: int, distinct: int) -> list[np.ndarray]:
        """Tokens, known tokens, base and model score of every document."""
        kinds = np.zeros(len(self.counts), dtype=np.float64)
        shares = [np.zeros(len(level[0]), dtype=np.float64) for level in self.levels]
        weights = [np.ones(len(level[0]), dtype=np.float64) for level in self.levels[:-1]]
        for row in answers:
            if row["kind"] == "split":
                kinds[self.place[row["key"]]] = row["number"]
                continue
            s = row["shard"]
            followers, *codes = unpack(row["data"])
            own = self.context[self.context_cuts[s] : self.context_cuts[s + 1]]
            kinds[own] = np.maximum(kinds[own], followers)
            for k, cuts in enumerate(self.cuts):
                shares[k][cuts[s] : cuts[s + 1]] = probability(codes[k])
                if k < len(weights):
                    code_ = codes[len(self.cuts) + k]
                    weights[k][cuts[s] : cuts[s + 1]] = np.where(code_ > 0, probability(code_), 1.0)
        base = (self.counts[self.now] + ADDED) / (total + ADDED * (distinct + 1))
        model = base
        for k, (_, _, _, gram, context_seen, head) in enumerate(self.levels):
            at = np.flatnonzero(context_seen)
            weight = DISCOUNT * kinds[head[at]] / self.counts[head[at]] if not k else weights[k - 1][head[at]]
            model = model.copy()
            model[at] *= weight
            at = at[gram[at] >= 0]
            model[at] += shares[k][gram[at]]
        n = len(self.lengths)
        document = np.repeat(np.arange(n), self.lengths)
        add = lambda w: np.bincount(document, weights=w, minlength=n)
        return [self.lengths.astype(np.int64), add(self.counts[self.now] > 0).astype(np.int64), add(np.log10(base)), add(np.log10(model))]


def code(share: np.ndarray) -> np.ndarray:
    """16-bit codes of discounted shares, evenly spaced in their logarithm; 0 stands for none."""
    level = np.rint((np.log10(np.maximum(share, 10**LOWEST)) - LOWEST) / -LOWEST * (CODES - 1)) + 1
    return np.where(share > 0, level, 0).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10 ** ((codes.astype(np.float64) - 1) / (CODES - 1) * -LOWEST + LOWEST), 0.0)


class Trie:
    """One shard: contexts, and for each order pointers, followers and codes; searched in ascending order, an order at a time."""

    def __init__(self, contexts: np.ndarray, totals: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], file):
        """Ascending contexts with their counts; for each order the rank of an n-gram's context, its word and its count, ascending."""
        self.file, self.levels = file, []
        self.width = max((int(words.max(initial=0)) for _, words, _ in levels), default=0) + 1
        self.contexts = EliasFano(contexts, int(contexts.max(initial=0)) + 1, file)
        above = totals
        for k, (parent, words, counts) in enumerate(levels):
            followers = EliasFano(parent * self.width + words, len(above) * self.width + 1, file)
            begins = np.searchsorted(parent, np.arange(len(above) + 1))
            pointers = EliasFano(begins, len(words) + 1, file)
            shares = self._written(code((counts - DISCOUNT) / np.maximum(above[parent], 1)))
            weights = self._written(code(DISCOUNT * np.diff(begins) / np.maximum(above, 1))) if k else None
            self.levels.append((pointers, followers, shares, weights))
            above = counts
        file.flush()

    def _written(self, codes: np.ndarray) -> tuple[int, int]:
        at = self.file.tell()
        self.file.write(codes.tobytes())
        return at, len(codes)

    def _codes(self, where: tuple[int, int], positions: np.ndarray) -> np.ndarray:
        at, n = where
        if not n or not len(positions):
            return np.zeros(len(positions), np.uint16)
        return np.where(positions >= 0, np.memmap(self.file, dtype=np.uint16, mode="r", offset=at, shape=(n,))[np.maximum(positions, 0)], 0).astype(np.uint16)

    def answer(self, contexts: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Numbers of followers of ascending contexts; for each order the codes of asked (index of the context, word), ascending; weights."""
        above = self.contexts.find(contexts.astype(np.uint64))
        hit = np.flatnonzero(above >= 0)
        followers = np.zeros(len(contexts), dtype=np.int64)
        pointers = self.levels[0][0]
        followers[hit] = pointers.take(above[hit] + 1) - pointers.take(above[hit])
        shares, weights = [], []
        for (_, level, codes, context_codes), (index, words) in zip(self.levels, asked, strict=True):
            if context_codes is not None:
                weights.append(self._codes(context_codes, above))
            at = np.flatnonzero((above[index] >= 0) & (words < self.width))
            found = np.full(len(index), -1, dtype=np.int64)
            found[at] = level.find((above[index[at]] * self.width + words[at]).astype(np.uint64))
            shares.append(self._codes(codes, found))
            above = found
        return followers, shares, weights


def _answer_grams(order: int, shards: int, total: int):
    def run(asked: pa.Table) -> pa.Table:
        shard, names = asked.column("shard")[0].as_py(), asked.column("block").to_pylist()
        parts = [unpack(d) for d in asked.column("data").to_pylist()]
        joined = lambda i: np.concatenate([p[i] for p in parts]).astype(np.int64)
        contexts, first, at = np.unique(joined(0), return_index=True, return_inverse=True)
        totals = joined(1)[first]
        places, sizes = [at], [[len(p[0]) for p in parts]]
        asked_grams, trained, above = [], [], np.arange(len(contexts))
        rank_above, width = np.arange(len(contexts)), 1 + max(int(p[i].max(initial=0)) for p in parts for i in range(3, len(p), 3))
        for k in range(order - 1):
            parent, words, counts = np.repeat(places[-1], joined(3 * k + 2)), joined(3 * k + 3), joined(3 * k + 4)
            grams, at = np.unique(parent * width + words, return_inverse=True)
            counts = np.bincount(at, weights=counts, minlength=len(grams)).astype(np.int64)
            parent, words = grams // width, grams % width
            asked_grams.append((parent, words))
            places.append(at)
            sizes.append([len(p[3 * k + 3]) for p in parts])
            seen = counts > 0
            trained.append((rank_above[parent[seen]], words[seen], counts[seen]))
            if not k:  # contexts of the trie are those with followers
                own = np.unique(parent[seen])
                rank = np.zeros(len(contexts), dtype=np.int64)
                rank[own] = np.arange(len(own))
                trained[0] = (rank[parent[seen]], words[seen], counts[seen])
                above = own
            rank_above = np.cumsum(seen) - 1
        with tempfile.TemporaryFile() as file:
            followers, shares, weights = Trie(contexts[above], totals[above], trained, file).answer(contexts, asked_grams)
        split = np.flatnonzero(_pieces(totals, shards, total) > 1)
        out = [{"kind": "part", "key": int(contexts[c]), "number": int(followers[c])} for c in split]
        ends = [np.cumsum([0, *s]) for s in sizes]
        sent = [(followers.astype(np.uint32), 0), *((s, k + 1) for k, s in enumerate(shares)), *((w, k + 1) for k, w in enumerate(weights))]
        split_home = np.zeros(len(contexts), dtype=bool)
        split_home[split] = _deal(contexts[split], np.zeros(len(split), dtype=np.int64), shards) == shard
        for i, name in enumerate(names):
            mine = [slice(e[i], e[i + 1]) for e in ends]
            out.append({"kind": "grams", "shard": shard, "block": name, "data": pack(*[codes[places[k][mine[k]]] for codes, k in sent])})
            own = places[0][mine[0]]
            out += [{"kind": "wanted", "block": name, "key": int(c)} for c in contexts[own[split_home[own]]]]
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return run


def score(documents: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Words are runs of non-white-space, lower-cased in A-Z; every text ends in one more token. The model learns from the rows for which
    ``train`` holds (null does not). Null counts as empty and has one token, its end. Repeated rows and null ids are rows like any
    other. Without training rows every token is unknown. An empty table gives an empty result; further columns are not read. ``order``
    is the length of the longest n-grams, 2 at least; near a text's beginning contexts are shorter, the beginning counts as one word.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = materialise(rows.mapInArrow(_blocks, "block string, ids array<long>, data binary, tokens long, words long"))
    sizes = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    word_shards, shards = (1 + n // SHARD_TOKENS for n in (sizes[1], sizes[0]))
    asked = blocks.select("block", "data").mapInArrow(_ask_words(word_shards), _ASK_SQL)
    answered = materialise(asked.groupBy("shard").applyInArrow(_answer_words(word_shards), _ANSWER_SQL))
    total, distinct = (int(x or 0) for x in answered.filter("kind = 'sum'").agg(F.sum("key"), F.sum("number")).first())
    words = answered.filter("kind = 'words'")

    def ask(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = [_Block(d, answers.to_pylist(), word_shards, shards, total, order) for d in own.column("data").to_pylist()]
        return pa.Table.from_pylist([{"shard": s, "block": own.column("block")[0].as_py(), "data": d} for b in rows for s, d in b.questions()], schema=_ASK)

    by_block = lambda df: df.groupBy("block")
    questions = by_block(blocks.select("block", "data")).cogroup(by_block(words)).applyInArrow(ask, _ASK_SQL)
    grams = materialise(questions.groupBy("shard").applyInArrow(_answer_grams(order, shards, total), _ANSWER_SQL))
    # followers of first words that are dealt in pieces add up over the shards, and go to the blocks that have such a word
    split = grams.filter("kind = 'part'").groupBy("key").agg(F.sum("number").alias("number"))
    told = grams.filter("kind = 'wanted'").select("block", "key").join(split, "key").select(F.lit("split").alias("kind"), "block", "key", "number")
    answers = words.unionByName(grams.filter("kind = 'grams'")).unionByName(told, allowMissingColumns=True)
    fields = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        found = answers.to_pylist()
        block = _Block(own.column("data")[0].as_py(), [r for r in found if r["kind"] == "words"], word_shards, shards, total, order)
        result = block.scores(sorted((r for r in found if r["kind"] != "words"), key=lambda r: r["kind"]), total, distinct)
        return pa.Table.from_arrays([pa.array(own.column("ids")[0].as_py(), pa.int64()), *map(pa.array, result)], schema=fields)

    done = by_block(blocks.select("block", "ids", "data")).cogroup(by_block(answers)).applyInArrow(finish, "id long, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
