"""Best-fit packing of token sequences into bins of a set capacity.

Only lengths matter, so the packing is planned on the histogram of lengths, which is bounded by
the capacity whatever the number of documents. The plan is a list of runs: so many items of one
length go, one each, to consecutive bins at one offset. Items then find their run by their rank
among the items of their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.ranking import ranked_in_group
from dialoom.llm.storage import arrow_batches, stored
from dialoom.llm.workers import give_back, kept

CAPACITY = 1024
END_ID = 2
CACHED = 1 << 19  # pieces of texts whose ids a worker remembers
IDS_EACH = 8  # ids that they have on average at most
ENCODED_AT_ONCE = 8192  # new ones that the tokenizer gets at a time
JOINED = 64  # new words that its model gets as one string
BLOCK = 1 << 20  # bytes of texts a worker handles at a time


class Run(NamedTuple):
    """Items ``first`` .. ``first + count - 1`` of a length go to bins ``bin`` .. at ``offset``."""

    length: int
    first: int
    count: int
    bin: int
    offset: int


def plan_bins(histogram: Mapping[int, int], capacity: int) -> list[Run]:
    """Pack a histogram of lengths (1 to capacity).

    Items above a third of the capacity pair at most twice a bin: from the largest down, each
    takes the largest partner that fits. Smaller items, from the largest down, go to the
    smallest gap that holds them, else to a new bin. Equal items and equal gaps are handled
    together, with the outcome of one at a time.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first bin, bins)
    sizes: list[int] = []  # gaps in order
    bins = 0

    def put(length: int, count: int, first_bin: int, offset: int) -> None:
        runs.append(Run(length, used[length], count, first_bin, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, first_bin: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first_bin, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect_left(large, capacity - a + 1) - 1
            while k >= 0 and (large[k] > a or not left[large[k]] or (large[k] == a and left[a] < 2)):
                k -= 1
            if k < 0:
                put_count = left[a]
                put(a, put_count, bins, 0)
                leave(capacity - a, bins, put_count)
                bins += put_count
            else:
                b = large[k]
                count = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, count, bins, 0)
                put(b, count, bins, a)
                leave(capacity - a - b, bins, count)
                bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at == len(sizes):
                each = capacity // n
                count = -(-left[n] // each)
                leave(capacity, bins, count)
                bins += count
                continue
            gap = sizes[at]
            first_bin, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            each, start = gap // n, capacity - gap
            full = min(count, left[n] // each)
            for k in range(each if full else 0):
                put(n, full, first_bin, start + k * n)
            leave(gap - each * n, first_bin, full)
            if full < count:
                rest = left[n]
                if rest < each:  # the last bin that this length opens
                    for k in range(rest):
                        put(n, 1, first_bin + full, start + k * n)
                    leave(gap - rest * n, first_bin + full, 1)
                    full += 1
                leave(gap, first_bin + full, count - full)
    return runs


def pack(items: DataFrame, length: str, order: list[str], capacity: int = CAPACITY, salts: int = 256) -> DataFrame:
    """Add sequence_id and offset to items with lengths 1 to ``capacity``.

    The histogram has at most ``capacity`` rows. The plan is broadcast: its size depends on the
    capacity, not on the number of items.
    """
    items = stored(items, "items")
    histogram = {int(r[0]): int(r[1]) for r in items.groupBy(length).count().collect()}
    runs = plan_bins(histogram, capacity)
    plan = items.sparkSession.createDataFrame(
        [(r.length, r.first, r.first + r.count, r.bin - r.first, r.offset) for r in runs],
        "_length long, _first long, _end long, _shift long, offset long",
    )
    ranked = ranked_in_group(items, [length], order, salts, "_rank")
    fits = (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    return ranked.join(F.broadcast(plan), fits).select(*items.columns, (F.col("_rank") + F.col("_shift")).alias("sequence_id"), "offset")


# The tokenizer's pattern, over characters whose class is the same in every Unicode version.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[{_LETTERS}0-9 \t\n\r!-/:-@\[-`{{-~]*")
_PRE_TOKEN = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_WORD = rf"\A ?(?:[{_LETTERS}]+|[0-9]+)\z"  # surely one pre-token
_LETTER_OR_DIGIT = re.compile(rf"[{_LETTERS}0-9]")
STOPS = ",.;:!?"  # texts are cut before these, before spaces, and on both sides of newlines
CUT_BEFORE = np.isin(np.arange(256), list(f" \n{STOPS}".encode()))
NEWLINE, SPACED, STOP, OTHER, WORD, BAD = range(6)  # how a piece begins or ends


def _edges(piece: str) -> tuple[int, int]:
    """How a piece begins (NEWLINE, SPACED, STOP, OTHER) and ends (NEWLINE, WORD, OTHER); BAD if cuts beside it are not safe."""
    if piece == "\n":
        return NEWLINE, NEWLINE
    if piece in STOPS:
        return STOP, OTHER
    body = piece[1:] if piece[0] == " " else piece
    if not body or any(c.isspace() or c == "\u180e" for c in (body[0], body[-1])):
        return BAD, BAD
    head = SPACED if piece[0] == " " else STOP if piece[0] in STOPS else OTHER
    return head, WORD if _LETTER_OR_DIGIT.match(body[-1]) else OTHER


SAFE = np.zeros((6, 6), bool)  # a cut between a piece that ends so and one that begins so changes no token
for _end, _begins in ((NEWLINE, (SPACED, STOP, OTHER)), (WORD, (NEWLINE, SPACED, STOP)), (OTHER, (NEWLINE, SPACED))):
    SAFE[_end, _begins] = True


WIDTH = 24  # bytes of a piece that the table holds itself; longer pieces stand in a dictionary
_MASKS = np.array([[(1 << 8 * min(max(n - at, 0), 8)) - 1 for at in range(0, WIDTH, 8)] for n in range(WIDTH + 1)], np.uint64)
_MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where texts without nulls begin and the last ends in their joined bytes, and these."""
    texts = texts.cast(pa.large_string())
    _, ends, held = texts.buffers()
    ends = np.frombuffer(ends or bytes(8), np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return ends - ends[0], np.frombuffer(held or b"", np.uint8)[ends[0] : ends[-1]]


class _Places:
    """Places of pieces, numbered as they come: a hash table with the pieces' bytes (no NUL) as keys, by whole arrays."""

    def __init__(self) -> None:
        self.size = 0
        self.keys = np.zeros((1 << 12, WIDTH // 8), np.uint64)  # of every place; zero where a dictionary has it
        self.slots = np.full(1 << 13, -1, np.int32)
        self.long: dict[str, int] = {}

    def __len__(self) -> int:
        return self.size

    def at(self, keys: np.ndarray) -> np.ndarray:
        """The slots where keys are first looked for."""
        mixed = keys @ _MIXERS
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIXERS[1]
        return (mixed >> np.uint64(32)).astype(np.int64) & (len(self.slots) - 1)

    def put(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Enter keys that are not there yet; the next free slot takes what finds its own one taken."""
        at = self.at(keys)
        while len(at):
            free = self.slots[at] < 0
            self.slots[at[free]] = places[free]
            left = self.slots[at] != places
            at, places = (at[left] + 1) & (len(self.slots) - 1), places[left]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where there is none."""
        found, at, left = np.full(len(keys), -1, np.int64), self.at(keys), np.arange(len(keys))
        while len(left):
            held = self.slots[at]
            same = (held >= 0) & (self.keys[held] == keys).all(1)
            found[left[same]] = held[same]
            other = (held >= 0) & ~same
            at, left, keys = (at[other] + 1) & (len(self.slots) - 1), left[other], keys[other]
        return found

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of distinct pieces, and which of these are new."""
        ends, held = _bytes_of(pieces)
        sizes = np.diff(ends)
        windows = np.lib.stride_tricks.sliding_window_view(np.append(held, np.zeros(WIDTH, np.uint8)), WIDTH)
        keys = windows[ends[:-1]].view("<u8") & _MASKS[np.minimum(sizes, WIDTH)]
        long = np.flatnonzero(sizes > WIDTH)
        keys[long] = 0
        places = self.get(keys)
        names = pieces.take(pa.array(long)).to_pylist()
        places[long] = [self.long.get(x, -1) for x in names]
        new = np.flatnonzero(places < 0)
        places[new] = np.arange(self.size, self.size + len(new))
        self.grow(len(new))
        self.long.update(zip(names, places[long].tolist(), strict=True))
        self.keys[self.size : self.size + len(new)] = keys[new]
        self.size += len(new)
        short = new[sizes[new] <= WIDTH]
        self.put(keys[short], places[short])
        return places, new

    def grow(self, more: int) -> None:
        """Room for so many more, with at least half of the slots free."""
        if self.size + more > len(self.keys):
            room = max(self.size + more, len(self.keys) * 3 // 2)
            self.keys = np.concatenate([self.keys[: self.size], np.zeros((room - self.size, WIDTH // 8), np.uint64)])
        if 2 * (self.size + more) > len(self.slots):
            self.slots = np.full(1 << (4 * (self.size + more)).bit_length() - 1, -1, np.int32)
            self.put_all()

    def put_all(self) -> None:
        short = np.ones(self.size, bool)
        short[list(self.long.values())] = False
        short = np.flatnonzero(short)
        self.put(self.keys[short], short)

    def keep(self, places: np.ndarray) -> None:
        """Keep what stands at these places, in order, and number it anew."""
        renamed = dict(zip(places.tolist(), range(len(places)), strict=True)) if self.long else {}
        self.long = {x: renamed[k] for x, k in self.long.items() if k in renamed}
        self.keys[: len(places)] = self.keys[places]
        self.size = len(places)
        self.slots.fill(-1)
        self.put_all()


class ChunkEncoder:
    """Token ids of texts by way of remembered pieces.

    Texts are cut before spaces and sentence marks and around newlines, each distinct piece of a
    block is looked up once, and new ones are encoded. A byte-level BPE whose pattern takes at most one
    leading space never joins what stands on both sides of most such cuts; which ones those are
    follows from the pieces' ends (``SAFE``). A text with any other cut is cut by the pattern
    itself if all its characters are plain, and else encoded as a whole. When there are too many
    pieces, those used least go. A tokenizer that is not of this kind is refused.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = self.added_tokens()
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level models write as they are, the rest from 256 on
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        longer = {c for x in self.tokenizer.get_vocab() if len(x) > 1 for c in x}
        alone = [b for b in (*range(1, 9), *range(14, 28)) if self.letters[b] not in longer and self.model.token_to_id(self.letters[b]) is not None]
        self.mark = chr(alone[0]) if alone and not self.model.ignore_merges else None  # a character that no merge joins to another
        self.places = _Places()
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.sizes, self.uses = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.heads, self.tails = np.zeros(0, np.int8), np.zeros(0, np.int8)

    def added_tokens(self) -> list[str]:
        """Added tokens of a tokenizer whose texts may be cut as this class does."""
        model, added = self.tokenizer.model, self.tokenizer.get_added_tokens_decoder().values()
        cutter = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        fits = (
            cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space") and not self.tokenizer.normalizer
            and type(model).__name__ == "BPE" and not model.dropout and not model.end_of_word_suffix and not model.continuing_subword_prefix
            and not any(x.single_word or x.lstrip or x.rstrip or x.normalized or set(x.content) & {*STOPS, *" \n"} for x in added)
        )
        if not fits:
            raise ValueError("texts of this tokenizer cannot be cut before spaces and marks")
        return [x.content for x in added]

    @staticmethod
    def joined(runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        return np.fromiter(chain.from_iterable(runs), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, joined, and their number in each text."""
        return self.joined([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of strings that are one pre-token each: the model takes many at once, as no merge reaches across the mark."""
        if self.mark is None:
            return self.encode(words)
        groups = (words[at : at + JOINED] for at in range(0, len(words), JOINED))
        shown = ((self.mark.join(x) + self.mark).encode().decode("latin-1").translate(self.letters) for x in groups)
        ids, _ = self.joined([[t.id for t in self.model.tokenize(x)] for x in shown])
        ends = ids == self.model.token_to_id(self.letters[ord(self.mark)])
        return ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1

    def learn(self, new: pa.Array) -> None:
        """Ids, number, and edges of new pieces, in their order."""
        parts = []
        for at in range(0, len(new), ENCODED_AT_ONCE):
            part = new.slice(at, ENCODED_AT_ONCE)
            is_word = pc.match_substring_regex(part, _WORD)
            word, others = is_word.to_numpy(zero_copy_only=False), part.filter(pc.invert(is_word)).to_pylist()
            sizes, edges = np.zeros(len(part), np.int32), np.full((len(part), 2), WORD, np.int8)
            ids, sizes[word] = self.encode_words(part.filter(is_word).to_pylist())
            other_ids, sizes[~word] = self.encode(others)
            both = np.empty(len(ids) + len(other_ids), np.uint32)
            mine = np.repeat(word, sizes)
            both[mine], both[~mine] = ids, other_ids
            edges[:, 0] = np.where(pc.starts_with(part, " ").to_numpy(zero_copy_only=False), SPACED, OTHER)
            edges[~word] = np.array(list(map(_edges, others)), np.int8).reshape(-1, 2)
            parts.append((both, sizes, edges))
        if parts:
            ids, sizes, edges = map(np.concatenate, zip(*parts, strict=True))
            self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.heads, self.tails = np.concatenate([self.heads, edges[:, 0]]), np.concatenate([self.tails, edges[:, 1]])
            self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])

    def forget(self) -> None:
        """Keep at most half of the pieces and ids, those of the most used pieces, and age their use."""
        most = np.argsort(-self.uses, kind="stable")[: CACHED // 2]
        kept = np.sort(most[(self.uses[most] > 1) & (np.cumsum(self.sizes[most]) <= CACHED * IDS_EACH // 2)])
        self.places.keep(kept)
        self.ids = self.gather(kept)
        self.sizes, self.uses, self.heads, self.tails = self.sizes[kept], self.uses[kept] // 2, self.heads[kept], self.tails[kept]
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Places of pieces."""
        if len(self.places) > CACHED or len(self.ids) > CACHED * IDS_EACH:
            self.forget()
        coded = pieces.dictionary_encode()
        nth = coded.indices.to_numpy()
        places, new = self.places(coded.dictionary)
        self.learn(coded.dictionary.take(pa.array(new)))
        self.uses[places] += np.bincount(nth, minlength=len(places))
        return places[nth]

    def gather(self, places: np.ndarray) -> np.ndarray:
        """Ids of the pieces at these places, joined."""
        sizes = self.sizes[places]
        after = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[places] - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)]

    def uncut(self, text: str) -> np.ndarray:
        """Ids of a text that may not be cut at all spaces and marks."""
        if not _PLAIN.fullmatch(text) or any(x in text for x in self.added):
            return self.encode([text])[0]
        return self.gather(self.find(pa.array(_PRE_TOKEN.findall(text), pa.string())))

    @staticmethod
    def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of texts without nulls, one after another, and where those of each text begin and the last ones end."""
        ends, held = _bytes_of(texts)
        first = CUT_BEFORE[held]
        first[1:] |= held[:-1] == ord("\n")
        first[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts = np.flatnonzero(first)
        bounds = np.searchsorted(starts, ends)
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(held))), pa.py_buffer(held)]), bounds

    def __call__(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        marked = pc.match_substring(texts, "\0")  # NUL fills up the keys of pieces
        odd = marked.to_numpy(zero_copy_only=False).copy()
        pieces, bounds = self.cut(pc.if_else(marked, "", texts) if odd.any() else texts)
        places = self.find(pieces)
        heads, tails = self.heads[places], self.tails[places]
        bad = np.zeros(len(places), bool)
        bad[1:] = ~SAFE.ravel()[tails[:-1] * np.int8(len(SAFE)) + heads[1:]]
        bad[bounds[:-1][bounds[:-1] < bounds[1:]]] = False
        bad |= heads == BAD
        odd[np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1] = True
        ends = np.append(0, np.cumsum(self.sizes[places]))[bounds[1:]]
        out = np.split(self.gather(places), ends[:-1]) if len(texts) else []
        for i in np.flatnonzero(odd):
            out[i] = self.uncut(texts[int(i)].as_py())
        return out


def _encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process, kept between tasks."""
    return kept(f"encoder {path}", lambda: ChunkEncoder(path))


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but perhaps the first."""
    head = length % capacity or min(length, capacity)
    return [(0, head), *[(s, capacity) for s in range(head, length, capacity)]]


def _cut_rows(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(keys):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK)))
                rows = []
                for key, ids in zip(keys[at:end], encoder(texts.slice(at, end - at)), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                        own = ids[start : start + n]
                        rows.append((key, k, start, n, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None))
                at = end
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                keep = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds, strict=False)], list(names[:keep]))
        give_back()

    return run


def token_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (``with_ids``) ids of every piece.

    A null or empty text is the end id alone. Rows that repeat a doc_id are cut one by one.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(_cut_rows(path, capacity, end_id, with_ids), schema)


def packed_sequences(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id and ids of every packed sequence, pieces joined by offset."""
    placed = pack(token_pieces(documents, path, capacity, end_id), "length", ["doc_id", "piece"], capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` tokens
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op1_packing(documents: DataFrame, path: str) -> DataFrame:
    """Digest rows of the packing of all documents."""
    with arrow_batches(documents.sparkSession, 1024):
        return pack(token_pieces(documents, path, with_ids=False), "length", ["doc_id", "piece"])
