"""Byte-level BPE by a lexicon of frequent words; words that it lacks are merged exactly.

encode: the corpus's words are counted over all texts, the most frequent ones are compiled with their ids into a
minimal acyclic transducer (lexicon.py), and each task maps it into memory. decode joins the bytes of the ids.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.common import ARROW_ROWS, cut, small, table
from claimweave.llm.lexicon import Lexicon, compile_lexicon

#: Words in the lexicon.
WORDS = 131_072
#: Bytes of text that a task splits into words at a time, and those of merged words that a worker remembers.
PORTION, REMEMBERED = 4 << 20, 4 << 20
#: Bytes from which on a word is merged by itself, with a heap.
LONG = 200
#: The pattern that starts() follows; texts of tokenizers with others are split by the regular expression itself.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Kinds of characters, and what is before a part's first.
LETTER, NUMBER, OTHER, SPACE, NONE = range(5)


def byte_alphabet() -> dict[str, int]:
    """The printable character for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """The vocabulary of a tokenizer file: exact merges, bytes of ids, special strings."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.pattern, self.words, self.find = pattern, regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.any_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.bytes_of = {i: raw(token) for token, i in vocab.items() if token not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.new = [vocab[a + b] for a, b in pairs]
        self.rank: dict[int, int] = {}  # of pairs of ids, the first in the upper half
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault(vocab[a] << 32 | vocab[b], k)
        pair = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(pair)
        self._pairs, self._ranks = pair[order], np.fromiter(self.rank.values(), np.int64, len(pair))[order]
        self._bytes, self._new = np.array(self.of_byte, dtype=np.int32), np.array(self.new, dtype=np.int32)
        self._of_bytes = np.array([[self.rank.get(a << 32 | b, len(self.new)) for b in self.of_byte] for a in self.of_byte], dtype=np.int32)
        self.token_bytes = pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)], pa.large_binary())
        self._alike = len(set(self.new)) == len(self.new)  # each token comes from one merge, so its own merges come later

    def merge(self, word: bytes) -> list[int]:
        """Apply the merges of lowest rank first, of equal ones the leftmost."""
        ids = [self.of_byte[b] for b in word]
        if len(ids) > LONG:
            return self._merge_long(ids)
        rank, new, none = self.rank.get, self.new, len(self.new)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = new[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
        return ids

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """merge() of each word, as little-endian 32-bit integers."""
        ids, size = self.merge_flat(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_flat(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of each word of size bytes in flat: their ids in a row, and how many each word has.

        In each round the best pair of each word is merged, for all words together: at all its places at once, from the
        left and without overlaps, as pairs with the token that this makes rank behind it. Long words go by themselves.
        """
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
        alone = np.flatnonzero((size > LONG) | (not self._alike))
        start = np.cumsum(size) - size
        ended = [np.array(self.merge(flat[start[w] : start[w] + size[w]].tobytes()), dtype=np.int32) for w in alone.tolist()]
        owners = [np.full(len(x), w, dtype=np.int32) for w, x in zip(alone.tolist(), ended, strict=True)]
        if len(alone):
            together = np.isin(owner, alone, invert=True)
            flat, owner = flat[together], owner[together]
        ids, none = self._bytes[flat], len(self.new)

        def ranks(at: np.ndarray) -> np.ndarray:
            """The rank of the pair that begins at each place; none at a word's last token."""
            after = np.minimum(at + 1, len(ids) - 1)
            wanted = ids[at].astype(np.int64) << 32 | ids[after]
            place = np.minimum(np.searchsorted(self._pairs, wanted), len(self._pairs) - 1)
            return np.where((after > at) & (owner[after] == owner[at]) & (self._pairs[place] == wanted), self._ranks[place], none)

        rank = np.full(len(ids), none, dtype=np.int32)
        if len(ids) and len(self._pairs):
            rank[:-1] = np.where(owner[1:] == owner[:-1], self._of_bytes[flat[:-1], flat[1:]], none)
        while len(ids):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(ids)]))
            if (done := least == none).any():
                ended.append(ids[done])
                owners.append(owner[done])
                going = ~done
                ids, owner, rank, least = ids[going], owner[going], rank[going], least[going]
                if not len(ids):
                    break
            best = rank == least
            places = np.flatnonzero(best)
            fresh = np.r_[True, np.diff(places) > 1]  # where a run of such pairs begins
            run = np.arange(len(places)) - np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            at = places[run % 2 == 0]
            ids[at] = self._new[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[at] = True
            ids, owner, rank, changed = ids[stay], owner[stay], rank[stay], changed[stay]
            changed[:-1] |= changed[1:]
            changed = np.flatnonzero(changed)
            rank[changed] = ranks(changed)
        if not ended:
            return ids, np.zeros(len(size), np.int64)
        owner = np.concatenate(owners)
        return np.concatenate(ended)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and a linked list, for words in which each search would take long."""
        import heapq

        n = len(ids)
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(k, i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := self.rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not live[i] or ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], live[j], right[i] = self.new[k], False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (k := self.rank.get(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (k, p, ids[p], ids[q]))
        return [x for x, ok in zip(ids, live, strict=True) if ok]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of each code point, as the regular expressions see it."""
    code = np.arange(0x110000, dtype="<u4")
    code[0xD800:0xE000] = 0  # surrogates are in no text
    kind, every = np.full(len(code), OTHER, np.uint8), code.tobytes().decode("utf-32-le")
    for k, found in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(found, every):
            kind[m.start() : m.end()] = k
    return kind


def starts(chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where SPLITS begins a pre-token in code points; edges: where parts that are split apart from each other begin.

    A run of characters of one kind is a pre-token, with a single space before it. Of white space before another
    character the last one stands apart, or goes with it if it is a space. An apostrophe that begins a pre-token takes
    the letters of a contraction.
    """
    kind, edge = kinds()[chars], np.zeros(len(chars), bool)
    edge[edges] = True
    before = np.concatenate(([NONE], kind[:-1])).astype(np.uint8)
    before[edges] = NONE
    start = kind != before
    follows = (before == SPACE) & (kind != SPACE)  # another character after white space of its part
    start[:-1] |= follows[1:]
    start[1:] &= ~(follows[1:] & (chars[:-1] == ord(" ")))
    at = np.flatnonzero(start & (chars == ord("'")))
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        here = at[at + len(ending) < len(chars)]
        for k, letter in enumerate(ending, 1):
            here = here[(chars[here + k] == ord(letter)) & ~edge[here + k]]
        start[here + 1] = False
        behind = here + len(ending) + 1
        start[behind[behind < len(chars)]] = True
    return start


def words_of(own: Codec, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pre-tokens of all texts in a row, special strings among them, each distinct one once in the dictionary; how many there are before each text, and in all."""
    texts = texts.cast(pa.large_string()).fill_null("")
    rows = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = texts.buffers()[2][rows[0] : rows[-1]] if rows[-1] > rows[0] else pa.py_buffer(b"")
    rows = rows - rows[0]
    whole = str(raw, "utf-8")
    chars = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    place = None  # of each character in bytes, if they aren't the same
    begin = rows
    if len(chars) < len(raw):
        place = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(1 + (chars > 0x7F).astype(np.uint8) + (chars > 0x7FF) + (chars > 0xFFFF), out=place[1:])
        begin = np.searchsorted(place, rows)
    edges, special = begin[:-1], []
    if own.any_special.search(whole):
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            special += [(a + m.start(), a + m.end()) for m in own.any_special.finditer(whole[a:b])]
        edges = np.union1d(edges, np.array(special, dtype=np.int64).ravel())
    edges = edges[edges < len(chars)]
    if own.pattern == SPLITS:
        start = starts(chars, edges)
    else:
        start = np.zeros(len(chars) + 1, bool)
        start[edges] = True
        for a, b in zip(edges.tolist(), [*edges.tolist(), len(chars)][1:], strict=False):
            start[[a + x for m in own.find(whole[a:b]) for x in m.span()]] = True
        start = start[:-1]
    for a, b in special:
        start[a + 1 : b] = False
    first = np.flatnonzero(start)
    ends = np.append(first, len(chars))
    ends = ends if place is None else place[ends]
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), raw])
    return words.dictionary_encode(), np.searchsorted(first, begin)


def flat_of(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of words in a row, and how many each has."""
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset) if len(words) else np.zeros(1, np.int64)
    flat = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, np.diff(at)


def of_flat(flat: np.ndarray, size: np.ndarray) -> pa.LargeBinaryArray:
    """Values of size bytes each from flat."""
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size, dtype=np.int64)))), pa.py_buffer(np.ascontiguousarray(flat))])


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PORTION bytes, a larger row by itself."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in small(batches):
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.nbytes > PORTION and part.num_rows > 1:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
                continue
            if held and size + part.nbytes > PORTION:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if size:
        yield pa.concat_batches(held)


def count_words(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """How often each pre-token occurs in all texts: (word binary, n long).

    Tasks count the words of a portion of texts at a time, Spark sums them, first within each task. Special strings are
    no words. A null text has no words, a table without rows gives none.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        special = pa.array([t.encode() for t in own.special], pa.large_binary())
        for batch in portions(batches):
            words, _ = words_of(own, batch.column(0))
            n = pa.array(np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)))
            found = pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), n], ["word", "n"])
            yield found.filter(pc.invert(pc.is_in(words.dictionary, special)))

    return docs.select(text_col).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, pattern: str, words: int = WORDS, text_col: str = "text") -> bytes:
    """Compile the most frequent words of all texts, words of them at most.

    Frequencies are ranged by steps of a sixteenth of their logarithm to base 2, at most a thousand of them. A range is
    taken whole, from the top on as long as they fit, so no task sorts the vocabulary, and ties don't matter. Only the
    words that are taken, with their ids, reach the driver.
    """
    step = F.floor(16 * F.log2("n")).cast("int")
    counts = cut(count_words(docs, path, pattern, text_col).select("word", step.alias("step")))
    sizes = sorted(((r.step, r.words) for r in counts.groupBy("step").agg(F.count("*").alias("words")).collect()), reverse=True)
    fits = [k for (k, _), upto in zip(sizes, accumulate(n for _, n in sizes), strict=True) if upto <= words]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids, size = own.merge_flat(*flat_of(batch.column("word").cast(pa.large_binary())))
            yield pa.RecordBatch.from_arrays([batch.column("word"), lists_of(ids, np.cumsum(np.r_[0, size]))], ["word", "ids"])

    top = counts.where((F.col("step") >= min(fits, default=1 << 20)) & (F.length("word") > 0)).select("word").mapInArrow(merged, "word binary, ids array<int>").toArrow()
    return compile_lexicon(zip(top.column("word").to_pylist(), map(tuple, top.column("ids").to_pylist()), strict=True))


def lists_of(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


class Ids:
    """Ids of distinct words, as bytes: from the lexicon, else merged. It remembers the words that it merged last."""

    def __init__(self, own: Codec, known: Lexicon) -> None:
        self.own, self.known = own, known
        self.special = pa.array([t.encode() for t in own.special], pa.large_binary())
        none = pa.array([], pa.large_binary())
        self.fixed = pa.concat_arrays([known.all_ids(), of_flat(np.array([*own.special.values()], "<u4").view(np.uint8), np.full(len(own.special), 4))])
        self.merged: list[tuple[pa.Array, pa.Array]] = [(none, none)]

    def of(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids, and the place of each word's among them."""
        place = self.known.numbers_flat(*flat_of(words))
        if len(rest := np.flatnonzero(place < 0)):
            lacking = words.take(pa.array(rest))
            special = pc.index_in(lacking, self.special).fill_null(-1).to_numpy()
            old, ids = (pa.concat_arrays(x) for x in zip(*self.merged, strict=True))
            seen = pc.index_in(lacking, old).fill_null(-1).to_numpy().astype(np.int64)
            new = lacking.filter(pa.array((seen < 0) & (special < 0)))
            found, size = self.own.merge_flat(*flat_of(new))
            merged = of_flat(found.astype("<u4").view(np.uint8), 4 * size)
            seen[(seen < 0) & (special < 0)] = len(old) + np.arange(len(new))
            place[rest] = np.where(special >= 0, len(self.known) + special, len(self.fixed) + seen)
            self.keep(new, merged)
            return pa.concat_arrays([self.fixed, ids, merged]), place
        return self.fixed, place

    def keep(self, words: pa.Array, ids: pa.Array) -> None:
        """Remember words and ids; of more than REMEMBERED bytes, the oldest go."""
        self.merged.append((words, ids))
        while len(self.merged) > 1 and sum(w.nbytes + i.nbytes for w, i in self.merged) > REMEMBERED:
            self.merged.pop(0)
        if len(self.merged) == 1 and sum(x.nbytes for x in self.merged[0]) > REMEMBERED:
            self.merged = [(words.slice(0, 0), ids.slice(0, 0))]


@lru_cache(maxsize=1)
def _memory(path: str, pattern: str, lexicon: bytes) -> Ids:
    """What a worker keeps from task to task; REMEMBERED bounds it."""
    return Ids(codec(path, pattern), Lexicon(lexicon))


def _encoder(lexicon: Broadcast, path: str, pattern: str, names: list[str]):
    """(id, text) to (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(path, pattern, lexicon.value)
        for batch in portions(batches):
            words, before = words_of(memory.own, batch.column(1))
            ids, place = memory.of(words.dictionary)
            flat, size = flat_of(ids.take(pa.array(place[words.indices.to_numpy()])))
            ends = np.concatenate(([0], np.cumsum(size // 4)))[before]
            encoded = pa.RecordBatch.from_arrays([batch.column(0), lists_of(flat.view("<i4"), ends)], names[:2])
            yield from (encoded.slice(k, ARROW_ROWS) for k in range(0, encoded.num_rows, ARROW_ROWS))

    return run


def _decoder(path: str, pattern: str, names: list[str]):
    """(id, ids) to (id, ids, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path, pattern).token_bytes
        for batch in small(batches):
            found = of.take(batch.column(1).flatten())
            if found.null_count:
                raise ValueError("an id that the vocabulary lacks")
            flat, size = flat_of(found)
            rows = np.cumsum([0, *batch.column(1).value_lengths().fill_null(0).to_pylist()])
            ends = np.concatenate(([0], np.cumsum(size)))[rows].tolist()
            raw = memoryview(flat)
            texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string(), mask=batch.column(1).is_null().to_numpy(zero_copy_only=False))], names)

    return run


def encode(docs: DataFrame, lexicon: bytes, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text: (id_col, ids array<int>), one row for each row of docs.

    Null texts count as empty, empty texts have no ids; special strings in texts become their id; null ids and
    repeated rows stay as they are; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the lexicon's number of words
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_encoder(shared, path, pattern, [id_col, "ids"]), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Turn ids back into text: (id_col, ids, text). Bytes that aren't UTF-8 become U+FFFD; null ids give null."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(_decoder(path, pattern, [id_col, "ids", "text"]), f"`{id_col}` {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, lexicon: bytes, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) by one Python worker: (id_col, ids, text), under the rules of encode() and decode()."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [id_col, "ids", "text"]
    there, back = _encoder(shared, path, pattern, names), _decoder(path, pattern, names)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lambda batches: back(there(batches)), f"`{id_col}` {kind}, ids array<int>, text string")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256), a row for each row; null ids lists and texts have null digests, null ids stay."""
    return decoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def encode_and_decode(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """digests() of the round trip of docs (doc_id, text) with a lexicon of their own words.

    A null text counts as empty; very long texts are encoded whole; null ids and repeated rows stay; an empty table
    gives no rows; other columns aren't read. The lexicon only saves work: no id depends on its words.
    """
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    return digests(round_trip(docs, build_lexicon(docs, path, pattern, words), path, pattern))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"))
