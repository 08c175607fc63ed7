"""Packing tokens into windows by Karmarkar-Karp multiway differencing.

Each task packs the documents of its partition, so nothing is shuffled. A document's ids are cut
every `window` ids; whole windows are sequences of their own. What is left of each document, in
equal pieces of a third of a window at most, waits until `group` pieces are there (or the partition
ends) and is then dealt to windows. Larger pieces would leave three to four per cent of padding.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.tuning import release, small_batches

#: Parts of texts whose ids a process keeps, beside those of one batch.
MEMO = 1_200_000
#: What may stand behind a word: no apostrophe, as tokenizers know "'s".
MARKS = string.punctuation.replace("'", "")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deals sizes to k windows: the two partial partitions with the largest spreads are merged,
    largest windows with smallest, until one is left. Returns the indices in each window."""
    # A partial partition: windows that hold something, least first, each one number: its load, and below
    # it the node that stands for its indices; the other windows are empty. Loads are relative to the
    # least once all windows are filled.
    bits = (2 * len(sizes)).bit_length()
    node = (1 << bits) - 1
    heap = [(-s, i, [s << bits | i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh, pairs = len(heap), []  # a node above the indices is a pair of nodes
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        room = max(0, len(a) + len(b) - k)  # so many windows of a take one of b's smallest, their least the largest of these
        merged = a[room:] + b[room:]
        for x, y in zip(a[:room], reversed(b[:room]), strict=True):
            merged.append((x >> bits) + (y >> bits) << bits | len(sizes) + len(pairs))
            pairs.append((x & node, y & node))
        merged.sort()
        if len(merged) == k and (low := merged[0] >> bits << bits):
            merged = [x - low for x in merged]
        heapq.heappush(heap, (-(merged[-1] >> bits), fresh, merged))
        fresh += 1
    out = []
    for x in reversed(heap[0][2] if heap else []):
        flat, rest = [], [x & node]
        while rest:
            i = rest.pop()
            if i < len(sizes):
                flat.append(i)
            else:
                rest += pairs[i - len(sizes)]
        out.append(sorted(flat))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows within the capacity: one more window whenever one would exceed it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        k += 1


class Packer:
    """Pieces in, rows of placed pieces out."""

    def __init__(self, window: int, group: int, first: int, slack: float = 0.015):
        self.window, self.group, self.next, self.slack, self.largest = window, group, first, slack, max(1, window // 3)
        self.rows: list[tuple] = []
        self.left: list[tuple] = []  # key, start, ids, number of the document's ids

    def place(self, pieces: list[tuple]) -> None:
        at = 0
        for key, start, ids, total in pieces:
            self.rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at, ids))
            at += len(ids)
        self.next += 1

    def add(self, key, ids: np.ndarray) -> None:
        w = self.window
        whole = len(ids) // w * w
        for s in range(0, whole, w):
            self.place([(key, s, ids[s : s + w], len(ids))])
        rest = len(ids) - whole
        parts = -(-rest // self.largest)
        for i in range(parts):
            lo, hi = whole + rest * i // parts, whole + rest * (i + 1) // parts
            self.left.append((key, lo, ids[lo:hi].copy(), len(ids)))
        if len(self.left) >= self.group:
            self.deal()

    def deal(self) -> None:
        """Deals what is left. Too few ids to fill the windows well: the excess over whole windows
        goes to sequences of powers of two, which need no padding."""
        total = sum(len(p[2]) for p in self.left)
        k, w = -(-total // self.window), self.window
        if total and total < (1 - 2 * self.slack) * k * w:
            excess = total - int((k - 1) * w * (1 - self.slack))
            self.left.sort(key=lambda p: -len(p[2]))
            while excess:
                want, taken, size = 1 << min(excess.bit_length() - 1, w.bit_length() - 1), [], 0
                excess -= want
                while size < want:
                    key, start, ids, n = self.left.pop(0)
                    fit = min(len(ids), want - size)
                    taken.append((key, start, ids[:fit], n))
                    size += fit
                    if fit < len(ids):
                        self.left.insert(0, (key, start + fit, ids[fit:], n))
                self.place(taken)
        for dealt in windows([len(p[2]) for p in self.left], w) if self.left else []:
            self.place([self.left[i] for i in dealt])
        self.left = []


#: Texts that show whether a tokenizer encodes what stands between blanks by itself, and marks behind words.
PROBES = ("ab cd", "Ab, cd. ef", "the of and", "x\ny z", "in  on", "one; two! three?")


class Encoder:
    """Ids of texts. Where ids of the parts between blanks don't depend on each other, nor those of a
    word and the marks behind it, nor on case, each distinct word is looked up once a batch, and what is
    new is encoded and kept. A tokenizer of which that is not true encodes whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), {}
        self.solid, self.parted = set(string.ascii_letters), set()  # letters that words stay whole with, and others
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_parts = all(ids(t) == [i for p in re.findall(r"[^\s.,;:!?]+|[.,;:!?]", t) for i in ids(p)] for t in PROBES)
        self.by_parts = self.by_parts and ids("Ab CD") == ids("ab cd") and all(ids(f"ab{m}") == ids("ab") + ids(m) for m in (*MARKS, "!!", "***", ".***", "?!)", '."', "$%&"))

    def plain(self, word: str) -> bool:
        """Whether a word is letters that the tokenizer doesn't part: it makes some, such as U+0130, into a letter and a mark."""
        if not word.isalpha():
            return False
        for c in set(word) - self.solid - self.parted:
            (self.parted if any(self.tokenizer.encode(f"a{c}a", add_special_tokens=False).word_ids) else self.solid).add(c)
        return self.solid.issuperset(word)

    def learn(self, parts: list[str]) -> None:
        """Adds parts to the memo. Plain words are one unit of the tokenizer each and are encoded together."""
        memo, solid, alike, words, odd = self.memo, self.solid, [], {}, {}
        for p in parts:
            stem = p.rstrip(MARKS)
            if not (stem and solid.issuperset(stem) or self.plain(stem)):
                odd[p] = None
                continue
            word = stem.lower() if stem.isascii() else stem
            if word == p:
                words[p] = None
                continue
            marks = p[len(stem) :]
            alike.append((p, word, marks))
            if word not in memo:
                words[word] = None
            if marks and marks not in memo:
                odd[marks] = None
        self.singly(list(odd))
        names = list(words)
        for lo in range(0, len(names), 512):
            some = names[lo : lo + 512]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            units = e.word_ids
            if len(set(units)) != len(some):  # not a unit for each word after all
                self.singly(some)
                continue
            ids, bounds = np.array(e.ids, "<u4").tobytes(), (4 * np.searchsorted(np.array(units), np.arange(len(some) + 1))).tolist()
            for name, (at, end) in zip(some, itertools.pairwise(bounds), strict=True):
                memo[name] = ids[at:end]
        for p, word, marks in alike:
            memo[p] = memo[word] + memo[marks] if marks else memo[word]

    def singly(self, parts: list[str]) -> None:
        for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.memo[p] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_parts:
            for t in texts:
                yield np.array(self.tokenizer.encode(t.as_py() or "", add_special_tokens=False).ids, "<u4")
            return
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        bounds = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy())).tolist()
        coded = parts.flatten().dictionary_encode()
        which, whole = coded.indices.to_numpy(), coded.dictionary
        stems = pc.ascii_rtrim(whole, characters=MARKS)
        plain = pc.ascii_is_alpha(stems)
        words = pc.if_else(plain, pc.ascii_lower(stems), whole).dictionary_encode()
        marks = pc.if_else(plain, pc.ascii_ltrim(whole, characters=string.ascii_letters), "").dictionary_encode()
        distinct = [*words.dictionary.to_numpy(zero_copy_only=False), *marks.dictionary.to_numpy(zero_copy_only=False)]
        units = np.stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(words.dictionary)], 1)
        del parts, coded
        if len(self.memo) > MEMO:
            self.memo = {}
        memo = self.memo
        known = [memo.get(p) for p in distinct]
        if new := [i for i, k in enumerate(known) if k is None]:
            self.learn([distinct[i] for i in new])
            for i in new:
                known[i] = memo[distinct[i]]
        ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        for lo, hi in itertools.pairwise(bounds):
            own = units[which[lo:hi]].ravel()
            n = sizes[own]
            yield ids[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder, which tasks share one after the other."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = 2048, end_id: int = 1, group: int = 1024, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, keep: bool = True) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its text's ids (null text: none) and end_id. Each id lies in one piece; pieces of
    a sequence follow each other from offset 0; a sequence holds `window` ids at most. tokenizer is
    a file name in the public_tokenizers folder of each executor, or a path.

    Rows that repeat an id are documents of their own. A null id is kept. An empty table gives no
    rows. keep: encoded words stay in the process for later tasks, which is faster; without it a
    task lets them go at its end. Other columns are not looked at. A very long text fills whole windows; only its last ids
    wait for others. A task keeps `group` pieces and their ids at most.
    """
    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer if os.sep in tokenizer else tokenizer_path(tokenizer))
        packer = Packer(window, group, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                packer.add(key, np.append(own, np.uint32(end_id)).astype("<u4"))
            yield from flush(packer)
        packer.deal()
        yield from flush(packer)
        if not keep:
            encode.memo = {}
            release()

    def flush(packer: Packer) -> Iterator[pa.RecordBatch]:
        rows, packer.rows = packer.rows, []
        for lo in range(0, len(rows), 4096):
            part = list(zip(*rows[lo : lo + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=False)], names=names)

    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType(fields))
