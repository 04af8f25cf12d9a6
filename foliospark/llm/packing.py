"""Documents packed into sequences of fixed length: shortest pack first over the histogram of lengths.

Documents are cut into pieces of at most `most` ids. The histogram of piece lengths, at most `most` numbers, is all that the driver sees. Lengths are
placed longest first, each into the packs with the most room left; packs that are filled alike are one pattern with a count, so the plan grows with the
lengths, not with the documents. As many packs are opened as the ids need, and what is left over goes to packs of a power of two ids, which need no padding.
A piece that finds no pack with room for it is cut: its first ids complete a pack, the rest goes back into the histogram. So every sequence is full and nothing
is padded; there are fewer cuts than sequences. The plan is joined back by rank: a piece's number among those of its length.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import keyed_texts, sliced, written
from foliospark.llm.tokens import KEPT, Store, encoder

MOST = 2048
END_ID = 1
#: Chunks that the library is given as one text.
JOINED = 64


# --- the plan, on the driver ---


def plan(histogram: dict[int, int], most: int = MOST) -> tuple[list[tuple], int]:
    """([(length, first rank, how many, pieces)], number of sequences) for a histogram of lengths up to most.

    Each of the `how many` items from the first rank on is cut into the same pieces (start, ids, d, offset): of the item of rank r they go to
    sequence d + r. The room of all packs is the sum of all lengths, so all become full.
    """
    total = sum(n * c for n, c in histogram.items())
    number = total // most
    packs = [(-most, 0, number, 0)] if number else []  # (-room, first sequence, how many, ids in each)
    for k in reversed(range(most.bit_length())):
        if total % most >> k & 1:
            packs.append((-(1 << k), number, 1, 0))
            number += 1
    todo = [(-n, 0, c, n, 0, ()) for n, c in histogram.items() if c]  # (-ids left, first rank, how many, length, ids placed, pieces)
    heapify(packs)
    heapify(todo)
    out = []
    while todo:
        left, rank, n, length, start, pieces = heappop(todo)
        room, sequence, m, offset = heappop(packs)
        k, put = min(n, m), min(-left, -room)
        if k < n:
            heappush(todo, (left, rank + k, n - k, length, start, pieces))
        if k < m:
            heappush(packs, (room, sequence + k, m - k, offset))
        if put < -room:
            heappush(packs, (room + put, sequence, k, offset + put))
        pieces = (*pieces, (start, put, sequence - rank, offset))
        if put < -left:
            heappush(todo, (left + put, rank, k, length, start + put, pieces))
        else:
            out.append((length, rank, k, pieces))
    return sorted(out), number


class Places:
    """The plan as sorted arrays: where the item of a length and rank goes."""

    def __init__(self, rows: list[tuple]):
        self.length = np.array([r[0] for r in rows], np.int64)
        self.rank = np.array([r[1] for r in rows], np.int64)
        self.first = np.cumsum([0] + [len(r[3]) for r in rows])
        self.pieces = np.array([p for r in rows for p in r[3]], np.int64).reshape(-1, 4)
        self.begins = np.searchsorted(self.length, np.arange(MOST + 2 if not rows else int(self.length[-1]) + 2))

    def __call__(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start, ids, sequence, offset) of each piece."""
        a, b = self.begins[length], self.begins[length + 1]
        at = a + int(np.searchsorted(self.rank[a:b], rank, "right")) - 1
        return [(s, n, d + rank, o) for s, n, d, o in self.pieces[self.first[at] : self.first[at + 1]].tolist()]


# --- ids ---


class Encoder(Store):
    """Cuts texts before spaces and line ends, for byte-level files: they join a space only to what is behind it. A chunk stands for itself with a space in front;
    one that begins with a line end, for itself. Texts with other white space, or two such characters in a row, are encoded whole.

    Arrow divides texts and numbers their chunks, so that Python meets each chunk once in a batch, however often it occurs. As a space or line end stands only
    at the front of a chunk, the tokens that begin with one show where the chunks of a joined text begin, and the library need not keep offsets."""

    def __init__(self, path: str, chunked: bool = True):
        super().__init__(path, chunked)
        self.space, self.line = self.whole([" ", "\n"])
        self.lead = len(self.line)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(("Ġ", "Ċ"))]] = True  # a space and a line end in byte-level files
        if not all(self.opens[np.frombuffer(x, self.kind)].tolist() == [True] for x in (self.space, self.line)):
            self.chunked = False  # a file without a token for one of them

    @staticmethod
    def divisible(tokenizer: dict) -> bool:
        """Whether a tokenizer file splits every text before single spaces and single line ends, by what it says: byte-level splitting, no normalizer,
        special tokens that are plain strings without white space, and nothing added to the ids."""
        pre = tokenizer.get("pre_tokenizer") or {}
        return (
            tokenizer.get("normalizer") is None
            and tokenizer.get("post_processor") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in tokenizer.get("added_tokens") or [])
        )

    @staticmethod
    def cut(text: str) -> str | None:
        """The chunks of a line end and the text, with spaces between them."""
        if not text or text[0] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text.replace("\n", "").isprintable():
            return None
        return "\n" + text.replace("\n", " \n")

    @staticmethod
    def beside(chunk: str) -> str:
        return chunk if chunk[0] == "\n" else " " + chunk

    def fixed(self) -> dict[str, bytes]:
        return {"": self.space, "\n": self.line}  # the last of a text

    def _joined(self, chunks: list[str]) -> list[bytes]:
        groups = ["".join(map(self.beside, chunks[k : k + JOINED])) for k in range(0, len(chunks), JOINED)]
        out, width = [], self.kind.itemsize
        for found in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False):
            ids = np.array(found.ids, self.kind)
            raw, at = ids.tobytes(), (width * np.flatnonzero(self.opens[ids])).tolist()
            out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
        return out

    def parts(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.chunked:
            return self.whole(texts)
        if len(self.kept) > KEPT:
            self.kept.clear()
        self.kept |= self.fixed()
        cut = [self.cut(t) for t in texts]
        whole = self.whole([t for t, c in zip(texts, cut) if c is None])
        if len(whole) == len(texts):
            return whole
        chunks = pc.split_pattern(pa.array([c for c in cut if c is not None], pa.large_string()), " ")
        numbered = chunks.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.kept.get, words))
        lack = [k for k, x in enumerate(ids) if x is None]
        new = [words[k] for k in lack]
        for k, c, x in zip(lack, new, self._joined(new), strict=True):
            ids[k] = self.kept[c] = x
        found = pa.array(ids, pa.large_binary()).take(numbered.indices)  # the ids of all texts, one behind the other
        _, ends, data = found.buffers()
        at = np.frombuffer(ends, np.int64)[chunks.offsets.to_numpy()].tolist()
        data, rest = memoryview(data), iter(whole)
        joined = iter([bytes(data[a + self.lead : b]) for a, b in zip(at, at[1:])])
        return [next(rest if c is None else joined) for c in cut]


# --- Spark jobs ---


def pieces(docs: DataFrame, tokenizer: str, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, chunked: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, part, rank, ids): every text's ids with the end id, cut after each `most` ids. rank numbers the pieces of a length within
    the task `part`. Ids are in the narrowest of 16 and 32 bits, little-endian."""
    import pyarrow as pa

    own = keyed_texts(docs, id_col, text_col)
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode, part, seen = encoder(Encoder, tokenizer, chunked), TaskContext.get().partitionId(), [0] * (most + 1)
        size = encode.kind.itemsize
        tail = array(encode.code, [end_id]).tobytes()
        for b in sliced(batches):
            rows, start, length, total, rank, ids = [], [], [], [], [], []
            for k, x in enumerate(encode.parts([t or "" for t in b.column("text").to_pylist()])):
                x += tail
                n = len(x) // size
                for s in range(0, n, most):
                    m = min(most, n - s)
                    rows.append(k)
                    start.append(s)
                    length.append(m)
                    total.append(n)
                    rank.append(seen[m])
                    ids.append(x[size * s : size * (s + m)])
                    seen[m] += 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(total, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "part", "rank", "ids"])

    return own.mapInArrow(run, f"doc_id {kind}, start bigint, length int, doc_tokens bigint, part int, rank bigint, ids binary")


def pack(docs: DataFrame, tokenizer: str, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, chunked: bool = True) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): where each piece of each document goes. ids are little-endian unsigned 32-bit integers.

    Null texts count as empty: one end id. Rows with null or equal ids are documents of their own. An empty table gives no rows. Other columns are
    not looked at. All sequences have `most` ids, but for at most one of each smaller power of two.

    Texts are encoded once and their ids written. Ranks over all tasks are a running sum of each task's counts, at most `most` numbers a task; that table
    is broadcast by Spark only where its size on disk allows it, else joined by (task, length), which no key is hot in.
    """
    import pyarrow as pa

    own = written(pieces(docs, tokenizer, most, id_col, text_col, end_id, chunked), "pieces")
    counts = written(own.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `most` rows
    rows, _ = plan(histogram, most)
    places = docs.sparkSession.sparkContext.broadcast(Places(rows))  # grows with the lengths, not with the documents
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base = counts.select("part", "length", before.alias("base"))
    ranked = own.join(base, ["part", "length"]).select("doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"), "ids")
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        place = places.value
        for b in sliced(batches):
            at, start, length, total, rank, ids = [], [], [], [], [], []
            sequence, offset = [], []
            for k, (s, m, n, r, x) in enumerate(zip(*[b.column(c).to_pylist() for c in ("start", "length", "doc_tokens", "rank", "ids")])):
                wide = x if len(x) == 4 * m else np.frombuffer(x, "<u2").astype("<u4").tobytes()
                for a, put, q, o in place(m, r):
                    at.append(k)
                    start.append(s + a)
                    length.append(put)
                    ids.append(wide[4 * a : 4 * (a + put)])
                    total.append(n)
                    sequence.append(q)
                    offset.append(o)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
