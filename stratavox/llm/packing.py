"""Packing documents into sequences: first-fit decreasing in randomised groups.

Documents are dealt to groups of about ``per_group`` documents, or ``GROUP_BYTES`` of text where they are long, by a hash that
takes in the row's place, so that repeated rows are spread. In a group every whole sequence's worth of a long
document becomes a sequence; the rests are placed first-fit decreasing, where a tournament tree over the free room of all bins
finds the first bin that is large enough in logarithmic time. The emptiest bins beyond the least possible number are then
dissolved: their pieces are cut to fill the holes of the others, so a group pads less than one sequence.

Defined results: null text is an empty document, which is the end token alone; rows with equal doc_id are packed separately;
a null doc_id is packed like any other; an empty table gives no sequences; extra columns are ignored. Strings of special tokens
in a text are ordinary text (``encode_special_tokens``). The tokenizer file must be readable on every executor.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, load
from .shingling import buffers, word_hashes
from .wordtable import WordTable

SEQUENCE, END, PER_GROUP, GROUP_BYTES = 4096, 2, 2000, 32_000_000
#: Words and ids remembered by a worker, after which it starts anew.
REMEMBERED, MOST_IDS = 2_000_000, 16_000_000
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids:
    """Token ids of texts as little-endian 32-bit integers.

    The tokenizer lower-cases, drops white space and never joins across it, so ids of a text are those of its words one after
    another. Words are told apart by hashes of 64 bits, looked up together in an open table, and tokenized once. A word of letters
    and ASCII marks behind them is two pre-tokens; a word of letters goes straight to the tokenizer's model.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.normal = self.tokenizer.model, self.tokenizer.normalizer
        self.marks: dict[bytes, list[int]] = {}
        # The short way holds for byte-level tokenizers that keep words of letters whole; with any other, every word is encoded.
        self.direct = True
        tries = [b"probe", "\u00fcber\u00e9".encode(), "\u65e5\u672c".encode()]
        self.direct = self.learn(tries) == [self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in tries]
        self.clear()

    def clear(self) -> None:
        self.table = WordTable()
        self.sizes, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def learn(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        odd, tokenize = [], self.model.tokenize
        for i, w in enumerate(words):
            core = w.rstrip(MARKS)
            if not self.direct:
                odd.append(i)
                continue
            if core.isalpha():
                text = core.decode()
            else:
                text = core.decode("utf-8", "replace")
                if not text.isalpha() or SPLITS in text:
                    odd.append(i)
                    continue
                text = self.normal.normalize_str(text).encode().decode("latin-1").translate(BYTES)
            out[i] = [t.id for t in tokenize(text)]
            if len(core) < len(w):
                mark = w[len(core) :]
                if mark not in self.marks:
                    self.marks[mark] = self.tokenizer.encode(mark.decode(), add_special_tokens=False).ids
                out[i] += self.marks[mark]
        for at in range(0, len(odd), 2000):
            some = odd[at : at + 2000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in some], add_special_tokens=False), strict=True):
                out[i] = e.ids
        if len(self.marks) > REMEMBERED:
            self.marks.clear()
        return out

    def texts(self, raws: list[bytes | None], end: int = END) -> list[bytes]:
        """The ids of texts (null: none), each with the end token behind them."""
        out: list[bytes] = []
        for buffer, some in buffers(raws):
            if len(self.sizes) > REMEMBERED or len(self.flat) > MOST_IDS:
                self.clear()
            start, size, h = word_hashes(buffer)
            number, words = self.table.numbered(buffer, start, size, h)
            if words:
                ids = self.learn(words)
                self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
                self.starts = np.cumsum(self.sizes) - self.sizes
                self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), "<u4")])
            count = self.sizes[number]
            behind = np.cumsum(count)
            at = np.repeat(self.starts[number] - (behind - count), count) + np.arange(behind[-1] if len(behind) else 0)
            raw, tail = self.flat[at].tobytes(), np.array([end], "<u4").tobytes()
            ends = np.searchsorted(start, 1 + np.cumsum([len(x) + 1 for x in some]))
            edge = (4 * np.concatenate([[0], behind])[np.concatenate([[0], ends])]).tolist()
            out += [raw[a:b] + tail for a, b in zip(edge, edge[1:])]
        return out


#: ASCII marks that end a word of letters without changing how it is cut; an apostrophe may.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Byte-level pieces write a byte that is no visible Latin-1 character as one from U+0100 on, in order.
BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173))}
#: The one letter whose lower case is not of letters alone.
SPLITS = "\u0130"


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Ids:
    return Ids(path)


def coded(rows: DataFrame, path: str, end: int = END) -> DataFrame:
    """rows with raw (text as binary) replaced by ids: the document's ids and the end token, as bytes of 32-bit integers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tokenizer(path).texts(batch.column("raw").to_pylist(), end)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_names), pa.array(ids, pa.binary())], names=[*kept_names, "ids"])

    kept_names = [c for c in rows.columns if c != "raw"]
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(encode, ", ".join([*(f"{c} {kinds[c]}" for c in kept_names), "ids binary"]))


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Bins as lists of positions in sizes. A tournament tree holds the free room of every bin; the leftmost bin that is large
    enough is found from the root."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    leaves = 1 << max(len(sizes) - 1, 0).bit_length()
    tree = [room] * (2 * leaves)
    bins: list[list[int]] = []
    for i in order:
        node = 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= sizes[i] else 2 * node + 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(i)
        tree[node] -= sizes[i]
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins


def pack(sizes: list[int], room: int = SEQUENCE) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length); every token is in one piece."""
    full = [[(i, s, room)] for i, n in enumerate(sizes) for s in range(0, n - room + 1, room)]
    rest = [(i, n - n % room, n % room) for i, n in enumerate(sizes) if n % room]
    bins = [[rest[j] for j in b] for b in first_fit_decreasing([r[2] for r in rest], room)]
    least = -(-sum(r[2] for r in rest) // room)
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    kept, loose = bins[:least], [p for b in bins[least:] for p in b]
    for b in kept:
        hole = room - sum(p[2] for p in b)
        while hole and loose:
            i, s, n = loose.pop()
            cut = min(hole, n)
            b.append((i, s, cut))
            hole -= cut
            if cut < n:
                loose.append((i, s + cut, n - cut))
    return full + kept


def _packed(group: pa.Table) -> pa.Table:
    ids, names = group["ids"].to_pylist(), group["doc_id"].to_pylist()
    first = group["group"][0].as_py() << 32
    out: list[list] = [[] for _ in range(7)]
    for k, pieces in enumerate(pack([len(x) // 4 for x in ids])):
        offset = 0
        for i, s, n in pieces:
            for column, value in zip(out, (names[i], s, n, zlib.crc32(ids[i][4 * s : 4 * (s + n)]), len(ids[i]) // 4, first + k, offset), strict=True):
                column.append(value)
            offset += n
    return pa.table([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in OUT.split(", ")])


def pack_documents(docs: DataFrame, path: str, per_group: int = PER_GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("raw")).alias("bytes")).first()
    groups = max(1, -(-size["n"] // per_group), -(-(size["bytes"] or 0) // GROUP_BYTES))
    group = F.pmod(F.xxhash64(F.lit("pack"), "doc_id", F.monotonically_increasing_id()), F.lit(groups)).alias("group")
    return coded(rows.select("doc_id", group, "raw"), path).groupBy("group").applyInArrow(_packed, OUT)


def op6_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(load(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_packing": op6_packing}
