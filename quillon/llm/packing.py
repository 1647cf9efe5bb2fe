"""Packing documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

A document is its token ids and one closing id; it is cut into pieces of the sequence length and one
remainder. Whole pieces are sequences by themselves and never move. Remainders are dealt to random groups
of about GROUP pieces, and each group is packed on its own, the longest first, into the first bin with room,
which the tournament tree finds in logarithmic time.

Defined cases: null and empty texts are one piece of one id; equal lengths are packed by doc_id, then start;
repeated rows are packed each; an empty table gives an empty result; columns besides the id and the text
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.bpe import CACHED_LENGTH, Bpe, vocabulary, worker_tokenizer

LENGTH = 1024
CLOSING_ID = 0
#: Pieces in a group, about.
GROUP = 2048


class LibraryBpe(Bpe):
    """Words that are not cached are encoded by the tokenizers library, all those of a text at once."""

    def __init__(self, spec: bytes):
        super().__init__(spec)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.blank_first = np.array([x[:1] == b" " for x in self.strings])

    def encode_word(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def look_up(self, words: list[str]) -> bytes:
        self.age()
        found = list(map(self.young.get, words))
        absent = [i for i, x in enumerate(found) if x is None]
        if absent:
            self.learn({words[i] for i in absent})
            for i in absent:
                found[i] = self.young[words[i]]
        return b"".join(found)

    def learn(self, words: set[str]) -> None:
        """Makes words known that aren't in the younger generation."""
        young, old = self.young, self.old
        letters, others = [], []
        for w in words:
            if w in old:
                young[w] = old[w]
            elif len(w) <= CACHED_LENGTH:
                (letters if w[0] == " " and w[1:].isalpha() else others).append(w)
        if letters:  # they go in one call; ids that begin with a blank part them
            ids = np.array(self.library.encode_batch_fast(["".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            cuts, packed = [*(self.blank_first[ids].nonzero()[0] * 4).tolist(), 4 * len(ids)], ids.tobytes()
            if len(cuts) == len(letters) + 1:
                young.update(zip(letters, [packed[a:b] for a, b in pairwise(cuts)], strict=True))
            else:
                others += letters
        if others:
            for w, e in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False), strict=True):
                young[w] = np.array(e.ids, "<u4").tobytes()


def cut_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_words: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens. keep_words: whether workers keep their words for the next task."""
    common.ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, closing = worker_tokenizer(spec.value, LibraryBpe), CLOSING_ID.to_bytes(4, "little")
        for batch in batches:
            of, starts, lengths, sums, sizes = [], [], [], [], []
            for row, x in enumerate(batch.column(1)):
                ids = bpe.encode(x.as_py() or "") + closing
                n = len(ids) // 4
                for at in range(0, n, length):
                    piece = ids[4 * at : 4 * (at + length)]
                    of.append(row)
                    starts.append(at)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    sizes.append(n)
            yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in (starts, lengths, sums, sizes))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        if not keep_words:
            bpe.forget()
        common.release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the order given; each goes to the first bin with room."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # a node holds the largest room of the bins below it
    bins, offsets = [], []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= size
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, keep_words: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = common.stored(cut_pieces(docs, path, id_col, text_col, length, keep_words), "pieces")
    whole = pieces.filter(F.col("length") == length).withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit(rows["length"].to_pylist(), length)
        part = rows["part"].to_numpy()
        sequence = (part.astype(np.int64) * (1 << 24) + np.array(bins, np.int64)) * 2 + 1
        return rows.drop_columns("part").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets, pa.int64()))

    kind = pieces.schema["doc_id"].dataType.simpleString()
    packed = dealt.groupBy("part").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(packed)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_packing": op10_packing}
