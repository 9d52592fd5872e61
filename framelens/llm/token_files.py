"""Token ids in files of frequency-ranked, byte-aligned variable-length blocks, and their reader."""

from __future__ import annotations

import os
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents_of, shared_dir, ship_package

#: Ids after which a block is closed (a longer document is a block alone).
BLOCK_IDS = 1 << 20
#: Stretches of text that a Python worker remembers, none of more than LONG bytes.
REMEMBERED = 800_000
LONG = 64
#: Marks of stretches that have no space before them.
MARKS = ("\x01", "\x02")
#: A stretch without white space, after a mark or not.
SOLID = re.compile(r"[\x01\x02]?[^\s\x01\x02]\S*\Z")
#: Bytes of text or ids that a task holds at a time (a longer text alone).
HELD = 8 << 20

MAGIC = b"FRVB0001"
#: Lengths in bytes of the four values of a control byte, two bits each, lowest first.
_LENGTHS = np.array([[((c >> (2 * k)) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One block: magic; documents, ids and distinct ids (8 bytes each); the distinct ids by falling frequency (4 bytes
    each); a null mark, doc_id and count for each document; control bytes; value bytes. A value is an id's place in
    the frequency order, little-endian in as few bytes as it needs."""
    often = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    distinct = np.flatnonzero(often)
    order = np.lexsort((distinct, -often[distinct]))
    place = np.zeros(len(often), np.uint32)
    place[distinct[order]] = np.arange(len(order))
    value = place[ids]
    size = 1 + (value > 0xFF).astype(np.uint8) + (value > 0xFFFF) + (value > 0xFFFFFF)
    codes = np.zeros(-(-len(value) // 4) * 4, np.uint8)
    codes[:len(value)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    wide = value.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = wide[np.arange(4)[None, :] < size[:, None]]
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(ids), len(distinct)], "<i8").tobytes(), distinct[order].astype("<u4").tobytes(), null.tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(counts, "<i8").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()])


def unpack(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a block, by table lookup of the control bytes."""
    if block[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, distinct = np.frombuffer(block, "<i8", 3, 8).tolist()
    at = 32

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(block, kind, count, at)
        at += out.nbytes
        return out

    by_rank, null, doc_ids, counts = take("<u4", distinct), take(np.uint8, docs), take("<i8", docs), take("<i8", docs)
    size = _LENGTHS[take(np.uint8, -(-n // 4))].reshape(-1)[:n].astype(np.int64)
    data = np.frombuffer(block, np.uint8, -1, at)
    start = np.cumsum(size) - size
    value = data[start].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        value[longer] |= data[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else d for z, d in zip(null.tolist(), doc_ids.tolist())], counts, by_rank[value]


class Words:
    """Texts to ids by the tokenizers library, which sees each distinct stretch of text once in a while.

    A pre-tokenizer for byte-level BPE always cuts before a space that stands between two characters other than white
    space, and around a line break that does. So a text in which no two white-space characters meet is the run of its
    stretches between such cuts: its ids are theirs, one after the other. Other texts go to the library whole, and so do
    those that hold the content of an added token, such as a mark of the end of a text, which the library finds in them."""

    #: Two white-space characters side by side, or one of the marks.
    WHOLE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]{2}|[\x01\x02]"

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([self.WHOLE, *map(re.escape, added)])
        #: Stretches between white space may be joined by it unless an added token has some.
        self.joins = not any(re.search(r"\s", t) for t in added)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # how byte-level vocabularies write a space
        self.line = self.library(["\n"])[0]
        #: Stretches that came before, their ids one after the other, and the number of each one's.
        self.known, self.flat, self.size = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for k in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[k:k + 4096], add_special_tokens=False)]

    def stretches(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of stretches: after a mark the text stands alone, else it has a space before it. Stretches without
        white space go to the library many at a time; the spaces or line breaks between them show where each ends."""
        alone: list[str] = []
        after: dict[bool, list[str]] = {True: [], False: []}
        spaced, marked, fits = after[True].append, after[False].append, SOLID.match if self.joins else lambda w: None
        for w in fresh:
            if not fits(w):
                alone.append(w)
            elif w[0] > MARKS[1]:
                spaced(w)
            else:
                marked(w)
        found = dict(zip(alone, self.library([w[1:] if w[:1] in MARKS else " " + w for w in alone])))
        for space, all_ in after.items():
            for k in range(0, len(all_), 2048):
                part = all_[k:k + 2048]
                ids = np.frombuffer(self.library([" " + " ".join(part) if space else "\n".join(w[1:] for w in part)])[0], "<u4")
                if space:
                    cut = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
                else:
                    breaks = np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0])
                    cut = np.concatenate([[0], breaks + 1, [len(ids) + 1]])
                if len(cut) != len(part) + 1:
                    found |= dict(zip(part, self.library([" " + w if space else w[1:] for w in part])))
                    continue
                data, gap = ids.tobytes(), 0 if space else 4
                found |= {w: data[x:y] for w, x, y in zip(part, (4 * cut[:-1]).tolist(), (4 * cut[1:] - gap).tolist())}
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end_id`` after each, and the number of each one's, the end included."""
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, self.whole)
        plain = pc.binary_join_element_wise("", pc.replace_substring(texts, "\n", " \x02\n \x01"), "\x01")
        parts = pc.split_pattern(pc.if_else(whole, "\x01", plain), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary
        slot = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        at = np.flatnonzero(slot < 0)
        taken = words.take(pa.array(at))
        fresh = taken.to_pylist()
        found = self.stretches(fresh)
        blobs = [*map(found.__getitem__, fresh), np.array([end_id], "<u4").tobytes(), *self.library(texts.filter(whole).to_pylist())]
        n_known, end = len(self.known), len(self.known) + len(fresh)
        slot[at] = n_known + np.arange(len(fresh))
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(blobs), "<u4")])
        size = np.concatenate([self.size, np.array(list(map(len, blobs)), np.int32) // 4])
        start = np.cumsum(size, dtype=np.int32) - size

        def gather(index):
            """Ids of the stretches in order, and where each one's end."""
            n = size[index]
            stop = np.cumsum(n, dtype=np.int64)
            place = np.repeat(start[index] - (stop - n).astype(np.int32), n)
            place += np.arange(len(place), dtype=np.int32)
            return flat[place], stop

        # The order of stretches: those of each text (for one that went whole, its own ids), then the end.
        index, bounds = slot[coded.indices.to_numpy()], parts.offsets.to_numpy().astype(np.int64)
        index[bounds[:-1][whole.to_numpy(zero_copy_only=False)]] = end + 1 + np.arange(len(blobs) - len(fresh) - 1)
        ids, stop = gather(np.insert(index, bounds[1:], end))
        short = np.flatnonzero(pc.binary_length(words if end > REMEMBERED else taken).to_numpy(zero_copy_only=False) <= LONG)
        if end > REMEMBERED:  # start again with what this call needed
            self.known, self.flat, self.size = words.take(pa.array(short)), gather(slot[short])[0], size[slot[short]]
        else:
            added = n_known + short
            self.known, self.flat, self.size = pa.concat_arrays([self.known, taken.take(pa.array(short))]), np.concatenate([self.flat, gather(added)[0]]), np.concatenate([self.size, size[added]])
        last = stop[bounds[1:] + np.arange(len(texts))]
        return ids, np.diff(np.concatenate([[0], last]))


#: Kept from task to task of a Python worker.
_WORDS: dict[int, Words] = {}


def write_token_files(docs: DataFrame, tokenizer_json: str, end_id: int, path: str | None = None) -> str:
    """Encode every whole text of ``docs`` (doc_id, text), append ``end_id`` to each, and write the ids in ascending
    doc_id order as blocks under ``path`` (a new folder in the shared one if None). Returns the path.

    Rows are range-partitioned by doc_id, ties by the text's hash, and sorted; each task closes a block after a million
    ids and ranks ids by their frequency in all of it, so memory is bounded and a block can be read alone. Null and
    empty texts have the end id alone; null doc_ids come first; repeated rows stay; extra columns are left out; an empty
    table gives no blocks. A special token's content in a text becomes that token, as the library
    does it; ``add_special_tokens=False`` only keeps it from adding any. A text of any length is encoded whole, and a
    document of more than a million ids is a block alone, so a task's memory is bounded by the longest document. Blocks are stored as the binary column of a Parquet table, which any store that Spark writes to can hold.
    """
    spark = docs.sparkSession
    ship_package(spark)
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer_json, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches):
        text_hash = hash(model.value)
        if text_hash not in _WORDS:
            _WORDS.clear()
            _WORDS[text_hash] = Words(model.value)
        words = _WORDS[text_hash]
        part, block = TaskContext.get().partitionId(), 0
        ids, ties, held, n = [], [], [], 0

        def closed():
            flat = np.concatenate(held)
            counts = list(map(len, held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array(ids[:1], pa.int64()), pa.array(ties[:1], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([pack(ids, counts, flat)], pa.binary())],
                names=["part", "block", "first_id", "first_tie", "n_docs", "n_ids", "payload"])

        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HELD, "right")))
                rows = batch.slice(at, to - at)
                coded, count = words.encode(rows.column("text"), end_id)
                for i, tie, own in zip(rows.column("doc_id").to_pylist(), rows.column("tie").to_pylist(), np.split(coded, np.cumsum(count)[:-1])):
                    ids.append(i)
                    ties.append(tie)
                    held.append(own)
                    n += len(own)
                    if n >= BLOCK_IDS:
                        yield closed()
                        block, ids, ties, held, n = block + 1, [], [], [], 0
                at = to
        if ids:
            yield closed()

    rows = documents_of(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.mapInArrow(run, "part int, block int, first_id long, first_tie long, n_docs long, n_ids long, payload binary").write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents of the blocks under ``path`` (part, block, doc_id, inside, n_tokens, ids), where ids are
    little-endian unsigned 32-bit integers in a binary and inside counts the block's ids before it, and the blocks'
    starts (part, block, from). ``with_starts`` joins the two, best after the ids have been used. Blocks are decoded
    alone; their starts come from a running sum over parts and one inside each part."""
    ship_package(spark)
    blocks = spark.read.parquet(path)
    key = [F.asc_nulls_first("first_id"), "first_tie", "part", "block"]
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_part"), F.min(F.struct("block", "first_id", "first_tie")).alias("head"))
    over = Window.orderBy(F.asc_nulls_first("head.first_id"), "head.first_tie", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n_part").over(over), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_start"))
    starts = starts.join(sums, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("from"))

    def run(batches):
        for batch in batches:
            for part, block, payload in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("payload")):
                docs, counts, ids = unpack(payload.as_py())
                end = np.cumsum(counts)
                at = 0
                while at < len(docs):
                    to = max(at + 1, int(np.searchsorted(end, end[at] + HELD // 4, "right")))
                    n = to - at
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(docs[at:to], pa.int64()),
                         pa.array(end[at:to] - counts[at:to]), pa.array(counts[at:to]),
                         pa.array([ids[e - c:e].astype("<u4").tobytes() for e, c in zip(end[at:to].tolist(), counts[at:to].tolist())], pa.binary())],
                        names=["part", "block", "doc_id", "inside", "n_tokens", "ids"])
                    at = to

    read = blocks.select("part", "block", "payload").mapInArrow(run, "part int, block int, doc_id long, inside long, n_tokens long, ids binary")
    return read, starts


def with_starts(read: DataFrame, starts: DataFrame) -> DataFrame:
    """start, the ids of all documents before it, for every row of ``read``."""
    return read.join(starts, ["part", "block"]).withColumn("start", F.col("from") + F.col("inside")).drop("from", "inside", "part", "block")
