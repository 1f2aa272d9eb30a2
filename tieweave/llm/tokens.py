"""Token-ID output in blocks of a static range asymmetric numeral system (rANS)."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.llm.common import kept, read, saved, shared_folder, with_columns_of_text

# Fixed values of the file format.
MAGIC = b"TWRANS01"
SCALE = 20  # the frequencies of a table sum to 2 ** SCALE
LANES = 64  # token t of a block belongs to lane t % LANES
LOW = np.uint64(1 << 31)  # a lane's state stays in [LOW, LOW << 32)
CHECKPOINT = 1024  # steps of all lanes between two checkpoints
BLOCK = 1 << 17  # tokens after which a block is closed at the end of a document
U32 = np.uint64(32)


#: Pieces that the model can be given as they are: letters of Latin-1, perhaps with one full stop or comma behind.
SIMPLE = re.compile("([a-zß-öø-ÿ]+)([.,]?)")


class Pieces(dict):
    """Piece -> its ids as bytes. Once `most` are held, further ones are encoded each time; the frequent ones came early."""

    def __init__(self, tokenizer: str, end_id: int, most: int = 200_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.most, self.model = most, Tokenizer.from_file(tokenizer)
        self.kind = "H" if max(self.model.get_vocab_size(), end_id + 1) <= 1 << 16 else "I"
        self.added = [t.content.lower() for t in self.model.get_added_tokens_decoder().values()]
        self.parts = self.model.model.tokenize
        spelled = {b: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        two = {c: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.spelling = str.maketrans({chr(k): v for k, v in (spelled | two).items()} | {chr(c): two[c + 32] for c in range(0xC0, 0xDF) if c != 0xD7})
        self.stops = {c: self.encoded(c) for c in ".,"} | {"": b""}

    def encoded(self, piece: str) -> bytes:
        return array(self.kind, self.model.encode(piece, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        simple = SIMPLE.fullmatch(piece)
        if simple:
            out = array(self.kind, [t.id for t in self.parts(simple[1].translate(self.spelling))]).tobytes() + self.stops[simple[2]]
        else:
            out = self.encoded(piece)
        if len(self) < self.most:
            self[piece] = out
        return out


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """docs with ids (little-endian unsigned, the end id last; 16 bits each if the vocabulary allows it, else 32), width (bytes of an id) and n_tokens.

    tokenizer: the path of a tokenizers file, on every executor. It must lower-case and drop white space as its first steps, so that the pieces
    between spaces and line ends can be lower-cased (A-Z) and encoded one by one; each distinct piece of a block of texts is looked up
    once, and the ids are put together in numpy. A null text has the end id alone.
    """

    def make() -> Callable:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        pieces = kept(f"pieces of {tokenizer}, {end_id}", lambda: Pieces(tokenizer, end_id))
        kind = np.dtype("<u2" if pieces.kind == "H" else "<u4")

        def work(texts: pa.Array) -> list:
            texts = pc.fill_null(texts, "")
            lower = pc.ascii_lower(texts)
            # A special string in capitals isn't one: the library looks for them before it lower-cases.
            odd = any(pc.any(pc.match_substring(lower, a)).as_py() for a in pieces.added)
            lines = pc.replace_substring(texts if odd else lower, "\n", " ")
            split = pc.split_pattern(lines, " ")
            words = pc.dictionary_encode(split.flatten())
            known = [pieces[w] for w in words.dictionary.to_pylist()]
            size = np.fromiter(map(len, known), np.int64, len(known)) // kind.itemsize
            ids = np.frombuffer(b"".join(known), kind)
            which = words.indices.to_numpy(zero_copy_only=False)
            n, start = size[which], (np.cumsum(size) - size)[which]
            ends = np.cumsum(n)
            tokens = ids[np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
            counts = np.diff(bounds)
            tokens = np.insert(tokens, bounds[1:], end_id).astype(kind)
            at = np.concatenate([[0], np.cumsum(counts + 1)]) * kind.itemsize
            raw = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(tokens.tobytes())])
            return [raw, np.full(len(texts), kind.itemsize), counts + 1]

        return work

    fields = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("n_tokens", T.LongType())])
    return with_columns_of_text(docs, fields, make, arrow=True)


def ids_of(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur (ascending) and their frequencies, scaled to sum 2 ** SCALE, over all tokens.

    One row per id of the vocabulary comes to the driver, whatever the size of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for width in set(batch.column(1).to_pylist()):
                rows = [x for x, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w == width]
                part = np.bincount(ids_of(b"".join(rows), width), minlength=len(total))
                part[: len(total)] += total
                total = part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = tokens.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r["id"])
    ids, n = np.array([r["id"] for r in rows], np.uint32), np.array([r["n"] for r in rows], np.float64)
    room = (1 << SCALE) - len(ids)
    if room < 0:
        raise ValueError("the vocabulary is larger than the range of the frequencies")
    if not len(ids):
        return ids, np.empty(0, np.uint64)
    freq = 1 + np.floor(room * (n / n.sum())).astype(np.int64)
    freq[np.argmax(freq)] += (1 << SCALE) - freq.sum()
    return ids, freq.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks with one frequency table; all lanes of many blocks go step by step together."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids, freq
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else freq
        self.number = np.zeros(int(ids[-1]) + 1 if len(ids) else 1, np.int64)
        self.number[ids] = np.arange(len(ids))
        self.slots = np.repeat(np.arange(len(ids), dtype=np.uint16 if len(ids) <= 1 << 16 else np.int32), freq.astype(np.int64))

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """One payload per block of ids: u32 number of tokens, u32 number of checkpoints, u32 crc32 of what follows; per checkpoint u32 the
        position in the words and LANES u64 states; then u32 words, in the order in which decoding reads them."""
        most = max(len(b) for b in blocks)
        steps, n = -(-most // LANES), len(blocks)
        table = np.zeros((n, steps * LANES), np.int32)
        filled = np.zeros((n, steps * LANES), bool)
        for i, b in enumerate(blocks):
            table[i, : len(b)] = self.number[b]
            filled[i, : len(b)] = True
        table = np.ascontiguousarray(table.reshape(n, steps, LANES).transpose(1, 0, 2).reshape(steps, -1))
        filled = np.ascontiguousarray(filled.reshape(n, steps, LANES).transpose(1, 0, 2).reshape(steps, -1))
        state = np.full(n * LANES, LOW, np.uint64)
        words, sent = np.zeros(table.shape, np.uint32), np.zeros(table.shape, bool)
        marks = {}
        scale = np.uint64(SCALE)
        for t in range(steps - 1, -1, -1):
            s = table[t]
            f = self.freq[s]
            out = state >= (f << np.uint64(63 - SCALE))
            full = bool(filled[t].all())
            if not full:
                out &= filled[t]
            words[t], sent[t] = state, out
            x = state >> (U32 * out)
            q = x // f
            x -= q * f
            q <<= scale
            x += q
            x += self.start[s]
            state = x if full else np.where(filled[t], x, state)
            if t % CHECKPOINT == 0:
                marks[t] = state
        result = []
        shape = (steps, n, LANES)
        words, sent = words.reshape(shape), sent.reshape(shape)
        for i, b in enumerate(blocks):
            mine = sent[:, i]
            stream = words[:, i][mine].astype("<u4")
            before = np.concatenate([[0], np.cumsum(mine.sum(axis=1))])
            own = range(0, max(1, -(-len(b) // LANES)), CHECKPOINT)
            body = b"".join(np.array([before[t]], "<u4").tobytes() + marks[t].reshape(n, LANES)[i].astype("<u8").tobytes() for t in own if t in marks) + stream.tobytes()
            result.append(np.array([len(b), sum(t in marks for t in own), zlib.crc32(body)], "<u4").tobytes() + body)
        return result

    def decode(self, payloads: list[bytes]) -> list[np.ndarray]:
        """The ids of each payload; every part between two checkpoints is decoded beside all others."""
        parts, sizes, offset, streams = [], [], 0, []
        for k, p in enumerate(payloads):
            n, marks, crc = np.frombuffer(p, "<u4", 3).tolist()
            if zlib.crc32(p[12:]) != crc:
                raise ValueError("a block's checksum is wrong")
            sizes.append(n)
            for j in range(marks):
                at = 12 + j * (4 + 8 * LANES)
                left = min(n - j * CHECKPOINT * LANES, CHECKPOINT * LANES)
                parts.append((k, j, left, offset + int(np.frombuffer(p, "<u4", 1, at)[0]), np.frombuffer(p, "<u8", LANES, at + 4)))
            stream = np.frombuffer(p, "<u4", offset=12 + marks * (4 + 8 * LANES))
            streams.append(stream)
            offset += len(stream)
        words = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
        result = [np.empty(n, np.uint32) for n in sizes]
        if not parts:
            return result
        parts.sort(key=lambda x: -x[2])  # whole parts first: the rows that are still at work stay a prefix
        left = np.array([x[2] for x in parts])
        state = np.array([x[4] for x in parts], np.uint64)
        at = np.array([x[3] for x in parts], np.int64)
        steps = -(-int(left[0]) // LANES)
        found = np.zeros((steps, len(parts), LANES), self.slots.dtype)
        mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
        for t in range(steps):
            live = int(np.searchsorted(-left, -t * LANES, side="left"))
            x = state[:live]
            slot = x & mask
            s = self.slots[slot.view(np.int64)]
            found[t, :live] = s
            slot -= self.start[s]
            y = x >> scale
            y *= self.freq[s]
            y += slot
            need = y < LOW
            if left[live - 1] < (t + 1) * LANES:
                inside = np.arange(LANES)[None, :] < (left[:live] - t * LANES)[:, None]
                y, need = np.where(inside, y, x), need & inside
            row = np.flatnonzero(need)
            count = need.sum(axis=1)
            flat = y.reshape(-1)
            where = np.repeat(at[:live] - (np.cumsum(count) - count), count) + np.arange(len(row))
            flat[row] = (flat[row] << U32) | words[where]
            state[:live] = y
            at[:live] += count
        for i, (k, j, n, _, _) in enumerate(parts):
            a = j * CHECKPOINT * LANES
            result[k][a : a + n] = self.ids[found[:, i].reshape(-1)[:n]]
        return result


FILE = "part int, block int, first_token long, doc_ids binary, doc_tokens binary, payload binary"


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Writes tokens(doc_id, ids, n_tokens) in ascending doc_id order to path/blocks and the shared table to path/table.

    A row of blocks is one independent block: part and block give its place, doc_ids (i64) and doc_tokens (u32) its documents, payload its tokens;
    first_token counts within the part. The container is Parquet, so that Spark commits, retries and splits the files on any store.
    Documents with the same doc_id come in the order of their lengths, then ids; a null doc_id comes first, as the least 64-bit number.
    """
    spark = tokens.sparkSession
    ids, freq = frequencies(tokens)
    shared = spark.sparkContext.broadcast((ids, freq))
    least = F.lit(-(1 << 63)).cast("long")
    ordered = tokens.select(F.coalesce("doc_id", least).alias("doc_id"), "n_tokens", "ids", "width").repartitionByRange("doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), Coder(*shared.value)
        block, first, waiting, docs, rows, n = 0, 0, [], [], [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, waiting, first
            if not waiting or len(waiting) < 16 and not last:
                return
            done = coder.encode([w[1] for w in waiting])
            cols = [[], [], [], [], [], []]
            for (owners, ids_), payload in zip(waiting, done, strict=True):
                row = (part, block, first, np.array([d for d, _ in owners], "<i8").tobytes(), np.array([k for _, k in owners], "<u4").tobytes(), MAGIC + payload)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                block, first = block + 1, first + len(ids_)
            waiting = []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in FILE.split(", ")])

        for batch in batches:
            for doc, count, raw, width in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows.append(ids_of(raw, width))
                docs.append((doc, count))
                n += count
                if n >= BLOCK:
                    waiting.append((docs, np.concatenate(rows)))
                    docs, rows, n = [], [], 0
                    yield from flush(False)
        if docs:
            waiting.append((docs, np.concatenate(rows)))
        yield from flush(True)

    ordered.mapInArrow(encode, FILE).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(ids.astype("<u4").tobytes(), freq.astype("<u8").tobytes())], "ids binary, freq binary").coalesce(1).write.parquet(f"{path}/table")


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files alone; start counts the ids of all documents before it."""
    row = spark.read.schema("ids binary, freq binary").parquet(f"{path}/table").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(row["ids"], "<u4"), np.frombuffer(row["freq"], "<u8").astype(np.uint64)))
    blocks = spark.read.schema(FILE).parquet(f"{path}/blocks")
    tokens = blocks.select("part", "first_token", "doc_tokens")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [f + int(np.frombuffer(d, "<u4").sum(dtype=np.int64)) for f, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.int64())], ["part", "end"])

    parts = tokens.mapInArrow(total, "part int, end long").groupBy("part").agg(F.max("end").alias("n"))
    # One row per written part.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 16):
                batch = whole.slice(a, 16)
                part, first, docs, counts, payloads = [batch.column(i).to_pylist() for i in range(5)]
                if any(p[:8] != MAGIC for p in payloads):
                    raise ValueError("not a block of this format")
                for p, f, d, c, ids in zip(part, first, docs, counts, coder.decode([x[8:] for x in payloads]), strict=True):
                    c = np.frombuffer(c, "<u4").astype(np.int64)
                    ends = np.cumsum(c)
                    raw = ids.astype("<u4").tobytes()
                    cut = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), c.tolist(), strict=True)]
                    columns = [pa.array([p] * len(c), pa.int32()), pa.array(np.frombuffer(d, "<i8"), pa.int64()), pa.array(f + ends - c, pa.int64()), pa.array(c, pa.int64()), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "first", "n_tokens", "ids"])

    out = blocks.select("part", "first_token", "doc_ids", "doc_tokens", "payload").mapInArrow(decode, "part int, doc_id long, first long, n_tokens long, ids binary")
    least = F.lit(-(1 << 63)).cast("long")
    return out.join(F.broadcast(starts), "part").select(F.when(F.col("doc_id") != least, F.col("doc_id")).alias("doc_id"), (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")


def encode_documents(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Tokenises docs(doc_id, text), writes them to path (a new folder in the shared one if None) and returns what read_tokens() gives.

    Repeated rows are written as often as they are there; an empty table gives empty files and no row.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(saved(tokenize(docs.select("doc_id", "text"), tokenizer, end_id).drop("text")), path)
    return read_tokens(spark, path)


def digests(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_tokens(spark, sf_dir: str) -> DataFrame:
    """Every document as read back from its token files: its place, its tokens and their checksum."""
    return digests(encode_documents(read(spark, sf_dir, "documents")))
