"""Token ids in Arrow files of equal-length sequences, and their reader.

A shard is an Arrow IPC file whose record batches hold two fixed-size lists a row, ``ids`` (the smallest unsigned type the
vocabulary fits in) and ``mask`` (False for what only fills up the last row). The shard's documents lie end to end, across rows. Beside it an index
file has each document's id, first place and number of ids. A reader maps the file and takes any sequence, or any document, without copying.

Tasks write under names of their own and report them; a file counts only if the report of the task that ended says so, so
lost or repeated tasks leave no trace in the result.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from equiloom.llm.common import new_folder, partitions, stored, worker_memory

SEQUENCE = 2048
ROWS_A_BATCH = 256
KEPT_PIECES = 1_000_000
WORDS_IN_A_ROW = 100
BYTES_AT_ONCE = 1 << 22
#: How byte-level vocabularies write a blank and a line break; fixed values.
BLANK, LINE = "\u0120", "\u010a"
#: A blank between two characters that are no white space starts a new piece in byte-level BPE, whatever else stands around.
PIECE_START = r"(?<=\S)(?= \S)"
#: Texts whose words are not one blank or line break apart: these signs at an end or side by side, or any other white space.
NOT_PLAIN = "^[ \n]|[ \n]\\z|[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def decoded(texts: pa.Array) -> pa.Array:
    """Bytes as text, a null one empty; what is no UTF-8 is replaced."""
    try:
        return pc.fill_null(texts, b"").cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def encoder(path: str, end_id: int = 0) -> tuple[Callable[[pa.Array], list[bytes]], np.dtype]:
    """A function from texts to their ids as bytes, end id included, and the type of the ids.

    Byte-level BPE encodes pieces of a text by themselves, so each different piece is encoded once and remembered by the
    worker, up to ``KEPT_PIECES``. In texts whose words are single blanks and line breaks apart, which is most, the pieces are the words, with
    the blank before. New words are encoded many in a row: only a word's first id holds a blank, and only a line break's
    own id a line break, so the row falls apart again. Words are told apart by Arrow, and ids put together by numpy. With other tokenizers whole texts are encoded.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
    end = np.array([end_id], kind).tobytes()

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, kind).tobytes()

    def encoded(texts: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    plan = json.loads(tokenizer.to_str())
    split = plan["pre_tokenizer"] or {}
    if plan["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return lambda texts: [x + end for x in encoded(decoded(texts).to_pylist())], kind

    names = tokenizer.get_vocab()
    starts_word = np.zeros(max(names.values()) + 1, bool)
    for name, number in names.items():
        starts_word[number] = name.startswith(BLANK) or name == LINE
    cut = regex.compile(PIECE_START).split
    known: dict[str, bytes] = worker_memory(f"pieces of {path}")  # of other texts, as they are
    words: dict[str, bytes] = worker_memory(f"words of {path}")  # with a line break before, or without one after a blank
    line_break = encoded(["\n"])[0]

    def learn(new: list[str]) -> None:
        parts = [new[at:at + WORDS_IN_A_ROW] for at in range(0, len(new), WORDS_IN_A_ROW)]
        rows = ["".join(w if w.startswith("\n") else " " + w for w in p) for p in parts]
        for part, found in zip(parts, tokenizer.encode_batch_fast(rows, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, kind)
            held, starts = ids.tobytes(), (np.flatnonzero(starts_word[ids]) * kind.itemsize).tolist()
            words.update((w, held[a:b]) for w, a, b in zip(part, starts, [*starts[1:], len(held)], strict=True))

    def by_words(texts: pa.Array) -> list[bytes]:
        """Of plain texts: every different word is looked up once, and the ids of all places are taken by number."""
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n"), texts, ""), "\n", " \n"), " ")
        # A blank was put before the first line break too: each text begins with an empty word, which goes.
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        words[""] = b""
        found = list(map(words.get, distinct))
        if None in found:
            learn([w for w, ids in zip(distinct, found, strict=True) if ids is None])
            found = list(map(words.get, distinct))
        size = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
        begin, flat = np.cumsum(size) - size, np.frombuffer(b"".join(found), kind)
        at = coded.indices.to_numpy()
        length = size[at]
        stop = np.cumsum(length)
        ids = flat[np.repeat(begin[at] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
        edges = np.append(0, stop)[offsets] * kind.itemsize
        held = ids.tobytes()
        return [held[a + len(line_break):b] + end for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def by_pieces(texts: list[str]) -> list[bytes]:
        pieces = [cut(t) if t else [] for t in texts]
        odd = list({p for some in pieces for p in some}.difference(known))
        known.update(zip(odd, encoded(odd), strict=True))
        return [b"".join(map(known.__getitem__, some)) + end for some in pieces]

    def encode(texts: pa.Array) -> list[bytes]:
        whole = decoded(texts)
        if len(known) + len(words) > KEPT_PIECES:
            known.clear()
            words.clear()
        odd = pc.or_(pc.equal(whole, ""), pc.match_substring_regex(whole, NOT_PLAIN)).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for rows, found in ((np.flatnonzero(~odd), by_words), (np.flatnonzero(odd), lambda some: by_pieces(some.to_pylist()))):
            if len(rows):
                for row, ids in zip(rows.tolist(), found(whole.take(pa.array(rows))), strict=True):
                    out[row] = ids
        return out

    return encode, kind


def schema(kind: np.dtype, sequence: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class Writer:
    """Writes one shard; ``add`` takes a document's ids as bytes."""

    def __init__(self, folder: fs.FileSystem, path: str, kind: np.dtype, sequence: int):
        self.kind, self.sequence, self.total, self.rest, self.size = kind, sequence, 0, [], 0
        self.schema, self.index = schema(kind, sequence), []
        self.sink = folder.open_output_stream(path)
        self.side = folder.open_output_stream(f"{path}.index")
        self.file = pa.ipc.new_file(self.sink, self.schema)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index.append((doc_id, self.total, len(ids) // self.kind.itemsize))
        self.total += self.index[-1][2]
        self.rest.append(ids)
        self.size += len(ids)
        if self.size >= self.sequence * ROWS_A_BATCH * self.kind.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        held = np.frombuffer(b"".join(self.rest), self.kind)
        full = len(held) // self.sequence * self.sequence
        mask = np.ones(full, bool)
        rest = held[full:]
        if last and len(rest):
            mask = np.r_[mask, np.arange(self.sequence) < len(rest)]
            held, rest = np.r_[held, np.zeros(self.sequence - len(rest), self.kind)], rest[:0]
            full = len(held)
        for at in range(0, full, self.sequence * ROWS_A_BATCH):
            to = min(full, at + self.sequence * ROWS_A_BATCH)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[at:to]), self.sequence) for x in (held, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.rest, self.size = [rest.tobytes()], rest.nbytes

    def close(self) -> None:
        self._flush(True)
        self.file.close()
        self.sink.close()
        columns = list(zip(*self.index, strict=True)) or [(), (), ()]
        index = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens"])
        with pa.ipc.new_file(self.side, index.schema) as out:
            out.write_batch(index)
        self.side.close()


class Shard:
    """Reads one shard: ``sequence(n)`` and ``document(start, size)`` give ids."""

    def __init__(self, folder: fs.FileSystem, path: str):
        local = isinstance(folder, fs.LocalFileSystem)
        source = [pa.memory_map(p) if local else folder.open_input_file(p) for p in (path, f"{path}.index")]
        self.file, index = (pa.ipc.open_file(s) for s in source)
        self.length = self.file.schema.field("ids").type.list_size
        self.index = index.read_all()
        self.starts, self.batches = [], []
        at = 0
        for n in range(self.file.num_record_batches):
            batch = self.file.get_batch(n)
            self.starts.append(at)
            self.batches.append(batch)
            at += batch.num_rows * self.length

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        which = int(np.searchsorted(self.starts, n * self.length, "right")) - 1
        row = n - self.starts[which] // self.length
        batch = self.batches[which]
        return batch.column("ids")[row].values.to_numpy(), batch.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def document(self, start: int, size: int) -> np.ndarray:
        which = int(np.searchsorted(self.starts, start, "right")) - 1
        out = []
        while size > 0:
            held = self.batches[which].column("ids").flatten().to_numpy()[start - self.starts[which]:][:size]
            out.append(held)
            start, size, which = start + len(held), size - len(held), which + 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, sequence: int = SEQUENCE, shards: int | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) in ascending order of id below ``folder``; gives (shard, file, n_docs, n_tokens, before).

    ``before`` counts the ids of all shards before. A null text is empty: its end id alone. Null ids come first; rows of equal
    ids follow one another in the order of a hash of their texts. An empty table has no shards.
    """
    hashed = F.xxhash64("text")
    # Equal rows may go to several ranges: which is which does not matter.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("copy"))
    placed = rows.repartitionByRange(shards or partitions(docs.sparkSession), "doc_id", hashed, "copy").sortWithinPartitions("doc_id", hashed).drop("copy")
    out = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, n_docs = None, 0
        encode, kind = encoder(tokenizer, end_id)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            if writer is None and batch.num_rows:
                place, base = fs.FileSystem.from_uri(folder)
                place.create_dir(base, recursive=True)
                writer = Writer(place, f"{base}/{name}", kind, sequence)
            texts = batch.column(1)
            # Rows up to BYTES_AT_ONCE, or a longer one by itself.
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()) // BYTES_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for doc_id, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encode(texts.slice(a, b - a)), strict=True):
                    writer.add(doc_id, ids)
            n_docs += batch.num_rows
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (shard, name, n_docs, writer.total)], schema=out)

    shard_rows = stored(placed.mapInArrow(write, "shard long, file string, n_docs long, n_tokens long"), "shards")
    # One row a shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shard_rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_tokens(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(place, f"{base}/{name}")
                start, size = (shard.index.column(c).to_numpy() for c in ("start", "n_tokens"))
                digests = [zlib.crc32(shard.document(a, n).astype("<u4")) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([shard.index.column("doc_id").combine_chunks(), pa.array(start + before), pa.array(size), pa.array(digests, pa.int64())], schema=out)

    rows = shards.select("file", "before")
    return rows.repartition(partitions(shards.sparkSession)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str, **options: int) -> DataFrame:
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, folder, **options), folder)
