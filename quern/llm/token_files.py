"""Token ids as Parquet list columns: range-sorted files, chosen encodings, row groups and page indexes.

Texts are dealt by ranges of doc_id and sorted, so file after file holds ascending
doc_ids and a reader of a range of them opens few files, row groups and pages. The
token column is dictionary-encoded (a vocabulary fits in a dictionary page); doc_id
and n_tokens are delta-encoded, so metadata reads touch no token.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import materialize, pieces, text_buffer
from quern.llm.shingles import _LOWER, hash_words, word_spans

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: Stretches that a worker remembers with their ids; hashing goes through this many bytes of text at once.
KNOWN, HASH_BYTES = 800_000, 128 << 10
#: Text whose stretches are looked up together: bytes and rows.
PIECE, PIECE_ROWS = 4 << 20, 16_384

#: The hash by which stretches are looked up.
SEED = (0x452821E638D01377,)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[39] = False  # an apostrophe may belong to what follows
_MARK &= ~_LETTER
_SAME = np.arange(256, dtype=np.uint8)


class WordEncoder:
    """Encodes texts, each distinct stretch once if the tokenizer drops white space and never joins what it parts.

    Texts are cut at ASCII white space and, if the tokenizer parts there and lower-cases, between
    ASCII letters or digits and other ASCII marks. Equal stretches have equal ids, so only
    those that the worker doesn't remember are encoded. A stretch is looked up by a 64-bit hash, and its bytes are
    compared with those remembered; should they differ, the texts at hand are encoded whole. Runs of letters are encoded many in one text, where a
    token with the end-of-word suffix closes each. A text that holds a special token's
    string is encoded as it is, and so is every text if probes show that the tokenizer keeps white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.special = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = ["ABC Abcdef, x2%(y)", "abc abcdef , x2 % ( y )", "abc abcdef , x2 %( y )"]
        plain = [tuple(e.ids) for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]
        self.parts = bool(suffix) and plain[0] == plain[2]
        spaced = ["two  words and   spaces", " lead", "trail \n", "tab\tnew\nline\r\n x\x0by\x0cz"]
        apart = self.tokenizer.encode_batch([" ".join(t.split()) for t in spaced] + [w for t in spaced for w in t.split()], add_special_tokens=False)
        whole = [e.ids for e in self.tokenizer.encode_batch(spaced, add_special_tokens=False)]
        self.drops = whole == [e.ids for e in apart[: len(spaced)]] and sum(whole, []) == sum((e.ids for e in apart[len(spaced) :]), [])
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.from_, self.bytes, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _plain(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[np.ndarray]:
        """The ids of runs of letters, a pre-token each."""
        out: list[np.ndarray] = []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            out += np.split(ids, ends[:-1]) if len(ends) == len(some) else self._plain(some)
        return out

    def _same(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, entry: np.ndarray) -> bool:
        """Whether all stretches of low have the bytes of their entries."""
        size = end - start
        if (self.bytes[entry] != size).any():
            return False
        upto = np.cumsum(size)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + HASH_BYTES, side="right")))
            n = size[at:to]
            along = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if (low[np.repeat(start[at:to], n) + along] != self.known[np.repeat(self.from_[entry[at:to]], n) + along]).any():
                return False
            at = to
        return True

    def _learn(self, hashes: np.ndarray, words: list[str], raw: list[bytes], shrink: bool) -> None:
        """Enter new stretches, which come in order of their hashes; raw are their bytes as compared."""
        letters = np.array([self.parts and w.isalpha() and (w.isascii() or is_normalized("NFC", w)) for w in words], bool)
        found = np.empty(len(words), object)
        for pick, encode in ((letters, self._letters), (~letters, self._plain)):
            at = np.flatnonzero(pick)
            if len(at):
                found[at] = _objects(encode([words[i] for i in at]))
        size = np.array([len(x) for x in found], np.int64)
        if shrink and len(self.hashes) > KNOWN:  # keep what came first, which is most frequent
            keep = self.at < len(self.ids) // 2
            self.hashes, self.at, self.size = self.hashes[keep], self.at[keep], self.size[keep]
            self.ids = self.ids[: int((self.at + self.size).max(initial=0))].copy()
            self.from_, self.bytes = self.from_[keep], self.bytes[keep]
            self.known = self.known[: int((self.from_ + self.bytes).max(initial=0))].copy()
        to = np.searchsorted(self.hashes, hashes)
        self.at = np.insert(self.at, to, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, to, size)
        self.hashes = np.insert(self.hashes, to, hashes)
        count = np.array([len(x) for x in raw], np.int64)
        self.from_ = np.insert(self.from_, to, len(self.known) + np.cumsum(count) - count)
        self.bytes = np.insert(self.bytes, to, count)
        self.known = np.concatenate([self.known, np.frombuffer(b"".join(raw), np.uint8)])
        self.ids = np.concatenate([self.ids, *found])

    def _ids(self, data: np.ndarray, offs: np.ndarray, shrink: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of all texts, and how many each has; nothing if two stretches share a hash."""
        parts, base = [], 0
        at = 0
        while at < len(offs) - 1:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + HASH_BYTES, side="right")) - 1)
            some, own = data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            cut = None
            if self.parts and len(some):
                letter, mark = _LETTER[some], _MARK[some]
                cut = np.zeros(len(some), bool)
                cut[1:] = letter[1:] & mark[:-1] | mark[1:] & letter[:-1]
            low, start, end, first = word_spans(some, own, cut, _LOWER if self.parts else _SAME)
            h = hash_words(low, start, end, SEED)[0]
            parts.append((h, start + offs[at], end + offs[at], first[:-1] + base, low))
            base += len(h)
            at = to
        hashes, start, end, first, low = (np.concatenate(x) for x in zip(*parts, strict=True))
        unique, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        to = np.searchsorted(self.hashes, unique)
        new = np.ones(len(unique), bool)
        inside = to < len(self.hashes)
        new[inside] = self.hashes[to[inside]] != unique[inside]
        if new.any():
            text = data.tobytes()
            missing = where[new]
            before = len(self.hashes)
            words = [text[a:b].decode() for a, b in zip(start[missing].tolist(), end[missing].tolist(), strict=True)]
            folded = low.tobytes()
            raw = [folded[a:b] for a, b in zip(start[missing].tolist(), end[missing].tolist(), strict=True)]
            self._learn(unique[new], words, raw, shrink)
            if len(self.hashes) != before + len(words):  # stretches of this text may have been forgotten
                return self._ids(data, offs, shrink=False)
            to = np.searchsorted(self.hashes, unique)
        if not self._same(low, start, end, to[which]):
            return None
        size = self.size[to][which]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.at[to][which] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.append(first, len(hashes))])

    def encode(self, data: np.ndarray, offs: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts that lie at offs in data, end behind each, and how many each has."""
        text = data.tobytes()
        known = None if not self.drops or any(s in text for s in self.special) else self._ids(data, offs)
        if known is None:
            whole = [np.append(self._plain([text[a:b].decode()])[0], [] if end is None else end).astype(np.uint32) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *whole]), np.array([len(x) for x in whole], np.int64)
        ids, n = known
        if end is None:
            return ids, n
        n = n + 1
        out = np.full(len(ids) + len(n), end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(n) - 1] = False
        out[inner] = ids
        return out, n


def _objects(arrays: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(arrays), object)
    for i, x in enumerate(arrays):
        out[i] = x
    return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One for each Python worker, whose tasks share what it remembers."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write (doc_id, n_tokens, tokens) for each row of docs (doc_id, text) to new files under path.

    A null or empty text has the end id alone, or nothing. A null doc_id comes first;
    rows with the same doc_id stand by a digest of their text. Long texts are encoded whole. No rows, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for part in pieces(batches, most=PIECE, rows=PIECE_ROWS):
            ids, n = encoder.encode(*text_buffer(part.column("text")), end_id)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int32)), lists], names=["doc_id", "n_tokens", "tokens"])

    # the text's digest parts rows of one doc_id, or of none, between files
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("digest", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text").drop("digest")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.enable.dictionary#tokens.list.element": "true",
    }
    rows.mapInArrow(run, "doc_id long, n_tokens int, tokens array<int>").write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens) of the files under path, of doc_ids from first to last if given: files, row groups and pages outside are passed over."""
    df = spark.read.schema("doc_id long, n_tokens int, tokens array<int>").parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    return df if last is None else df.where(F.col("doc_id") <= last)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) for each document in the files under path, from the files: start counts the ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("tokens")
            values, offs = np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False)).astype("<i4"), col.offsets.to_numpy()
            crc = np.array([zlib.crc32(values[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc), batch.column("file")], names=["doc_id", "n_tokens", "ids_crc32", "file"])

    rows = read_tokens(spark, path).select("doc_id", "tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    facts = rows.select("doc_id", "tokens", F.concat_ws("\t", "file", "row").alias("file")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, file string")
    cut = F.split("file", "\t")
    facts = materialize(facts.withColumns({"file": cut[0], "row": cut[1].cast("long")}), "index")
    files = facts.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row per file, by the number of the partition that it came from: as text, the 100,000th would stand before the second
    place = F.regexp_extract("file", r"^part-(\d+)", 1).try_cast("long")
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy(place, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return facts.withColumn("here", F.coalesce(here, F.lit(0))).join(files, "file").select("doc_id", (F.col("before") + F.col("here")).alias("start"), "n_tokens", "ids_crc32", "file")
