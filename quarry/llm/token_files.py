"""Token ids in length-delimited binary record files, with an offset index.

Every text is encoded, an end id is appended, and the ids of each document are
one record. A record file is a run of frames

    length of payload      8 bytes, little endian
    masked CRC of these 8  4 bytes
    payload                8 bytes document id, then the ids, little endian
    masked CRC of payload  4 bytes

The mask rotates the CRC-32 by 15 bits and adds a constant, so that a CRC over
data that holds CRCs stays useful. Ids take two bytes when the vocabulary fits,
else four. Files follow each other in ascending document id, as do the records
in a file; the number of ids before a file is in the manifest.

The offset index, a Parquet table beside the files, has file, byte offset,
length and token start of each record: :func:`read_records` reads any of them
in any order. Files are written in the task that encodes, under a name of its
own for each attempt; the index names the files of the attempts that counted,
others are leftovers that no reader opens.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of_bytes, file_system, shared_path, small_batches, staged

MASK_DELTA = 0xA282EAD8
#: Bytes of a generation of remembered words, and what an entry takes beside its word and ids.
REMEMBERED, ENTRY = 112 << 20, 180
END_ID = 2
NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<QI")
_STATE: dict[str, tuple] = {}


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked_crc(n)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(stream) -> bytes | None:
    """Next payload of a stream, None at its end; a damaged frame raises ``ValueError``."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12:
        raise ValueError("record file ends inside a frame")
    n, crc = _HEAD.unpack(head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("bad length checksum")
    body = stream.read(n + 4)
    if len(body) < n + 4:
        raise ValueError("record file ends inside a frame")
    if masked_crc(body[:n]) != int.from_bytes(body[n:], "little"):
        raise ValueError("bad payload checksum")
    return body[:n]


class Encoder:
    """Ids of whole texts by a tokenizer whose pieces never cross ASCII white space.

    Such a tokenizer encodes a text like its white-space separated words one
    by one, so a worker encodes a word once and remembers it. A-Z are lowered
    first (the tokenizer lowers its input), and one final comma or stop behind
    a letter is encoded by itself, as the tokenizer splits it off; both only
    make equal words meet.

    Memory holds two generations of ``REMEMBERED`` bytes: when the young one is
    full it becomes the old one, and old words that are met again move to the
    new young one, so words in use stay whatever the vocabulary's size.
    """

    def __init__(self, path: str, by_word: bool, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.wide = size > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.by_word = by_word
        self.end = np.array([end_id], self.kind).tobytes()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.final = {c: self._whole([c.decode()])[0] for c in (b",", b".")} if by_word else {}
        #: ids that end a piece, where the vocabulary marks them
        self.closing = np.zeros(size, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.closing[i] = token.endswith(suffix)
        self.marked = bool(self.closing.any())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: dict[bytes, int]) -> dict[bytes, bytes]:
        """Ids of words whose number of pieces is known: many words a call, the
        ids cut behind each word's last piece."""
        out: dict[bytes, bytes] = {}
        order = list(words)
        groups = [order[i:i + 256] for i in range(0, len(order), 256)]
        found = self._whole([b" ".join(g).decode("utf-8") for g in groups])
        for g, ids in zip(groups, found, strict=True):
            cut = (np.flatnonzero(self.closing[np.frombuffer(ids, self.kind)]) + 1) * self.kind.itemsize
            last = np.cumsum([words[w] for w in g]) - 1
            if len(cut) == last[-1] + 1 and cut[-1] == len(ids):
                cut = cut[last].tolist()
                out.update(zip(g, [ids[x:y] for x, y in zip([0, *cut[:-1]], cut, strict=True)], strict=True))
            else:  # the tokenizer's letters aren't Python's
                out.update(zip(g, self._whole([w.decode("utf-8") for w in g]), strict=True))
        return out

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of unknown words. A word that ends in one comma or stop right
        behind a letter is encoded in two pieces."""
        counted: dict[bytes, int] = {}
        rest, split = set(), []
        young, old, final, marked = self.young, self.old, self.final, self.marked
        for w in words:
            base = w
            if w[-1:] in final and len(w) > 1:
                base = w[:-1]
                # the tokenizer looks at the normalised word: its last sign decides whether the stop stands alone
                if base[-1:].isalpha() or not base[-1:].isascii() and _plain(base)[-1].isalpha():
                    split.append(w)
                    if base in young or base in old:
                        continue
                else:
                    base = w
            if marked and (n := _pieces(base)):
                counted[base] = n
            else:
                rest.add(base)
        new = self._lines(counted)
        rest = list(rest)
        new.update(zip(rest, self._whole([b.decode("utf-8") for b in rest]), strict=True))
        for w in split:
            base = w[:-1]
            new[w] = next(m[base] for m in (new, young, old) if base in m) + final[w[-1:]]
        return new

    def _remember(self, words: list[bytes]) -> None:
        """Bring all of the different ``words`` into the young generation."""
        if self.held > REMEMBERED:
            self.young, self.old, self.held = {}, self.young, 0
        young, old = self.young, self.old
        missing = [w for w in words if w not in young]
        known = {w: old[w] for w in missing if w in old}
        fresh = self._learn([w for w in missing if w not in known]) if len(known) < len(missing) else {}
        for more in (known, fresh):
            young.update(more)
            self.held += sum(map(len, more)) + sum(map(len, more.values())) + ENTRY * len(more)

    def encode(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """Little-endian ids of each text, the end id last.

        The words of all texts are numbered first, so that each is looked up
        once; the texts' ids are then gathered by those numbers."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary()).cast(pa.string())
        if not self.by_word:
            return [i + self.end for i in self._whole(texts.to_pylist())]
        low = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(low)
        coded = lists.flatten().dictionary_encode()
        # one buffer, cut again: much faster than a Python object a word by pyarrow; words hold no blank
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")
        words = line[0].as_buffer().to_pybytes().split(b" ") if len(coded.dictionary) else []
        self._remember(words)
        ids = list(map(self.young.__getitem__, words))
        table = np.frombuffer(b"".join(ids), self.kind)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        code = coded.indices.to_numpy()
        times = n[code]
        ends = np.cumsum(times)
        at = np.repeat((np.cumsum(n) - n)[code] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
        flat = table[at].tobytes()
        first = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
        cut = (np.r_[0, ends][first] * self.kind.itemsize).tolist()
        out = [flat[x:y] + self.end for x, y in zip(cut[:-1], cut[1:], strict=True)]
        # a text that spells a special token is left to the tokenizer as it is
        for special in self.special:
            for i in np.flatnonzero(pc.match_substring(low, special).to_numpy(zero_copy_only=False)):
                out[i] = self._whole([texts[int(i)].as_py()])[0] + self.end
        return out


def _plain(word: bytes) -> str:
    """A word as the tokenizer sees it: composed, in lower case."""
    return unicodedata.normalize("NFC", word.decode("utf-8")).lower()


#: How the default tokenizer cuts printable ASCII without apostrophes: runs of letters, single digits, runs of others.
_PIECE = re.compile(rb"[A-Za-z]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def _pieces(word: bytes) -> int:
    """Number of pieces of a word where that is plain, else 0: words of letters, and printable ASCII without apostrophes."""
    if word.isalpha():
        return 1
    if not word.isascii():
        return int(_plain(word).isalpha())
    found = _PIECE.findall(word)
    return len(found) if sum(map(len, found)) == len(word) else 0


def _encoder(path: str, by_word: bool, end_id: int) -> Encoder:
    key = f"{path}|{by_word}|{end_id}"
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = (Encoder(path, by_word, end_id),)
    return _STATE[key][0]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, by_word: bool = True,
                 end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encode ``docs`` into record files below ``path`` (by default a new
    folder in the shared checkpoint folder). Returns ``(index, manifest)``:
    ``index(file, doc_id, offset, length, n_tokens, start)`` and
    ``manifest(file, first_row, docs, tokens, start, wide)``.

    Null and empty texts are one end id. Null ids come first, in records whose
    id is the smallest long; repeated rows have a record each. Texts of any
    length are encoded whole. An empty table gives no file."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    tokenizer = tokenizer or default_tokenizer()
    fs, inner = file_system(path)
    fs.create_dir(inner, recursive=True)
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    # the text's hash spreads rows of one id (null ids, repeated rows) and fixes their order
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for whole in batches:
            for b in batches_of_bytes(whole, "text"):
                if enc is None:
                    enc = _encoder(tokenizer, by_word, end_id)
                    fs, inner = file_system(path)
                    name = f"tokens-{uuid.uuid4().hex}.rec"
                    out, at, start = fs.open_output_stream(f"{inner}/{name}"), 0, 0
                ids = b.column("id").to_pylist()
                texts = b.column("text").fill_null("")
                offs, lens, counts, starts = [], [], [], []
                for i, tokens in zip(ids, enc.encode(texts), strict=True):
                    f = frame(struct.pack("<q", i) + tokens)
                    out.write(f)
                    n = len(tokens) // enc.kind.itemsize
                    offs.append(at)
                    lens.append(len(f))
                    counts.append(n)
                    starts.append(start)
                    at, start = at + len(f), start + n
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), b.column("id"), pa.array(offs, pa.int64()), pa.array(lens, pa.int64()),
                                                  pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), b.column("tie")],
                                                 names=["file", "doc_id", "offset", "length", "n_tokens", "local", "tie"])
        if enc is not None:
            out.close()

    local = ranged.mapInArrow(run, "file string, doc_id bigint, offset bigint, length bigint, n_tokens bigint, local bigint, tie bigint")
    local = staged(local, "tokens-index")
    files = local.groupBy("file").agg(F.min(F.struct("doc_id", "tie", "local")).alias("first_row"), F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    # one row per file: the window is as long as the list of files
    before = Window.orderBy("first_row", "file").rowsBetween(Window.unboundedPreceding, -1)
    manifest = files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    manifest = staged(manifest.withColumn("wide", F.lit(_encoder(tokenizer, by_word, end_id).wide)), "tokens-manifest")
    index = local.join(manifest.select("file", F.col("start").alias("_s")), "file")
    index = index.select(F.concat(F.lit(path + "/"), "file").alias("file"), "doc_id", "offset", "length", "n_tokens", (F.col("local") + F.col("_s")).alias("start"))
    return index, manifest.withColumn("file", F.concat(F.lit(path + "/"), "file"))


def _record_row(payload: bytes, wide: bool, with_ids: bool):
    doc = struct.unpack_from("<q", payload)[0]
    ids = np.frombuffer(payload, "<u4" if wide else "<u2", offset=8)
    return (None if doc == NULL_ID else doc), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), (ids.astype(np.int32) if with_ids else None)


_OUT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _out(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.list_(pa.int32()))] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(arrays)])


def scan_tokens(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """All records in file order, a file per task at a time, read as a stream
    with both checksums tested: ``(doc_id, start, n_tokens, ids_crc32[, ids])``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.to_pylist():
                fs, inner = file_system(f["file"])
                start, rows, held = f["start"], [], 0
                with fs.open_input_stream(inner, buffer_size=1 << 20) as s:
                    while (p := read_frame(s)) is not None:
                        doc, n, crc, ids = _record_row(p, f["wide"], with_ids)
                        rows.append((doc, start, n, crc, ids))
                        start, held = start + n, held + (n if with_ids else 1)
                        if held >= 1 << 16:
                            yield _out(rows, with_ids)
                            rows, held = [], 0
                if rows:
                    yield _out(rows, with_ids)

    files = manifest.select("file", "start", "wide")
    n = max(1, files.count())
    return files.repartition(n).mapInArrow(run, _OUT + (", ids array<int>" if with_ids else ""))


def read_records(index: DataFrame, wide: bool, order: str = "doc_id") -> DataFrame:
    """The records that ``index`` rows name, wherever they lie: ``(doc_id,
    start, n_tokens, ids_crc32, ids)``. Rows are read by file and offset; for a
    shuffled epoch pass the index in any order and partitioning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, name, file = [], None, None
            for r in b.to_pylist():
                if r["file"] != name:
                    name = r["file"]
                    fs, inner = file_system(name)
                    file = fs.open_input_file(inner)
                file.seek(r["offset"])
                doc, n, crc, ids = _record_row(read_frame(file), wide, True)
                rows.append((doc, r["start"], n, crc, ids))
            if rows:
                yield _out(rows, True)

    return index.select("file", "offset", "start").mapInArrow(run, _OUT + ", ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` and read the files back: ``(doc_id, start, n_tokens, ids_crc32)``."""
    _, manifest = write_tokens(docs, tokenizer=tokenizer, id_col=id_col, text_col=text_col)
    return scan_tokens(docs.sparkSession, manifest)
