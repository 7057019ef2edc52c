"""Problem 7: encode every document with a public byte-level tokenizer, in constant memory a document.

The encoder is a bounded-lookahead transducer: it takes a text in pieces of ``PIECE`` characters and emits tokens as soon as they are final. The
pattern that divides a text into stretches looks at most three characters ahead, so all stretches but the last are final, and their tokens are. Within
a stretch a merge can be undone by what follows only through a chain of merges of ever higher priority, each starting inside the right part of the
one before; the longest such chain in bytes is the merge list's sufficient lookahead. In a stretch that goes on for longer, a token that ends
further than that from the end of what has been read is final too, and encoding goes on from there. So what waits never exceeds a piece and a few
lookaheads. Decoding is an incremental machine from bytes to text.
"""

from __future__ import annotations

import codecs
import functools
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm import vocabularies as V
from foliant.session import spread

#: Characters taken at a time, and stretches remembered with their tokens.
PIECE, KEEP = 4_096, 400_000


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes after a token's end that can still change it, for an ordered merge list.

    reach(u+v) = |u+v| + the most that an earlier (higher-priority) merge adds when its result starts with some suffix of v.
    """
    by_prefix: dict[str, int] = {}
    longest = 1
    for u, v in merges:
        token = u + v
        extra = max((by_prefix.get(v[k:], 0) for k in range(len(v))), default=0)
        reach = len(token) + max(0, extra)
        longest = max(longest, reach)
        for k in range(1, len(token)):
            if reach - k > by_prefix.get(token[:k], 0):
                by_prefix[token[:k]] = reach - k
    return longest


@functools.cache
def lookahead_of(name: str, path: str) -> int:
    return sufficient_lookahead(V.merges(name, path))


class _Known(dict):
    """Stretches with their tokens; a new one is encoded when it is first asked for."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, stretch: str) -> list[int]:
        ids = self.encoding.encode_ordinary(stretch)
        if len(stretch) < 64:
            self[stretch] = ids
        return ids


class StreamEncoder:
    """Takes a text piece by piece and gives token ids as soon as they are final.

    What ``feed`` and ``finish`` give, joined, equals the encoding of the whole text, however it was divided.
    """

    def __init__(self, name: str, path: str):
        self.encoding = V.byte_encoding(name, path)
        self.lookahead = lookahead_of(name, path)
        self.known = _Known(self.encoding)
        self.rest = ""

    def feed(self, piece: str) -> list[int]:
        stretches = V.byte_pretokens(self.rest + piece)
        if not stretches:
            return []
        self.rest = stretches.pop()
        if stretches and stretches[-1] == "'":  # may become one stretch with the letters that follow
            self.rest = stretches.pop() + self.rest
        ids = list(chain.from_iterable(map(self.known.__getitem__, stretches)))
        if len(self.rest) > 4 * self.lookahead:
            final, cut = self._stable(self.rest)
            ids += final
            self.rest = self.rest[cut:]
        if len(self.known) > KEEP:
            self.known.clear()
        return ids

    def finish(self) -> list[int]:
        ids = self.encoding.encode_ordinary(self.rest) if self.rest else []
        self.rest = ""
        return ids

    def _stable(self, stretch: str) -> tuple[list[int], int]:
        """Final tokens of a stretch that may go on, and how many characters they cover.

        All characters of a stretch are of one kind, and more of it than the lookahead is left, so what is left is read as the same stretch's rest.
        """
        ids = self.encoding.encode_ordinary(stretch)
        raw = stretch.encode("utf-8", "surrogatepass")
        safe = len(raw) - self.lookahead - 8
        ends = np.cumsum([len(self.encoding.decode_single_token_bytes(i)) for i in ids])
        starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        for k in range(int(np.searchsorted(ends, safe, side="right")) - 1, 0, -1):
            if starts[end := int(ends[k])]:
                return ids[: k + 1], int(starts[:end].sum())
        return [], 0


@functools.cache
def stream_of(name: str, path: str) -> StreamEncoder:
    return StreamEncoder(name, path)


def encode(text: str | None, name: str, path: str, piece: int = PIECE) -> list[int]:
    """All ids of one text; null and empty texts have none."""
    if not text:
        return []
    stream, ids = stream_of(name, path), []
    for k in range(0, len(text), piece):
        ids += stream.feed(text[k : k + piece])
    return ids + stream.finish()


class StreamDecoder:
    """Ids back to text, piece by piece; bytes of a character that isn't complete yet wait in the machine's state."""

    def __init__(self, name: str, path: str):
        self.encoding = V.byte_encoding(name, path)
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="strict")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(self.encoding.decode_bytes(list(ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def encode_documents(documents: DataFrame, tokenizer: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row a document: ``key`` and ``ids`` (ARRAY<INT>), without special tokens.

    Null and empty texts give an empty list; a special token's string is ordinary text; repeated rows give repeated rows; other columns
    are dropped, so their names can't clash. No shuffle: the work follows the scan's partitions.
    """
    where = V.folder(path)
    df = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 256):
                lists = [np.asarray(encode(t, tokenizer, where), dtype=np.int32) for t in texts[k : k + 256]]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return spread(df, "doc_id").mapInArrow(run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", key)


def round_trip(documents: DataFrame, tokenizer: str = "byte_bpe_50k", key: str = "doc_id", text: str = "text", path: str | None = None, step: int = 512) -> DataFrame:
    """One row a document: tokens, characters and whether decoding the ids ``step`` at a time gives the text back."""
    where = V.folder(path)
    df = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for key_, value in zip(batch["doc_id"], batch["text"]):
                ids, decoder = encode(value, tokenizer, where), StreamDecoder(tokenizer, where)
                back = "".join(decoder.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + decoder.finish()
                rows.append((key_, len(ids), len(value or ""), back == (value or "")))
            yield pd.DataFrame(rows, columns=["doc_id", "tokens", "chars", "same"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return spread(df, "doc_id").mapInPandas(run, f"doc_id {kind}, tokens bigint, chars bigint, same boolean").withColumnRenamed("doc_id", key)
