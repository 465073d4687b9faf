"""Byte-level BPE: encoding and decoding with the ranks of a public vocabulary."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_ENTRIES = 300_000
CACHED_CHARS = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The lines `base64 rank` of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes text as the rank-ordered merges would, in time linear in the length of a piece.

    Bytes are mapped to Latin-1 so that one Aho-Corasick pass finds the longest token at every position.  From there
    the encoder goes from longest match to longest match and backtracks to shorter ones where two neighbours could not
    stand side by side after exact merging; a position proved dead is never tried again.  Whether two tokens fit is
    found by undoing their merges across the seam, and is remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split_text = ranks, regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.machine = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.machine.add_word(token.decode("latin-1"), (len(token), rank))
        self.machine.make_automaton()
        self.bytes_of = {str(rank): token for token, rank in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._shorter: dict[int, int | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; itself twice for a single byte; None if merges never make it."""
        if rank not in self._halves:
            parts = [self.token[rank][i : i + 1] for i in range(len(self.token[rank]))]
            while len(parts) > 2:
                merges = [(self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                best, i = min(merges)
                if best >= rank:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = (rank, rank) if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]])
            self._halves[rank] = found if len(parts) <= 2 else None
        return self._halves[rank]

    def shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if rank not in self._shorter:
            token = self.token[rank]
            self._shorter[rank] = next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
        return self._shorter[rank]

    def fits(self, left: int, right: int) -> bool:
        """Whether exact merging can leave these two tokens side by side."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= CACHE_ENTRIES:
                self._fits.clear()
            known = self._fits[left, right] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        if self.halves(left) is None or self.halves(right) is None:
            return False
        bound = len(self.ranks) * 2
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < bound:
                return False
            # Undo the later of the two merges; a merge across the seam would have had to come before it.
            inner_left, inner_right = self.halves(left)[1], self.halves(right)[0]
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    return True
                bound, left = left, inner_left
            else:
                bound, right = right + 1, inner_right

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        longest = [0] * len(piece)
        for end, (n, rank) in self.machine.iter(piece.decode("latin-1")):
            longest[end - n + 1] = rank
        dead, out, at = bytearray(len(piece) + 1), [], 0
        trial: int | None = longest[0]
        while at < len(piece):
            while trial is not None and (dead[at + len(self.token[trial])] or (out and not self.fits(out[-1], trial))):
                trial = self.shorter(trial)
            if trial is None:
                dead[at] = 1
                trial = out.pop()
                at -= len(self.token[trial])
            else:
                out.append(trial)
                at += len(self.token[trial])
                trial = longest[at] if at < len(piece) else None
        return out

    def encode(self, text: str) -> str:
        """The ids of a text in decimal, with one space between two."""
        return " ".join(map(self.memo.__getitem__, self.split_text(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(" "))) if ids else b""


class _Memo(dict):
    """Ids of pieces met before; bounded in entries and in their length."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> str:
        ids = " ".join(map(str, self.codec.encode_piece(piece.encode())))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


_codecs: dict[str, Codec] = {}


def bpe_tokens(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (decimals joined by a space), decoded (bytes), and the SHA-256 of both in lower-case hex.

    Null counts as empty: no tokens, and hashes of nothing.  Every piece that `pattern` finds is encoded by itself, with
    no special tokens.  The rank file is read once by the driver and broadcast; its size does not depend on the input.
    Rows are independent, so nothing is shuffled and a lost task is simply run again.  Rows that repeat an id are encoded each,
    an empty table gives an empty one; other columns are not read.
    """
    with open(vocabulary, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())
    fields = [pa.field(id_col, pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    fields += [pa.field("ids", pa.string()), pa.field("decoded", pa.binary())] if with_ids else []
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(ranks.value + pattern.encode()).hexdigest()
        if key not in _codecs:
            lines = map(bytes.split, ranks.value.splitlines())
            _codecs[key] = Codec({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)
        codec = _codecs[key]
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = []
                for text in batch.column("c_text"):
                    ids = codec.encode(text.as_py() or "")
                    decoded = codec.decode(ids)
                    n = ids.count(" ") + 1 if ids else 0
                    hashes = hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()
                    rows.append((n, *hashes, ids, decoded) if with_ids else (n, *hashes))
                arrays = [batch.column("c_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows), fields[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return docs.select(F.col(id_col).cast("long").alias("c_id"), F.col(text_col).cast("string").alias("c_text")).mapInArrow(run, schema)
