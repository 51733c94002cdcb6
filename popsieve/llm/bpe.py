"""Op 7. Byte-level BPE, encoded by longest matches with backtracking and decoded again.

Bytes are read as Latin-1 so that pyahocorasick's trie finds the longest token that starts at a byte. The encoder takes the longest token that is compatible with the one before it, and
steps to a shorter one, or back over the last token, where none is. Two tokens are compatible if no
merge crosses their border; the merges give the one sequence all of whose
neighbours are compatible, so the result is exact. Compatibility is memoised (see merges.py); a dead
position is visited once, so the time is linear in the piece.

Null text counts as empty: no ids. Any text, however long or without spaces, is encoded whole.
Rows are mapped one by one: no shuffle; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import Chunker
from .common import documents, id_and_text, map_texts, strings
from .merges import Merges

RANKS = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder for a table of ranks (bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.merges = Merges(self.ranks)
        self.shorter: dict[str, str] = {}
        self.reach = max(map(len, self.ranks))
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for token in self.ranks:
            self.trie.add_word(token)

    def next_shorter(self, token: str) -> str:
        """The longest token that is a proper prefix of this text, or the empty text."""
        known = self.shorter.get(token)
        if known is None:
            known = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), "")
            if len(self.shorter) < 200_000:
                self.shorter[token] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        length, ranks, reach = len(text), self.ranks, self.reach
        pairs, compatible, shorter, longest_prefix = self.merges.pairs.get, self.merges.compatible, self.next_shorter, self.trie.longest_prefix
        dead: set[int] = set()
        out: list[str] = []
        at, last, token = 0, "", None
        while at < length:
            if token is None:  # the longest token that starts here
                ahead = text[at : at + reach]
                token = ahead[: longest_prefix(ahead)]
                if token not in ranks:
                    token = shorter(token)
            while token:
                end = at + len(token)
                if end not in dead and (not last or pairs((last, token)) or compatible(last, token)):
                    break
                token = shorter(token)
            if token:
                out.append(token)
                at, last, token = end, token, None
            else:  # nothing fits after the last token: step back over it
                dead.add(at)
                at -= len(last)
                token = shorter(out.pop())
                last = out[-1] if out else ""
        return [ranks[token] for token in out]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextCodec:
    """Texts to ids as decimal words, the form that op 7 digests; `bpe` has the ids themselves."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(read_ranks(path))
        self.bytes_of = {str(rank): token for rank, token in self.bpe.bytes_of.items()}
        self.chunker = Chunker(lambda piece: " ".join(map(str, self.bpe.encode_piece(piece.encode()))), " ")

    def words(self, text: str) -> str:
        return self.chunker(text)

    def encode(self, text: str) -> list[int]:
        return [int(word) for word in self.words(text).split()]

    def decode_words(self, words: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, words.split()))


_CODECS: dict[str, TextCodec] = {}


def codec(path: str) -> TextCodec:
    """One codec a Python worker; it holds the vocabulary and bounded memos."""
    if path not in _CODECS:
        _CODECS[path] = TextCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    path = path or public_tokenizers.path(RANKS)

    def make():
        one = codec(path)

        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([one.encode(t) for t in strings(batch)], pa.list_(pa.int32()))], ["doc_id", "ids"])

        return step

    return map_texts(id_and_text(docs, id_col, text_col), make, "doc_id long, ids array<int>")


def decode(ids: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of every list of ids; bytes that are no UTF-8 become U+FFFD."""
    path = path or public_tokenizers.path(RANKS)

    def make():
        bpe = codec(path).bpe

        def step(batch):
            texts = [bpe.decode(x or ()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return map_texts(ids.selectExpr(f"`{id_col}` as doc_id", f"`{ids_col}` as ids"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or public_tokenizers.path(RANKS)

    def make():
        one = codec(path)

        def step(batch):
            counts, ids, decoded = [], [], []
            for text in strings(batch):
                words = one.words(text)
                counts.append(words.count(" ") + 1 if words else 0)
                ids.append(hashlib.sha256(words.encode()).hexdigest())
                decoded.append(hashlib.sha256(one.decode_words(words)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return map_texts(id_and_text(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark, sf_dir):
    return round_trip(documents(spark, sf_dir))
